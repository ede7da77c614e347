"""Lexicon sentiment as column expressions: hits per class, softmax, label, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_COLUMNS = (
    "sentiment_positive", "sentiment_negative", "sentiment_neutral", "sentiment_score",
)


@dataclass(frozen=True)
class Lexicon:
    """Words that speak for each class, and how strongly a class share moves its logit."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    neutral: tuple[str, ...] = ()
    gain: float = 4.0
    neutral_bias: float = 1.0


FINANCE = Lexicon(
    positive=(
        "beat", "beats", "gain", "gains", "growth", "high", "jump", "jumps", "profit", "profits",
        "raise", "raises", "rally", "record", "rise", "rises", "soar", "soars", "strong",
        "surge", "surges", "top", "tops", "up", "upgrade", "upgrades", "win", "wins",
    ),
    negative=(
        "cut", "cuts", "decline", "declines", "down", "downgrade", "downgrades", "drop", "drops",
        "fall", "falls", "fraud", "lawsuit", "layoffs", "loss", "losses", "low", "miss",
        "misses", "plunge", "plunges", "recall", "slump", "weak", "warn", "warns",
    ),
    neutral=("announces", "hold", "holds", "maintains", "meets", "reports", "says", "steady"),
)


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many words of ``text`` belong to ``words``, each occurrence counted."""
    if not words:
        return F.lit(0)
    return F.regexp_count(F.lower(text), F.lit(rf"(?U)\b(?:{'|'.join(words)})\b"))


def plain(lexicon: Lexicon) -> bool:
    """Whether all words are ASCII letters and digits: such a word is a hit where it is a whole word of the text."""
    words = (*lexicon.positive, *lexicon.negative, *lexicon.neutral)
    return all(w.isascii() and w.isalnum() for w in words)


def _listed(found: Column, words: tuple[str, ...]) -> Column:
    """How many of the words ``found`` belong to ``words``, each occurrence counted."""
    return F.array_size(F.filter(found, lambda w: w.isin(*words))) if words else F.lit(0)


def with_sentiment(df, text: str = "headline", lexicon: Lexicon = FINANCE):
    """Add label, the three class probabilities and score = positive - negative.

    A class's logit is its share of all lexicon hits times the gain; neutral also gets a bias,
    so a text without hits is neutral. Logits are bounded, so the softmax cannot overflow.
    """
    # Plain words are found by cutting the text into words once, others by a pattern for each class.
    whole = plain(lexicon)
    if whole:
        df = df.withColumn("_w", F.split(F.lower(F.col(text)), r"(?U)\W+"))
    source, count = (F.col("_w"), _listed) if whole else (F.col(text), hits)
    df = df.withColumns(
        {
            "_p": count(source, lexicon.positive),
            "_n": count(source, lexicon.negative),
            "_u": count(source, lexicon.neutral),
        }
    ).drop("_w")
    every = F.greatest(F.col("_p") + F.col("_n") + F.col("_u"), F.lit(1))
    df = df.withColumns(
        {
            "_ep": F.exp(lexicon.gain * F.col("_p") / every),
            "_en": F.exp(lexicon.gain * F.col("_n") / every),
            "_eu": F.exp(lexicon.gain * F.col("_u") / every + lexicon.neutral_bias),
        }
    )
    total = F.col("_ep") + F.col("_en") + F.col("_eu")
    df = df.withColumns(
        {
            "label": F.when(
                (F.col("_ep") >= F.col("_en")) & (F.col("_ep") >= F.col("_eu")), "positive"
            ).when(F.col("_en") >= F.col("_eu"), "negative").otherwise("neutral"),
            "sentiment_positive": F.col("_ep") / total,
            "sentiment_negative": F.col("_en") / total,
            "sentiment_neutral": F.col("_eu") / total,
        }
    )
    score = F.col("sentiment_positive") - F.col("sentiment_negative")
    return df.withColumn("sentiment_score", score).drop("_p", "_n", "_u", "_ep", "_en", "_eu")
