"""Prediction and text search on a user's own tables, from what a training run has stored.

A bundle (models, scaler) and a text index (slot weights, unit vectors with their metadata) are folders.
Everything requested is answered in one plan for all tickers; nothing loops over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.sentiment import FINANCE, Lexicon, with_sentiment
from marketloom.functions.text import headline_hash
from marketloom.operators import embedding as em
from marketloom.operators import models as md
from marketloom.operators import sentiment as sn
from marketloom.operators import similarity as sm
from marketloom.operators.dedupe import clean_column, long_enough
from marketloom.operators.features import apply_scaler, build_features, fit_scaler
from marketloom.operators.ordering import keep_first, top_per_key
from marketloom.operators.splits import sequences
from marketloom.settings import DEFAULTS
from marketloom.sources.tables import read_scaler, read_table, write_table
from marketloom.workspace import written

# Fixed value: the headline of a ticker without any news.
NO_NEWS = "No recent news available"


@dataclass(frozen=True)
class TextIndex:
    """Search table of embedded texts and the slot weights that embed further ones."""

    vectors: DataFrame
    weights: list[float]

    @staticmethod
    def store(texts: DataFrame, path: str, vec_id: str = "doc_id", text: str = "text") -> TextIndex:
        """Embed every text once and store the index; the other columns become metadata. A null text
        is empty."""
        slotted = em.with_slots(texts.withColumn(text, F.coalesce(F.col(text), F.lit(""))), text)
        weights = em.slot_weights(slotted)
        write_table(sm.build(em.embed(slotted, weights), vec_id=vec_id), f"{path}/vectors")
        table = texts.sparkSession.createDataFrame(list(enumerate(weights)), "slot int, weight double")
        write_table(table.coalesce(1), f"{path}/weights")
        return TextIndex.load(texts.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        """A stored index; a missing one raises. The weights are as many as a vector has slots."""
        rows = read_table(spark, f"{path}/weights").orderBy("slot").collect()
        return TextIndex(read_table(spark, f"{path}/vectors"), [r["weight"] for r in rows])

    def search(self, queries: DataFrame, k: int = DEFAULTS.top_k_similar) -> DataFrame:
        """Best ``k`` stored texts per query text (``query_id, text``), with their metadata."""
        asked = em.with_slots(queries.select("query_id", F.coalesce("text", F.lit("")).alias("text")), "text")
        return sm.search(self.vectors, em.embed(asked, self.weights), k)

    def similar_to_latest(
        self, headlines: DataFrame, order: list[Column], headline_id: str = "doc_id",
        latest: int = 5, k: int = DEFAULTS.top_k_similar,
    ) -> DataFrame:
        """The stored texts nearest to each ticker's first ``latest`` headlines in ``order``.

        ``headlines`` has ``ticker``, ``headline`` and an id. Ids are ranked first, and texts fetched
        for the few that stay. Returns ``ticker, position`` and the columns of ``search``.
        """
        first = written(
            top_per_key(headlines.drop("headline"), ["ticker"], order, latest, rank="position").select(
                F.col(headline_id).alias("query_id"), "ticker", "position"
            ),
            "latest",
        )
        texts = headlines.select(F.col(headline_id).alias("query_id"), F.col("headline").alias("text"))
        hits = self.search(texts.join(first.select("query_id"), "query_id", "left_semi"), k)
        return first.join(hits, "query_id")


@dataclass(frozen=True)
class Bundle:
    """Fitted models and, if stored, the scaler of their training rows."""

    models: md.Models
    scaler: DataFrame | None = None

    def save(self, path: str) -> None:
        """Store models and scaler under ``path``."""
        self.models.save(path)
        if self.scaler is not None:
            write_table(self.scaler, f"{path}/scaler")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        """A stored bundle. Missing models raise; a missing scaler is None, with a warning."""
        return Bundle(md.Models.load(path), read_scaler(spark, f"{path}/scaler"))

    def scaled(self, features: DataFrame) -> DataFrame:
        """Features scaled by the stored scaler, or by one of the rows at hand if none is stored."""
        if self.scaler is not None:
            return apply_scaler(features, self.scaler)
        rows = written(features, "features")
        return apply_scaler(rows, fit_scaler(rows))

    def predict(
        self, requested: DataFrame, bars: DataFrame, headlines: DataFrame,
        lexicon: Lexicon = FINANCE, latest: int = 5,
    ) -> DataFrame:
        """One row per requested ``ticker``: the card of its newest window and a summary of its news.

        ``bars`` are daily bars, ``headlines`` have ``ticker, headline, date``. A ticker without
        any headline counts the placeholder as its one; one whose headlines are all too short has none
        (0 and a sentiment of 0). A ticker with too few bars gets label 0, confidence one half, return 0.
        """
        asked = requested.select("ticker").distinct()
        news = written(with_sentiment(recent_news(asked, headlines), lexicon=lexicon), "news")
        own = bars.join(asked, "ticker", "left_semi")
        rows = self.scaled(build_features(own, sn.daily(news)))
        card = md.latest_card(asked, md.predict(self.models, md.samples(sequences(rows))))
        summary = sn.request_summary(
            news, [F.col("date").desc_nulls_last()], ["headline"], latest
        )
        return card.join(summary, "ticker", "left").fillna(0, ["current_sentiment", "news_count"])


def with_placeholder(requested: DataFrame, headlines: DataFrame) -> DataFrame:
    """Headlines of the requested tickers, and one undated placeholder for each that has none."""
    rows = headlines.select("ticker", "headline", "date").join(requested, "ticker", "left_semi")
    without = requested.join(headlines.select("ticker").distinct(), "ticker", "left_anti")
    return rows.unionByName(
        without.select("ticker", F.lit(NO_NEWS).alias("headline")), allowMissingColumns=True
    )


def recent_news(requested: DataFrame, headlines: DataFrame) -> DataFrame:
    """Cleaned headlines of the requested tickers, each normalised headline of a ticker once (the
    earliest dated copy), with placeholders."""
    cleaned = long_enough(
        clean_column(with_placeholder(requested, headlines), "headline", keep_raw=False), "headline"
    )
    return keep_first(
        cleaned, ["ticker", headline_hash(F.col("headline"))], [F.col("date").isNull(), F.col("date")]
    )
