"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased, anything but letters becomes one space, and each character is predicted from
the three before it. Grams are packed into 64 bits, spread by a multiplicative hash and kept in
sorted arrays, one row of log probabilities for all languages a gram, so one lookup scores a
character under every model; only grams no language has seen fall back to shorter ones.

The language with the lowest cross-entropy per character wins. A text whose cross-entropy lies
beyond what held-out texts of that language show (calibrated, wider for short texts) is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
SAMPLE_DOCS = 2000
CALIBRATION_SHARE = 5
SPREAD_LIMIT = 4.0
#: Share of a language's own calibration texts whose excess is accepted, and the nats a text that is
#: added while a language has too few calibration texts to show that share.
ACCEPTED = 0.995
MARGIN = 0.8
_ENOUGH = 20
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PAD = " " * (ORDER - 1)
_BITS = 16
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_GROUP_CHARS = 1 << 20


def cleaned(text: str | None) -> str:
    """Letters in lower case with single spaces between; empty if there is no letter."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip(" ")
    return letters if any(map(str.isalpha, letters)) else ""


def codes(text: str) -> np.ndarray:
    """Characters as 16-bit numbers; those beyond the basic plane are folded into it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return ((points & 0xFFFF) ^ (points >> 16)).astype(np.uint64)


def packed(characters: np.ndarray, order: int) -> np.ndarray:
    """Grams that end at each position from ``order - 1`` on."""
    count = len(characters) - order + 1
    grams = np.zeros(max(count, 0), np.uint64)
    for at in range(order):
        grams = (grams << np.uint64(_BITS)) | characters[at:at + len(grams)]
    return grams


def _context(grams: np.ndarray) -> np.ndarray:
    return grams >> np.uint64(_BITS)


def _shorter(grams: np.ndarray, order: int) -> np.ndarray:
    return grams & np.uint64((1 << (_BITS * (order - 1))) - 1)


class HashArray:
    """Rows of numbers by gram: hashes in sorted order, found through an index on their top bits."""

    def __init__(self, grams: np.ndarray, rows: np.ndarray) -> None:
        hashes = grams * _SPREAD
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order].astype(np.float32)
        bits = max(4, int(len(grams)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        top = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.first).max(initial=0))
        self.hashes = np.append(self.hashes, np.uint64(0))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each gram, -1 where there is none."""
        hashes = grams * _SPREAD
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        last = len(self.hashes) - 1
        found = np.where((self.hashes[at] == hashes) & (at < last), at, -1)
        open_ = np.flatnonzero((found < 0) & (self.hashes[at] < hashes))
        for step in range(1, self.steps):
            if not len(open_):
                break
            here = np.minimum(at[open_] + step, last)
            hit = (self.hashes[here] == hashes[open_]) & (here < last)
            found[open_[hit]] = here[hit]
            open_ = open_[~hit & (self.hashes[here] < hashes[open_]) & (here < last)]
        return found


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


class _Estimate:
    """Kneser-Ney estimates of one language: counts by order, continuations below the top."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.levels = {}
        for order in range(ORDER, 0, -1):
            contexts, inverse = np.unique(_context(grams), return_inverse=True)
            totals = np.bincount(inverse, counts, len(contexts))
            kinds = np.bincount(inverse, minlength=len(contexts))
            discount = _discount(counts)
            self.levels[order] = grams, counts, contexts, totals, discount * kinds / totals, discount
            grams, counts = np.unique(_shorter(grams, order), return_counts=True)
        self.letters = len(self.levels[1][0]) + 1

    def backoff(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """Weight of the shorter model after each context; 1 for contexts never seen."""
        _, _, known, _, weights, _ = self.levels[order]
        at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return np.where(known[at] == contexts, weights[at], 1.0)

    def probability(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Interpolated probability of the last character of each gram after the others."""
        if order == 0:
            return np.full(len(grams), 1.0 / self.letters)
        known, counts, contexts, totals, _, discount = self.levels[order]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        count = np.where(known[at] == grams, counts[at], 0)
        context = _context(grams)
        place = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        total = np.where(contexts[place] == context, totals[place], np.inf)
        shorter, inverse = np.unique(_shorter(grams, order), return_inverse=True)
        lower = self.probability(shorter, order - 1)[inverse]
        return np.maximum(count - discount, 0) / total + self.backoff(context, order) * lower


@dataclass
class Models:
    """All languages' models in shared arrays, and the bounds of what each accepts."""

    languages: list[str]
    grams: dict[int, HashArray]
    backoffs: dict[int, HashArray]
    floor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    excess: np.ndarray

    def log_probabilities(self, characters: np.ndarray) -> np.ndarray:
        """Row per character from position ``ORDER - 1`` on, column per language."""
        top = packed(characters, ORDER)
        out = np.empty((len(top), len(self.languages)), np.float32)
        rest, bonus = np.arange(len(top)), None
        for order in range(ORDER, 0, -1):
            grams = top[rest] & np.uint64((1 << (_BITS * order)) - 1)
            at = self.grams[order].find(grams)
            hit = at >= 0
            rows = self.grams[order].rows[at[hit]]
            out[rest[hit]] = rows if bonus is None else rows + bonus[hit]
            rest, grams = rest[~hit], grams[~hit]
            bonus = np.zeros((len(rest), len(self.languages)), np.float32) if bonus is None else bonus[~hit]
            if not len(rest):
                return out
            place = self.backoffs[order].find(_context(grams))
            known = place >= 0
            bonus[known] += self.backoffs[order].rows[place[known]]
        out[rest] = self.floor + bonus
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per cleaned, non-empty text: nats per character by language, their spread, and the length."""
        characters = codes("".join([_PAD + t for t in texts]))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        logs = self.log_probabilities(np.append(characters, np.uint64(32)))[:-1]
        begin = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
        edges = np.stack([begin, begin + lengths], axis=1).ravel()
        logs = np.concatenate([logs, np.zeros((1, logs.shape[1]), np.float32)])
        sums = np.add.reduceat(logs, edges, axis=0, dtype=np.float64)[::2]
        squares = np.add.reduceat(logs * logs, edges, axis=0, dtype=np.float64)[::2]
        mean = -sums / lengths[:, None]
        spread = np.sqrt(np.maximum(squares / lengths[:, None] - mean**2, 0))
        return mean, spread, lengths

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected, for cleaned texts."""
        names = [UNDETERMINED] * len(texts)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        some = [i for i, t in enumerate(texts) if t]
        if some and self.languages:
            mean, _, lengths = self.entropies([texts[i] for i in some])
            best = mean.argmin(axis=1)
            lead = (mean - mean.min(axis=1, keepdims=True)) * lengths[:, None]
            score[some] = 1 / np.exp(-lead).sum(axis=1)
            bound = self.mean[best] + self.excess[best] + (
                SPREAD_LIMIT * self.spread[best] / np.sqrt(lengths)
            )
            rejected[some] = mean[np.arange(len(some)), best] > bound
            for i, language in zip(some, best.tolist()):
                names[i] = self.languages[language]
        return names, score, rejected


def _grouped(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and cleaned texts of consecutive rows, a bounded amount of text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    edges = (np.flatnonzero(np.diff(sizes // _GROUP_CHARS)) + 1).tolist()
    for low, high in zip([0, *edges], [*edges, len(column)]):
        if high > low:
            yield low, [cleaned(t) for t in column.slice(low, high - low).to_pylist()]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        language = batch.column(0).to_numpy(zero_copy_only=False)
        for low, texts in _grouped(batch.column(1)):
            for number in np.unique(language[low:low + len(texts)]):
                own = [t for t, n in zip(texts, language[low:]) if n == number and t]
                for part in own:
                    grams, counts = np.unique(packed(codes(_PAD + part), ORDER), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(grams), number, np.int32)),
                         pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))],
                        ["language", "gram", "n"],
                    )


def _assembled(languages: list[str], estimates: list[_Estimate]) -> Models:
    grams, backoffs = {}, {}
    for order in range(ORDER, 0, -1):
        keys = np.unique(np.concatenate([e.levels[order][0] for e in estimates]))
        table = np.stack([np.log(e.probability(keys, order)) for e in estimates], axis=1)
        grams[order] = HashArray(keys, table)
        contexts = np.unique(np.concatenate([e.levels[order][2] for e in estimates]))
        weights = np.stack([np.log(e.backoff(contexts, order)) for e in estimates], axis=1)
        backoffs[order] = HashArray(contexts, weights)
    floor = np.array([np.log(1 / e.letters) for e in estimates], np.float32)
    none = np.zeros(len(languages))
    return Models(languages, grams, backoffs, floor, none, none, none)


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models from rows of ``doc_id, text, lang``.

    The sample is bounded: of each language about ``sample_docs`` texts, those with the least
    hashes of ``doc_id``. A fifth of it calibrates the rejection and trains nothing.
    """
    rows = labelled.filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    empty = Models([], {}, {}, *[np.zeros(0)] * 4)
    if not languages:
        return empty
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = F.create_map(*[
        F.lit(v) for lang in languages
        for v in (lang, int(min(1.0, sample_docs / counts[lang]) * (1 << 30)))
    ])
    numbers = F.create_map(*[F.lit(v) for i, lang in enumerate(languages) for v in (lang, i)])
    sample = rows.filter(place < F.try_element_at(limits, F.col("lang"))).select(
        F.try_element_at(numbers, F.col("lang")).alias("language"),
        F.col("text").cast("string").alias("text"),
        (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATION_SHARE)) == 0)
        .alias("calibrates"),
    )
    table = (
        sample.filter("not calibrates").select("language", "text")
        .mapInArrow(_count_grams, "language int, gram bigint, n bigint")
        .groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    )
    language = table.column("language").to_numpy()
    gram = table.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    count = table.column("n").to_numpy()
    kept, estimates = [], []
    for number, name in enumerate(languages):
        own = np.flatnonzero(language == number)
        if len(own):
            own = own[np.argsort(gram[own])]
            kept.append(name)
            estimates.append(_Estimate(gram[own], count[own]))
    if not kept:
        return empty
    models = _assembled(kept, estimates)
    return _calibrated(models, sample.filter("calibrates"), languages)


def _calibrated(models: Models, sample: DataFrame, languages: list[str]) -> Models:
    """Mean, spread and accepted excess of each language from texts that trained nothing."""
    column = {languages.index(n): i for i, n in enumerate(models.languages)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column(0).to_pylist()
            for low, texts in _grouped(batch.column(1)):
                some = [i for i, t in enumerate(texts) if t and language[low + i] in column]
                if some:
                    own = [column[language[low + i]] for i in some]
                    mean, spread, lengths = models.entropies([texts[i] for i in some])
                    at = np.arange(len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int32()), pa.array(mean[at, own]),
                         pa.array(spread[at, own]), pa.array(lengths)],
                        ["own", "mean", "spread", "length"],
                    )

    rows = sample.select("language", "text").mapInArrow(
        measure, "own int, mean double, spread double, length bigint"
    ).toArrow()
    own, mean, spread, length = (rows.column(i).to_numpy() for i in range(4))
    size = len(models.languages)
    models.mean, models.spread = np.full(size, np.inf), np.ones(size)
    models.excess = np.full(size, MARGIN)
    for i in range(size):
        here = own == i
        if not here.any():
            continue
        # medians and a limit in median deviations, so that a few mislabelled texts move nothing
        models.mean[i], models.spread[i] = np.median(mean[here]), np.median(spread[here])
        over = mean[here] - models.mean[i] - SPREAD_LIMIT * models.spread[i] / np.sqrt(length[here])
        middle = np.median(over)
        robust = middle + SPREAD_LIMIT * 1.4826 * np.median(np.abs(over - middle))
        tail = min(np.quantile(over, ACCEPTED, method="higher"), robust)
        models.excess[i] = max(0.0, tail) + MARGIN * min(1.0, _ENOUGH / len(over))
    return models


def identified(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``; only ``text`` is looked at.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Clashing columns of
    these names are replaced. Ties go to the language that comes first by name.
    """
    added = ("lang_pred", "score", "rejected")
    columns = [c for c in docs.columns if c not in added]
    base = docs.select(*columns).withColumn("text", F.col("text").cast("string"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = [], [], []
            for _, texts in _grouped(batch.column("text")):
                n, s, r = models.predict(texts)
                names += n
                scores.append(s)
                rejected.append(r)
            columns = [pa.array(names, pa.string())] + [
                pa.array(np.concatenate(c) if c else np.zeros(0, t))
                for c, t in ((scores, np.float64), (rejected, bool))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, *added]
            )

    schema = base.select(
        "*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
    ).schema
    return base.mapInArrow(task, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: one in four ids, by checksum; false for a null id."""
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(False))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the rows that are not held out and predict every row of ``docs``.

    Returns ``docs`` with ``held_out``, ``lang_pred``, ``score`` and ``rejected``. Rows with a null
    ``doc_id``, ``lang`` or ``text`` train nothing; without any training row every text is ``und``.
    Repeated rows count as often as they come.
    """
    models = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample_docs)
    return identified(docs, models).withColumn("held_out", held_out(F.col("doc_id")))
