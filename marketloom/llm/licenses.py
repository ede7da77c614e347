"""Licence scans by ordered signature rules.

Each text is reduced to its lower-case words. A keyword prefilter decides which rules can match at
all: a rule runs only on texts that hold all its keywords, which few do.
Matches are intervals of words. One that lies inside an interval of higher priority, or inside a
longer or earlier-ruled one of the same priority, is suppressed, so "GNU Lesser General Public
License" is no GPL. The base phrases (``license_rules.BASE``) are always reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.license_rules import BASE, CONFIDENCE, NOTICE, Rule, rules
from marketloom.llm.words import chunks, folded

_HIT = "label string, rule string, base boolean, start bigint, end bigint, kept boolean, confidence double"
_HITS = f"doc_id bigint, n_words bigint, hits array<struct<{_HIT.replace(' ', ':').replace(',:', ',')}>>"
_BASE_PHRASES = [(f" {phrase} ".encode(), label) for phrase, label in BASE]


@cache
def _by_keyword() -> list[tuple[bytes, list[tuple[bytes, list[Rule]]]]]:
    """The rules by their first keyword, and within it by their last."""
    found: dict[bytes, dict[bytes, list[Rule]]] = {}
    for rule in rules():
        found.setdefault(rule.keywords[0], {}).setdefault(rule.keywords[-1], []).append(rule)
    return [(first, list(some.items())) for first, some in found.items()]


def _possible(text: bytes) -> Iterator[Rule]:
    """The rules whose keywords are all in the text."""
    for first, some in _by_keyword():
        if first in text:
            for last, found in some:
                if last in text:
                    yield from found


def _places(text: bytes, phrase: bytes) -> list[int]:
    """Where a phrase begins, overlapping places included."""
    found, at = [], text.find(phrase)
    while at >= 0:
        found.append(at)
        at = text.find(phrase, at + 1)
    return found


def suppressed(start: np.ndarray, end: np.ndarray, priority: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which intervals lie inside one that outranks them.

    Higher priority outranks; within one priority the longer interval does, and of two equal
    intervals that of the earlier rule. Whatever contains a suppressed interval's suppressor contains the
    interval too, so it does not matter whether the suppressor is itself suppressed.
    """
    out = np.zeros(len(start), bool)
    # by start, longest first: what can contain an interval comes before it
    place = np.lexsort((order, -priority, -end, start))
    for level in np.unique(priority):
        mine = place[priority[place] >= level]
        reach = np.maximum.accumulate(end[mine])
        before = np.concatenate([[-1], reach[:-1]])
        here = priority[mine] == level
        out[mine[here]] = before[here] >= end[mine[here]]
    return out


def scan(text: bytes) -> tuple[int, list[dict]]:
    """The number of words of one text, and its hits by start; places are word numbers."""
    words = folded(text).split()
    plain = b" " + b" ".join(words) + b" "
    found = [
        (at, at + len(phrase) - 1, label, "base", NOTICE, -1)
        for phrase, label in _BASE_PHRASES if phrase in plain for at in _places(plain, phrase)
    ]
    for rule in _possible(plain):
        found += [
            (m.start(), m.end(), rule.label, rule.name, rule.priority, rule.order)
            for m in rule.pattern.finditer(plain)
        ]
    if not found:
        return len(words), []
    spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    start, end = (np.searchsorted(spaces, [f[i] for f in found]) for i in (0, 1))
    priority, order = (np.array([f[i] for f in found]) for i in (4, 5))
    gone = suppressed(start, end, priority, order)
    hits = [
        {"label": f[2], "rule": f[3], "base": f[5] < 0, "start": int(a), "end": int(b),
         "kept": f[5] < 0 or not g, "confidence": CONFIDENCE[f[4]]}
        for f, a, b, g in zip(found, start, end, gone)
    ]
    return len(words), sorted(hits, key=lambda h: (h["start"], -h["end"], h["rule"]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("label", pa.string()), ("rule", pa.string()), ("base", pa.bool_()), ("start", pa.int64()),
              ("end", pa.int64()), ("kept", pa.bool_()), ("confidence", pa.float64())]
    for batch in batches:
        for low, texts in chunks(batch, 1):
            found = [scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, len(texts)), pa.array([n for n, _ in found], pa.int64()),
                pa.array([h for _, h in found], pa.list_(pa.struct(fields))),
            ], ["doc_id", "n_words", "hits"])


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, hits`` of every row of ``docs`` (``doc_id``, ``text``).

    A hit has its label, rule, interval of words ``[start, end)``, confidence, whether it is of a base
    phrase and whether it is kept. A null or empty text has no words and no hits. Texts of any length
    are scanned whole; repeated rows are rows of their own, null ids stay null. Of two equal intervals the
    earlier rule is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_scanned, _HITS)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: base places, labels and a score.

    ``score`` is the highest confidence of a kept hit, 0 without hits. ``labels`` are those of all kept
    hits, the base phrases' included. Without base places ``first_word`` and ``last_word`` are null.
    Odd rows are treated as in ``scanned``.
    """
    base = F.filter("hits", lambda h: h["base"])
    kept = F.filter("hits", lambda h: h["kept"])

    def listed(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    starts = F.transform(base, lambda h: h["start"])
    return scanned(docs).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda h: h["confidence"])), F.lit(0.0)).alias("score"),
    )
