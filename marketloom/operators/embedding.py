"""Headline vectors: hashed word counts weighted by inverse document frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import SPACES_PATTERN, normalized
from marketloom.settings import DEFAULTS
from marketloom.workspace import written


# Texts counted at once; bounds the block of word counts.
_COUNTED_ROWS = 1024


def slots(text: Column, dim: int = DEFAULTS.embedding_dim) -> Column:
    """Vector slot of every word of a text: the first 32 bits of its MD5 modulo ``dim``."""
    words = F.array_remove(F.split(normalized(text), SPACES_PATTERN), "")
    return F.transform(
        words,
        lambda w: F.pmod(
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)
        ).cast("int"),
    )


def with_slots(
    df: DataFrame, text: str, dim: int = DEFAULTS.embedding_dim, name: str = "slots"
) -> DataFrame:
    """Replace the text by its slots, written once: hashing every word is the costly part, and
    both the weights and the vectors read the result."""
    return written(df.withColumn(name, slots(F.col(text), dim)).drop(text), "slots")


def slot_weights(
    slotted: DataFrame, dim: int = DEFAULTS.embedding_dim, name: str = "slots"
) -> list[float]:
    """Smoothed inverse document frequency per slot: ln((n + 1) / (df + 1)).

    One scan: each text contributes its distinct slots and one extra count row, pre-aggregated
    to at most ``dim`` + 1 rows, which is all the driver sees.
    """
    marks = F.concat(F.array_distinct(name), F.array(F.lit(-1)))
    counts = {
        r["slot"]: r["n"]
        for r in slotted.select(F.explode(marks).alias("slot")).groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n")).collect()
    }
    n = counts.get(-1, 0)
    return [float(np.log((n + 1) / (counts.get(i, 0) + 1))) for i in range(dim)]


def embed(
    slotted: DataFrame, weights: list[float], slots_name: str = "slots", name: str = "embedding"
) -> DataFrame:
    """Replace the slots by a fixed-width vector of weighted word counts. Map-only."""
    dim = len(weights)
    scale = np.asarray(weights)

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            # yielded in parts: the vectors of a whole batch are far larger than its slots
            for at in range(0, len(batch), _COUNTED_ROWS):
                part = batch.iloc[at:at + _COUNTED_ROWS]
                lengths = part.map(len).to_numpy()
                slots = np.concatenate(part.to_numpy()).astype(np.int64) if lengths.sum() else lengths[:0]
                cells = np.repeat(np.arange(len(part)) * dim, lengths) + slots
                counts = np.bincount(cells, minlength=len(part) * dim).reshape(len(part), dim)
                yield pd.Series(list((counts * scale).astype(np.float32)))
            if not len(batch):
                yield pd.Series([], dtype=object)

    return slotted.withColumn(name, vector(slots_name)).drop(slots_name)
