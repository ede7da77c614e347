"""Scans along an ordered series.

Two layouts share the same column logic:

* daily bars: one row per (ticker, date). A ticker's partition is bounded by the calendar (about
  37,000 rows per century) whatever the size of the raw data, so ``Window.partitionBy(ticker)``
  is safe and costs one shuffle for all indicators together;
* long series (ticks, articles): a key may hold any share of the rows. ``in_chunks`` cuts each
  key into fixed-length chunks that also carry the preceding rows, and ``running`` carries
  chunk totals forward, level by level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marketloom.operators.ordering import position_in_key
from marketloom.workspace import written

# Rows per smoothing block. A weight that is BLOCK rows old has decayed below e^-DECAYED for every
# alpha >= 1/14, so one carry from the previous block is exact in double precision, and the
# inverse weights stay below e^LARGEST for every alpha <= 1/2. Other alphas get their own length.
BLOCK = 864
DECAYED, LARGEST = 64, 600

CHUNK_ROWS = 4096
HALO_ROWS = 2 * BLOCK


def with_blocks(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Number each series' rows (``_row``, from 0) and group them into blocks (``_block``)."""
    numbered_rows = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("_row", numbered_rows).withColumn(
        "_block", F.floor(F.col("_row") / BLOCK)
    )


def series_window(keys: Sequence[str], order: str) -> WindowSpec:
    """Window over a whole series. Ordering by (_block, order) equals ordering by ``order`` and
    lets series and block windows share one sort."""
    return Window.partitionBy(*keys).orderBy("_block", order)


def context_rows(alpha: float) -> int:
    """How far back an exponential mean looks, in double precision."""
    return 0 if alpha >= 1 else math.ceil(DECAYED / -math.log1p(-alpha))


def block_rows(alpha: float) -> int:
    """Rows of a smoothing block for this alpha."""
    fits = context_rows(alpha) <= BLOCK and BLOCK * -math.log1p(-alpha) <= LARGEST
    return BLOCK if fits else max(2, context_rows(alpha))


def smooth(
    df: DataFrame, outputs: Mapping[str, tuple[str, float, int]], keys: Sequence[str], order: str
) -> DataFrame:
    """Exponentially weighted means y0 = x0, yt = a*xt + (1-a)*y(t-1) for several columns.

    ``outputs`` maps a new column to (input column, alpha, start): the input is null before row
    ``start``, whose value seeds the mean. Any alpha in (0, 1] will do; 1 is the input itself. Needs
    ``with_blocks``. Each mean is a running weighted sum inside a block plus the decayed end value of
    the block before it, so the means of one call that share a block length take two window
    operators and no sort beyond the (keys, block, order) one.
    """
    along = series_window(keys, order)
    local, carried, final, numbers = {}, {}, {}, {}
    for name, (source, alpha, start) in outputs.items():
        if not 0 < alpha <= 1:
            raise ValueError(f"{name}: alpha {alpha} is outside (0, 1]")
        if alpha == 1:
            final[name] = F.col(source)
            continue
        rows = block_rows(alpha)
        block = "_block" if rows == BLOCK else f"_block_{rows}"
        if rows != BLOCK:
            numbers[block] = F.floor(F.col("_row") / rows)
        in_block = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(
            Window.unboundedPreceding, 0
        )
        offset = F.col("_row") - F.col(block) * rows
        keep = 1.0 - alpha
        weight = F.when(F.col("_row") == start, 1.0).otherwise(alpha)
        scaled = weight * F.col(source) * F.pow(F.lit(keep), -offset)
        local[f"_local_{name}"] = F.sum(scaled).over(in_block) * F.pow(F.lit(keep), offset)
        carried[f"_carry_{name}"] = F.last(
            F.when(offset == rows - 1, F.col(f"_local_{name}")), ignorenulls=True
        ).over(along.rowsBetween(Window.unboundedPreceding, -1))
        final[name] = F.col(f"_local_{name}") + F.coalesce(
            F.col(f"_carry_{name}") * F.pow(F.lit(keep), offset + 1), F.lit(0.0)
        )
    df = df.withColumns(numbers) if numbers else df
    df = df.withColumns(local).withColumns(carried) if local else df
    return df.withColumns(final).drop(*local, *carried, *numbers)


def in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[DataFrame, list[str]], DataFrame],
    chunk_rows: int = CHUNK_ROWS,
    back: int = HALO_ROWS,
    ahead: int = 1,
    alphas: Sequence[float] = (),
) -> DataFrame:
    """Run a per-series ``build(rows, keys)`` over chunks of series of any length.

    Each chunk gets the ``back`` rows before it and ``ahead`` rows after it as context; context
    rows are dropped afterwards. ``build`` must look at most that far (rolling windows, lags,
    smoothing). Name the ``alphas`` of its exponential means: context and chunks grow to what the
    slowest of them needs. Rows arrive with ``_position``, their place in the series, to order by.
    """
    back = max([back, *(2 * max(BLOCK, context_rows(a)) for a in alphas)])
    chunk_rows = max(chunk_rows, back if alphas else 0)
    if not (0 < back <= chunk_rows and 0 <= ahead <= chunk_rows):
        raise ValueError("context must not exceed one chunk")
    placed = position_in_key(df, keys, order, "_position")
    own = F.floor(F.col("_position") / chunk_rows)
    within = F.col("_position") - own * chunk_rows
    homes = F.array_compact(
        F.array(
            own,
            F.when(within >= chunk_rows - back, own + 1),
            F.when((within < ahead) & (own > 0), own - 1),
        )
    )
    copies = placed.withColumn("_own", own).withColumn("_chunk", F.explode(homes))
    built = build(copies, [*keys, "_chunk"])
    return built.filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk", "_position")


#: Totals that meet in one window of a carry; above that they are totalled again, level by level.
FAN_IN = 1024


def _merged(kind: str, before: Column, after: Column) -> Column:
    """One total of two neighbouring stretches; null where neither holds a value."""
    return {
        "sum": F.coalesce(before + after, after, before),
        "product": F.coalesce(before * after, after, before),
        "max": F.greatest(before, after),
        "last": F.coalesce(after, before),
    }[kind]


def _total(kind: str, value: Column, place: Column) -> Column:
    """Total of an unordered group; ``place`` tells which value is the last."""
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), place))
    return {"sum": F.sum, "product": F.product, "max": F.max}[kind](value)


def _along(kind: str, value: Column) -> Column:
    """Total over an ordered window."""
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "product": F.product, "max": F.max}[kind](value)


def _lifted(rows: DataFrame, carry: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Join ``carry`` (keys, _place, _carry) to the rows' ``place`` as ``_lift``, null keys included."""
    lifts = carry.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_place").alias("_of"),
        F.col("_carry").alias("_lift"),
    )
    same = F.col(place) == F.col("_of")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return rows.join(lifts, same, "left")


def carry_levels(
    totals: DataFrame, keys: Sequence[str], last_place: int, kind: str, fan_in: int = FAN_IN
) -> list[DataFrame]:
    """Totals, totals of ``fan_in`` totals, and so on, until a key fits one group.

    ``totals`` has ``_place`` (0-based along the key) and ``_total``; ``last_place`` is the largest
    place. Each level has ``keys, _place, _group, _total``, at most ``fan_in`` rows a group, and a
    ``fan_in``-th of the places below it.
    """
    group = F.floor(F.col("_place") / F.lit(fan_in))
    levels = [totals.select(*keys, "_place", group.alias("_group"), "_total")]
    while last_place >= fan_in:
        last_place //= fan_in
        above = (
            levels[-1].groupBy(*keys, "_group")
            .agg(_total(kind, F.col("_total"), F.col("_place")).alias("_total"))
            .withColumnRenamed("_group", "_place")
        )
        levels.append(above.select(*keys, "_place", group.alias("_group"), "_total"))
    return levels


def carried(levels: Sequence[DataFrame], keys: Sequence[str], kind: str) -> DataFrame:
    """What each place of the lowest level takes over from all places before it (``_carry``).

    From the top down: the carry of a group, merged with the total of the group's places before.
    """
    before = Window.partitionBy(*keys, "_group").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, -1
    )
    above = None
    for level in reversed(levels):
        within = level.withColumn("_carry", _along(kind, F.col("_total")).over(before))
        if above is not None:
            within = _lifted(within, above, keys, "_group").withColumn(
                "_carry", _merged(kind, F.col("_lift"), F.col("_carry"))
            )
        above = within.select(*keys, "_place", "_carry")
    return above


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    kind: str = "sum",
    chunk_rows: int = CHUNK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Running ``sum``, ``product``, ``max`` or ``last`` (non-null) over series of any length.

    Chunk totals are carried forward by levels (``carry_levels``) and combined with the running value
    inside each chunk: no window holds more than ``chunk_rows`` rows or ``fan_in`` totals of one key,
    however long it is. The placed rows are written once, since totals and result both read them.
    A null key is a key like any other.
    """
    placed = written(
        position_in_key(df.withColumn("_value", value), keys, order, "_position")
        .withColumn("_place", F.floor(F.col("_position") / chunk_rows)),
        "placed",
    )
    totals = placed.groupBy(*keys, "_place").agg(
        _total(kind, F.col("_value"), F.col("_position")).alias("_total")
    )
    last_place = placed.agg(F.max("_place")).first()[0] or 0
    if last_place >= fan_in:
        totals = written(totals, "chunk-totals")
    carry = carried(carry_levels(totals, keys, last_place, kind, fan_in), keys, kind)
    in_chunk = Window.partitionBy(*keys, "_place").orderBy("_position").rowsBetween(
        Window.unboundedPreceding, 0
    )
    here = placed.withColumn("_here", _along(kind, F.col("_value")).over(in_chunk))
    return _lifted(here, carry, keys, "_place").select(
        *df.columns, _merged(kind, F.col("_lift"), F.col("_here")).alias(name)
    )


def decay(span: int) -> float:
    """Alpha of an exponential mean given as a span."""
    return 2.0 / (span + 1.0)
