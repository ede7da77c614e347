"""Ordering operators that never put one key's rows into one task.

A key may hold a third of the table, so "first row per key", "newest N per key", "position
within key" and "exact median per key" are built from partial aggregation, salted limits and a
range-partitioned numbering instead of one window per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.workspace import written

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits
_FAN_IN, _LEVELS = 256, 2
_RUN_ROWS = 1 << 16


def nulls_last(column: Column) -> list[Column]:
    """Two sort keys that put nulls after every value, usable inside a struct comparison."""
    return [column.isNull(), column]


#: Bits of an order column by its type; other types cannot be packed.
_WIDTHS = {"boolean": 1, "tinyint": 8, "smallint": 16, "int": 32, "date": 32, "bigint": 64, "timestamp": 64, "timestamp_ntz": 64}
#: What a decimal of 38 digits holds, and what a long without its sign holds.
_DECIMAL_BITS, _LONG_BITS = 126, 63


def packed(
    df: DataFrame, order: Sequence[Column | str], widths: Sequence[int] | None = None
) -> Column | None:
    """One number that sorts as the columns of ``order`` do, nulls first; None if they do not fit.

    A minimum by a number is kept in an updatable buffer, so such aggregates are hashed and need
    no sort of whole rows. ``widths`` gives the bits of columns that are known to hold whole numbers
    from 0 to below 2 to that power; a value outside raises. Without widths the type decides: flags,
    whole numbers, dates and timestamps can be packed.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    fields = df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).schema
    numbers = ("bigint", "decimal(38,0)")
    if len(columns) == 1 and not fields[0].nullable and fields[0].dataType.simpleString() in numbers:
        return columns[0]
    if widths is not None:
        parts = [
            (F.when(c.between(0, (1 << w) - 1), c.cast("bigint")).otherwise(
                F.raise_error(F.lit(f"order column {i} is null or beyond {w} bits"))
            ), w) for i, (c, w) in enumerate(zip(columns, widths))
        ]
    else:
        parts = []
        for field, column in zip(fields, columns):
            width = _WIDTHS.get(field.dataType.simpleString())
            if width is None:
                return None
            parts += ([(column.isNotNull().cast("bigint"), 1)] if field.nullable else []) + [
                _counted_up(column, field.dataType.simpleString(), width)
            ]
    if sum(width for _, width in parts) > _DECIMAL_BITS:
        return None
    limbs: list[tuple[Column, int]] = []
    for value, width in parts:
        if limbs and limbs[-1][1] + width <= _LONG_BITS:
            limbs[-1] = F.shiftleft(limbs[-1][0], width).bitwiseOR(value), limbs[-1][1] + width
        else:
            limbs.append((value, width))
    whole = limbs[0][0]
    for value, width in limbs[1:]:
        scale = F.lit(str(1 << width)).cast("decimal(38,0)")
        whole = (whole.cast("decimal(38,0)") * scale + value.cast("decimal(38,0)")).cast("decimal(38,0)")
    return whole


def _counted_up(column: Column, kind: str, width: int) -> tuple[Column, int]:
    """A column as a number from 0 on, null as 0, and its bits."""
    if kind == "date":
        number = F.datediff(column, F.lit("1970-01-01").cast("date")).cast("bigint")
    elif kind.startswith("timestamp"):
        number = F.unix_micros(column.cast("timestamp"))
    else:
        number = column.cast("int").cast("bigint") if kind == "boolean" else column.cast("bigint")
    if kind == "boolean":
        return F.coalesce(number, F.lit(0).cast("bigint")), 1
    if width < 64:
        return F.coalesce(number + F.lit(1 << (width - 1)), F.lit(0).cast("bigint")), width
    shifted = number.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.coalesce(shifted, F.lit(0).cast("decimal(20,0)")), 64


def _text_key(df: DataFrame, column: Column) -> Column:
    """The column itself if it has a fixed width, else its SHA-256: no two texts are known to share one."""
    kind = df.select(column.alias("k")).schema["k"].dataType.simpleString()
    return F.unhex(F.sha2(column.cast("string"), 256)) if kind == "string" else column


def keep_first(
    df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """The first row of each key by ``order``, fetched late.

    The rows are written with a number. Only digests of the keys, the packed order and the number
    are aggregated, in hash tables and before the shuffle; the numbers of the first rows then fetch
    the rows, so a text moves at most once and copies of it never do. ``names`` adds computed
    keys to the result under these names (null for those that are columns already). An order that cannot be
    packed (``packed``) is compared as a whole row instead. Among rows of equal order any may stay.
    """
    given = list(names or [None] * len(keys))
    columns = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]
    rows = written(
        df.select("*", *[c.alias(n) for c, n in zip(columns, given) if n], F.monotonically_increasing_id().alias("_row")),
        "first-rows",
    )
    place = packed(rows, order)
    place = F.struct(*order) if place is None else place
    narrow = rows.select(
        *[_text_key(rows, c).alias(f"_key{i}") for i, c in enumerate(columns)], place.alias("_order"), "_row"
    )
    first = narrow.groupBy(*[f"_key{i}" for i in range(len(columns))]).agg(F.min_by("_row", "_order").alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(
        *[F.col(f"`{c}`") for c in df.columns], *[n for n in given if n]
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank",
) -> DataFrame:
    """The first ``limit`` rows per key with a 1-based ``rank``; ``order`` must be total.

    A hot key is cut level by level: the rows of ``_FAN_IN`` tasks meet in one slice, which keeps
    ``limit`` of them, then the slices of ``_FAN_IN`` slices, and so on. Each cut also runs before its
    shuffle, so no task receives more than ``_FAN_IN * limit`` rows of one key from a level.
    """
    sliced = df.withColumn("_slice", F.spark_partition_id())
    for _ in range(_LEVELS):
        sliced = sliced.withColumn("_slice", F.floor(F.col("_slice") / _FAN_IN).cast("int"))
        within = Window.partitionBy(*keys, "_slice").orderBy(*order)
        sliced = sliced.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= limit)
    over_all = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.withColumn(rank, F.row_number().over(over_all)).filter(F.col(rank) <= limit)
        .drop("_slice")
    )


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Add a global 0-based position in ``order`` without a single-task sort.

    Rows are range-partitioned and sorted; the written slot number (partition, position) is then
    shifted by the row counts of the earlier partitions. The count table has one row per
    partition, so its one-task window and its broadcast do not grow with the rows.
    ``order`` must be a total order for the numbering to be reproducible.
    """
    slots = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slots.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    position = F.col("_before") + F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        slots.join(F.broadcast(offsets), "_part")
        .withColumn(name, position)
        .drop("_part", "_slot", "_before")
    )


def position_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "position"
) -> DataFrame:
    """Add a 0-based position within each key, for keys of any size.

    Each range partition of the numbering is one contiguous run of the order, so a key's first
    global index is a partially aggregated minimum. The first indexes are joined back on the key
    salted by position run, so a hot key's rows spread over many tasks.
    """
    ranked = numbered(df, [*keys, *order], "_idx").withColumn(
        "_run", F.floor(F.col("_idx") / F.lit(_RUN_ROWS))
    )
    names = [f"_k{i}" for i in range(len(keys))]
    first = (
        ranked.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_run").alias("_r"))
        .agg(F.min("_idx").alias("_low"))
        .select("*", F.min("_low").over(Window.partitionBy(*names)).alias("_first"))
    )
    same = F.col("_run") == F.col("_r")
    for key, name_ in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name_))
    return ranked.join(first, same).select(
        *df.columns, (F.col("_idx") - F.col("_first")).alias(name)
    )


#: Rows of one key whose values an aggregate may hold.
MEDIAN_ROWS = 100_000
#: Parts a range of values is cut into in one round of the selection.
_PARTS = 1024


def exact_median(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], most_rows: int = MEDIAN_ROWS
) -> DataFrame:
    """Exact median of every value column per key, for keys of any size and any number of ties.

    Keys of at most ``most_rows`` rows are aggregated directly. For larger ones the middle is selected:
    a partially aggregated histogram narrows the range that holds it, round by round (``_selected``),
    so no key is ever sorted, numbered or gathered. Groups without any value have no row.
    """
    rows = df.select(*keys, *values).filter(reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values]))
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("_rows")), "key-sizes")
    largest = sizes.agg(F.max("_rows")).first()[0] or 0

    def direct(of: DataFrame) -> DataFrame:
        return of.groupBy(*keys).agg(*[F.median(v).alias(v) for v in values])

    if largest <= most_rows:
        return direct(rows)
    names = [f"_k{i}" for i in range(len(keys))]
    large = sizes.filter(F.col("_rows") > most_rows).select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return direct(rows.join(large, same, "left_anti")).unionByName(
        _selected(rows.join(large, same, "left_semi"), keys, values)
    )


def _selected(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians by selection.

    For every key and column a range of values is known that holds both middle rows, and how many rows
    lie before it. A round counts the rows of ``_PARTS`` parts of the range (its least and its
    greatest value are parts of their own) and goes on with the part of the middle rows. They are
    found when they lie in two parts, or in a part of one value. Every round cuts a range at least by its two
    ends and as a rule to a thousandth, whatever the number of rows; NaN counts as the greatest value.
    """
    group = [*keys, "_name"]
    names = [f"_g{i}" for i in range(len(group))]
    stacked = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_value")) for v in values
    ])).alias("_cell")).select(*keys, "_cell._name", "_cell._value").filter(F.col("_value").isNotNull())
    total = stacked.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)]).agg(
        F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.count("*").alias("_n")
    )
    ranges = written(total.select(
        *names, "_low", "_high", F.floor((F.col("_n") - 1) / 2).alias("_first"), F.floor(F.col("_n") / 2).alias("_second"),
    ), "ranges")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)])
    half = lambda c: F.col(c) / 2  # noqa: E731 - halves cannot overflow
    share = F.try_divide(half("_value") - half("_low"), half("_high") - half("_low"))
    inner = F.when(share.isNull() | F.isnan(share), 1).otherwise(
        F.least(F.greatest(F.floor(share * _PARTS) + 1, F.lit(1)), F.lit(_PARTS))
    )
    part = F.when(F.col("_value") == F.col("_low"), 0).when(F.col("_value") == F.col("_high"), _PARTS + 1).otherwise(inner)
    found = None
    while True:
        counts = stacked.join(ranges, same).filter(F.col("_value").between(F.col("_low"), F.col("_high"))).groupBy(
            *names, "_first", "_second", part.alias("_part")
        ).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.count("*").alias("_n"))
        # at most _PARTS + 2 rows a key
        upto = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("_to", F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n"))
        holds = lambda at: (F.col("_from") <= F.col(at)) & (F.col(at) < F.col("_to"))
        placed = written(placed.filter(holds("_first") | holds("_second")), "ranges")
        both = holds("_first") & holds("_second")
        settled = placed.filter(~both | (F.col("_low") == F.col("_high"))).select(
            *names, F.when(holds("_second"), F.col("_low")).otherwise(F.col("_high")).alias("_value")
        )
        found = settled if found is None else found.unionByName(settled)
        ranges = placed.filter(both & (F.col("_low") != F.col("_high"))).select(
            *names, "_low", "_high", (F.col("_first") - F.col("_from")).alias("_first"),
            (F.col("_second") - F.col("_from")).alias("_second"),
        )
        if not ranges.take(1):
            break
    # two middle values count half each, halved first: their sum may overflow
    mine = lambda v: F.when(F.col(names[-1]) == v, F.col("_value"))
    return found.groupBy(*[F.col(n).alias(k) for n, k in zip(names, keys)]).agg(*[
        F.when(F.count(mine(v)) == 2, F.sum(mine(v) / 2)).otherwise(F.max(mine(v))).alias(v) for v in values
    ])
