"""Exact, hashed and windowed near-duplicate removal."""

from __future__ import annotations

import functools
import itertools
import math
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import clean, headline_hash, set_jaccard, word_set
from marketloom.operators.ordering import keep_first, numbered
from marketloom.settings import DEFAULTS
from marketloom.workspace import written

# Positions one resolution task handles at a time; also the most rows it holds in memory.
STRETCH = 200_000
# Ways the rows before a stretch may have turned out that are tried ahead of time.
MOST_COMBINATIONS = 2048
# Numbers of 64 bits that mark a row's words.
_MARKS = 8


def exact(df: DataFrame, text: str, order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every distinct text."""
    return keep_first(df, [text], order)


def by_hash(
    df: DataFrame, text: str, source_priority: Column, order: Sequence[Column],
    name: str | None = None,
) -> DataFrame:
    """Keep one row per normalised headline across sources and tickers; earlier sources win.

    ``source_priority`` ranks sources (``feeds.source_priority`` for feed labels); ``name`` adds the hash.
    """
    return keep_first(df, [headline_hash(F.col(text))], [source_priority, *order], [name])


def near_pairs(
    indexed: DataFrame,
    text: str,
    threshold: float = DEFAULTS.near_duplicate_threshold,
    span: int = DEFAULTS.near_duplicate_span,
) -> DataFrame:
    """Pairs (i, j), i < j <= i + span, whose word sets have Jaccard >= threshold.

    Positions are unique, so buckets of ``span`` positions are all the same size: the join is an
    equi-join on the bucket that meets every pair exactly once, never a cross join. The word
    counts of a pair bound its Jaccard, and so do the bits that its words set in small marks: a bit that only one row
    has stands for at least one word that only it has. That drops most pairs before the set comparison.
    """
    # Written once: both sides of the join read the word sets.
    words = written(
        indexed.select("idx", word_set(F.col(text)).alias("words"))
        .withColumn("n", F.size("words")).withColumn("bits", _bits_of(F.col("words")))
        .withColumn("marks", _marks(F.col("bits"))).drop("bits"),
        "words",
    ).filter(F.col("n") > 0)
    bucket = F.floor(F.col("idx") / span)
    left = words.select(
        F.col("idx").alias("i"), F.col("words").alias("wi"), F.col("n").alias("ni"), F.col("marks").alias("mi"),
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"),
    )
    right = words.select(
        F.col("idx").alias("j"), F.col("words").alias("wj"), F.col("n").alias("nj"), F.col("marks").alias("mj"),
        bucket.alias("bucket"),
    )
    close = (F.col("i") < F.col("j")) & (F.col("j") <= F.col("i") + span)
    # Kept a hair below the threshold: rounding must not drop a pair the exact test would keep.
    possible = F.least("ni", "nj") >= (threshold - 1e-9) * F.greatest("ni", "nj")
    # At least threshold / (1 + threshold) of both counts is shared.
    spare = (1 - threshold / (1 + threshold) + 1e-9) * (F.col("ni") + F.col("nj"))
    possible &= F.greatest(
        F.col("nj") + _only("mi", "mj"), F.col("ni") + _only("mj", "mi")
    ) <= spare
    return (
        left.join(right, "bucket")
        .filter(close & possible)
        .withColumn("jaccard", set_jaccard(F.col("wi"), F.col("wj")))
        .filter(F.col("jaccard") >= threshold)
        .select("i", "j", "jaccard")
    )


def _bits_of(words: Column) -> Column:
    """Which bit each word sets, by its hash; each once."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * _MARKS)).cast("int")))


def _marks(bits: Column) -> Column:
    """The bits as a few numbers."""
    def mark(at: int) -> Column:
        one = F.lit(1).cast("bigint")
        return F.aggregate(
            F.filter(bits, lambda b: F.shiftright(b, 6) == at), F.lit(0).cast("bigint"),
            lambda mark, b: mark.bitwiseOR(F.call_function("shiftleft", one, b.bitwiseAND(F.lit(63)))),
        )

    return F.struct(*[mark(at).alias(f"m{at}") for at in range(_MARKS)])


def _only(mine: str, others: str) -> Column:
    """How many bits are set in the marks ``mine`` alone."""
    return functools.reduce(operator.add, (
        F.bit_count(F.col(f"{mine}.m{i}").bitwiseAND(F.bitwise_not(F.col(f"{others}.m{i}")))) for i in range(_MARKS)
    ))


def _walk(positions, masks, start: int, end: int, span: int, states: np.ndarray) -> np.ndarray:
    """Kept flags of the last ``span`` rows after walking from ``start`` to ``end``, for several
    starting flags at once. Bit k of a state is set if the row k + 1 places back is kept; bit k of
    a row's mask is set if that row resembles it. Rows without a mask are kept."""
    full = np.uint64((1 << span) - 1)
    one = np.uint64(1)
    at = start
    for j, mask in zip(positions, masks):
        states = _advance(states, j - at, span, full)
        kept = (states & np.uint64(mask)) == 0
        states = ((states << one) & full) | kept.astype(np.uint64)
        at = j + 1
    return _advance(states, end - at, span, full)


def _advance(states: np.ndarray, gap: int, span: int, full: np.uint64) -> np.ndarray:
    """The flags after ``gap`` rows that nothing precedes."""
    if gap <= 0:
        return states
    if gap >= span:
        return np.full_like(states, full)
    return ((states << np.uint64(gap)) & full) | np.uint64((1 << gap) - 1)


def _bits(mask: int) -> list[int]:
    return [k for k in range(mask.bit_length()) if mask >> k & 1]


def _independent_sets(nodes: list[int], clashes: dict[int, int], limit: int) -> list[int] | None:
    """All sets of ``nodes`` (as masks) without a clashing pair, or None if beyond ``limit``."""
    sets = [0]
    for node in nodes:
        sets += [s | 1 << node for s in sets if not s & clashes.get(node, 0)]
        if len(sets) > limit:
            return None
    return sets


def _outcomes(rows: pd.DataFrame, span: int, stretch_rows: int, limit: int) -> pd.DataFrame:
    """What one stretch passes on for each way the rows just before it may have turned out.

    Only rows before the stretch that resemble one of its rows, and whose own fate is open,
    matter. They fall into groups that no row of the stretch ties together; each group is tried
    with every possible combination. A line (group, before, after) says: if the group's kept
    flags are ``before``, its share of the flags at the end is ``after``. Group 0 holds what does
    not depend on earlier rows. The lines follow each other in one list, which is empty for a
    stretch with too many combinations.
    """
    stretch = int(rows["stretch"].iloc[0])
    start, end = stretch * stretch_rows, (stretch + 1) * stretch_rows
    rows = rows.sort_values("j")
    js, masks = rows["j"].tolist(), rows["mask"].tolist()
    earlier = {start - 1 - j: m for j, m in zip(js, masks) if j < start}
    own = [(j, m) for j, m in zip(js, masks) if j >= start]
    positions, own_masks = [j for j, _ in own], [m for _, m in own]
    # Two earlier rows clash if one precedes and resembles the other.
    clashes: dict[int, int] = {}
    for back, mask in earlier.items():
        for k in _bits(mask):
            other = back + 1 + k
            if other < span:
                clashes[back] = clashes.get(back, 0) | 1 << other
                clashes[other] = clashes.get(other, 0) | 1 << back
    # The group of each row: the earlier open rows its fate depends on, merged where they meet.
    leader = {back: back for back in earlier}

    def find(back: int) -> int:
        while leader[back] != back:
            back = leader[back]
        return back

    depends: dict[int, int] = {}
    for j, mask in own:
        for k in _bits(mask):
            i = j - 1 - k
            back = depends.get(i) if i >= start else (start - 1 - i)
            if back is None or back not in leader:
                continue
            if j in depends:
                leader[find(back)] = find(depends[j])
            else:
                depends[j] = back
    tails: dict[int, int] = {}
    for j, back in depends.items():
        if j >= end - span:
            tails[find(back)] = tails.get(find(back), 0) | 1 << (end - 1 - j)
    full = (1 << span) - 1
    certain = full & ~sum(1 << back for back in earlier)
    tries = [(0, 0, full & ~sum(tails.values()))]
    for group, tail in tails.items():
        members = sorted(b for b in leader if find(b) == group)
        sets = _independent_sets(members, clashes, limit)
        if sets is None:
            return pd.DataFrame({"stretch": [stretch], "lines": [[]]})
        group_mask = sum(1 << b for b in members)
        tries += [(group_mask, kept, tail) for kept in sets]
    states = np.array([certain | kept for _, kept, _ in tries], dtype=np.uint64)
    ends = _walk(positions, own_masks, start, end, span, states)
    lines = [(m, kept, int(e) & tail) for e, (m, kept, tail) in zip(ends, tries)]
    return pd.DataFrame({"stretch": [stretch], "lines": [[x for line in lines for x in line]]})


Lines = list[tuple[int, int, int]]


def apply_lines(lines: Lines, state: int) -> int:
    """The flags at the end for these flags before."""
    return functools.reduce(operator.or_, (a for m, before, a in lines if state & m == before), 0)


def _simplified(groups: list[Lines], certain: int) -> Lines:
    """Groups as lines; a group that always ends alike depends on nothing."""
    out: Lines = []
    for group in groups:
        if len({after for _, _, after in group}) == 1:
            certain |= group[0][2]
        else:
            out += group
    return [(0, 0, certain), *out]


def _grouped(lines: Lines) -> tuple[int, list[Lines]]:
    """What is certain, and the lines of each group."""
    certain, groups = 0, {}
    for line in lines:
        if line[0]:
            groups.setdefault(line[0], []).append(line)
        else:
            certain |= line[2]
    return certain, list(groups.values())


def compose(later: Lines, earlier: Lines, limit: int) -> Lines | None:
    """The outcomes of two stretches in a row, or None if there are too many.

    Each group of the later stretch reads flags that some groups of the earlier one decide. Groups that
    meet this way become one, tried with every combination of the earlier groups' lines.
    """
    passed, sources = _grouped(earlier)
    certain, groups = _grouped(later)
    decides = [functools.reduce(operator.or_, (a for _, _, a in g)) for g in sources]
    # parts: the later groups and earlier groups that hang together
    parts: list[tuple[set[int], set[int]]] = []
    for at, group in enumerate(groups):
        mine, needs = {at}, {i for i, bits in enumerate(decides) if bits & group[0][0]}
        apart = []
        for members, read in parts:
            if read & needs:
                mine, needs = mine | members, needs | read
            else:
                apart.append((members, read))
        parts = [*apart, (mine, needs)]
    out = []
    for members, read in parts:
        read_lines = [sources[i] for i in sorted(read)]
        if math.prod(map(len, read_lines)) > limit:
            return None
        merged = []
        for chosen in itertools.product(*read_lines):
            state = functools.reduce(operator.or_, (a for _, _, a in chosen), passed)
            ends = [next((a for m, b, a in groups[g] if state & m == b), None) for g in members]
            if None not in ends:  # else these flags cannot come about
                merged.append((
                    functools.reduce(operator.or_, (m for m, _, _ in chosen), 0),
                    functools.reduce(operator.or_, (b for _, b, _ in chosen), 0),
                    functools.reduce(operator.or_, ends),
                ))
        out.append(merged)
    return _simplified([g for g in out if g], certain)


def _triples(flat: Sequence[int]) -> Lines:
    numbers = [int(x) for x in flat]
    return list(zip(numbers[::3], numbers[1::3], numbers[2::3]))


def _settled(batches: Iterator[pd.DataFrame], span: int, limit: int) -> Iterator[pd.DataFrame]:
    """One round of the scan: rows whose base is settled are settled, others reach back twice as far."""
    full = (1 << span) - 1
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            lines, base, state, start = _triples(row.lines), row.base, row.state, None
            known = full if not row.found else None if pd.isna(row.base_state) else int(row.base_state)
            if not pd.isna(state):
                state = int(state)
            elif known is not None:
                state, start = (apply_lines(lines, known), None) if lines else (None, known)
            elif lines and len(row.base_lines):
                both = compose(lines, _triples(row.base_lines), limit)
                if both is not None:
                    lines, base = both, row.base_base
                    state = both[0][2] if len(both) == 1 else None
            out.append((row.stretch, int(base), [x for line in lines for x in line], state, start))
        frame = pd.DataFrame(out, columns=["stretch", "base", "lines", "state", "start"])
        yield frame.astype({"state": "Int64", "start": "Int64"})


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state behind each stretch as a function of the state before it; settled where that is constant."""
    for batch in batches:
        found = [_triples(flat) for flat in batch["lines"]]
        found = [_simplified(*reversed(_grouped(lines))) if lines else [] for lines in found]
        yield pd.DataFrame({
            "stretch": batch["stretch"] + 1, "base": batch["stretch"],
            "lines": [[x for line in lines for x in line] for lines in found],
            "state": pd.array([lines[0][2] if len(lines) == 1 else None for lines in found], "Int64"),
            "start": pd.array([None] * len(found), "Int64"),
        })


def _dropped(rows: pd.DataFrame, span: int, stretch_rows: int) -> pd.DataFrame:
    """Rows of one stretch that are dropped, given the real flags before it (``state``)."""
    start = int(rows["stretch"].iloc[0]) * stretch_rows
    rows = rows[rows["j"] >= start].sort_values("j")
    full, at, state, gone = (1 << span) - 1, start, None, []
    for j, mask, before in zip(rows["j"].tolist(), rows["mask"].tolist(), rows["state"].tolist()):
        state = before if state is None else state
        gap = j - at
        state = full if gap >= span else ((state << gap) | ((1 << gap) - 1)) & full
        hit = bool(state & mask)
        if hit:
            gone.append(j)
        state = ((state << 1) | (not hit)) & full
        at = j + 1
    return pd.DataFrame({"idx": gone}, dtype="int64")


def _with(step, *values):
    """``step`` with its settings fixed now, as a function of one group or of batches."""
    return lambda rows: step(rows, *values)


_SCAN = "stretch bigint, base bigint, lines array<bigint>, state bigint, start bigint"


def states_before(masks: DataFrame, span: int, stretch_rows: int, limit: int) -> DataFrame:
    """``stretch, state``: the kept flags before each stretch that follows one with pairs.

    A parallel scan: every stretch is a function from the flags before it to those behind it. Most
    are constant and settle at once. The others are composed with the function before theirs, so
    that each round doubles how far they reach back, until they meet a settled one: as many rounds as the logarithm of
    the longest run of stretches that hang together. A stretch with too many outcomes is walked
    once the flags before it are settled.
    """
    lines = masks.groupBy("stretch").applyInPandas(
        _with(_outcomes, span, stretch_rows, limit), "stretch bigint, lines array<bigint>"
    )
    scan = written(lines.mapInPandas(_first_lines, _SCAN), "near-scan")
    while True:
        left = scan.agg(
            F.sum(F.col("state").isNull().cast("int")).alias("open"),
            F.sum((F.col("state").isNull() & F.col("start").isNotNull()).cast("int")).alias("to_walk"),
        ).first()
        if not left["open"]:
            return scan.select("stretch", "state")
        if left["to_walk"]:
            starts = scan.filter("state IS NULL AND start IS NOT NULL").select(
                F.col("base").alias("stretch"), F.col("start").alias("before")
            )
            walked = masks.join(starts, "stretch").groupBy("stretch").applyInPandas(
                _with(_passed_on, span, stretch_rows), "stretch bigint, walked bigint"
            )
            scan = scan.join(walked, "stretch", "left").select(
                "stretch", "base", "lines", F.coalesce("state", "walked").alias("state"), "start"
            )
            scan = written(scan, "near-scan")
        bases = scan.select(
            F.col("stretch").alias("of"), F.col("state").alias("base_state"),
            F.col("lines").alias("base_lines"), F.col("base").alias("base_base"), F.lit(True).alias("found"),
        )
        joined = scan.join(bases, F.col("base") == F.col("of"), "left").select(
            "stretch", "base", "lines", "state", F.coalesce("found", F.lit(False)).alias("found"), "base_state",
            F.coalesce("base_lines", F.array().cast("array<bigint>")).alias("base_lines"), "base_base",
        )
        scan = written(joined.mapInPandas(_with(_settled, span, limit), _SCAN), "near-scan")


def resolve(
    pairs: DataFrame, span: int = DEFAULTS.near_duplicate_span, stretch_rows: int = STRETCH,
    combinations: int = MOST_COMBINATIONS,
) -> DataFrame:
    """Positions to drop: j is dropped if some kept i < j pairs with it.

    The pairs shrink to one bit mask per row. Stretches of ``stretch_rows`` positions are worked
    out in parallel for every way the ``span`` rows before them may have turned out (for a run
    of copies that is at most ``span`` + 1 ways), the outcomes are composed by a parallel scan
    (``states_before``), and a second parallel pass marks the dropped rows. So a run of near-copies
    through the whole table does not serialise the work; the result is exact.
    """
    if span > 62:
        raise ValueError("span must fit a 64-bit mask")
    if stretch_rows < span:
        raise ValueError("a stretch must be at least as long as the span")
    bit = F.expr("shiftleft(1L, cast(j - i - 1 as int))")
    home = F.floor(F.col("j") / stretch_rows)
    near_end = F.col("j") >= (home + 1) * stretch_rows - span
    masks = written(
        pairs.groupBy("j").agg(F.bit_or(bit).alias("mask")).select(
            "j", "mask",
            F.explode(F.array_compact(F.array(home, F.when(near_end, home + 1)))).alias("stretch"),
        ),
        "near-masks",
    )
    states = masks.join(states_before(masks, span, stretch_rows, combinations), "stretch", "left").withColumn(
        "state", F.coalesce("state", F.lit((1 << span) - 1))
    )
    return states.groupBy("stretch").applyInPandas(_with(_dropped, span, stretch_rows), "idx bigint")


def _passed_on(rows: pd.DataFrame, span: int, stretch_rows: int) -> pd.DataFrame:
    """Flags behind one stretch walked with its real flags (``before``), under the next stretch's number."""
    stretch, state = int(rows["stretch"].iloc[0]), int(rows["before"].iloc[0])
    start = stretch * stretch_rows
    rows = rows[rows["j"] >= start].sort_values("j")
    ends = _walk(
        rows["j"].tolist(), rows["mask"].tolist(), start, start + stretch_rows, span,
        np.array([state], dtype=np.uint64),
    )
    return pd.DataFrame({"stretch": [stretch + 1], "walked": [int(ends[0])]})


def near_duplicates(
    df: DataFrame,
    text: str,
    order: Sequence[Column | str],
    threshold: float = DEFAULTS.near_duplicate_threshold,
    span: int = DEFAULTS.near_duplicate_span,
    keep_index: bool = False,
) -> DataFrame:
    """Exact dedupe, then greedy near-duplicate removal among the next ``span`` rows.

    A kept row removes the later rows it resembles; a removed row removes nobody. Positions are
    those after the exact dedupe and do not shift as rows drop.
    """
    first = exact(df, text, [F.col(o) if isinstance(o, str) else o for o in order])
    if threshold >= 1.0:  # only exact copies
        return first
    indexed = numbered(first, order, "idx")
    kept = indexed.join(resolve(near_pairs(indexed, text, threshold, span), span), "idx", "left_anti")
    return kept if keep_index else kept.drop("idx")


def clean_column(
    df: DataFrame, text: str, keep_raw: bool = True,
    max_length: int | None = DEFAULTS.max_headline_length,
) -> DataFrame:
    """Clean one text column, keeping the original as ``<text>_raw``; a missing column raises."""
    if text not in df.columns:
        raise ValueError(f"column {text!r} is not in {df.columns}")
    if keep_raw:
        df = df.withColumn(f"{text}_raw", F.col(text))
    return df.withColumn(text, clean(F.col(text), max_length))


def long_enough(
    df: DataFrame, text: str, min_length: int = DEFAULTS.min_headline_length
) -> DataFrame:
    """Drop texts shorter than ``min_length`` characters.

    A text that is computed is computed once: as a filter its expression would be evaluated for the filter and again
    for the column.
    """
    kept = F.filter(F.array(F.col(text)), lambda t: F.length(t) >= min_length)
    return df.select(*[F.explode(kept).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
