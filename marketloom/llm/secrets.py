"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

Only DataFrame functions are used. Positions of matches follow from the lengths of the stretches
between them, counted in code points.

Besides the three patterns, each long token of letters and digits is a candidate. Its encoding is
inferred from its characters; under the hypothesis that its symbols are drawn evenly from that
alphabet, three tests are made:

* chi-squared on the symbol counts (Wilson-Hilferty, so that it also holds for few symbols),
* the number of runs below and above the middle of the alphabet,
* the serial correlation of neighbouring symbols.

Fisher's method combines the three. What words and identifiers leave is rejected at a false-discovery
rate controlled by Benjamini and Hochberg within each encoding and length class of the whole corpus,
since the power of the tests depends on both; tokens that are not rejected are reported as ``random``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.names import fresh
from marketloom.workspace import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A run that is too short matches nothing further in, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST_ASSIGNED = 12
FALSE_DISCOVERIES = 0.05
_BINS = 400
_BINS_A_NATS = 20.0

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings from the narrowest alphabet to the widest.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "hex upper": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36 upper": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64 url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}


def _hits(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """Matches of ``pattern`` as structs: kind, number, stretch before, length, kept or not, token."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(found.alias("whole"), inner.alias("inner"), between.alias("gap"))
    rows = F.filter(rows, lambda r: r["whole"].isNotNull())

    def row(r: Column, at: Column) -> Column:
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), at.alias("at"),
            F.char_length(r["gap"]).alias("gap"), F.char_length(r["whole"]).alias("size"),
            (F.lit(True) if keep is None else keep(r["inner"])).alias("keep"),
            (r["whole"] if kind == "random" else F.lit(None).cast("string")).alias("token"),
        )

    none = F.expr(
        "cast(array() as array<struct<kind:int,at:int,gap:int,size:int,keep:boolean,token:string>>)"
    )
    return F.when(text.rlike(pattern), F.transform(rows, row)).otherwise(none)


def _candidate(token: Column) -> Column:
    """A token is tested if it has a digit and a letter."""
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def hits(docs: DataFrame) -> DataFrame:
    """Every match in every text as ``row, doc_id, hits``; one row per row of ``docs``."""
    text = F.col("text")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select(
        "row", "doc_id",
        F.concat(
            _hits(text, ASSIGN, "assign", lambda t: F.char_length(t) >= LEAST_ASSIGNED, 2),
            _hits(text, ACCESS, "access"),
            _hits(text, HEX, "hex"),
            _hits(text, TOKEN, "random", _candidate),
        ).alias("hits"),
    )


def _upper_normal(z: Column) -> Column:
    """Upper tail of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (
        1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _alphabet(token: Column) -> Column:
    """The narrowest alphabet that holds all characters of a token."""
    chosen = None
    for letters in ALPHABETS.values():
        fits = F.translate(token, letters, "") == ""
        chosen = F.when(fits, F.lit(letters)) if chosen is None else chosen.when(fits, F.lit(letters))
    return chosen.otherwise(F.lit(ALPHABETS["mixed"]))


def with_p_values(tokens: DataFrame) -> DataFrame:
    """Add ``family`` (alphabet size and length class) and ``p``, small for uneven tokens."""
    body = F.regexp_replace("token", "=+$", "")
    rows = tokens.withColumn("_body", body).withColumn("_letters", _alphabet(F.col("_body")))
    rows = rows.withColumns({
        "_n": F.char_length("_body").cast("double"),
        "_k": F.char_length("_letters").cast("double"),
        "_x": F.transform(
            F.filter(F.split("_body", ""), lambda c: c != ""),
            lambda c: (F.instr(F.col("_letters"), c) - 1).cast("double"),
        ),
        "_squares": F.aggregate(
            F.filter(F.split("_letters", ""), lambda c: c != ""), F.lit(0.0),
            lambda total, c: total + F.pow(
                F.col("_n") - F.char_length(F.replace(F.col("_body"), c, F.lit(""))), F.lit(2.0)
            ),
        ),
    })
    n, k = F.col("_n"), F.col("_k")
    middle = (k - 1) / 2
    pairs = F.zip_with(
        F.slice("_x", F.lit(1), F.size("_x") - 1), F.slice("_x", F.lit(2), F.size("_x") - 1),
        lambda a, b: F.struct(
            F.when((a > middle) != (b > middle), 1.0).otherwise(0.0).alias("turn"),
            ((a - middle) * (b - middle)).alias("product"),
        ),
    )
    rows = rows.withColumn("_sums", F.aggregate(
        pairs, F.struct(F.lit(0.0).alias("turn"), F.lit(0.0).alias("product")),
        lambda s, p: F.struct(
            (s["turn"] + p["turn"]).alias("turn"), (s["product"] + p["product"]).alias("product")
        ),
    ))
    free = k - 1
    uneven = (
        F.pow((k / n * F.col("_squares") - n) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))
    ) / F.sqrt(2 / (9 * free))
    turns = (F.col("_sums.turn") - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = F.col("_sums.product") / ((k * k - 1) / 12) / F.sqrt(n - 1)
    least = F.lit(1e-300)
    log_p = (
        F.log(F.greatest(_upper_normal(uneven), least))
        + F.log(F.greatest(2 * _upper_normal(F.abs(turns)), least))
        + F.log(F.greatest(2 * _upper_normal(F.abs(serial)), least))
    )
    half = -F.least(log_p, F.lit(0.0))
    return rows.select(
        *tokens.columns,
        F.concat_ws(" ", k.cast("int").cast("string"),
                    F.floor(F.log2(n)).cast("string")).alias("family"),
        (F.exp(-half) * (1 + half + half * half / 2)).alias("p"),
    )


def _bin(p: Column) -> Column:
    """Bins of -log p, the last for everything beyond."""
    return F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * _BINS_A_NATS), F.lit(_BINS))


def rejection_bins(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``family, from_bin``: from which bin of p on randomness is rejected.

    Benjamini-Hochberg on counts by bin; a family without a rejection has no row. The table has at
    most one row per family.
    """
    from_small = Window.partitionBy("family").orderBy(F.desc("bin"))
    counts = tested.groupBy("family", _bin(F.col("p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = Window.partitionBy("family")
    upper = F.exp(-F.col("bin") / _BINS_A_NATS)
    return (
        counts.withColumn("below", F.sum("n").over(from_small))
        .withColumn("m", F.sum("n").over(total))
        .filter(upper <= F.col("below") / F.col("m") * rate)
        .groupBy("family").agg(F.min("bin").alias("from_bin"))
    )


_NOTHING = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans(docs: DataFrame) -> DataFrame:
    """``row, doc_id, spans`` of every row: sorted structs of start, kind number and end."""
    rows = written(hits(docs), "hits")
    found = rows.filter(F.size("hits") > 0).select("row", "doc_id", F.inline("hits"))
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = found.withColumn(
        "end", F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(so_far)
    ).withColumn("start", F.col("end") - F.col("size"))
    is_token = F.col("kind") == KINDS.index("random")
    tested = written(
        with_p_values(found.filter(is_token & F.col("keep")).select("row", "at", "token"))
        .drop("token"),
        "tested",
    )
    random = tested.join(rejection_bins(tested), "family", "left").filter(
        F.col("from_bin").isNull() | (_bin(F.col("p")) < F.col("from_bin"))
    ).select("row", "at", F.lit(True).alias("passed"))
    span = F.struct("start", "kind", "end")
    base = placed.filter(~is_token).select("row", "doc_id", F.when(F.col("keep"), span).alias("s"))
    added = placed.filter(is_token).join(random, ["row", "at"], "left").select(
        "row", "doc_id", F.when(F.coalesce("passed", F.lit(False)), span).alias("s")
    )
    by_row = base.unionByName(added).groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_list("s")).alias("spans")
    )
    rest = rows.filter(F.size("hits") == 0).select(
        "row", "doc_id", F.expr(f"cast(array() as {_NOTHING})").alias("spans")
    )
    return by_row.unionByName(rest)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )))


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``docs``.

    A null text counts as empty: no spans, and the digest of the empty string. Repeated rows and rows
    with a null ``doc_id`` each get their own result. Texts of any length are scanned whole. Extra
    columns are ignored; an empty table gives an empty result.
    """
    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    return spans(docs).select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def without_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch covered by spans in ``text`` replaced by ``mask``.

    Null and clean texts stay as they are; ``n_chars``, where there is such a column, is set to the new
    length of changed texts. Repeated rows are treated each on its own.
    """
    row, changed, listed = (fresh(docs, n) for n in ("_row", "_changed", "_spans"))
    rows = docs.select(
        "*", F.monotonically_increasing_id().alias(row)
    ).withColumn("text", F.col("text").cast("string"))
    stored = written(rows, "texts")
    found = _spans_of_stored(stored, row, listed)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    size = F.char_length("text").cast("bigint")

    def step(state: Column, s: Column) -> Column:
        low, high = F.greatest(state["at"], s["start"]), F.greatest(state["at"], s["end"])
        before = F.substring(
            F.col("text"), (state["at"] + 1).cast("int"), (low - state["at"]).cast("int")
        )
        covered = s["end"] <= state["at"]
        joined = (s["start"] < state["at"])
        return F.when(covered, state).otherwise(F.struct(
            high.alias("at"),
            F.when(joined, state["out"]).otherwise(F.concat(state["out"], before, F.lit(mask)))
            .alias("out"),
        ))

    masked = F.aggregate(
        listed, start, step,
        lambda s: F.concat(s["out"], F.substring(
            F.col("text"), (s["at"] + 1).cast("int"), (size - s["at"]).cast("int")
        )),
    )
    out = stored.join(found, row, "left").withColumn(
        changed, F.coalesce(F.size(listed) > 0, F.lit(False)) & F.col("text").isNotNull()
    ).withColumn("text", F.when(F.col(changed), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.col(changed), F.char_length("text").cast(docs.schema["n_chars"].dataType)
        ).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _spans_of_stored(stored: DataFrame, row: str, listed: str) -> DataFrame:
    """Row number and spans of the rows of a written table that have any."""
    return spans(stored.select(F.col(row).alias("doc_id"), "text")).filter(
        F.size("spans") > 0
    ).select(F.col("doc_id").alias(row), F.col("spans").alias(listed))
