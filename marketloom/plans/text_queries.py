"""Registered queries over headlines: columns, cleaning, hashing, near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import text as tx
from marketloom.operators import dedupe
from marketloom.plans.registry import query
from marketloom.plans.tables import FEED_SQL, HEADLINES_SQL, feed_entries, headlines, table
from marketloom.workspace import new_path
from marketloom.sources import headlines as hl
from marketloom.settings import DEFAULTS


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {_lit(tx.EDGES_PATTERN)}, '', 'g')"


def markup_sql(x: str) -> str:
    for pattern, by in ((tx.TAG_PATTERN, ""), (tx.URL_PATTERN, ""), (tx.SPECIAL_PATTERN, " ")):
        x = f"regexp_replace({x}, {_lit(pattern)}, '{by}', 'g')"
    return x


def prefix_sql(x: str) -> str:
    cases = " ".join(
        f"WHEN starts_with(lower({x}), '{p}') THEN substring({x}, {len(p) + 1})"
        for p in tx.NOISE_PREFIXES
    )
    return f"CASE {cases} ELSE {x} END"


def spaces_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {_lit(tx.SPACES_PATTERN)}, ' ', 'g'))"


def cleaned_sql(source: str, key: str, column: str) -> str:
    """CTEs that end in ``cleaned(key, raw, text)`` with whole cleaned texts."""
    return f"""
bare AS (SELECT {key}, {column} AS raw, {markup_sql(column)} AS t FROM {source}),
cleaned AS (SELECT {key}, raw, {spaces_sql('t2')} AS text
            FROM (SELECT {key}, raw, {prefix_sql('t')} AS t2 FROM bare))"""


WORDS_SQL = (
    f"list_filter(list_distinct(regexp_split_to_array({strip_sql('lower(text)')}, "
    f"{_lit(tx.SPACES_PATTERN)})), lambda w: w <> '')"
)


@query(
    "a3_column_aliases",
    "SELECT doc_id, text AS headline, CAST(NULL AS TIMESTAMP) AS date, 'UNKNOWN' AS ticker, source "
    "FROM documents",
)
def a3(spark, sf_dir):
    return hl.standardize(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query(
    "a4_column_defaults",
    "SELECT conv_id, turn, text AS headline, CAST(NULL AS TIMESTAMP) AS date, "
    "'UNKNOWN' AS ticker, 'kaggle' AS source FROM conversations",
)
def a4(spark, sf_dir):
    return hl.standardize(table(spark, sf_dir, "conversations"), keep=["conv_id", "turn"])


@query(
    "a4_date_parsing",
    "SELECT event_id, props AS headline, CASE WHEN event_type = 'error' THEN NULL ELSE ts END "
    "AS date, 'UNKNOWN' AS ticker, 'kaggle' AS source FROM events",
)
def a4_dates(spark, sf_dir):
    stamp = F.col("ts").cast("string")
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.col("props").alias(" Text "),
        F.when(F.col("event_type") == "error", F.concat(F.lit("about "), stamp))
        .otherwise(stamp).alias("Published"),
    )
    return hl.standardize(raw, keep=["event_id"])


@query(
    "a4_mixed_dates",
    "SELECT event_id, CASE WHEN event_id % 8 IN (3, 5) THEN date_trunc('day', ts) "
    "ELSE date_trunc('second', ts) END AS date FROM events",
)
def a4_mixed(spark, sf_dir):
    """The instants of events, written in eight ways and zones; two of them name the day alone."""
    def shown(pattern, hours=0):
        return F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), pattern)

    kind = F.col("event_id") % 8
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.col("props").alias("text"),
        F.when(kind == 0, F.concat(shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 1, F.concat(shown("yyyy-MM-dd HH:mm:ss", -4), F.lit("-04:00")))
        .when(kind == 2, F.concat(shown("EEE, d MMM yyyy HH:mm:ss", -5), F.lit(" EST")))
        .when(kind == 3, shown("MM/dd/yyyy"))
        .when(kind == 4, shown("MMMM d, yyyy h:mm:ss a"))
        .when(kind == 5, shown("yyyyMMdd"))
        .when(kind == 6, F.concat(shown("dd MMM yyyy HH:mm:ss", 2), F.lit(" +0200")))
        .otherwise(shown("yyyy/MM/dd HH:mm:ss")).alias("published"),
    )
    return hl.standardize(raw, keep=["event_id"]).select("event_id", "date")


_DATE_FORMS = (
    # pattern, hours its clock is ahead of UTC, text behind it, the part that it names
    ("yyyy-MM", 0, "", "month"), ("MMM yyyy", 0, "", "month"), ("yyyy", 0, "", "year"),
    ("yyyy-MM-dd ha", 0, "", "hour"), ("yyyy-MM-dd'T'HH", 0, "", "hour"),
    ("yyyyMMdd'T'HHmmss", 0, "Z", "second"), ("yyyyMMddHHmmss", 0, "", "second"),
    ("MMM-dd-yyyy", 0, "", "day"), ("ddMMMyyyy", 0, "", "day"),
    ("EEE, dd MMM yyyy HH:mm:ss", 5, " GMT+0500", "second"), ("EEE MMM d HH:mm:ss 'EST' yyyy", -5, "", "second"),
    ("d MMMM yyyy 'at' h:mm a", 1, " CET", "minute"), ("yyyy-MM-dd HH:mm", 9, " JST", "minute"),
    ("EEE, dd MMM yyyy HH:mm:ss", 0, " QQT", None), ("yyyy.MM.dd HH:mm:ss", 2, "+02:00", "second"),
)


@query(
    "a4_date_forms",
    f"SELECT event_id, CASE event_id % {len(_DATE_FORMS)} "
    + " ".join(
        f"WHEN {at} THEN " + (f"date_trunc('{part}', ts)::TIMESTAMP" if part else "NULL")
        for at, (_, _, _, part) in enumerate(_DATE_FORMS)
    ) + " END AS date FROM events",
)
def a4_forms(spark, sf_dir):
    """The instants of events, each written in one of many forms; a form names the instant up to a part."""
    kind, shown = F.col("event_id") % len(_DATE_FORMS), F.lit(None)
    for at, (pattern, hours, behind, _) in enumerate(_DATE_FORMS):
        there = F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), pattern)
        shown = F.when(kind == at, F.concat(there, F.lit(behind))).otherwise(shown)
    raw = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"), shown.alias("published"))
    return hl.standardize(raw, keep=["event_id"]).select("event_id", "date")


@query("a15_references", "SELECT doc_id, text AS headline FROM documents")
def a15_references(spark, sf_dir):
    """Whole texts with their accents, capitals and ampersands written as character references."""
    written_out = F.col("text")
    for character, reference in (
        ("&", "&amp;"), ("é", "&eacute;"), ("è", "&#232;"), ("ü", "&#xFC;"), ("ñ", "&ntilde"),
        ("T", "&#84;"), ("ß", "&#XdF;"), ("!", "&excl;"),
    ):
        written_out = F.replace(written_out, F.lit(character), F.lit(reference))
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.html_to_text(written_out).alias("headline")
    )


def _landed_csv(spark, sf_dir, header):
    """Documents as Latin-1 files: a label, the text and the source."""
    label = F.element_at(F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative")),
                         (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        label.alias("sentiment"), F.col("text").alias("headline"), "source",
        F.col("doc_id").cast("string").alias("number"),
    )
    path = new_path(spark, "csv")
    rows.write.option("encoding", "ISO-8859-1").option("header", header).option("escape", '"').option(
        "quoteAll", True
    ).csv(path)
    return hl.scan_csv(spark, path, multi_line=True)


_CSV_SQL = """SELECT CAST(doc_id AS VARCHAR) AS number, text AS headline, source,
  ['positive', 'neutral', 'negative'][doc_id % 3 + 1] AS sentiment FROM documents"""


@query("a1_headline_csv", _CSV_SQL)
def a1(spark, sf_dir):
    return _landed_csv(spark, sf_dir, True).select("number", "headline", "source", "sentiment")


@query("a2_headerless_csv", _CSV_SQL)
def a2(spark, sf_dir):
    """The same rows without a header line: columns are found by their place."""
    return _landed_csv(spark, sf_dir, False).select(
        F.col("col_3").alias("number"), "headline", F.col("col_2").alias("source"), "sentiment"
    )


@query(
    "a5_basic_clean",
    f"WITH {HEADLINES_SQL} SELECT min(doc_id) AS doc_id, headline FROM headlines "
    "WHERE length(headline) >= 10 GROUP BY headline",
)
def a5(spark, sf_dir):
    rows = headlines(spark, sf_dir)
    return hl.basic_clean(rows, [F.col("doc_id")]).select("doc_id", "headline")


@query(
    "a6_multi_file_union",
    """WITH files AS (
      SELECT 0 AS f, text, 'UNKNOWN' AS ticker, source FROM documents
      UNION ALL SELECT 1, text, 'UNKNOWN', 'kaggle' FROM benchmark
      UNION ALL SELECT 2, text, 'UNKNOWN', 'kaggle' FROM conversations)
    SELECT text AS headline, CAST(NULL AS TIMESTAMP) AS date, ticker, source FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY f, source) AS r FROM files
      WHERE length(text) >= 10) WHERE r = 1""",
)
def a6(spark, sf_dir):
    names = ("documents", "benchmark", "conversations")
    return hl.union_files([hl.standardize(table(spark, sf_dir, n)) for n in names])


@query(
    "a5_file_order",
    """SELECT headline, source, date FROM (
      SELECT 'headline number ' || doc_id % 97 AS headline, source,
        TIMESTAMP '2024-01-01' - to_days(CAST(doc_id AS INTEGER)) AS date,
        row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
)
def a5_file_order(spark, sf_dir):
    """Landed files in which every further copy of a headline has an earlier date: the first in the files stays."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("headline number "), (F.col("doc_id") % 97).cast("string")).alias("title"),
        F.date_format(F.expr("date'2024-01-01' - make_dt_interval(cast(doc_id as int))"), "MMM d, yyyy").alias("published"),
        "source",
    )
    path = new_path(spark, "ordered csv")
    rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.option(
        "header", True).csv(path)
    return hl.load(spark, path).select("headline", "source", "date")


@query(
    "a6_files_in_order",
    """SELECT headline, source FROM (
      SELECT 'headline number ' || doc_id % 97 AS headline, source,
        row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id % 2 DESC, doc_id) AS r FROM documents) WHERE r = 1""",
)
def a6_files_in_order(spark, sf_dir):
    """Odd documents landed as one set of files, even ones as the next; the earlier set and line wins."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("headline number "), (F.col("doc_id") % 97).cast("string")).alias("title"), "source"
    )
    paths = [new_path(spark, "csv") for _ in range(2)]
    for odd, path in zip((1, 0), paths):
        rows.filter(F.col("doc_id") % 2 == odd).repartitionByRange(3, "doc_id").sortWithinPartitions(
            "doc_id").drop("doc_id").write.option("header", True).csv(path)
    return hl.load_many(spark, [*paths, new_path(spark, "missing")]).select("headline", "source")


@query(
    "b1_blank_guard",
    f"SELECT conv_id, turn, CASE WHEN text IS NULL OR {strip_sql('text')} = '' THEN '' "
    "ELSE text END AS text FROM (SELECT conv_id, turn, "
    "CASE WHEN role = 'user' THEN text WHEN turn = 1 THEN ' ' || chr(160) END AS text "
    "FROM conversations)",
)
def b1(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    gaps = F.when(F.col("role") == "user", F.col("text")).when(F.col("turn") == 1, " \u00a0")
    return talk.select("conv_id", "turn", tx.blank_to_empty(gaps).alias("text"))


@query("b2_strip_markup", f"SELECT page_id, {markup_sql('html')} AS text FROM pages")
def b2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.strip_markup(F.col("html")).alias("text"))


_PREFIXED = (
    "CASE lang WHEN 'en' THEN 'BREAKING: ' WHEN 'fr' THEN 'Update:' "
    "WHEN 'de' THEN 'Breaking News: Alert:' ELSE '' END || text"
)


@query(
    "b3_noise_prefix",
    f"SELECT doc_id, {prefix_sql('t')} AS text FROM (SELECT doc_id, {_PREFIXED} AS t "
    "FROM documents)",
)
def b3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.drop_noise_prefix(F.expr(_PREFIXED)).alias("text")
    )


@query("b4_collapse_spaces", f"SELECT doc_id, {spaces_sql('text')} AS text FROM documents")
def b4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.collapse_spaces(F.col("text")).alias("text"))


@query("b5_truncate", "SELECT doc_id, substring(text, 1, 512) AS text FROM documents")
def b5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    limit = DEFAULTS.max_headline_length
    return docs.select("doc_id", F.substring("text", 1, limit).alias("text"))


@query(
    "b6_clean_column",
    f"WITH {cleaned_sql('documents', 'doc_id', 'text')} "
    "SELECT doc_id, raw AS headline_raw, substring(text, 1, 512) AS headline FROM cleaned",
)
def b6(spark, sf_dir):
    return dedupe.clean_column(headlines(spark, sf_dir), "headline").select(
        "doc_id", "headline_raw", "headline"
    )


@query(
    "b6_clean_pages",
    f"WITH {cleaned_sql('pages', 'page_id', 'html')} SELECT page_id, text FROM cleaned",
)
def b6_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.clean(F.col("html"), max_length=None).alias("text"))


@query(
    "b7_min_length",
    f"WITH {cleaned_sql('documents', 'doc_id', 'text')} "
    "SELECT doc_id, substring(text, 1, 512) AS headline FROM cleaned WHERE length(text) >= 10",
)
def b7(spark, sf_dir):
    cleaned = dedupe.clean_column(headlines(spark, sf_dir), "headline", keep_raw=False)
    return dedupe.long_enough(cleaned, "headline").select("doc_id", "headline")


@query(
    "b8_exact_dedupe",
    "SELECT min(doc_id) AS doc_id, text AS headline FROM documents GROUP BY text",
)
def b8(spark, sf_dir):
    rows = headlines(spark, sf_dir)
    return dedupe.exact(rows, "headline", [F.col("doc_id")]).select("doc_id", "headline")


_STORIES_SQL = f"""
stories AS (
  SELECT 0 AS priority, doc_id AS id, text AS headline FROM documents
  UNION ALL SELECT 1, item_id, '  ' || text || ' ' FROM benchmark
  UNION ALL SELECT 2, conv_id * 1000 + turn, text FROM conversations),
hashed AS (SELECT *, md5({strip_sql('lower(headline)')}) AS hash FROM stories)"""


def stories(spark, sf_dir):
    """Headlines of three sources in one table, with the priority of their source."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit(0).alias("priority"), F.col("doc_id").alias("id"), F.col("text").alias("headline")
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.lit(1).alias("priority"), F.col("item_id").alias("id"),
        F.concat(F.lit("  "), "text", F.lit(" ")).alias("headline"),
    )
    talk = table(spark, sf_dir, "conversations").select(
        F.lit(2).alias("priority"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("headline"),
    )
    return docs.unionByName(items).unionByName(talk)


@query(
    "b9_hash_dedupe",
    f"WITH {_STORIES_SQL} SELECT priority, id, hash FROM (SELECT *, row_number() OVER "
    "(PARTITION BY hash ORDER BY priority, id) AS r FROM hashed) WHERE r = 1",
)
def b9(spark, sf_dir):
    rows = dedupe.by_hash(
        stories(spark, sf_dir), "headline", F.col("priority"), [F.col("id")], name="hash"
    )
    return rows.select("priority", "id", "hash")


@query(
    "b10_word_jaccard",
    f"""WITH words AS (SELECT conv_id, turn, {WORDS_SQL} AS w FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0e0 ELSE
      len(list_intersect(a.w, b.w))
        / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) END, 6) AS jaccard
    FROM words a JOIN words b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def b10(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.word_set(F.col("text")).alias("words")
    )
    following = words.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words")
    )
    return words.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.round(tx.set_jaccard(F.col("words"), F.col("next_words")), 6).alias("jaccard"),
    )


# Alphabetical order puts near-copies next to each other.
_INDEXED_SQL = f"""
firsts AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text),
indexed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY text) - 1 AS idx, doc_id,
            {WORDS_SQL} AS w FROM firsts),
pairs AS MATERIALIZED (
  SELECT a.idx AS i, b.idx AS j,
         len(list_intersect(a.w, b.w))
           / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) AS jaccard
  FROM indexed a JOIN indexed b ON b.idx > a.idx AND b.idx <= a.idx + 49
   AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) AND len(a.w) > 0)"""


def _indexed_documents(spark, sf_dir):
    firsts = dedupe.exact(headlines(spark, sf_dir), "headline", [F.col("doc_id")])
    return dedupe.numbered(firsts.select("doc_id", "headline"), ["headline"], "idx")


@query(
    "b11_near_pairs",
    f"WITH {_INDEXED_SQL} SELECT i, j, round(jaccard, 6) AS jaccard FROM pairs "
    "WHERE jaccard >= 0.95",
)
def b11_pairs(spark, sf_dir):
    pairs = dedupe.near_pairs(_indexed_documents(spark, sf_dir), "headline")
    return pairs.select("i", "j", F.round("jaccard", 6).alias("jaccard"))


def _greedy_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE {_INDEXED_SQL},
    preds AS (SELECT j, list(i) AS p FROM pairs WHERE jaccard >= {threshold} GROUP BY j),
    nodes AS MATERIALIZED (SELECT d.idx, q.p FROM indexed d LEFT JOIN preds q ON q.j = d.idx),
    walk(idx, kept) AS (
      SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)]
      UNION ALL
      SELECT x.idx, CASE WHEN x.p IS NOT NULL AND list_has_any(w.kept, x.p) THEN w.kept
                    ELSE list_append(w.kept, x.idx) END
      FROM walk w JOIN nodes x ON x.idx = w.idx + 1)
    SELECT doc_id FROM indexed JOIN (SELECT unnest(kept) AS idx FROM walk
      WHERE idx = (SELECT max(idx) FROM indexed)) USING (idx)"""


@query("b11_near_duplicates", _greedy_sql(0.95))
def b11(spark, sf_dir):
    rows = headlines(spark, sf_dir)
    return dedupe.near_duplicates(rows, "headline", ["headline", "doc_id"]).select("doc_id")


@query("b11_near_duplicates_loose", _greedy_sql(0.8))
def b11_loose(spark, sf_dir):
    rows = headlines(spark, sf_dir)
    return dedupe.near_duplicates(
        rows, "headline", ["headline", "doc_id"], threshold=0.8
    ).select("doc_id")


@query("b12_preview", "SELECT doc_id, substring(text, 1, 80) AS preview FROM documents")
def b12(spark, sf_dir):
    return headlines(spark, sf_dir).select("doc_id", tx.preview(F.col("headline")).alias("preview"))


# The references that titles of the given pages can hold; the ampersand comes last.
_TITLE_REFERENCES = (
    ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?|&#x27;?|&apos;", "'"),
    ("&nbsp;?", "\u00a0"), ("&amp;?", "&"),
)


def html_text_sql(x: str) -> str:
    x = f"regexp_replace({x}, {_lit(tx.TAG_PATTERN)}, '', 'g')"
    for reference, character in _TITLE_REFERENCES:
        x = f"regexp_replace({x}, {_lit(reference)}, {_lit(character)}, 'g')"
    return x


@query("a15_title_text", f"WITH {FEED_SQL} SELECT page_id, {html_text_sql('title')} AS headline FROM feed")
def a15(spark, sf_dir):
    return feed_entries(spark, sf_dir).select(
        "page_id", tx.html_to_text(F.col("title")).alias("headline")
    )


@query(
    "a18_symbol",
    "SELECT p_partkey, upper(replace(split_part(p_name || '-' || p_brand || '.' || p_type, '.', 1),"
    " '-', '')) AS symbol FROM part",
)
def a18(spark, sf_dir):
    raw = F.concat_ws("-", "p_name", F.concat_ws(".", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.symbol(raw).alias("symbol"))
