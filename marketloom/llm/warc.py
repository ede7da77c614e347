"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

A reader cannot trust the magic string, since payloads may hold it. Tasks read stretches between
magics and emit, for each, the offset of a candidate record and the offset at which its successor
would have to start (from its own Content-Length). Pointer jumping from the start of each file then
keeps the candidates on the chain: in round ``r`` every kept record also keeps the record ``2**r``
further on. A magic inside a payload is never on the chain. Records of one stretch are read at once;
those whose payload holds the magic are put together from their stretches in a second pass, when the
chain is known, so a candidate never holds bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.workspace import new_path, written

MAGIC = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
_RECORD = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits at a time are four base32 digits."""
    digest = F.sha1(text)
    groups = [
        F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)
    ]
    return F.translate(F.concat(*groups), _HEX_DIGITS, _BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line; left out where the value is null. Line breaks in values become spaces."""
    safe = F.regexp_replace(value, r"[\r\n]+", " ")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))).otherwise("")


def records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record (``value``) per row of ``page_id, url, html``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest ``page_id``
    are responses and the others revisit it. A null html is an empty payload; a null ``page_id`` counts
    as smaller than any other.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    # Only payloads that come more than once, written: few of them are joined without a shuffle of
    # the pages, and many by plain shuffles, in which a payload of many pages can be split.
    kept = written(
        rows.groupBy(F.col("digest").alias("of"), F.col("size").alias("of_size"))
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "copies",
    )
    told = rows.join(
        kept, (F.col("digest") == F.col("of")) & (F.col("size") == F.col("of_size")), "left"
    )
    copied = F.col("of").isNotNull() & (F.col("size") >= least_bytes)
    revisit = copied & ~F.col("page_id").eqNullSafe(F.col("keeper"))

    def name(page_id: Column) -> Column:
        return F.concat(F.lit(f"<{_RECORD}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"),
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    header = F.concat(
        F.lit(MAGIC.decode()),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("keeper")))),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return told.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write gzipped archives under ``path``, one for each task of the write."""
    records(pages, least_bytes).write.option("lineSep", _END.decode()).option(
        "compression", "gzip"
    ).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    lines = (line.partition(b":") for line in raw.split(b"\r\n"))
    return {n.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for n, _, v in lines}


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isascii() and value.isdigit() else None


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(_RECORD)
    return int(number) if number.lstrip("-").isdigit() else None


_CANDIDATE = (
    "file string, block bigint, at bigint, next bigint, stretch bigint, whole boolean, "
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, intact boolean"
)


def _described(file: str, block: int, at: int, raw: bytes) -> tuple[dict, int | None]:
    """A candidate from the bytes after its magic, and how many of them the record needs."""
    row = {"file": file, "block": block, "at": at, "next": -1, "stretch": 0, "whole": False}
    end = raw.find(_END)
    fields = _headers(raw[:end]) if end >= 0 else {}
    size = _number(fields.get("content-length"))
    if size is None or "warc-type" not in fields:
        return row, None
    row |= {
        "next": at + len(MAGIC) + end + 4 + size + len(_END), "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"], "page_id": _page(fields.get("warc-record-id")),
        "refers_to": _page(fields.get("warc-refers-to")), "_digest": fields.get("warc-payload-digest"),
    }
    return row, end + 4 + size


def _completed(row: dict, record: bytes) -> tuple[dict, bytes]:
    """Add what the payload tells; ``record`` runs from after the magic to the end of the block."""
    block = record[record.find(_END) + 4:]
    http, _, payload = block.partition(_END)
    stated = (row.pop("_digest") or "").removeprefix("sha1:")
    if row["record_type"] == "revisit":
        size, digest = _number(_headers(http).get("content-length")), stated
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    row |= {"whole": True, "payload_bytes": size, "payload_digest": digest, "intact": digest == stated}
    return row, payload


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """``file, block, at, bytes after the magic`` batch by batch; ``at`` is -1 before a file's first magic."""
    place, at = None, 0
    for batch in batches:
        found = []
        for raw, file, block in zip(*(batch.column(i) for i in range(3))):
            raw, here = raw.as_buffer().to_pybytes(), (file.as_py(), block.as_py())
            leading = here != place and here[1] == 0
            if here != place:
                place, at = here, 0
            found.append((*here, -1 if leading else at, raw))
            at += len(raw) + (0 if leading else len(MAGIC))
        yield found


def _candidates(with_payload: bool):
    """A candidate a stretch; it is whole if its record ends within the stretch."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(with_payload)
        for found in _stretches(batches):
            rows = []
            for file, block, at, raw in found:
                if at < 0:
                    row, size = {"file": file, "block": block, "at": at, "next": -1, "whole": False}, None
                else:
                    row, size = _described(file, block, at, raw)
                row["stretch"] = len(raw) + (len(MAGIC) if at >= 0 else 0)
                if size is not None and size <= len(raw):
                    row, payload = _completed(row, raw[:size])
                    row |= {"payload": payload} if with_payload else {}
                row.pop("_digest", None)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return task


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches again, by their place and with their magic."""
    for found in _stretches(batches):
        files, blocks, ats, raws = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([
            pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(ats, pa.int64()),
            pa.array([raw if at < 0 else MAGIC + raw for at, raw in zip(ats, raws)], pa.binary()),
        ], names=["file", "block", "at", "raw"])


def _assembled(with_payload: bool):
    """The record of one owner from its stretches."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        file, block, at = (pdf[c].iloc[0] for c in ("file", "block", "at"))
        record = b"".join(pdf["raw"])[len(MAGIC):]
        row, size = _described(file, int(block), int(at), record)
        if size is not None and size <= len(record):
            row, payload = _completed(row, record[:size])
            row |= {"payload": payload} if with_payload else {}
        names = [f.name for f in _arrow_schema(with_payload)]
        return pa.Table.from_pylist([{n: row.get(n) for n in names}], _arrow_schema(with_payload)).to_pandas(
            types_mapper={pa.int64(): pd.Int64Dtype()}.get
        )

    return one


def _arrow_schema(with_payload: bool) -> pa.Schema:
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in _CANDIDATE.split(", ")]
    schema = pa.schema([(n, types[t]) for n, t in fields])
    return schema.append(pa.field("payload", pa.binary())) if with_payload else schema


def on_chain(at: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Which candidates (sorted by offset) are reachable from offset 0, by pointer jumping."""
    kept = at == 0
    if not len(at) or not kept.any():
        return kept
    place = np.minimum(np.searchsorted(at, next_), len(at) - 1)
    jump = np.where(at[place] == next_, place, -1)
    while True:
        reached = jump[kept]
        reached = reached[reached >= 0]
        if kept[reached].all():
            return kept
        kept[reached] = True
        jump = np.where(jump >= 0, jump[jump], -1)


_CHAIN = "file string, block bigint, at bigint, start bigint, owner bigint, whole boolean"


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records on the chain of one file, and the stretches of those that are not whole.

    ``start`` is the place in the file, ``owner`` that of the record a stretch belongs to.
    """
    sizes = pdf.groupby("block")["stretch"].sum().sort_index()
    lift = pdf["block"].map((sizes.cumsum() - sizes).to_dict())
    some = pdf[pdf["at"] >= 0].assign(lift=lift)
    some = some.assign(start=some["at"] + some["lift"], to=some["next"] + some["lift"])
    some = some.sort_values("start", kind="stable")
    start = some["start"].to_numpy()
    records = some[on_chain(start, some["to"].to_numpy())]
    if not len(records):
        return pd.DataFrame({c.split(" ")[0]: [] for c in _CHAIN.split(", ")})
    at = np.searchsorted(records["start"].to_numpy(), start, "right") - 1
    some = some.assign(owner=records["start"].to_numpy()[at], whole=records["whole"].to_numpy()[at])
    some = some[(some["owner"] == some["start"]) | ~some["whole"].astype(bool)]
    return some[["file", "block", "at", "start", "owner", "whole"]]


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives under ``path`` that lie on their file's chain.

    Returns ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact`` and,
    if wanted, ``payload``. Size and digest of a response are taken from the payload itself
    (``intact``: they agree with its header); a revisit has no payload and states them.
    The chain of one file is followed in one task, on offsets alone. A record whose payload holds
    the magic spans several stretches; the archives are then read once more, and its stretches meet in
    the task of that record. A record on the chain that is not whole (the file is cut short) raises an error.
    """
    stretches = spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    schema = _CANDIDATE + (", payload binary" if with_payload else "")
    found = written(stretches.mapInArrow(_candidates(with_payload), schema), "candidates")
    chain = written(
        found.select("file", "block", "at", "next", "stretch", "whole").groupBy("file")
        .applyInPandas(_chains, _CHAIN),
        "chain",
    )
    key = ["file", "block", "at"]
    kept = found.join(chain.filter("whole"), key, "left_semi")
    spread = chain.filter("not whole").drop("whole")
    if not spread.isEmpty():
        pieces = stretches.mapInArrow(_pieces, "file string, block bigint, at bigint, raw binary")
        kept = kept.unionByName(
            pieces.join(spread, key).groupBy("file", "owner").applyInPandas(_assembled(with_payload), schema)
        )
    checked = F.when(F.col("whole"), F.col("record_type")).otherwise(
        F.raise_error(F.concat(F.lit("record not whole in "), F.col("file")))
    )
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"]
    return kept.withColumn("record_type", checked).select(*columns, *(["payload"] if with_payload else []))


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives to the shared folder and read them back.

    One row per row of ``pages``, repeated rows included: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, intact``. A null html is an empty payload; payloads of any length and
    with any number of magics come back whole; of equal payloads that of the largest ``page_id`` is the
    response (rows that share it all are). Extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, least_bytes)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"
    )
