import base64
import hashlib

import numpy as np
import pytest

from marketloom.llm import warc

EVIL = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nzz"
GREEDY = EVIL + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 500000\r\n\r\nhello"
PAGES = [
    (1, "u", EVIL), (2, "u\r\nWARC-Type: x", GREEDY), (3, None, None), (4, "a", ""), (5, "b", "WARC/1.1\r\n"),
    (6, "u", EVIL), (None, "u", EVIL), (7, "é", "é\r\n\r\n"), (8, "c", "y" * 300_000), (9, "c", "plain"), (9, "c", "plain"),
]


@pytest.fixture
def pages(spark):
    frame = spark.createDataFrame([(*p, 0, 0) for p in PAGES], "page_id long, url string, html string, at int, file int")
    return frame.coalesce(2)


def expected():
    best = {}
    for page_id, _, html in PAGES:
        best[html or ""] = max(best.get(html or "", -1), page_id if page_id is not None else -1)
    out = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        first = page_id == best[html or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "response" if first else "revisit", None if first else best[html or ""]))
    return sorted(out, key=repr)


def test_round_trip(pages):
    rows = warc.archived(pages).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == expected()
    assert all(r.intact for r in rows)


def test_payloads_come_back(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/a")
    rows = warc.read_archives(spark, f"file://{tmp_path}/a", with_payload=True).collect()
    want = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(bytes(r.payload) == want[r.page_id] for r in rows if r.record_type == "response")


def test_split_plain_files(spark, pages, tmp_path):
    """Stretches of one large plain file are read by many tasks."""
    rows = warc.records(pages.filter("page_id in (7, 9)").crossJoin(spark.range(400)))
    rows.coalesce(1).write.option("lineSep", "\r\n\r\n").text(f"file://{tmp_path}/b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = warc.read_archives(spark, f"file://{tmp_path}/b")
        assert read.count() == 1200 and read.filter("not intact").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_least_bytes(pages):
    kinds = [(r.page_id, r.record_type) for r in warc.archived(pages, least_bytes=6).collect()]
    assert (3, "response") in kinds and (4, "response") in kinds and (1, "revisit") in kinds


def test_a_cut_file_is_an_error(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort"
    (tmp_path / "c.warc").write_bytes(head.encode())
    with pytest.raises(Exception, match="not whole"):
        warc.read_archives(spark, f"file://{tmp_path}/c.warc").collect()


def test_a_page_of_ten_thousand_false_headers(spark, tmp_path):
    """Each claims more than the rest of the file; none of them holds bytes or ends up on the chain."""
    false = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9000000\r\n\r\n" + "z" * 40
    pages = spark.createDataFrame(
        [(1, "a", false * 10_000), (2, "b", "plain"), (3, "c", "x" + false * 3), (4, "a", false * 10_000)],
        "page_id long, url string, html string",
    ).coalesce(1)
    rows = {r.page_id: r for r in warc.archived(pages).collect()}
    body = (false * 10_000).encode()
    assert len(rows) == 4 and all(r.intact for r in rows.values())
    assert (rows[4].record_type, rows[4].payload_bytes) == ("response", len(body))
    assert (rows[1].record_type, rows[1].refers_to, rows[1].payload_bytes) == ("revisit", 4, len(body))
    assert rows[4].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert rows[3].payload_bytes == 1 + 3 * len(false)


def test_false_headers_in_split_plain_files(spark, tmp_path):
    """A record whose stretches are read by several tasks is put together."""
    html = "é" + EVIL * 200
    pages = spark.createDataFrame([(k, None, f"{k} {html}") for k in range(5)], "page_id long, url string, html string")
    warc.records(pages).coalesce(1).write.option("lineSep", "\r\n\r\n").text(f"file://{tmp_path}/d")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = warc.read_archives(spark, f"file://{tmp_path}/d", with_payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.page_id: bytes(r.payload).decode() for r in rows} == {k: f"{k} {html}" for k in range(5)}


def test_chain_equals_walking():
    rng = np.random.default_rng(1)
    for _ in range(50):
        at = np.unique(rng.integers(0, 400, 60)) * (rng.random() < 0.9)
        at = np.unique(np.append(at, 0))
        to = np.where(rng.random(len(at)) < 0.8, at[np.minimum(np.arange(len(at)) + rng.integers(1, 4, len(at)), len(at) - 1)], 999)
        to = np.where(to > at, to, 999)
        kept, here = set(), 0
        while here in at:
            kept.add(here)
            here = int(to[np.searchsorted(at, here)])
        assert set(at[warc.on_chain(at, to)].tolist()) == kept


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
