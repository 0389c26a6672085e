"""WARC: round trips of records and chunks, revisits, large payloads."""

import base64
import gzip
import hashlib

from chronoweave.llm import warc
from chronoweave.llm._store import Stage

SCHEMA = "page_id long, url string, html string"
PAGES = [(1, "http://a/x y\r\nZ: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "http://ü/", "x" * 1_000_000), (6, "u", "WARC/1.1\r\n\r\nWARC-Type: none\r\n\r\n"), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (None, "u", "lone"), (8, "u", "\r\n\r\n")]


def want(pages):
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = i is not None and last[h or ""] > i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    monkeypatch.setattr(warc, "SEGMENT", 200)
    df = spark.createDataFrame(PAGES, SCHEMA).withColumn("path", warc.F.lit(1)).withColumn("sha", warc.F.lit(2)).repartition(3)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == want(PAGES)


def test_chunks_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    segments = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), Stage(spark, "w"))
    rows = warc.read_archives(segments).collect()
    big = sorted((r for r in rows if r["page_id"] == 5), key=lambda r: r["chunk"])
    assert len(big) == 1000 and max(len(r["data"]) for r in big) == 1000 and [r["last"] for r in big].count(True) == 1
    sha = hashlib.sha1()
    for r in big:
        sha.update(r["data"])
        assert r["payload_digest"] == warc.b32(sha.digest())
    path = segments.first()["path"]
    raw = gzip.decompress(open(path.removeprefix("file:").replace("//", "/", 1), "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def test_unlike_payloads_of_one_page(spark):
    pages = [(7, "u", "AAAA"), (7, "u", "BBBBBB"), (9, "u", "AAAA"), (8, "u", "BBBBBB"), (9, "v", "AAAA")]
    digest = {h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in ("AAAA", "BBBBBB")}
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(pages, SCHEMA)).collect()), key=str)
    assert got == sorted([
        (7, 4, digest["AAAA"], "revisit", 9), (7, 6, digest["BBBBBB"], "revisit", 8), (8, 6, digest["BBBBBB"], "response", None),
        (9, 4, digest["AAAA"], "response", None), (9, 4, digest["AAAA"], "response", None)], key=str)


def test_lengths_come_from_the_chunks(spark):
    stage = Stage(spark, "w")
    chunks = warc.read_archives(warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), stage))
    short = chunks.where("page_id <> 5 OR chunk > 0")  # a chunk that is lost shows in the length
    got = {r["page_id"]: r["payload_bytes"] for r in warc.records(short, stage).collect()}
    assert got[5] == 1_000_000 - warc.CHUNK and got[8] == 4


def test_edges(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    short = warc.round_trip(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], SCHEMA), least=3)
    assert {r["record_type"] for r in short.collect()} == {"response"}
