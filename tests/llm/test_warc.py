import gzip
import hashlib

import pytest

from turfspark.llm import warc as W
from turfspark.llm._files import resolve
from turfspark.llm._store import scratch_path

SCHEMA = "page_id long, url string, html string, data string"


def brute(rows):
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        same = [j for j, _, k, _ in rows if j is not None and (k or "").encode() == p]
        best = max(same, default=None)
        revisit = len(p) >= 1000 and i is not None and best != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "é<p>x</p>\r\n\r\n" * 500
    rows = [
        (1, "http://a/\r\nX: y", long, "n"), (2, None, long, "n"), (3, "http://b", "short", "n"), (4, "http://b", "short", "n"), (5, "u", None, "n"),
        (6, "u", "", "n"), (None, "u", long, "n"), (7, "u", "z" * 999, "n"), (8, "u", "z" * 999, "n"), (9, "u", "y" * 1000, "n"), (10, "u", "y" * 1000, "n"),
        (11, "u", "WARC/1.1\r\n\r\n" * 9000, "n"), (2, None, long, "n"), (12, "u", "\x00\n" * 700, "n"),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    manifest = W.write(pages, scratch_path(spark, "warc"), split=500, file_bytes=3000, chunk=1024)
    got = W.read(manifest, chunk=700).collect()
    last = [tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got if r["last"]]
    assert sorted(last, key=str) == brute(rows)
    body = {}
    for r in sorted((r for r in got if r.page_id in (11, 12, 3, 5)), key=lambda r: (r.page_id, r.chunk_no)):
        assert len(r.data) <= 700
        body[r.page_id] = body.get(r.page_id, b"") + bytes(r.data)
    assert body == {i: (h or "").encode() for i, _, h, _ in rows if i in (11, 12, 3, 5)}
    small = W.round_trip(pages, scratch_path(spark, "warc")).drop("url").collect()
    assert sorted(map(tuple, small), key=str) == brute(rows)
    m = manifest.collect()
    assert sum(r.records for r in m) == len(rows) and len({r.file for r in m}) > 1
    with open(resolve(m[0].file)[1], "rb") as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_empty_and_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert W.round_trip(pages.limit(0), scratch_path(spark, "warc")).count() == 0
    rows = [(r.page_id, r.url, r.html, "") for r in pages.collect()]
    got = W.round_trip(pages, scratch_path(spark, "warc")).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_records_are_named_once_and_revisits_name_their_response(spark):
    long, to = "x" * 2000, scratch_path(spark, "warc")
    rows = [(1, "http://a", long, "n"), (5, "http://é b", long, "n"), (3, None, long, "n"), (3, None, long, "n"), (7, "u", "y" * 1500, "n"), (7, "u", "y" * 1500, "n"), (6, "v", "y" * 1500, "n"), (None, "u", long, "n")]
    manifest = W.write(spark.createDataFrame(rows, SCHEMA).repartition(3), to)
    raw = b""
    for f in {r.file for r in manifest.collect()}:
        with open(resolve(f)[1], "rb") as source:
            raw += gzip.decompress(source.read())
    heads = [W._fields(x.decode().split("\r\n")) for x in raw.split(b"WARC/1.1\r\n")[1:] for x in [b"\r\n" + x.partition(b"\r\n\r\n")[0]]]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(ids) and all(i.startswith("<urn:uuid:") for i in ids)
    assert sum(h["warc-type"] == "warcinfo" for h in heads) == len({r.file for r in manifest.collect()})
    named = {h["warc-record-id"]: h.get("x-page-id") for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 4 and all(h["warc-refers-to-date"] == W.DATE for h in revisits)
    for h in revisits:
        assert h["x-refers-to-page-id"] == ("7" if h["x-page-id"] == "6" else "5")
        assert h["warc-refers-to-target-uri"] == ("u" if h["x-page-id"] == "6" else "http://é%20b")
        assert named.get(h.get("warc-refers-to")) == (None if h["x-page-id"] == "6" else "5")  # 7 is there twice
    assert sorted(map(tuple, W.verified(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)


def test_a_revisit_without_its_response_is_an_error(spark):
    pages = spark.createDataFrame([(1, "u", "z" * 2000, "n"), (9, "u", "z" * 2000, "n")], SCHEMA)
    manifest = W.write(pages, scratch_path(spark, "warc"), split=1)
    assert W.verified(manifest).count() == 2
    rest = [s for s in manifest.collect() if all(r["page_id"] != 9 for r in W.records(W.opened(s.file, s.offset), s.length, payload=False))]
    with pytest.raises(OSError, match="page 9"):
        W.verified(spark.createDataFrame(rest, manifest.schema))


def test_a_huge_payload_is_never_held_again():
    """200 MB: what digests and chunks take beside the scanned batch is a few chunks."""
    import tracemalloc

    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["u"], "payload": pa.array(["é" * (100 << 20)], pa.string())})
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    sizes = [r for x in W.summaries(iter([b])) for r in x.to_pylist()]
    total, most = 0, 0
    for x in W.cuts(iter([b]), part=0):
        total += sum(len(d.as_buffer()) for d in x.column("data"))
        most = max(most, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 200 << 20 and sizes[0]["payload_bytes"] == total and len(sizes) == 1
    assert peak < 16 << 20 and most < 16 << 20
    for z in list(W.cuts(iter([b]), part=0))[-1:]:
        assert z.column("last").to_pylist()[-1] and z.column("payload_digest")[0].as_py() == sizes[0]["payload_digest"]


def test_tasks_read_several_splits(spark, monkeypatch):
    pages = spark.range(300).selectExpr("id page_id", "'u' url", "repeat(cast(id AS string), 300) html")
    manifest = W.write(pages, scratch_path(spark, "warc"), split=1)
    assert manifest.count() == 300 and W.read(manifest).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
