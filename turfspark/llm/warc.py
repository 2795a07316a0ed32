"""WARC archives as chunked record tables.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, both ways: payloads are cut
where they are scanned, the cuts shuffled, sorted within partitions and streamed into gzip members, so that no
task but the scan's holds a whole record, and that one once. Digests are carried from chunk to chunk. ``write``
gives every page a record, one gzip member each, in files of the shared folder that begin with a ``warcinfo``
record; ``read`` streams members back into chunk rows. Files are named by task attempt and only those in the
manifest (a small table written from the finished tasks) count, so lost or repeated attempts leave nothing that
is read. The manifest has the offset of every ``SPLIT`` bytes of records: large files are read by many tasks, and
a task reads splits of about ``PART_BYTES`` together.

Records with equal payloads of at least ``LEAST`` bytes are stored once: the one with the largest page id is the
response, the others revisit it and hold no payload, only the HTTP header with its length. That is decided on
narrow rows of a first pass: page id, url, length and digest. Reading checks lengths and digests of payloads, and
``verified`` that every revisit's response is there with the length and digest that the revisit states.

Record ids are UUIDs by name, of the page id, the digest and, where rows are repeated, the row's place in the scan;
the page id is in a field of its own. A revisit of a response whose row is repeated names it by page id, URI and
date only.

Edge cases: a null payload is empty; pages without an id are responses and are never referred to; repeated
rows of one page id and payload are all responses; control characters in a url are percent-encoded, a null
url gives no target header; an empty table gives no files and no rows. Other columns, whatever their names, are
ignored. Ids must be numbers, or texts of numbers.
"""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._files import create, opened
from ._store import map_batches, materialise
from ._text import buffers, sliced

CHUNK, LEAST, SPLIT, FILE, READ, PART_BYTES = 256 << 10, 1000, 16 << 20, 1 << 30, 64 << 10, 256 << 20
DATE = "1970-01-01T00:00:00Z"
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
_END = b"\r\n\r\n"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-records")
_KEYS = ["page_id", "payload_bytes", "payload_digest"]


def _payloads(b: pa.RecordBatch, chunk: int) -> Iterator[tuple[int, memoryview, str]]:
    """(row, payload, digest) of a batch's rows; the digest is carried over pieces of the buffer, none is copied."""
    data, offsets = buffers(b.column("payload"))
    view = memoryview(np.ascontiguousarray(data))
    for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        digest = hashlib.sha1()
        for at in range(begin, end, chunk):
            digest.update(view[at : min(at + chunk, end)])
        yield i, view[begin:end], digest.hexdigest()


def summaries(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Length and digest of every payload, and nothing of the payload itself."""
    for whole in batches:
        for b in sliced(whole, "payload"):
            found = [(len(p), d) for _, p, d in _payloads(b, chunk)]
            sizes, digests = pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), sizes, digests], ["page_id", "url", "payload_bytes", "payload_digest"])


_CUTS = pa.schema([
    ("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("chunk_no", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()),
])
CUTS = "row long, page_id long, url string, payload_bytes long, payload_digest string, chunk_no long, last boolean, data binary"


def cuts(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK, part: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of chunks; those of a record follow each other. ``row`` tells records apart."""
    part = TaskContext.get().partitionId() if part is None else part
    row, held, size = part << 33, [], 0
    for whole in batches:
        for b in sliced(whole, "payload"):
            ids, urls = b.column("page_id").to_pylist(), b.column("url").to_pylist()
            for i, payload, digest in _payloads(b, chunk):
                row += 1
                for number, at in enumerate(range(0, max(len(payload), 1), chunk)):
                    data = payload[at : at + chunk].tobytes()
                    held.append((row, ids[i], urls[i], len(payload), digest, number, at + chunk >= len(payload), data))
                    size += len(data)
                    if size >= 8 * chunk or len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _CUTS, strict=True)], schema=_CUTS)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _CUTS, strict=True)], schema=_CUTS)


def chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """The chunked record table to write: record fields, ``chunk_no``, ``last`` and ``data``; the chunks
    of a record follow each other in one partition."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    narrow = rows.transform(map_batches, partial(summaries, chunk=chunk), "page_id long, url string, payload_bytes long, payload_digest string")
    known = narrow.filter("page_id is not null").groupBy(*_KEYS).agg(F.count("*").alias("copies"), F.min("url").alias("target"))
    known = materialise(known, "warc-payloads")
    kept = known.filter(F.col("payload_bytes") >= least).groupBy("payload_bytes", "payload_digest")
    kept = kept.agg(F.max(F.struct("page_id", "target", "copies")).alias("kept"), F.min("page_id").alias("least")).filter("least < kept.page_id")
    again = known.join(kept, ["payload_bytes", "payload_digest"], "left").withColumn("is_again", F.coalesce(F.col("page_id") < F.col("kept.page_id"), F.lit(False)))
    refers = [F.when(F.col("is_again"), F.col(f"kept.{c}")).alias(n) for c, n in (("page_id", "refers_to"), ("target", "refers_url"), ("copies", "refers_copies"))]
    again = again.filter("is_again or copies > 1").select(*[F.col(c).alias(f"_{c}") for c in _KEYS], *refers, "copies")
    cut = rows.transform(map_batches, partial(cuts, chunk=chunk), CUTS)
    same = [F.col(c) == F.col(f"_{c}") for c in _KEYS]
    out = cut.join(again, same[0] & same[1] & same[2], "left").drop(*[f"_{c}" for c in _KEYS])
    # a revisit's first chunk stands for its record, which has no payload
    out = out.filter("refers_to is null or chunk_no = 0").withColumns({
        "last": F.col("last") | F.col("refers_to").isNotNull(), "data": F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b"")),
    })
    return out.sortWithinPartitions("row", "chunk_no")


def record_id(page_id: int | None, digest: str, row: int | None = None) -> str:
    """``row`` only where the page's row is repeated, or has no page id."""
    return f"<{uuid.uuid5(_NAMES, f'{page_id} {digest} {row}').urn}>"


def _target(url: str) -> str:
    return "".join(c if " " < c and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _digest(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def head(r: dict, date: str = DATE) -> bytes:
    """WARC header, and the HTTP header that begins the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    revisit, digest = r["refers_to"] is not None, r["payload_digest"]
    alone = r["page_id"] is not None and (r["copies"] or 1) == 1
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(r['page_id'], digest, None if alone else r['row'])}", f"WARC-Date: {date}"]
    if r["url"] is not None:
        lines.append(f"WARC-Target-URI: {_target(r['url'])}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {date}", f"{REFERS}: {r['refers_to']}"]
        if r["refers_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_target(r['refers_url'])}")
        if r["refers_copies"] == 1:
            lines.append(f"WARC-Refers-To: {record_id(r['refers_to'], digest)}")
    if r["page_id"] is not None:
        lines.append(f"{PAGE}: {r['page_id']}")
    length = len(http) + (0 if revisit else r["payload_bytes"])
    lines += [f"WARC-Payload-Digest: {_digest(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _END + http


def info(name: str, date: str = DATE) -> bytes:
    """A gzip member with the record that describes a file."""
    block = b"software: turfspark\r\nformat: WARC File Format 1.1\r\n"
    name = name.rpartition("/")[2]
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(_NAMES, name).urn}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    member = zlib.compressobj(4, zlib.DEFLATED, 31)
    return member.compress("\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block + _END) + member.flush()


_MANIFEST = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])


def write(pages: DataFrame, to: str, split: int = SPLIT, file_bytes: int = FILE, chunk: int = CHUNK, date: str = DATE, **columns) -> DataFrame:
    """Write the archives; returns the manifest (file, offset, length, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = name = member = digest = fields = None
        number = offset = begun = records = 0
        splits = []

        def close_split():
            nonlocal begun, records
            if offset > begun:
                splits.append({"file": name, "offset": begun, "length": offset - begun, "records": records})
            begun, records = offset, 0

        for b in batches:
            for r in b.to_pylist():  # of bounded bytes, as chunks are
                if r["chunk_no"] == 0:
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            close_split()
                            out.close()
                        name, number, offset, begun = f"{to}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", number + 1, 0, 0
                        out = create(name)
                        offset += out.write(info(name, date))
                    member, digest, fields = zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha1(), r
                    offset += out.write(member.compress(head(r, date)))
                digest.update(r["data"])
                offset += out.write(member.compress(r["data"]))
                if r["last"]:
                    if fields["refers_to"] is None and digest.hexdigest() != fields["payload_digest"]:
                        raise OSError(f"page {fields['page_id']}: the chunks' digest isn't the payload's")
                    offset += out.write(member.compress(_END) + member.flush())
                    records += 1
                    if offset - begun >= split:
                        close_split()
        if out is not None:
            close_split()
            out.close()
        yield pa.RecordBatch.from_pylist(splits, _MANIFEST)

    rows = chunks(pages, chunk=chunk, **columns)
    return materialise(rows.transform(map_batches, run, "file string, offset long, length long, records long"), "warc-manifest")


def members(read, length: int, size: int = READ) -> Iterator[Iterator[bytes]]:
    """The records in the next ``length`` bytes, each as an iterator over pieces of bounded size; one must
    be used up before the next."""
    rest = b""
    while rest or length > 0:
        inflate = zlib.decompressobj(31)

        def pieces():
            nonlocal rest, length
            full = False  # more output may wait although all input is used up
            while not inflate.eof:
                if not rest and not full:
                    rest = read(min(size, length))
                    length -= len(rest)
                    if not rest:
                        raise OSError("an archive ends within a record")
                piece = inflate.decompress(rest, size)
                rest, full = inflate.unconsumed_tail or inflate.unused_data, len(piece) == size
                if piece:
                    yield piece

        yield pieces()
        if not inflate.eof:
            raise OSError("a record wasn't read to its end")


def _head(pieces: Iterator[bytes]) -> tuple[list[str], bytes]:
    """Lines of a header and what follows it in the pieces read so far."""
    raw = b""
    while _END not in raw:
        raw += next(pieces)
    lines, _, rest = raw.partition(_END)
    return lines.decode("utf-8", "surrogateescape").split("\r\n"), rest


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


_ROWS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()),
    ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
ROWS = "page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, data binary, payload_bytes long, payload_digest string"


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def records(read, length: int, chunk: int = CHUNK, payload: bool = True) -> Iterator[dict]:
    """Chunk rows of the records: payload bytes and digest so far, on the last chunk those of the whole."""
    for member in members(read, length):
        lines, rest = _head(member)
        warc = _fields(lines)
        left = int(warc["content-length"])
        if warc["warc-type"] == "warcinfo":
            for _ in member:
                pass
            continue

        def block(rest=rest, member=member):
            nonlocal left
            for piece in (x for part in ([rest], member) for x in part):
                piece, left = piece[:left], left - len(piece[:left])
                if piece:
                    yield piece

        body = block()
        http, rest = _head(body)
        size = int(_fields(http)["content-length"])
        declared = base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
        row = {"page_id": _number(warc.get(PAGE.lower())), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": _number(warc.get(REFERS.lower()))}
        if row["record_type"] == "revisit":
            for _ in body:
                pass
            yield row | {"chunk_no": 0, "last": True, "data": None, "payload_bytes": size, "payload_digest": declared}
            continue
        digest, seen, number, held = hashlib.sha1(), 0, 0, bytearray()
        for piece in (x for part in ([rest], body) for x in part):
            digest.update(piece)
            seen += len(piece)
            if payload:
                held += piece
                while len(held) > chunk:
                    yield row | {"chunk_no": number, "last": False, "data": bytes(held[:chunk]), "payload_bytes": seen - len(held) + chunk, "payload_digest": None}
                    del held[:chunk]
                    number += 1
        if seen != size or digest.hexdigest() != declared:
            raise OSError(f"record {warc['warc-record-id']} is damaged")
        yield row | {"chunk_no": number, "last": True, "data": bytes(held) if payload else None, "payload_bytes": seen, "payload_digest": declared}


def read(manifest: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunked record table of the archives; without ``payload`` one row per record, its payload
    streamed for length and digest only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for s in b.to_pylist():
                for r in records(opened(s["file"], s["offset"]), s["length"], chunk, payload):
                    held.append(r)
                    size += len(r["data"] or b"")
                    if len(held) >= 1000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, _ROWS)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, _ROWS)

    splits, total = manifest.agg(F.count("*"), F.sum("length")).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(1, min(splits, max(4 * cores, ceil((total or 0) / PART_BYTES))))).transform(map_batches, run, ROWS)


def verified(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives, its payload streamed for length and digest; an error if a revisit's
    response isn't there, or isn't as the revisit says."""
    rows = materialise(read(manifest, payload=False), "warc-records")
    said = rows.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest").distinct()
    lost = said.join(rows.filter("record_type = 'response'").select(*_KEYS), _KEYS, "left_anti").first()
    if lost:
        raise OSError(f"page {lost.page_id} isn't stored as its revisits say")
    return rows


def round_trip(pages: DataFrame, to: str) -> DataFrame:
    """Per page, from the archives: payload bytes and digest, record type and what a revisit refers to."""
    return verified(write(pages, to)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
