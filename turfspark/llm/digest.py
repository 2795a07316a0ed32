"""Document fingerprints: quartile bucket digests, compared by a bounded difference score.

Every five consecutive bytes give six byte triplets that hold the first of them; each triplet is hashed to
one of 256 buckets and counted. The digest keeps, for every bucket, the quartile of the counts that it
falls in (two bits), with the ratios of the quartiles and the logarithm of the length: 67 bytes in hex.
``likeness`` is 1 for equal digests and falls to 0 at the bound of the difference score, about what two
unrelated digests have. The texts of a slice are counted together, in windows of ``WINDOW`` bytes.

``edited_pairs`` needs each document's successor by id. It range-partitions the documents once by id and
streams every partition in order; only the first and last document of a partition are joined across. The
number of partitions follows the bytes of text: one for ``PART_BYTES``, on small tables a few for each core.

Edge cases: a null or empty text has the digest of no bytes; documents without an id come first, documents
with one id are ordered by a hash of the text; a single document is its own successor; an empty table gives
no rows. Other columns, whatever their names, are ignored. Ids must be numbers, or texts of numbers.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import byte_parts, map_batches, materialise
from ._text import buffers, sliced

BUCKETS, WINDOW, PART_BYTES = 256, 1 << 20, 512 << 20
#: Positions of the triplets' second and third byte after the first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_T = np.random.default_rng(20240611).integers(0, 1 << 16, (6, 3, 256), dtype=np.uint16)
_MEAN = 1.25  # mean difference of two unrelated quartile codes
BOUND = _MEAN * BUCKETS


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket counts of every text, a row each."""
    n = len(offsets) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(data))  # bytes from here to the text's end
    for at in range(0, len(data), WINDOW):
        x, r, more = data[at : at + WINDOW + 4], row[at : at + WINDOW], left[at : at + WINDOW]
        for (j, k), (t1, t2, t3) in zip(TRIPLETS, _T, strict=True):
            m = min(len(r), len(x) - k)
            if m > 0:
                h = (t1[x[:m]] + t2[x[j : j + m]] + t3[x[k : k + m]]) >> 8
                out += np.bincount((r[:m] + h)[more[:m] > k], minlength=len(out))
    return out.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digest of every text, a row of bytes each."""
    c = counts(data, offsets)
    q1, q2, q3 = np.partition(c, (63, 127, 191), axis=1)[:, [63, 127, 191]].T
    codes = ((c > q1[:, None]).astype(np.uint8) + (c > q2[:, None]) + (c > q3[:, None])).astype(np.uint8)
    body = (codes.reshape(len(c), BUCKETS // 4, 4) * np.array([64, 16, 4, 1], np.uint8)).sum(2, dtype=np.uint8)
    length = np.minimum(255, np.rint(8 * np.log2(1 + np.diff(offsets))))
    most = np.maximum(q3, 1)
    return np.column_stack([length, 255 * q1 // most, 255 * q2 // most, body]).astype(np.uint8)


def digest(data: bytes) -> bytes:
    return digests(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tobytes()


_DIFF = np.array([[sum(abs((a >> s & 3) - (b >> s & 3)) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.int64)


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the digests of two equally long lists, row by row: 1 for equal ones, 0 at a difference of ``BOUND``."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    head = np.abs(x[:, 0] - y[:, 0]) * 2 + np.abs(x[:, 1:3] - y[:, 1:3]).sum(1) / 16
    return 1 - np.minimum(BOUND, head + _DIFF[x[:, 3:], y[:, 3:]].sum(1)) / BOUND


def likeness(a: bytes, b: bytes) -> float:
    return float(likenesses(np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None])[0])


def edit(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], pa.string())


def _pairs(ids: pa.Array, texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray) -> list[pa.Array]:
    """Columns of ``RESULT``."""
    edited = [edit(t, f).encode("utf-8", "surrogatepass") for t, f in zip(texts, following, strict=True)]
    other = digests(np.frombuffer(b"".join(edited), np.uint8), np.cumsum([0, *map(len, edited)]))
    return [
        ids.cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), _hex(own),
        _hex(other), pa.array(likenesses(own, other)), pa.array(likenesses(own, theirs)),
    ]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_END = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("is_first", pa.bool_()), ("text", pa.string())])
_PARTIAL = [*_NAMES, "part", "is_first", "text"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs within a partition, and its first and last text."""
    part, held = TaskContext.get().partitionId(), None

    def end(doc_id, text: str, is_first: bool) -> pa.RecordBatch:
        row = pa.RecordBatch.from_pylist([{"doc_id": doc_id, "part": part, "is_first": is_first, "text": text}], _END)
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([row.column(0), *blank, *row.columns[1:]], _PARTIAL)

    for whole in batches:
        for b in sliced(whole, "text"):
            texts, ids = [t or "" for t in b.column("text").to_pylist()], b.column("doc_id")
            own = digests(*buffers(b.column("text")))
            if held is None:
                yield end(ids[0].as_py(), texts[0], True)
            else:
                texts, ids, own = [held[1], *texts], pa.concat_arrays([held[0], ids]), np.concatenate([held[2], own])
            held = ids.slice(len(ids) - 1), texts[-1], own[-1:]
            done = _pairs(ids.slice(0, len(ids) - 1), texts[:-1], own[:-1], texts[1:], own[1:])
            n = len(ids) - 1
            yield pa.RecordBatch.from_arrays([*done, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], _PARTIAL)
    if held is not None:
        yield end(held[0][0].as_py(), held[1], False)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in sliced(whole, "text"):
            own, theirs = (digests(*buffers(b.column(c))) for c in ("text", "following"))
            texts, following = ([t or "" for t in b.column(c).to_pylist()] for c in ("text", "following"))
            yield pa.RecordBatch.from_arrays(_pairs(b.column("doc_id"), texts, own, following, theirs), _NAMES)


def edited_pairs(docs: DataFrame, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its digest, that of the text with its last quarter taken from the next
    document's beginning, and the likeness of the first to the second and to the next document's."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("tie")]
    ordered = rows.repartitionByRange(byte_parts(rows, "text", part_bytes), *order).sortWithinPartitions(*order).drop("tie")
    done = materialise(ordered.transform(map_batches, _stream, f"{RESULT}, part long, is_first boolean, text string"), "digests")
    firsts = done.filter("is_first").select("part", F.col("text").alias("following"))
    by_part = Window.orderBy("part")  # a row per partition
    head = F.first("part").over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    chain = firsts.select("part", F.coalesce(F.lead("part").over(by_part), head).alias("next"))
    lasts = done.filter("not is_first").select("doc_id", "text", "part")
    ends = lasts.join(chain, "part").join(firsts.withColumnRenamed("part", "next"), "next")
    finished = ends.select("doc_id", "text", "following").transform(map_batches, _finish, RESULT)
    return done.filter("part is null").select(*_NAMES).unionByName(finished)
