"""Token ids as flat unsigned integer files with 64-bit document offsets.

``write`` range-partitions the documents by id, encodes each partition in order and streams it into
``part-N.bin`` (ids, little-endian, 16 bits where the vocabulary fits, else 32), ``part-N.off`` (64-bit
offsets in tokens, one more than documents) and ``part-N.key`` (64-bit document ids). A task writes under
the name of its attempt, and only files in the manifest - a small table written from the finished tasks -
count, so a repeated or lost attempt leaves nothing behind that is read. The base of a partition is the
prefix sum of the token counts before it; ``read`` memory-maps the files. The number of partitions follows
the bytes of text: one for ``PART_BYTES``, on small tables a few for each core.

Encoding equals the tokenizers library on the whole text. Byte-level BPE never merges across its pre-tokens,
so a text is cut where one certainly ends: before white space, and between ASCII letters, digits and
punctuation (an apostrophe stays with what follows). All pieces of a slice are looked up at once in a table of
pieces known to the worker, two generations of at most ``KNOWN`` each plus a slice's; the library gets the new
ones, joined by line ends, which are pre-tokens of their own. Other tokenizers get whole texts.

Edge cases: a null or empty text is only its end id; documents without an id come first; documents with one
id are ordered by a hash of the text; an empty table gives no files and no rows. Other columns, whatever their
names, are ignored. A text of any length is cut and encoded in blocks. Ids must be numbers, or texts of numbers.
"""

import json
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._files import create, exact, spans
from ._store import byte_parts, map_batches, materialise
from ._text import SpanHasher, buffers, sliced

END_ID, PART_BYTES, KNOWN, BLOCK = 2, 512 << 20, 600_000, 2 << 20
NO_ID = np.int64(-(1 << 63))
_encoders: dict[str, "Encoder"] = {}

# Kinds of bytes: 0 not ASCII, 1 letter, 2 digit, 3 white space, 4 other
_KIND = np.full(256, 4, np.uint8)
_KIND[128:] = 0
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Known:
    """Ids of pieces by a 64-bit hash and the first bytes: an open table that grows, looked up array-wise."""

    def __init__(self, bits: int = 16):
        self.slots, self.n = np.full(1 << bits, -1, np.int32), 0
        self.hashes, self.firsts, self.begins, self.sizes, self.flat = (np.zeros(1 << 15, k) for k in (np.uint64, np.uint64, np.int32, np.int32, np.uint32))
        self.used = 0

    def find(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Number of each piece's entry, -1 for none."""
        last = len(self.slots) - 1
        at = (hashes >> np.uint64(20)).astype(np.int64) & last
        out = self.slots[at]
        other = lambda e, k: (e >= 0) & ((self.hashes[e] != hashes[k]) | (self.firsts[e] != firsts[k]))
        rest = np.flatnonzero(other(out, slice(None)))
        while len(rest):
            at[rest] = (at[rest] + 1) & last
            out[rest] = self.slots[at[rest]]
            rest = rest[other(out[rest], rest)]
        return out

    def add(self, hashes: np.ndarray, firsts: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New distinct pieces, whose ids follow each other in ``flat``."""
        self.hashes, self.firsts, self.begins, self.sizes = (_room(x, self.n, len(hashes)) for x in (self.hashes, self.firsts, self.begins, self.sizes))
        self.flat = _room(self.flat, self.used, len(flat))
        new = slice(self.n, self.n + len(hashes))
        self.hashes[new], self.firsts[new], self.sizes[new] = hashes, firsts, sizes
        self.begins[new] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += len(hashes)
        if 2 * self.n > len(self.slots):
            self.slots = np.full(1 << int(np.ceil(np.log2(4 * self.n))), -1, np.int32)
            self._place(np.arange(self.n, dtype=np.int32))
        else:
            self._place(np.arange(new.start, new.stop, dtype=np.int32))

    def _place(self, left: np.ndarray) -> None:
        last = len(self.slots) - 1
        at = (self.hashes[left] >> np.uint64(20)).astype(np.int64) & last
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[won]] = left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & last

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after another, and how many each has."""
        n = self.sizes[entries].astype(np.int64)
        return self.flat[np.repeat(self.begins[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _firsts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each piece as a number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[starts]
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(ends - starts, 8).astype(np.uint64)))


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(x):
        return x
    out = np.zeros(max(2 * len(x), used + more), x.dtype)
    out[:used] = x[:used]
    return out


class Encoder:
    def __init__(self, path: str, known: int = KNOWN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.largest = max(self.tokenizer.get_vocab_size(True) - 1, 0)
        self.limit, self.known, self.old = known, Known(), Known()
        spec = json.loads(self.tokenizer.to_str())
        before, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.added = [x["content"].encode() for x in added]
        self.end = self._library(["\n"])[0]
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not spec["normalizer"]
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added) and len(self.end) == 1 and not any(b"\n" in x for x in self.added)
        )

    def _library(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and the end of the last one; for every byte whether it belongs to white space."""
        n, kind = len(data), _KIND[data]
        space = kind == 3
        if (at := np.flatnonzero(np.isin(data, [0xC2, 0xE1, 0xE2, 0xE3]))).size:
            padded = np.concatenate([data, np.zeros(3, np.uint8)])
            for wide in _WIDE_SPACES:
                hit = at[np.all([padded[at + k] == c for k, c in enumerate(wide)], axis=0)]
                for k in range(len(wide)):
                    space[hit + k] = True
        cut = np.zeros(n + 1, bool)
        if n > 1:
            a, b = kind[:-1], kind[1:]
            cut[1:-1] = (a != b) & (a > 0) & (b > 0) & (a != 3) & (b != 3) & (data[:-1] != 39)
            begins = space[1:] & ~space[:-1]  # white space is a pre-token's beginning
            cut[1:-1] |= begins
            # of white space before a word of the same text the last character stands alone, or with the word if it's a space
            last = np.setdiff1d(np.flatnonzero(space[:-1] & ~space[1:] & (a == 3)), offsets - 1)
            cut[last[data[last] != 32] + 1] = True
            cut[last[(last > 0) & space[np.maximum(last - 1, 0)]]] = True
        for token in self.added:
            raw, at = data.tobytes() if len(self.added) else b"", -1
            while (at := raw.find(token, at + 1)) >= 0:
                cut[at + 1 : at + len(token)] = False
        cut[offsets] = True
        return np.flatnonzero(cut), space

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, without end ids, and the texts' offsets in them."""
        if not self.cuts:
            found = self._library([t or "" for t in column.to_pylist()])
            return np.array([i for x in found for i in x], np.uint32), np.cumsum([0, *map(len, found)])
        data, offsets = buffers(column)
        bounds, space = self.bounds(data, offsets)
        found, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(bounds) - 1:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1)
            a, b = bounds[at], bounds[to]
            ids, n = self._block(data[a:b], bounds[at : to + 1] - a, space[a:b])
            found.append(ids), counts.append(n)
            at = to
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(found), before[np.searchsorted(bounds, offsets)]

    def _block(self, data: np.ndarray, bounds: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.known.n > self.limit:
            self.known, self.old = Known(), self.known
        hashes = SpanHasher(data)(bounds[:-1], bounds[1:])
        firsts = _firsts(data, bounds[:-1], bounds[1:])
        entry = self.known.find(hashes, firsts)
        missing = np.flatnonzero(entry < 0)
        while len(missing):  # a second time only if two new pieces share a hash
            new, first = np.unique(hashes[missing], return_index=True)
            first = missing[first]
            before = self.old.find(new, firsts[first])
            back = before >= 0
            if back.any():
                self.known.add(new[back], firsts[first[back]], *self.old.ids(before[back]))
            if not back.all():
                which, flat, sizes = self._learn(data, bounds, first[~back], space)
                self.known.add(hashes[which], firsts[which], flat, sizes)
            entry[missing] = self.known.find(hashes[missing], firsts[missing])
            missing = missing[entry[missing] < 0]
        return self.known.ids(entry)

    def _learn(self, data: np.ndarray, bounds: np.ndarray, which: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of new pieces, in another order, with their ids and how many each has. Those of a word, with or without a space before it, go to the
        library joined by line ends; others one by one."""
        blanks = np.concatenate([[0], np.cumsum(space)])
        start, end = bounds[which], bounds[which + 1]
        inside = blanks[end] - blanks[start]
        plain = (inside == 0) | ((inside == 1) & (data[start] == 32) & (end - start > 1))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        sizes, flat, some = [], [], order[: plain.sum()]
        for at in range(0, len(some), 20_000):
            s, e = start[some[at : at + 20_000]], end[some[at : at + 20_000]]
            n = e - s + 1
            ends = np.cumsum(n)
            joined = data[np.minimum(np.repeat(s - (ends - n), n) + np.arange(ends[-1]), len(data) - 1)]
            joined[ends - 1] = 10
            ids = np.array(self._library([joined.tobytes().decode()])[0], np.uint32)
            stops = np.flatnonzero(ids == self.end[0])
            if len(stops) != len(s):
                raise RuntimeError("the tokenizer joins words across line ends")
            sizes.append(np.diff(stops, prepend=-1) - 1), flat.append(np.delete(ids, stops))
        for k in order[plain.sum() :]:
            ids = self._library([data[start[k] : end[k]].tobytes().decode()])[0]
            sizes.append([len(ids)]), flat.append(np.array(ids, np.uint32))
        return which[order], np.concatenate(flat), np.concatenate(sizes).astype(np.int64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        flat, offsets = self.ids(pa.array(texts, pa.string()))
        return [flat[a:b] for a, b in pairwise(offsets)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_type(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def write(
    docs: DataFrame, to: str, tokenizer: str, end_id: int = END_ID, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents; returns the manifest (part, stem, dtype, docs, tokens, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, n, total = TaskContext.get(), None, 0, 0
        encode = encoder(tokenizer)
        dtype = id_type(max(encode.largest, end_id))
        stem = f"{to}/part-{task.partitionId():08d}-{task.taskAttemptId()}"
        for whole in batches:
            for b in sliced(whole, "text", BLOCK):
                if files is None:
                    files = [create(f"{stem}.{x}") for x in ("bin", "off", "key")]
                    files[1].write(exact(np.zeros(1, "<i8")))
                ids, offsets = encode.ids(b.column("text"))
                ends = offsets[1:] + np.arange(1, len(offsets))
                flat, inner = np.full(len(ids) + len(ends), end_id, dtype), np.ones(len(ids) + len(ends), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                files[0].write(exact(flat))
                files[1].write(exact((total + ends).astype("<i8")))
                files[2].write(exact(b.column("id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("<i8")))
                n, total = n + len(ends), total + len(flat)
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "stem": stem, "dtype": dtype, "docs": n, "tokens": total}])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.asc_nulls_first("id"), F.asc_nulls_first("tie")]
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(byte_parts(rows, "text", part_bytes), *order).sortWithinPartitions(*order).drop("tie")
    manifest = materialise(ordered.transform(map_batches, run, "part long, stem string, dtype string, docs long, tokens long"), "tokens-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files, per document: id, ``start``, ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                ids, offsets = spans(f["stem"] + ".bin", f["dtype"]), spans(f["stem"] + ".off", "<i8")
                key = spans(f["stem"] + ".key", "<i8")
                for at in range(0, f["docs"], 2000):
                    to = min(at + 2000, f["docs"])
                    o, k = offsets(at, to + 1), key(at, to)
                    crc = [zlib.crc32(np.ascontiguousarray(ids(x, y), "<u4")) for x, y in pairwise(o.tolist())]
                    columns = [pa.array(k, mask=k == NO_ID), pa.array(o[:-1] + f["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32"])

    files = manifest.count()
    spread = manifest.repartition(max(1, files))
    return spread.transform(map_batches, run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def document_ids(manifest_row: dict, number: int) -> np.ndarray:
    """Ids (with the end id) of the ``number``-th document of one file, without reading the others."""
    begin, end = spans(manifest_row["stem"] + ".off", "<i8")(number, number + 2).tolist()
    return spans(manifest_row["stem"] + ".bin", manifest_row["dtype"])(begin, end)


def round_trip(spark: SparkSession, docs: DataFrame, to: str, tokenizer: str) -> DataFrame:
    return read(write(docs, to, tokenizer))
