"""Benchmark decontamination: MinHash containment search, partitioned by size.

Texts are lower-cased and cut into words (runs of ASCII letters, digits and non-ASCII characters); their
shingles are five words. A document contains an item when it has at least ``threshold`` of the item's
distinct shingles, wherever they stand. Short items inside long documents have a tiny Jaccard similarity,
so ordinary MinHash signatures miss them. Here an item's signature is its bottom-k sketch: of m distinct
shingles its k = m - ceil(threshold * m) + 1 smallest hashes. A document that contains the item misses at
most k - 1 of its shingles, so it holds one of the k: no contained item is lost. Items are partitioned by
size (powers of two); a partition has its own k, its own largest sketch hash, above which document hashes
are dropped unseen, and its own least document size. Candidates are verified by exact shingle containment:
the shingles' strings are compared.

Documents are scanned once, in place, without a shuffle. The items' index is broadcast only if distinct items
have at most ``max_shingles`` words, and so no more shingles; larger sets are searched in blocks of that size, by
a hash of the item, each over all documents. The index holds some 20 bytes for a shingle, hashes and the items'
texts; the strings of an item are made when a candidate for it is verified, those of the last ``VERIFIED`` items
are kept. An item that is larger than a block by itself is a block of its own.

Edge cases: null, empty and word-less documents or items match nothing; an item of fewer than five words is
one shingle of its own length; benchmark rows repeated in id and text count once; repeated document rows
give repeated results; equal texts under two item ids are two items. Other columns, whatever their names, are
kept out of ``contained`` and kept as they are by ``clean``. Ids must be numbers, or texts of numbers.
"""

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh, map_batches, materialise
from ._text import ALNUM, buffers, hash_spans, shingle_hashes, sliced, word_spans

SIZE, THRESHOLD, MAX_SHINGLES, VERIFIED = 5, 0.8, 1_000_000, 200
PAIRS = "doc_id long, item_id long, shared int, item_shingles int, containment double"


class Texts:
    """Words and shingles of a column of texts."""

    def __init__(self, column: pa.Array):
        self.data, offsets = buffers(pc.utf8_lower(column))
        self.starts, self.ends, self.per_row = word_spans(self.data, offsets, ALNUM)
        self.words = hash_spans(self.data, self.starts, self.ends)

    def strings(self, at: np.ndarray, size: int) -> set[bytes]:
        raw = self.data
        return {b" ".join(raw[self.starts[w] : self.ends[w]].tobytes() for w in range(i, i + size)) for i in at}


class Index:
    def __init__(self, items: list[tuple], size: int = SIZE, threshold: float = THRESHOLD):
        self.threshold = threshold
        items = sorted({(i, t) for i, t in items if t}, key=str)
        self.items, parts = [], {}
        for item, text in items:  # one at a time: no more in memory than the index and an item
            texts = Texts(pa.array([text], pa.string()))
            n = min(size, len(texts.words))
            if not n:
                continue
            hashes = np.unique(shingle_hashes(texts.words, texts.per_row, n)[0][: len(texts.words) - n + 1])
            need = ceil(threshold * len(hashes) - 1e-9)
            number = len(self.items)
            self.items.append((item, n, hashes, text))
            part = parts.setdefault((n, len(hashes).bit_length()), [[], need])
            part[0].append((number, hashes[: len(hashes) - need + 1]))
            part[1] = min(part[1], need)
        self.parts = []
        for (n, _), (sketches, least) in sorted(parts.items()):
            owner = np.concatenate([np.full(len(h), i, np.int32) for i, h in sketches])
            probes = np.concatenate([h for _, h in sketches])
            order = np.argsort(probes, kind="stable")
            self.parts.append((n, least, probes[order], owner[order]))

    def strings(self, number: int) -> set[bytes]:
        """The shingles of an item."""
        if "verified" not in self.__dict__:
            self.verified = lru_cache(VERIFIED)(self._strings)
        return self.verified(number)

    def _strings(self, number: int) -> set[bytes]:
        _, n, _, text = self.items[number]
        texts = Texts(pa.array([text], pa.string()))
        return texts.strings(np.arange(len(texts.words) - n + 1), n)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "verified"}

    def search(self, column: pa.Array) -> Iterator[tuple[int, object, int, int]]:
        """(row, item id, shared, item's shingles) of every contained item."""
        if not self.parts:
            return
        texts = Texts(column)
        counts = np.diff(texts.per_row)
        for size in sorted({p[0] for p in self.parts}):
            hashes, valid = shingle_hashes(texts.words, texts.per_row, size)
            at = np.flatnonzero(valid)
            hashes = hashes[at]
            row = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
            found = set()
            for n, least, probes, owner in self.parts:
                if n == size:
                    few = np.flatnonzero(hashes <= probes[-1])
                    few = few[counts[row[few]] - size + 1 >= least]
                    first = np.searchsorted(probes, hashes[few])
                    few, first = (x[probes[first] == hashes[few]] for x in (few, first))
                    while len(few):
                        found.update(zip(row[few].tolist(), owner[first].tolist(), strict=True))
                        first = first + 1
                        more = first < len(probes)
                        few, first = few[more], first[more]
                        more = probes[first] == hashes[few]
                        few, first = few[more], first[more]
            for r, i in sorted(found):
                item, _, wanted, _ = self.items[i]
                a, b = np.searchsorted(row, [r, r + 1])
                near = np.flatnonzero(np.isin(hashes[a:b], wanted))
                if len(np.unique(hashes[a:b][near])) >= ceil(self.threshold * len(wanted) - 1e-9):
                    strings = self.strings(i)
                    shared = len(texts.strings(at[a:b][near], size) & strings)
                    if shared >= ceil(self.threshold * len(strings) - 1e-9):
                        yield r, item, shared, len(strings)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items with their number of words; copies of one, however many, are gone."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(?:[a-z0-9]|[^\x00-\x7f])+"), 0))
    return materialise(rows.distinct().withColumn("words", words).filter("words > 0"), "items")


def _blocks(items: DataFrame, max_shingles: int) -> list[DataFrame]:
    """Blocks of at most ``max_shingles`` words, but for an item with more."""
    total = items.agg(F.sum("words")).first()[0] or 0
    if total <= max_shingles:
        return [items]
    n = ceil(4 * total / max_shingles)  # parts by hash, of which as many make a block as fit
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    sizes = items.groupBy(part.alias("part")).agg(F.sum("words").alias("words")).orderBy("part").collect()
    blocks, room = [], 0
    for r in sizes:
        if r.words > room:
            blocks.append([])
            room = max_shingles
        blocks[-1].append(r.part)
        room -= r.words
    return [items.filter(part.isin(b)) for b in blocks]


def _index(spark, block: DataFrame, size: int, threshold: float):
    return spark.sparkContext.broadcast(Index([tuple(r) for r in block.select("item_id", "text").collect()], size, threshold))


def contained(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, max_shingles: int = MAX_SHINGLES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item that it contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in sliced(whole, "text"):
                    hits = list(index.value.search(b.column(1)))
                    ids = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                    item, shared, of = ([h[k] for h in hits] for k in (1, 2, 3))
                    share = [s / n for s, n in zip(shared, of, strict=True)]
                    columns = [ids, pa.array(item, pa.int64()), pa.array(shared, pa.int32()), pa.array(of, pa.int32()), pa.array(share, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        return rows.transform(map_batches, run, PAIRS)

    blocks = _blocks(_items(benchmark, item_col, item_text_col), max_shingles)
    if len(blocks) == 1:
        return scan(_index(spark, blocks[0], size, threshold))
    found = []
    for block in blocks:  # one index in memory at a time
        index = _index(spark, block, size, threshold)
        found.append(materialise(scan(index), "contained"))
        index.destroy()
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, max_shingles: int = MAX_SHINGLES, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that contain no item. With several blocks of items each is a pass that writes the
    hashes of the texts found, with their lengths; those texts go at the end."""
    spark = docs.sparkSession
    blocks = _blocks(_items(benchmark, "item_id", "text"), max_shingles)
    if len(blocks) == 1:
        index = _index(spark, blocks[0], size, threshold)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in sliced(whole, text_col):
                    keep = np.ones(b.num_rows, bool)
                    keep[[h[0] for h in index.value.search(b.column(text_col))]] = False
                    yield b.filter(pa.array(keep))

        return docs.transform(map_batches, run, docs.schema)
    text, key, length = F.col(f"`{text_col}`").cast("string"), fresh(docs, "_key"), fresh(docs, "_length")
    rows, found = docs.select(text.alias("text"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("length")), []
    for block in blocks:
        index = _index(spark, block, size, threshold)

        def note(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in sliced(whole, "text"):
                    at = pa.array(sorted({h[0] for h in index.value.search(b.column(0))}), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at)], ["key", "length"])

        found.append(materialise(rows.transform(map_batches, note, "key long, length int"), "contaminated"))
        index.destroy()
    bad = reduce(DataFrame.unionByName, found).distinct().select(F.col("key").alias(key), F.col("length").alias(length))
    return docs.join(bad, (F.xxhash64(text) == F.col(key)) & (F.octet_length(text) == F.col(length)), "left_anti")
