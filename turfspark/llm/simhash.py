"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits are majority votes over hashed 3-word shingles. Two fingerprints are linked
when at most three bits differ; a document's component is the smallest id that it can reach.

Search. The 64 bits are cut into A (23 bits), B (23) and C (18). The binary Golay code is perfect: a
23-bit word has exactly one codeword within distance 3 (its centre), and a word with an error more is
within distance 4 of that centre. So a word gets few codeword indices: its centre, and the at most five
other codewords at distance 4. Words at distance 1 have each other's centre among them. Three errors over
three segments fall into one of

    A has none                            key: A itself
    B has none                            key: B itself
    C has none, then A or B has <= 1      key: C with an index of A; C with an index of B
    every segment has exactly one         key: index of A with index of B

so that linked fingerprints share a key. (Of two words with different centres it's enough that one meets
the other's centre: only the lower pair of indices is emitted.) Rows with one key are verified together:
a breadth-first pass over the key's distinct fingerprints gives a spanning forest of the true links, at
most one edge per fingerprint and key, never all pairs. A key of more than ``BLOCK`` fingerprints is
spread as pairs of blocks over many tasks.

Edge cases: null and word-less texts have fingerprint zero and link like any other; repeated rows and
equal texts share a fingerprint; rows with a null id get a fingerprint, take part in links, and never
name a component (a component of null ids alone has a null ``component_id``). An empty table gives an
empty result. Other columns, whatever their names, are ignored; ``near_duplicates`` reads only the id and the
text. Texts of any length are hashed in pieces. Ids must be numbers, or texts of numbers.

``keep_one`` drops near copies by the likeness of five-word shingles (see ``shingle_sets``), not by these
fingerprints.
"""

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, repeat
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_sets
from ._store import cut, fresh, map_batches, materialise

SEED, SHINGLE, MAX_BITS, BLOCK = 42, 3, 3, 16384
HOT_ROWS = 100_000
_CHUNK = 1 << 15
#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.transform(map_batches, run, "id long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word (their sum is the word's); by syndrome, the
    error that leads to the centre, and the five errors of weight 4 where that one has weight 3 (else -1)."""
    bits = []
    for bit in range(23):
        x = 1 << bit
        for high in range(22, 10, -1):
            if x >> high & 1:
                x ^= GENERATOR << (high - 11)
        bits.append(x)
    spread = lambda some: np.bitwise_xor.reduce([(np.arange(1 << len(some)) >> i & 1) * x for i, x in enumerate(some)])
    leader, others, n = np.zeros(2048, np.int64), np.full((2048, 5), -1, np.int64), np.zeros(2048, int)
    for weight in range(5):
        for at in combinations(range(23), weight):
            error, syndrome = sum(1 << i for i in at), reduce(xor, (bits[i] for i in at), 0)
            if weight < 4:
                leader[syndrome] = error
            elif int(leader[syndrome]).bit_count() == 3:
                others[syndrome, n[syndrome]] = error
                n[syndrome] += 1
    return spread(bits[:12]), spread(bits[12:]), leader, others


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: codeword index of the centre, and of the codewords at distance 4 (-1: none).
    The code is systematic in its upper 12 bits, which serve as the index."""
    low, high, leader, others = golay()
    s = low[words & 4095] ^ high[words >> 12]
    far = others[s]
    return (words ^ leader[s]) >> 11, np.where(far < 0, -1, (words[:, None] ^ far) >> 11)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all search keys of the fingerprints (unsigned); the kind is in the key's top bits."""
    a, b, c = ((fp >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18)))
    row = np.arange(len(fp))
    (ca, fa), (cb, fb) = indices(a), indices(b)
    out = [(row, 0 << 60 | a), (row, 1 << 60 | b)]
    for kind, centre, far in ((2, ca, fa), (3, cb, fb)):
        out.append((row, kind << 60 | c << 12 | centre))
        r, k = np.nonzero((far >= 0) & (far < centre[:, None]))
        out.append((r, kind << 60 | c[r] << 12 | far[r, k]))
    alls = [np.column_stack([x, y]) for x, y in ((ca, fa), (cb, fb))]
    own = ca << 12 | cb
    for i in range(6):
        for j in range(6):
            pair = alls[0][:, i] << 12 | alls[1][:, j]
            r = np.flatnonzero((alls[0][:, i] >= 0) & (alls[1][:, j] >= 0) & (pair <= own))
            out.append((r, 4 << 60 | pair[r]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def forest(fp: np.ndarray, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within ``fp``, or between ``fp`` and ``other``."""
    edges = []
    if other is None:
        rest = fp
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(rest ^ x) <= MAX_BITS
                if near.any():
                    found = rest[near]
                    edges += zip(repeat(x), found, strict=False)
                    queue += list(found)
                    rest = rest[~near]
        return edges
    left, right = fp, other
    while len(left) and len(right):  # alternate sides, each node leaves its side when reached
        queue, left = [(left[0], True)], left[1:]
        while queue:
            x, is_left = queue.pop()
            side = right if is_left else left
            near = np.bitwise_count(side ^ x) <= MAX_BITS
            if near.any():
                found = side[near]
                edges += zip(repeat(x), found, strict=False)
                queue += [(y, not is_left) for y in found]
                if is_left:
                    right = right[~near]
                else:
                    left = left[~near]
    return edges


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From rows sorted by key: batches of (key, fp) that hold the whole of every key in them."""
    held_k, held_f = [], []
    for b in batches:
        k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        if k[-1] == k[0] and (not held_k or held_k[0][0] == k[0]):
            held_k.append(k), held_f.append(f)
            continue
        last = int(np.searchsorted(k, k[-1]))
        yield np.concatenate([*held_k, k[:last]]), np.concatenate([*held_f, f[:last]])
        held_k, held_f = [k[last:]], [f[last:]]
    if held_k:
        yield np.concatenate(held_k), np.concatenate(held_f)


def _edge_batch(edges: list) -> pa.RecordBatch:
    e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 2048):
            part = fp[at : at + 2048]
            row, key = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, f in _runs(batches):
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        edges, f = [], f.view(np.uint64)
        two = starts[sizes == 2]
        near = two[np.bitwise_count(f[two] ^ f[two + 1]) <= MAX_BITS]
        edges += zip(f[near], f[near + 1], strict=False)
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            edges += forest(np.unique(f[s : s + n]))
        yield _edge_batch(edges)


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, fp, side), sorted by task: side 0 within a block, sides 1 and 2 across two."""
    held: dict[int, list] = {}
    task = None

    def done():
        x = {s: np.concatenate(v).view(np.uint64) for s, v in held.items()}
        if 0 in x:
            return _edge_batch(forest(x[0]))
        return _edge_batch(forest(x[1], x[2]) if len(x) == 2 else [])

    for b in batches:
        t, f, s = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        for at in np.split(np.arange(len(t)), np.flatnonzero(t[1:] != t[:-1]) + 1):
            if not len(at):
                continue
            if task is not None and t[at[0]] != task:
                yield done()
                held = {}
            task = t[at[0]]
            for side in np.unique(s[at]):
                held.setdefault(int(side), []).append(f[at][s[at] == side])
    if held:
        yield done()


def links(distinct_fp: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of column ``fp``: enough of the pairs at most three
    bits apart to connect all that those pairs connect."""
    keyed = cut(distinct_fp.select("fp").transform(map_batches, _emit_keys, "key long, fp long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = cut(sizes.withColumn("blocks", F.ceil(F.col("n") / (block // 2)).cast("int")))
    if hot.isEmpty():
        return keyed.repartition("key").sortWithinPartitions("key").transform(map_batches, _verify, "a long, b long")
    plain = keyed.join(hot.select("key"), "key", "left_anti")
    found = plain.repartition("key").sortWithinPartitions("key").transform(map_batches, _verify, "a long, b long")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = keyed.join(hot, "key").withColumn("mine", mine).select(
        "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2)
    tasks = spread.select(F.xxhash64("key", low, high).alias("task"), "fp", side.alias("side"))
    blocks = tasks.repartition("task").sortWithinPartitions("task").transform(map_batches, _verify_blocks, "a long, b long")
    return found.unionByName(blocks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each component, for the nodes of ``edges`` (a, b), by alternating
    large-star and small-star steps until nothing changes; every round is checkpointed, and no node gathers its
    neighbours."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        )
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _classes(fp: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(fp, copies, root, component_id) of every distinct fingerprint of (id, fp), linked by ``edges`` if given."""
    classes = cut(fp.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(classes.select("fp")) if edges is None else edges)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "copies", "root").join(named, "root")


def _of_class(fp: DataFrame, classes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (id, fp) with their class. A fingerprint of more than ``hot_rows`` rows, such as that of empty texts, is
    spread over several keys; there is less than one such fingerprint for each ``hot_rows`` rows."""
    parts = F.ceil(F.col("copies") / hot_rows).cast("long")
    hot = F.broadcast(classes.filter(F.col("copies") > hot_rows).select(F.col("fp").alias("_hot"), parts.alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(0))
    rows = fp.join(hot, F.col("fp") == F.col("_hot"), "left").select("id", "fp", part.alias("_part"))
    copies = classes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    return rows.join(copies, ["fp", "_part"]).drop("_part", "copies")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    fp = materialise(fingerprints(docs, id_col, text_col), "simhash")
    return _of_class(fp, cut(_classes(fp))).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their near copies: texts with 0.8 or more of their five-word shingles in common
    are linked, and of each component the row with the smallest id stays. An id that several rows have stays once, with the
    first by text of those rows that are of a component which it names. A row without an id stays only where none of its
    component has one; then one such row stays, the first by text."""
    fp = materialise(shingle_sets.keyed(docs, id_col, text_col), "shingles")
    classes = cut(_classes(fp, shingle_sets.links(fp, docs, components, text_col)))
    head, text, print_, row = (fresh(docs, c) for c in ("_head", "_text", "_fp", "_row"))
    heads = classes.filter("component_id is not null").select(F.col("component_id").alias(head)).distinct()
    number = docs[id_col].cast("long")
    kept = docs.join(heads, number == F.col(head), "left_semi")

    def prints(rows: DataFrame) -> DataFrame:
        """(text, fp) of the rows' distinct texts, null as the empty one."""
        texts = rows.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text)).distinct()
        found = shingle_sets.keyed(texts.withColumn("id", F.xxhash64(text)), "id", text).select("id", F.col("fp").alias(print_))
        return texts.join(found, F.xxhash64(text) == F.col("id")).drop("id")

    again = cut(fp.groupBy(F.col("id").alias(head)).count().filter(f"`{head}` is not null and count > 1").select(head))
    if not again.isEmpty():  # each task hands on one row of an id and text, however often it repeats
        several = kept.join(again, number == F.col(head), "left_semi")
        named = prints(several).join(classes.select(F.col("fp").alias(print_), F.col("component_id").alias("_named")), print_).drop(print_)
        once = several.groupBy(number.alias(head), F.col(text_col).cast("string").alias(print_)).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
        once = once.join(named, (F.col(head) == F.col("_named")) & (F.coalesce(F.col(print_), F.lit("")) == F.col(text)), "left_semi")
        once = once.groupBy(head).agg(F.min_by(row, F.struct(F.col(print_).isNotNull(), F.col(print_))).alias(row))
        kept = kept.join(again, number == F.col(head), "left_anti").unionByName(once.select(f"{row}.*"))
    nameless = classes.filter("component_id is null").select(F.col("fp").alias(print_), "root")
    if nameless.isEmpty():
        return kept
    lost = docs.filter(F.col(id_col).cast("long").isNull())
    one = prints(lost).join(nameless, print_).groupBy("root").agg(F.min(text).alias(text))
    lost = lost.withColumn(head, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return kept.unionByName(lost.join(one, F.col(head) == F.col(text), "left_semi").dropDuplicates([head]).drop(head))
