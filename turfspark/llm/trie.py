"""Prefix trie of conversations: which turns are shared, and what is saved if each shared prefix is worked on once.

A node of depth d is a distinct sequence of the first d turns (role, text); conversations that start with it are its
members, and its name is (smallest member, depth), as a conversation has one prefix of each depth. The root has depth
0. For every node: its parent, members, children, the childless nodes and the saved bytes of its subtree, and a digest
of the conversations that end there.

Sums over subtrees come from the Euler tour: a node has an arc that enters it and one that leaves it, and each arc
knows the next one (``tour``): from entering on to the first child, or else to leaving; from leaving on to the next
sibling, or else to the parent's leaving. ``ranked`` ranks that list, wherever its arcs lie, and adds up weights on
the way: a subtree's sums are the difference between leaving and entering, whatever its depth and shape.

* ``turns`` reduces texts to digests before anything moves. Turns are numbered, and prefixes are identified, by sums
  within conversations (``grouped_totals``): a prefix is known by the sum of 128-bit hashes of its (depth, turn), so
  a conversation of any length is spread over partitions. Two different prefixes share one with a probability of
  1e-17 in 1e10 prefixes.
* ``adjacent`` sorts parents and children by the parent's prefix over the whole table. So a parent finds its first
  child, a child its sibling, in the next row, and the parent in the last such row before, in this range or, by a row
  for each range, an earlier one. No node gathers its children.
* ``ranked`` contracts the list: each partition follows the arcs it holds as far as they go and leaves one row for
  each stretch; these rows are a shorter list of the same kind. Arcs are laid out by conversation first, so that most
  follow each other within a partition; afterwards, as long as rows don't fit into a partition of ``PART_ROWS``, half
  of them by a hash move to where their follower is, so that a quarter or more go in every round. The stretches'
  sums are then handed down again.
* the digest of a node's ends needs their ids in order: they are joined to texts of 64 KB by ranges, and a task streams
  such texts through the hash, holding one batch.

Edge cases: turns without a conversation id belong to none and are left out; a null role or text is empty; turns of
equal number are ordered by the MD5 of ``length of role in bytes:role text``, null numbers first, and each counts, also
repeated rows; an empty table gives no rows. Ids and numbers of turns must be numbers, or texts of numbers. Other
columns, whatever their names, are ignored.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import PART_ROWS, grouped_totals, parts_for, ranged
from ._store import materialise

CHUNK, SPREAD = 64 << 10, 1 << 16
WEIGHTS = ["position", "leaves", "saved"]
_LIST = ["c", "a", "next_c", "next_a", *WEIGHTS]
_EMPTY = hashlib.sha256().hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, x, bytes) of every turn: its number in the conversation from 0 on, the digest of role and text, the
    length of the text in bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("x"), F.octet_length(text).cast("long").alias("bytes"))
    return grouped_totals(rows.filter("conv is not null"), ["conv"], ["turn", "x"], {"i": F.lit(1).cast("long")}).drop("turn")


def whole(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv, depth, x, bytes, size) of every turn of ``turns``, and (conv, size)."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("size"))
    return _with(rows, sizes, ["size"]).select("conv", (F.col("i") + 1).alias("depth"), "x", "bytes", "size"), sizes


def spliced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for conversations that are rebuilt, so that neighbours share prefixes: the first h turns of
    conversation c - c % 5, then c's own after its first h, where h is crc32 of the decimal c, % 9."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("long")
    sizes = materialise(rows.groupBy("conv").agg(F.count("*").alias("n")), "trie-sizes")
    convs = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), h.alias("h"))
    lent = sizes.select(F.col("conv").alias("base"), F.least("n", F.lit(8).cast("long")).alias("lent"))  # h is 8 at most
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0).cast("long"))))
    convs = materialise(convs.withColumn("size", F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("lent")), "trie-convs")
    own = _with(rows, convs, ["h", "lent", "size"]).filter("i >= h")
    own = own.select("conv", (F.col("i") - F.col("h") + F.col("lent") + 1).alias("depth"), "x", "bytes", "size")
    heads = rows.filter("i < 8").withColumnRenamed("conv", "base")
    borrowed = heads.join(convs.select("conv", "base", "h", "size"), "base").filter("i < h")
    return own.unionByName(borrowed.select("conv", (F.col("i") + 1).alias("depth"), "x", "bytes", "size")), convs.select("conv", "size")


def _with(rows: DataFrame, convs: DataFrame, columns: list[str]) -> DataFrame:
    """Turns with their conversation's columns; long conversations are spread over as many keys as they need."""
    n = F.col("n") if "n" in convs.columns else F.col("size")
    keyed = convs.select(F.col("conv").alias("_conv"), *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / SPREAD))).alias("_part"))
    return rows.join(keyed, (F.col("conv") == F.col("_conv")) & (F.floor(F.col("i") / SPREAD) == F.col("_part"))).drop("_conv", "_part")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, bytes, size) of every prefix of every conversation, that of depth 0 too: its key, its
    parent's, and the bytes of its last turn."""
    lots = [F.xxhash64("depth", "x", F.lit(i)) for i in (1, 2)]
    words = {f"w{i}{j}": (w if j else F.shiftrightunsigned(w, 32)).bitwiseAND(F.lit(0xFFFFFFFF)) for i, w in enumerate(lots) for j in (0, 1)}
    rows = grouped_totals(rows.withColumns(words), ["conv"], ["depth"], {f"s{n}": F.col(n) for n in words})

    def key(i: int, of: Callable[[str], Column]) -> Column:  # sums of 32 bits at a time can't overflow
        return F.shiftleft(of(f"{i}0"), 32).bitwiseOR(of(f"{i}1").bitwiseAND(F.lit(0xFFFFFFFF)))

    before, upto = (lambda n: F.col(f"sw{n}")), (lambda n: F.col(f"sw{n}") + F.col(f"w{n}"))
    rows = rows.select("conv", "depth", key(0, upto).alias("k1"), key(1, upto).alias("k2"), key(0, before).alias("p1"), key(1, before).alias("p2"), "bytes", "size")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"), "size")
    return rows.unionByName(roots)


def adjacent(nodes: DataFrame) -> DataFrame:
    """(depth, conv, first_child, parent, sibling): of every node of (depth, conv, k1, k2, p1, p2) the smallest child, the
    parent, and the next of the parent's children by name."""
    as_parent = nodes.select("depth", "k1", "k2", F.lit(0).alias("kind"), "conv")
    as_child = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).alias("kind"), "conv")
    order = ["depth", "k1", "k2", "kind", "conv"]
    rows = ranged(as_parent.unionByName(as_child), order)
    ends = rows.groupBy("_part").agg(F.min(F.struct(*order)).alias("first"), F.max(F.when(F.col("kind") == 0, F.struct(*order))).alias("top"))
    parts = Window.orderBy("_part")  # a row for each range
    ends = ends.select(
        F.col("_part").alias("_at"), F.lead("first").over(parts).alias("follows"), F.last("top", True).over(parts.rowsBetween(Window.unboundedPreceding, -1))["conv"].alias("above")
    )
    within = Window.partitionBy("_part").orderBy(*order)
    rows = rows.withColumns({
        "next": F.lead(F.struct(*order)).over(within),
        "up": F.last(F.when(F.col("kind") == 0, F.col("conv")), True).over(within.rowsBetween(Window.unboundedPreceding, 0)),
    }).join(F.broadcast(ends), F.col("_part") == F.col("_at"))
    rows = rows.withColumns({"next": F.coalesce("next", "follows"), "up": F.coalesce("up", "above")})
    same = (F.col("next.depth") == F.col("depth")) & (F.col("next.k1") == F.col("k1")) & (F.col("next.k2") == F.col("k2")) & (F.col("next.kind") == 1)
    after, child = F.when(same, F.col("next.conv")), F.col("kind") == 1
    rows = rows.select(
        F.when(child, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), "conv",
        F.when(~child, after).alias("first_child"), F.when(child, F.col("up")).alias("parent"), F.when(child, after).alias("sibling"),
    )
    return rows.groupBy("depth", "conv").agg(*[F.max(c).alias(c) for c in ("first_child", "parent", "sibling")])


def tour(nodes: DataFrame) -> DataFrame:
    """The Euler tour as a list: arcs (c, a) of conversation and 2 * depth to enter, and one more to leave, with the arc
    after each and the weights that it adds. ``nodes`` have what ``adjacent`` gives, with own ``leaf`` and ``gain``."""
    depth, zero = F.col("depth"), F.lit(0).cast("long")
    enter, leave = 2 * depth, 2 * depth + 1
    inner, more = F.col("first_child").isNotNull(), F.col("sibling").isNotNull()
    arc = lambda a, next_c, next_a, leaf, gain: F.struct(
        F.col("conv").alias("c"), a.alias("a"), next_c.alias("next_c"), next_a.alias("next_a"), F.lit(1).cast("long").alias(WEIGHTS[0]), leaf.alias(WEIGHTS[1]), gain.alias(WEIGHTS[2])
    )
    arcs = [
        arc(enter, F.coalesce("first_child", "conv"), F.when(inner, enter + 2).otherwise(leave), F.col("leaf"), F.col("gain")),
        arc(leave, F.coalesce("sibling", "parent"), F.when(more, enter).when(F.col("parent").isNotNull(), enter - 1), zero, zero),
    ]
    return nodes.select(F.explode(F.array(*arcs)).alias("x")).select("x.*")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the arcs of a partition: each with the head of its stretch and the weights before it since there; a stretch's last
    arc also with the arc that follows and the weights of the whole."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    held = pa.Table.from_batches(held)
    c, a, w = held["c"].to_numpy(), held["a"].to_numpy(), np.column_stack([held[k].to_numpy() for k in WEIGHTS])
    follows = held["next_c"].is_valid().to_numpy(zero_copy_only=False)
    next_c, next_a = (held[k].fill_null(0).to_numpy() for k in ("next_c", "next_a"))
    names, at = np.unique(c, return_inverse=True)
    width = max(int(a.max()), int(next_a.max())) + 1
    codes = at * width + a
    order = np.argsort(codes)
    where = np.minimum(np.searchsorted(names, next_c), len(names) - 1)
    wanted = where * width + next_a
    found = np.minimum(np.searchsorted(codes[order], wanted), len(order) - 1)
    inside = follows & (names[where] == next_c) & (codes[order][found] == wanted)
    head, before = np.arange(len(c)), np.zeros_like(w)
    source, to = np.flatnonzero(inside), order[found[inside]]
    head[to], before[to] = source, w[source]
    while not np.array_equal(further := head[head], head):
        before += before[head]
        head = further
    last = ~inside
    only = lambda mask, values: pa.array(values, pa.int64(), mask=~mask)
    columns = {"c": pa.array(c), "a": pa.array(a), "head_c": pa.array(c[head]), "head_a": pa.array(a[head])}
    columns |= {k: pa.array(x) for k, x in zip(WEIGHTS, before.T.copy(), strict=True)} | {"last": pa.array(last)}
    columns |= {"next_c": only(last & follows, next_c), "next_a": only(last & follows, next_a)}
    columns |= {f"whole_{k}": only(last, x) for k, x in zip(WEIGHTS, (before + w).T.copy(), strict=True)}
    yield pa.RecordBatch.from_pydict(columns)


_STRETCHES = "c long, a long, head_c long, head_a long, " + ", ".join(f"{k} long" for k in WEIGHTS) + ", last boolean, next_c long, next_a long, " + ", ".join(f"whole_{k} long" for k in WEIGHTS)


def ranked(arcs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(c, a, *WEIGHTS): for every arc of one list the weights before it."""
    rest, n, levels = arcs, arcs.count(), []
    while True:
        if not levels:
            dealt = rest.repartitionByRange(parts_for(rest, n, part_rows), "c", "a")
        elif n <= part_rows:
            dealt = rest.repartition(1)  # what is left of the list, at most ``part_rows``
        else:
            moves = (F.xxhash64("c", "a", F.lit(len(levels))) % 2 == 0) & F.col("next_c").isNotNull()
            to = [F.when(moves, F.col(f"next_{k}")).otherwise(F.col(k)) for k in ("c", "a")]
            dealt = rest.repartition(parts_for(rest, n, part_rows), *to)
        level = materialise(dealt.select(*_LIST).mapInArrow(_contract, _STRETCHES), "trie-stretches")
        levels.append(level)
        rest = level.filter("last").select(F.col("head_c").alias("c"), F.col("head_a").alias("a"), "next_c", "next_a", *[F.col(f"whole_{k}").alias(k) for k in WEIGHTS])
        n = rest.count()
        if n <= 1:
            break
    found = levels.pop().select("c", "a", *WEIGHTS)
    while levels:
        above = found.select(F.col("c").alias("head_c"), F.col("a").alias("head_a"), *[F.col(k).alias(f"_{k}") for k in WEIGHTS])
        found = levels.pop().join(above, ["head_c", "head_a"]).select("c", "a", *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in WEIGHTS])
    return found


_KEY = ["depth", "k1", "k2"]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of consecutive ids of a node, comma-joined, of about ``CHUNK`` bytes, under the first id."""
    key, first, ids, size = None, None, [], 0

    def row():
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([first], pa.int64()), pa.array([",".join(ids)])], [*_KEY, "first", "ids"])

    for b in batches:
        for d, k1, k2, conv in zip(*(b.column(k).to_pylist() for k in (*_KEY, "conv")), strict=True):
            if (d, k1, k2) != key or size >= CHUNK:
                if key:
                    yield row()
                key, first, ids, size = (d, k1, k2), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if key:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, one after another."""
    key, digest, held = None, None, []
    out = lambda: pa.RecordBatch.from_arrays([*(pa.array([h[i] for h in held], pa.int64()) for i in range(3)), pa.array([h[3] for h in held])], [*_KEY, "ends_sha256"])
    for b in batches:
        for d, k1, k2, ids in zip(*(b.column(k).to_pylist() for k in (*_KEY, "ids")), strict=True):
            if (d, k1, k2) != key:
                if key:
                    held.append((*key, digest.hexdigest()))
                    if len(held) >= 10_000:
                        yield out()
                        held.clear()
                key, digest = (d, k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key:
        held.append((*key, digest.hexdigest()))
        yield out()


def ends_digest(ends: DataFrame, n: int) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes with ``ends`` (depth, k1, k2, conv), n in all."""
    sorted_ends = ends.repartitionByRange(parts_for(ends, n), *_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    texts = materialise(sorted_ends.mapInArrow(_joined, "depth long, k1 long, k2 long, first long, ids string"), "trie-ends")
    return texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = whole) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuild(materialise(turns(conversations), "trie-turns"))
    known = materialise(prefixes(rows, convs), "trie-prefixes")
    nodes = known.groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("bytes").alias("bytes")
    )  # parents and bytes are the same in all rows of a key
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    ended = known.filter("depth = size").select(*_KEY, "conv")
    digests = ends_digest(ended, convs.count())
    nodes = nodes.join(children, _KEY, "left").join(digests, _KEY, "left").join(adjacent(nodes), ["depth", "conv"])
    none = F.col("n_children").isNull()
    nodes = materialise(nodes.select(
        "conv", "depth", "parent", "first_child", "sibling", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), none.cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("gain"),
    ), "trie")
    sums = ranked(tour(nodes)).withColumn("depth", F.shiftright("a", 1)).groupBy("c", "depth")
    change = lambda k: F.sum(F.when(F.col("a") % 2 == 1, F.col(k)).otherwise(-F.col(k)))
    sums = sums.agg(change("leaves").alias("n_leaves"), change("saved").alias("saved_tokens")).withColumnRenamed("c", "conv")
    return nodes.join(sums, ["conv", "depth"]).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
