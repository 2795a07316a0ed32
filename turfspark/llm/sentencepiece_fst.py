"""SentencePiece encoding and decoding by weighted finite-state transducers.

``Transducer`` compiles a model file once, in the driver, to arrays of arcs; it is broadcast, its size set by
the vocabulary. What is compiled and composed:

* the normaliser N: a space is rewritten to the space mark, every other byte to itself, one space goes in front;
* the pieces L: a trie over bytes whose accepting states write a piece;
* byte fallback: every byte of a character that no piece is writes the piece of that byte, at a weight that
  makes it a last resort;
* for BPE models the pairs P: an acceptor of pieces that remembers the last one.

N and L are composed beforehand: wherever L reads a space mark, the machine reads a space as well. Texts are
composed with it array-wise: all states of the distinct segments of a batch advance together, a byte at a step,
which gives their lattice; the tropical shortest path is found for all segments together too, by end
position. An arc of a unigram model weighs minus its piece's score. The encoding of a BPE model isn't a path
with the best sum of scores but the one on which merging leaves every two adjacent pieces apart; so P gives
such pairs weight 0 and others infinity. Whether a pair stays apart follows from undoing its merges from the
last to the first and looking at every step for a better one across the border. With that, one path to any
position is finite but for fallback, so that a node a position is enough.

No piece holds two characters that don't stand side by side in some piece; texts are cut there into segments.
A segment beyond ``LONG`` bytes is searched by itself, in windows. Decoding is the inverted machine: a piece
reads its id and writes its bytes.

Edge cases: null and empty texts have no ids and decode to an empty text; a space mark in a text decodes to
a space, as in every such model; texts may hold runs of spaces, control characters and characters outside the
vocabulary; control pieces decode to nothing. Texts of any length are worked off in blocks. Refused are models
with a character map, models that strip spaces, models without all byte pieces or with user-defined ones, and
BPE models with a character in a piece that is no piece itself. Repeated rows are encoded alike; an empty table
gives no rows; other columns are kept by ``encode`` and ``decode`` (which replace a column named like their
result).
"""

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import map_batches
from ._text import SpanHasher, buffers, sliced

SPACE, LONG, BLOCK, SLICE, BATCH, WINDOW = "▁", 255, 2 << 20, 2 << 20, 512 << 10, 1 << 16
_BPE, _UNIGRAM = 2, 1
_MEMO = 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """A fixed map from non-negative 64-bit keys to numbers, looked up by whole arrays (-1: absent)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2))))
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & self.last

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.values[at], np.int32(-1))
        rest = np.flatnonzero(~hit & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.last
            found = self.keys[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        rules, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that keep characters and spaces as they are can be compiled")
        self.prefix, self.bpe = rules.add_dummy_prefix, model.trainer_spec.model_type == _BPE
        if not self.bpe and model.trainer_spec.model_type != _UNIGRAM:
            raise ValueError("only BPE and unigram models can be compiled")
        number, scores, surface = {}, np.zeros(len(model.pieces)), []
        self.fallback = np.full(256, -1, np.int32)
        for i, p in enumerate(model.pieces):
            surface.append(b"")
            if p.type == kind.NORMAL:
                number[p.piece], scores[i], surface[i] = i, p.score, p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                surface[i] = bytes([int(p.piece[3:5], 16)])
                self.fallback[surface[i][0]] = i
            elif p.type == kind.UNKNOWN:
                surface[i] = model.trainer_spec.unk_surface.encode()
            elif p.type != kind.CONTROL:
                raise ValueError("models with user-defined pieces can't be compiled")
        if (self.fallback < 0).any():
            raise ValueError("only models with byte fallback can be compiled")
        self.joins = {x + y for piece in number for x, y in pairwise(piece)}
        self.weights = np.zeros(len(surface), np.float32) if self.bpe else -scores.astype(np.float32)
        self.plain = ~np.isin(np.arange(len(surface)), self.fallback)  # pieces but for those of bytes
        self.penalty = 1.0 if self.bpe else 10 - min(scores[i] for i in number.values())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surface)])
        formed = self._merges(number, scores) if self.bpe else number
        self._compose(formed)
        self._borders()
        self.memo = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None, "scalar": None}

    # ---- compilation ------------------------------------------------------------------------------
    def _merges(self, number: dict[str, int], scores: np.ndarray) -> dict[str, int]:
        """Ranks of merges, each piece's last merge, and the pairs that merge; returns the pieces that can be formed."""
        order = {s: r for r, s in enumerate(sorted({scores[i] for x, i in number.items() if len(x) > 1}, reverse=True))}
        rank = {x: order[scores[i]] for x, i in number.items() if len(x) > 1}
        if not {c for x in rank for c in x} <= number.keys():
            raise ValueError("every character of a piece must be a piece")
        self.rank, self.left, self.right = (np.full(self.fallback.max() + len(scores) + 1, -1, np.int32) for _ in range(3))
        formed, keys, ranks = {}, [], []
        for x, i in number.items():
            for k in range(1, len(x)):
                a, b = number.get(x[:k]), number.get(x[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b), ranks.append(rank[x])
            parts = list(x)
            while len(parts) > 2:
                found = [(rank[u + v], at) for at, (u, v) in enumerate(pairwise(parts)) if u + v in rank]
                if not found:
                    break
                at = min(found)[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) < 3:
                formed[x] = i
                if len(parts) == 2:
                    self.rank[i], self.left[i], self.right[i] = rank[x], number[parts[0]], number[parts[1]]
        self.pairs = Lookup(np.array(keys, np.int64), np.array(ranks, np.int32))
        return formed

    def _compose(self, number: dict[str, int]) -> None:
        """The pieces' trie, with the normaliser's rewriting composed into it."""
        nexts, accepts = [{}], [-1]
        for piece, i in number.items():
            at = 0
            for c in piece.encode():
                if c not in nexts[at]:
                    nexts[at][c] = len(nexts)
                    nexts.append({})
                    accepts.append(-1)
                at = nexts[at][c]
            accepts[at] = i
        for arcs in nexts:
            at = arcs
            for c in SPACE.encode():
                to = at.get(c)
                if to is None:
                    break
                at = nexts[to]
            else:
                arcs[32] = to
        triples = np.array([(s << 8 | c, to) for s, arcs in enumerate(nexts) for c, to in arcs.items()], np.int64).reshape(-1, 2)
        self.arcs, self.accepts = Lookup(triples[:, 0].copy(), triples[:, 1].astype(np.int32)), np.array(accepts, np.int32)
        self.first = np.array([nexts[0].get(c, -1) for c in range(256)], np.int32)

    def _borders(self) -> None:
        """Which two neighbouring bytes of a text may lie in one piece."""
        plain = lambda c: 32 if c == SPACE else ord(c) if c < "\x80" else 128
        known = np.zeros((129, 129), bool)
        for x, y in self.joins:
            known[plain(x), plain(y)] = True
            if x == SPACE != y:  # a literal mark
                known[128, plain(y)] = True
            if y == SPACE != x:
                known[plain(x), 128] = True
        wide = np.minimum(np.arange(256), 128)
        self.joined = known[wide][:, wide]
        self.joined[128:, 128:] = True
        self.joined[:, 128:192] = True

    # ---- composition with texts -------------------------------------------------------------------
    def lattice(self, data: np.ndarray, begin: int, end: int, limit: np.ndarray | int) -> tuple[np.ndarray, ...]:
        """Arcs (from, to, piece, weight) of the machine on ``data`` that start at ``begin`` to ``end``; ``limit`` says
        where the segment of a position ends. A fallback character counts by its first byte."""
        at = np.arange(begin, end, dtype=np.int32)
        state = self.first[data[begin:end]]
        limit = np.broadcast_to(limit, at.shape)
        alone = np.zeros(end - begin, bool)  # characters that are pieces
        size = np.where(data[begin:end] < 192, 1, np.where(data[begin:end] < 224, 2, np.where(data[begin:end] < 240, 3, 4)))
        found, d = [], 1
        alive = np.flatnonzero(state >= 0)
        at, state, limit = at[alive], state[alive], limit[alive]
        while len(at):
            piece = self.accepts[state]
            hit = piece >= 0
            if hit.any():
                here = at[hit]
                found.append((here, here + np.int32(d), piece[hit], self.weights[piece[hit]]))
                alone[here[size[here - begin] == d] - begin] = True
            on = np.flatnonzero(at + d < limit)
            at, limit = at[on], limit[on]
            state = self.arcs(state[on].astype(np.int64) << 8 | data[at + d])
            on = np.flatnonzero(state >= 0)
            at, state, limit, d = at[on], state[on], limit[on], d + 1
        lead = (data[begin:end] & 192) != 128
        lost = np.flatnonzero(lead & ~alone)
        if len(lost):
            n = size[lost]
            each = (np.repeat(lost - (np.cumsum(n) - n), n) + np.arange(n.sum()) + begin).astype(np.int32)
            w = np.where((data[each] & 192) != 128, self.penalty, 0.0).astype(np.float32)
            found.append((each, each + np.int32(1), self.fallback[data[each]], w))
        kinds = np.int32, np.int32, np.int32, np.float32
        return tuple(np.concatenate([np.zeros(0, kind), *(f[k] for f in found)]) for k, kind in enumerate(kinds))

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces apart; remembered in a table of fixed size."""
        if self.memo is None:
            self.memo = np.full(1 << _MEMO, -1, np.int64)
        left, right = left.astype(np.int64), right.astype(np.int64)
        key = left << 31 | right
        slot = (key.view(np.uint64) * _SPREAD >> np.uint64(64 - _MEMO)).view(np.int64)
        known = self.memo[slot]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            out[new] = self._apart(left[new], right[new])
            self.memo[slot[new]] = key[new] << 1 | out[new]
        return out

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.ones(len(left), bool)
        rest, limit = np.arange(len(left)), np.full(len(left), np.iinfo(np.int32).max)
        while len(rest):
            union = self.pairs(left << 32 | right)
            merged = (union >= 0) & (union < limit)
            out[rest[merged]] = False
            a, b = self.rank[left], self.rank[right]
            go = ~merged & ((a >= 0) | (b >= 0))
            rest, left, right, a, b = rest[go], left[go], right[go], a[go], b[go]
            last = a > b  # the left piece's merge comes after the right one's; of equal ones the left is first
            limit = np.where(last, a, b + 1)
            left, right = np.where(last, self.right[left], left).astype(np.int64), np.where(last, right, self.left[right]).astype(np.int64)
        return out

    def paths(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths through the lattices of segments of ``sizes`` bytes, one after another in ``data``:
        ids one after another, and their number in each segment."""
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        start, end, piece, weight = self.lattice(data, 0, len(data), np.repeat(ends.astype(np.int32), sizes))
        own = owner[start]
        step = (end - (ends - sizes).astype(np.int32)[own]).astype(np.uint8)
        order = np.argsort(step, kind="stable")
        # nodes: a segment has one more than bytes
        source, target, piece, weight = (x[order] for x in (start + own, end + own, piece, weight))
        bounds = np.cumsum(np.bincount(step, minlength=2))
        best = np.full(len(data) + len(sizes), np.inf, np.float64 if not self.bpe else np.float32)
        last, back = np.full(len(best), -1, np.int32), np.zeros(len(best), np.int32)
        first = ends - sizes + np.arange(len(sizes))
        best[first] = 0
        for a, b in pairwise(bounds):
            s = source[a:b]
            w = best[s]
            on = np.flatnonzero(w < np.inf)
            s, t, p, w = s[on], target[a:b][on], piece[a:b][on], w[on] + weight[a:b][on]
            if self.bpe and len(s):
                before = last[s]
                ask = np.flatnonzero((before >= 0) & self.plain[p] & self.plain[before])
                bad = ask[~self.stable(before[ask], p[ask])]
                w[bad] = np.inf
            np.minimum.at(best, t, w)
            take = np.flatnonzero((w == best[t]) & (w < np.inf))
            last[t[take]], back[t[take]] = p[take], s[take]
        # back from the ends of all segments
        at, live, steps = ends + np.arange(len(sizes)), np.arange(len(sizes)), []
        if (best[at] == np.inf).any():
            raise ValueError("a text without a path")
        while len(live):
            steps.append((live, last[at]))
            at = back[at]
            on = at > first[live]
            live, at = live[on], at[on]
        counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *(s[0] for s in steps)]), minlength=len(sizes))
        out, behind = np.zeros(counts.sum(), np.int32), np.cumsum(counts)
        for k, (which, p) in enumerate(steps):
            out[behind[which] - 1 - k] = p
        return out, counts

    def long_path(self, data: np.ndarray) -> np.ndarray:
        """The same of one long segment, position by position, with the lattice of a window at a time."""
        if getattr(self, "scalar", None) is None:
            some = self.pairs.keys >= 0 if self.bpe else []
            self.scalar = dict(zip(self.pairs.keys[some].tolist(), self.pairs.values[some].tolist(), strict=True)) if self.bpe else {}
        known, plain = {}, self.plain.tolist()
        n = len(data)
        best, last, back = np.full(n + 1, np.inf), np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        best[0] = 0
        for begin in range(0, n, WINDOW):
            start, end, piece, weight = self.lattice(data, begin, min(n, begin + WINDOW), n)
            order = np.lexsort((end, start))
            for s, e, p, w in zip(*(x[order].tolist() for x in (start, end, piece, weight)), strict=True):
                total = best[s] + w
                if total > best[e] or total == np.inf:
                    continue
                before = int(last[s])
                if self.bpe and before >= 0 and plain[p] and plain[before]:
                    key = before << 32 | p
                    if key not in known:
                        known[key] = self._apart_one(before, p)
                    if not known[key]:
                        continue
                best[e], last[e], back[e] = total, p, e - s
        out, at = [], n
        while at:
            out.append(last[at])
            at -= int(back[at])
        return np.array(out[::-1], np.int32)

    def _apart_one(self, left: int, right: int) -> bool:
        limit = 1 << 31
        while True:
            union = self.scalar.get(left << 32 | right)
            if union is not None and union < limit:
                return False
            a, b = int(self.rank[left]), int(self.rank[right])
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, int(self.right[left])
            else:
                limit, right = b + 1, int(self.left[right])

    # ---- texts ------------------------------------------------------------------------------------
    def segments(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments begin, and the end of the last one."""
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if len(data) > 1:
            cut[1:-1] |= ~self.joined[data[:-1], data[1:]]
            mark = np.flatnonzero((data[2:-1] == 0x81) & (data[1:-2] == 0x96) & (data[:-3] == 0xE2) & (data[3:] == 32)) + 3
            cut[np.setdiff1d(mark, offsets)] = False  # a space after a literal mark
        bounds = np.flatnonzero(cut)
        long = np.flatnonzero(np.diff(bounds) > LONG)
        if not len(long):
            return bounds
        more = []
        for k in long:  # by characters
            text = data[bounds[k] : bounds[k + 1]].tobytes().decode().replace(" ", SPACE)
            at = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joins]
            if at:
                starts = np.flatnonzero((data[bounds[k] : bounds[k + 1]] & 192) != 128)
                more.append(starts[at] + bounds[k])
        return np.unique(np.concatenate([bounds, *more]))

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets in them."""
        column = column.fill_null("") if column.null_count else column
        if self.prefix:
            column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(" ", column.cast(pa.string()), ""))
        data, offsets = buffers(column)
        bounds = self.segments(data, offsets)
        found, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(bounds) - 1:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, "right")) - 1)
            f, c = self._block(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            found.append(f), counts.append(c)
            at = to
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(found), before[np.searchsorted(bounds, offsets)]

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = bounds[:-1], np.diff(bounds)
        _, one, number = np.unique(SpanHasher(data)(starts, bounds[1:]), return_index=True, return_inverse=True)
        short = sizes[one] <= LONG
        s, n = starts[one[short]], sizes[one[short]]
        ends, at, found = np.cumsum(n), 0, [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        while at < len(n):  # lattices take a hundred bytes or so for each of their text
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + BATCH, "right")))
            m = n[at:to]
            found.append(self.paths(data[np.repeat(s[at:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())], m))
            at = to
        flat, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        size = np.zeros(len(one), np.int64)
        size[short] = counts
        begin = np.zeros(len(one), np.int64)
        begin[short] = np.cumsum(counts) - counts
        if not short.all():
            parts, total = [flat], len(flat)
            for k in np.flatnonzero(~short):
                parts.append(self.long_path(data[starts[one[k]] : starts[one[k]] + sizes[one[k]]]))
                begin[k], size[k] = total, len(parts[-1])
                total += len(parts[-1])
            flat = np.concatenate(parts)
        n = size[number]
        return flat[np.repeat(begin[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        flat, offsets = self.ids(pa.array(texts, pa.string()))
        return [flat[a:b] for a, b in pairwise(offsets)]

    def written(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inverted machine: bytes of all lists of ids, and their offsets; without the space in front."""
        flat = flat.astype(np.int64)
        sizes = self.surface_at[flat + 1] - self.surface_at[flat]
        ends = np.cumsum(sizes)
        data = self.surface[np.repeat(self.surface_at[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[offsets]
        if self.prefix:
            full = np.flatnonzero(np.diff(at) > 0)
            drop = at[full][data[at[full]] == 32]
            data = np.delete(data, drop)
            at = at - np.searchsorted(drop, at)
        return data, at

    def decode(self, ids) -> str:
        ids = np.array([i for i in ids if 0 <= i < len(self.weights)], np.int64)
        return self.written(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    fields = [f for f in df.schema if f.name.lower() != name.lower()]
    return [f.name for f in fields], T.StructType([*fields, T.StructField(name, kind)])


def compiled(docs: DataFrame, model: str):
    """The machine in all workers; its size depends on the model alone."""
    return docs.sparkSession.sparkContext.broadcast(Transducer(model))


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text."""
    kept, schema = _with(docs, ids_col, T.ArrayType(T.IntegerType(), False))
    machine = compiled(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, text_col, SLICE):
                flat, offsets = machine.value.ids(b.column(text_col))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), ids], [*kept, ids_col])

    return docs.transform(map_batches, run, schema)


def decode(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of each list of ids."""
    kept, schema = _with(docs, text_col, T.StringType())
    machine = compiled(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [machine.value.decode(x or ()) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    return docs.transform(map_batches, run, schema)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, crc32 of the ids as little-endian unsigned 32-bit integers, and whether
    decoding them gives the text again. Ids don't leave the task."""
    machine = compiled(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text", SLICE):
                flat, offsets = machine.value.ids(b.column(1))
                (data, at), (text, where) = machine.value.written(flat, offsets), buffers(b.column(1))
                same = [np.array_equal(data[a:z], text[c:d]) for (a, z), (c, d) in zip(pairwise(at), pairwise(where), strict=True)]
                crc = [zlib.crc32(flat[i:j].astype("<u4")) for i, j in pairwise(offsets)]
                columns = [b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_crc32", "decodes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(map_batches, run, "id long, n_tokens long, ids_crc32 long, decodes boolean").withColumnRenamed("id", id_col)
