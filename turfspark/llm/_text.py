"""Vectorised text primitives over Arrow string columns: byte buffers, word spans, rolling hashes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def sliced(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` holds about ``max_bytes`` (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets in them; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_class(letters: bytes, above: bool) -> np.ndarray:
    """Table of 256: which bytes belong to a word; ``above``: those of non-ASCII characters do."""
    table = np.zeros(256, bool)
    table[list(letters)] = True
    table[128:] = above
    return table


ALNUM = byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", True)
LETTERS = byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", True)


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes (none crosses a row), and for each row the
    number of words before it (one more entry than rows)."""
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(base: np.uint64, n: int) -> np.ndarray:
    """Powers of the base, n at least; the table is kept up to a slice's size."""
    key = str(base)
    if len(_powers.get(key, ())) < n:
        x = np.full(max(n + n // 8, SLICE_BYTES + (64 << 10)), base, np.uint64)
        x[0] = 1
        table = np.cumprod(x, dtype=np.uint64)
        if n > 4 * SLICE_BYTES:  # one huge text
            return table
        _powers[key] = table
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of arbitrary byte spans of one buffer from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, n)[: n - 1], out=self.sums[1:])
        self.inverse = _power(_PINV, n)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 4 * SLICE_BYTES) -> np.ndarray:
    """The same for ascending spans that don't overlap, in blocks, so that one huge text takes no more than they."""
    if len(data) <= block or not len(starts):
        return SpanHasher(data)(starts, ends)
    out, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        a, b = starts[at], ends[to - 1]
        out.append(SpanHasher(data[a:b])(starts[at:to] - a, ends[at:to] - a))
        at = to
    return np.concatenate(out)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The same hashes for separate words."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    return SpanHasher(np.frombuffer(b"".join(words), np.uint8))(ends - sizes, ends)


def shingle_hashes(words: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they all lie in its row."""
    out = np.zeros(len(words), np.uint64)
    valid = np.ones(len(words), bool)
    n = len(words) - size + 1
    if n <= 0:
        return out, np.zeros(len(words), bool)
    total = words[:n].copy()
    for k in range(1, size):
        total = total * _P + words[k : k + n]
    out[:n] = mix(total)
    for k in range(1, size):
        last = per_row[1:] - k
        valid[last[last >= per_row[:-1]]] = False
    return out, valid
