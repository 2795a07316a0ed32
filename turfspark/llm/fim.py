"""Fill-in-middle examples: texts cut at two places and put together in another order.

A text is cut into prefix, middle and suffix by code points and written as ``<P>`` prefix ``<S>`` suffix ``<M>``
middle (psm), as ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm), or as it is (plain). Cuts, and which form a
document gets, follow from a hash of its id, so a document gets the same wherever and whenever it's worked on.

Cuts count code points, but texts are UTF-8 bytes. ``Exceptions`` is the sparse index between both: of a whole
buffer of texts it records only the characters of several bytes, by position, with the excess bytes up to each.
Between two of them, bytes and code points run alike, so a position is moved over by one binary search among the
exceptions and an addition; an ASCII text needs no entry at all. Texts are cut and joined as bytes; no character
is decoded.

Texts that hold a sentinel stay plain, so sentinels in an output are the ones put there, and ``restored`` rebuilds
the text from output and form alone. Both steps are scans: no shuffle, and no state beyond a slice of rows.

Edge cases: a null text is empty; an empty text is plain, as is one with a sentinel; cuts may coincide or lie at
the ends, so each part may be empty; a row without an id takes part with an empty id; repeated rows each get a row;
texts of any length are worked off whole, with a few bytes for each of their characters of several bytes; an empty
table gives no rows. Other columns, whatever their names, are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import map_batches
from ._text import buffers, sliced

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred: documents that are cut, and of these those in the order suffix, prefix, middle.
CUT_SHARE, SPM_SHARE = 90, 20
SEED = "1"
CUTS = "id string, text string, h1 long, h2 long, h3 long, h4 long"
EXAMPLES = "n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Code points and bytes of a UTF-8 buffer: an entry for each character of several bytes."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        self.chars = self.bytes - self.excess[:-1]

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte at which each of these characters begins."""
        return chars + self.excess[np.searchsorted(self.chars, chars)]

    def to_chars(self, at: np.ndarray) -> np.ndarray:
        """Number of characters before each of these bytes, at which characters begin."""
        return at - self.excess[np.searchsorted(self.bytes, at)]


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a sentinel."""
    at = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], [PREFIX[1], SUFFIX[1], MIDDLE[1]]) & (data[at + 2] == PREFIX[2])]
    row = np.searchsorted(offsets, at, "right") - 1
    found = np.zeros(len(offsets) - 1, bool)
    found[row[at + 3 <= offsets[row + 1]]] = True
    return found


def examples(b: pa.RecordBatch, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> list[pa.Array]:
    """The columns of ``EXAMPLES`` for rows with ``text`` and ``h1`` to ``h4``."""
    data, offsets = buffers(b.column("text"))
    h1, h2, h3, h4 = (b.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
    index = Exceptions(data)
    first = index.to_chars(offsets)
    n, first = np.diff(first), first[:-1]
    a, z = h1 % (n + 1), h2 % (n + 1)
    a, z = np.minimum(a, z), np.maximum(a, z)
    plain = (n == 0) | (h3 % 100 >= cut_share) | marked(data, offsets)
    spm = ~plain & (h4 % 100 < spm_share)
    low, high = index.to_bytes(first + a), index.to_bytes(first + z)
    raw, outputs = memoryview(data), []
    for i, (s, x, y, e) in enumerate(zip(offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), strict=True)):
        if plain[i]:
            outputs.append(bytes(raw[s:e]))
        elif spm[i]:
            outputs.append(b"".join((SUFFIX, raw[y:e], PREFIX, raw[s:x], MIDDLE, raw[x:y])))
        else:
            outputs.append(b"".join((PREFIX, raw[s:x], SUFFIX, raw[y:e], MIDDLE, raw[x:y])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return [
        pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(a, pa.int64(), mask=plain), pa.array(z - a, pa.int64(), mask=plain),
        pa.array(outputs, pa.binary()).view(pa.string()),
    ]


def parts(output: bytes, form: str) -> tuple[bytes, bytes, bytes]:
    """Prefix, middle and suffix of an example that was cut."""
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return (one, middle, two) if form == "psm" else (two, middle, one)


def restore(output: bytes, form: str) -> bytes:
    return output if form == "plain" else b"".join(parts(output, form))


def hashes(key: Column, seed: str = SEED) -> list[Column]:
    """``h1`` to ``h4``: the first four 8-digit groups of the hex SHA-256 of seed, colon and key."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key, F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every document: its length in code points and its example."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *hashes(F.col(id_col).cast("string"), seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "text"):
                found = examples(b, cut_share, spm_share)
                yield pa.RecordBatch.from_arrays([b.column("id"), *found], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.transform(map_batches, run, f"id {kind}, {EXAMPLES}").withColumnRenamed("id", id_col)


def restored(rows: DataFrame, name: str = "restored") -> DataFrame:
    """``rows`` (of ``transform``, all columns) with the text that ``output`` and ``form`` give."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "output"):
                outputs, form = b.column("output").cast(pa.binary()), b.column("form").to_pylist()
                texts = [restore(o.as_py(), f) for o, f in zip(outputs, form, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).view(pa.string())], [*names, name])

    return rows.transform(map_batches, run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Per document its length, form and parts, and the SHA-256 of its example and of the text restored from that."""
    rows = restored(transform(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"),
    )
