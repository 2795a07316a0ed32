"""Which keys of a batch are new, without a shuffle of all known keys: a Bloom filter kept as a table beside them.

The filter is a table of 64-bit words (``word``, ``bits``), of which each key sets ``hashes`` bits in one; words without
a bit have no row. ``words`` and ``hashes`` are columns of it, so that whoever reads it agrees with who wrote it.
Filters of the same size are merged by a bitwise or, in any order, and adding a key twice changes nothing. A key that
the filter doesn't know is new for certain; the others, a few, are looked up among the known keys.

Keys are compared as they are: a batch's key column has the type of the known one, and isn't floating. A null key is
never known, as in an anti join. Rows of the batch are kept as often as they come.
"""

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import stored

BITS_PER_KEY, HASHES = 16, 4
BROADCAST_KEYS = 200_000


def _typed(df: DataFrame, key: str) -> str:
    kind = dict(df.dtypes)[key]
    if kind in ("float", "double"):
        raise ValueError(f"{key}: keys are whole numbers, texts, dates or the like, not {kind}")
    return kind


def _place(key: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(key), words)


def _mask(key: Column, hashes: int) -> Column:
    bits = F.lit(0).cast("long")
    for i in range(hashes):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(i), key), F.lit(64)).cast("int")))
    return bits


def key_filter(known: DataFrame, key: str, expected: int, bits_per_key: int = BITS_PER_KEY, hashes: int = HASHES) -> DataFrame:
    """The filter of the known keys, sized for ``expected`` of them; more make it less selective, never wrong."""
    _typed(known, key)
    words = F.lit(max(1, ceil(expected * bits_per_key / 64))).cast("long")
    rows = known.filter(F.col(key).isNotNull()).select(_place(F.col(key), words).alias("word"), _mask(F.col(key), hashes).alias("bits"))
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).select("word", "bits", words.alias("words"), F.lit(hashes).alias("hashes"))


def merged_filter(*filters: DataFrame) -> DataFrame:
    """One filter of several of the same size and number of hashes; others are an error."""
    both = filters[0]
    for f in filters[1:]:
        both = both.unionByName(f)
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit(f"filters differ in {c}")))
    return both.groupBy("word").agg(F.bit_or("bits").alias("bits"), one("words").alias("words"), one("hashes").alias("hashes"))


def _size(keys: DataFrame) -> tuple[int, int] | None:
    low = keys.agg(F.min("words"), F.max("words"), F.min("hashes"), F.max("hashes")).first()  # one row
    if low[0] is None:
        return None
    if low[0] != low[1] or low[2] != low[3]:
        raise ValueError("rows of filters of different sizes")
    return low[0], low[2]


def filled(keys: DataFrame) -> float:
    """Share of the filter's bits that are set; beyond a half it's time to build a larger one."""
    size = _size(keys)
    return keys.agg(F.sum(F.bit_count("bits"))).first()[0] / (64 * size[0]) if size else 0.0


def possibly_known(batch: DataFrame, keys: DataFrame, key: str, name: str = "possibly") -> DataFrame:
    """``batch`` with a boolean: false means that the key is new for certain."""
    _typed(batch, key)
    size = _size(keys)
    if size is None:
        return batch.withColumn(name, F.lit(False))
    found = keys.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    rows = batch.withColumns({"_place": _place(F.col(key), F.lit(size[0])), "_mask": _mask(F.col(key), size[1])})
    hit = F.col(key).isNotNull() & F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return rows.join(found, F.col("_place") == F.col("_word"), "left").withColumn(name, hit).drop("_place", "_mask", "_word", "_bits")


def new_keys_by_filter(batch: DataFrame, known: DataFrame, keys: DataFrame, key: str, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``new_keys_only(batch, known, key)``. Without a possible hit the known keys aren't read at all. With up to
    ``broadcast_keys`` of them, counted, these go to the known keys, which aren't shuffled; beyond that an anti join takes both."""
    if _typed(batch, key) != _typed(known, key):
        raise ValueError(f"{key} has other types in the batch and in the known keys")
    rows = stored(possibly_known(batch, keys, key, "_possibly"), "possibly")
    new, possible = rows.filter("not _possibly").drop("_possibly"), rows.filter("_possibly").drop("_possibly")
    asked = possible.select(key).distinct()
    n = asked.count()
    if n == 0:
        return new
    hits = known.select(key)
    if n <= broadcast_keys:
        hits = hits.join(F.broadcast(asked), key, "left_semi").distinct()
    return new.unionByName(possible.join(hits, key, "left_anti").select(*new.columns))
