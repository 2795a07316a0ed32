"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: start at an offset, go on by a
step, both hashed from its name. Shards take turns, each claiming its next free slot, until the table is
full: slot counts differ by one at most, and when a shard comes or goes few other slots change hands. The
table's size is a parameter, not a matter of the data; it's broadcast, and a row is placed by one hash and
one look-up. Placement takes no shuffle and doesn't depend on how often a key occurs; rows of one key stay
together unless ``write`` salts them over several files.

Edge cases: a null key has a hash too and is placed like any other; repeated rows go to one shard; an empty
table gives no rows; columns named like the results are replaced. A single shard can't be lost, so ``placements``
needs two.
"""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh

SIZE = 65537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """Number of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(size) or size < len(shards):
        raise ValueError(f"{size} isn't a prime of at least the number of shards")
    order = []
    for name in shards:
        h = hashlib.blake2b(name.encode(), digest_size=16).digest()
        order.append((int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:], "big") % (size - 1) + 1))
    turn = sorted(range(len(shards)), key=lambda i: shards[i])
    table, at, free = [-1] * size, [x for x, _ in order], size
    while free:
        for i in turn:
            while table[at[i]] >= 0:
                at[i] = (at[i] + order[i][1]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def _placed(df: DataFrame, keys: list[str], size: int, slot_col: str, tables: dict[str, list[str]]) -> DataFrame:
    """``df`` with its rows' slots and what each of the tables, slot by slot, says of them. What is broadcast is as
    large as the table size parameter says."""
    replaced = {c.lower() for c in (slot_col, *tables)}
    rest = [c for c in df.columns if c.lower() not in replaced]
    at, key, names = fresh(df, "_at"), fresh(df, "_slot"), {c: fresh(df, f"_{c}") for c in tables}
    schema = f"`{key}` int, " + ", ".join(f"`{n}` string" for n in names.values())
    table = df.sparkSession.createDataFrame(list(zip(range(size), *tables.values(), strict=True)), schema)
    placed = df.withColumn(at, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(size)).cast("int")).join(F.broadcast(table), F.col(at) == F.col(key))
    return placed.select(*[F.col(f"`{c}`") for c in rest], F.col(at).alias(slot_col), *[F.col(n).alias(c) for c, n in names.items()])


def assign(df: DataFrame, keys: list[str], shards: list[str], size: int = SIZE, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with the slot and the name of each row's shard."""
    return _placed(df, keys, size, slot_col, {shard_col: [shards[i] for i in lookup_table(shards, size)]})


def write(df: DataFrame, to: str, keys: list[str], shards: list[str], files_per_shard: int = 8, size: int = SIZE) -> None:
    """Parquet under ``shard=name``; a shard's rows are dealt to several tasks by a hash of the whole row, so a large
    one isn't one task's, and a task that runs again deals alike."""
    placed = assign(df, keys, shards, size)
    salt = F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(to)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def placements(docs: DataFrame, n: int = SHARDS, size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, slot, shard, and the shard that it would go to if the last one were lost."""
    names = shard_names(n)
    now, later = lookup_table(names, size), lookup_table(names[:-1], size)
    return _placed(docs.select(id_col), [id_col], size, "slot", {"shard": [names[i] for i in now], "rehomed": [names[i] for i in later]})
