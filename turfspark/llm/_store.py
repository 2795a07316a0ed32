"""Results written to the shared folder."""

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, shared_root

__all__ = ["byte_parts", "cut", "fresh", "map_batches", "materialise", "scratch_path"]

BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows doesn't depend on executors
    that may be lost, and a step with side effects runs once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (removed with its last reference where the cluster cleans checkpoints)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def byte_parts(df: DataFrame, text: str, part_bytes: int, least: int = 8 << 20) -> int:
    """Number of partitions of ``part_bytes`` of text; on small tables of ``least`` bytes, up to four for each core."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, ceil(total / part_bytes), min(ceil(total / least), 4 * cores))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, since texts may be long: where neither the cluster nor the session
    sets another bound than Spark's own 64 MB, the session's is lowered to ``BATCH_BYTES``, so that what a task holds
    stays small beside its heap. A bound given when the session's context was started is left alone."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_LIMIT) and spark.conf.get(_LIMIT, "64MB").lower() in ("64mb", "64m", "67108864b", "67108864"):
        spark.conf.set(_LIMIT, BATCH_BYTES)
    return df.mapInArrow(run, schema)
