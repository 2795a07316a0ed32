"""Reading and writing of tables, and keyed updates. Every function works on any store that Spark reads."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SCHEDULE, TEXT_IDS
from .page_files import PageSource
from .scratch import store_of


def read_table(spark: SparkSession, path: str, schema: str | None = None, names: list[str] | None = None) -> DataFrame:
    """A stored table; columns that are named by digits take the positional ``names``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if names:
        df = df.withColumnsRenamed({c: names[int(c)] for c in df.columns if c.isdigit() and int(c) < len(names)})
    return df


def read_csv_typed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. With a schema nothing is inferred; without one, every column is text except that
    the known ids are named, so leading zeros stay."""
    if schema:
        return spark.read.schema(schema).option("header", True).csv(path)
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[F.col(f"`{c}`").cast(TEXT_IDS.get(c, "string")).alias(c) for c in df.columns])


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEDULE).csv(path)


def read_pages(spark: SparkSession, folder: str, glob: str = "*.bin", charset: str | None = None) -> DataFrame:
    """(page_id, html, charset, damaged) of a folder of pages, empty ones too; ``page_files`` tells how."""
    spark.dataSource.register(PageSource)
    reader = spark.read.format("pages").option("glob", glob)
    return (reader.option("charset", charset) if charset else reader).load(folder)


def stream_pages(spark: SparkSession, folder: str, glob: str = "*.bin", charset: str | None = None, settle_seconds: float = 1) -> DataFrame:
    """The same as pages are saved."""
    spark.dataSource.register(PageSource)
    reader = spark.readStream.format("pages").option("glob", glob).option("settleSeconds", str(settle_seconds))
    return (reader.option("charset", charset) if charset else reader).load(folder)


def write_pages(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", ending: str = "bin", charset: str = "UTF-8") -> int:
    """A file ``<key>.<ending>`` for each page, written by the tasks; returns the number of files. A task that runs again
    writes the same files; of several rows of a key the page that comes last by its characters is kept, a null one only
    if there's no other. A page without a key is an error."""
    store, base = store_of(folder)
    store.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for b in batches:
            for k, content in zip(b.column(0), b.column(1), strict=True):
                with store.open_output_stream(f"{base}/{k.as_py()}.{ending}", compression=None) as out:
                    out.write((content.as_py() or "").encode(charset))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    keys = F.col(key).cast("string")
    rows = pages.select(F.coalesce(keys, F.raise_error(F.lit("a page has no key"))).alias("k"), F.col(html).alias("h")).groupBy("k").agg(F.max("h").alias("h"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """The table ``name``, at ``path`` or in the warehouse, cut by the key into ``buckets`` sorted files. Two tables cut alike
    by keys of one type are joined on them, and one is grouped by its key, without a shuffle of either."""
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, schema: T.StructType, path: str, key: str, buckets: int) -> DataFrame:
    """A table of ``write_bucketed`` in a session whose catalogue doesn't know it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def upsert_by_key(old: DataFrame, new: DataFrame, key: str = "race_id") -> DataFrame:
    """All rows of a key are replaced by the new batch's; write the result to a new path, then swap."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, key: str = "race_id", partition: str = "year", staging: str | None = None, schema=None) -> None:
    """The same for a partitioned table: only partitions that the batch touches, or that hold an older row of its keys,
    are rewritten, and only those that lose or gain rows. The new partitions are written to ``staging`` first; should
    the swap fail, they're complete there, and running it again gives the same table. ``schema`` is needed where the
    table may have no rows yet."""
    stored = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    touched = new.select(partition).unionByName(stored.join(new.select(key).distinct(), key, "left_semi").select(partition))
    touched = [r[0] for r in touched.distinct().collect()]  # partition values
    kept = F.lit(False)
    for value in touched:
        kept = kept | F.col(partition).eqNullSafe(F.lit(value))
    merged = upsert_by_key(stored.filter(kept), new, key)
    staging = staging or path.rstrip("/") + "_staging"
    gathered = merged.hint("rebalance", F.col(partition))  # else every task has a file of every partition
    gathered.write.mode("overwrite").partitionBy(partition).parquet(staging)  # what is rewritten must not be read meanwhile
    fresh = spark.read.schema(merged.schema).parquet(staging)
    left = {r[0] for r in fresh.select(partition).distinct().collect()}
    emptied = [v for v in touched if v not in left]
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for value in emptied:  # dynamic overwriting leaves partitions without new rows as they were
        _drop_partition(spark, path, partition, value)


def _drop_partition(spark: SparkSession, path: str, partition: str, value) -> None:
    store, base = store_of(path)
    store.delete_dir(f"{base.rstrip('/')}/{partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")


def new_keys_only(wanted: DataFrame, done: DataFrame, key: str = "race_id") -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def resume_after(wanted: DataFrame, last: str | int, key: str = "race_id") -> DataFrame:
    return wanted.filter(F.col(key) >= last)


def touch_master(master: DataFrame, batch: DataFrame, stamp, key: str = "id", updated: str = "updated_at") -> DataFrame:
    """Freshness table: ids of the batch get the stamp, unseen ones are added."""
    now = batch.select(F.col(key)).distinct().withColumn("_now", F.lit(stamp).cast("timestamp"))
    return master.join(now, key, "full_outer").select(key, F.coalesce("_now", updated).alias(updated))


def ids_updated_on(master: DataFrame, day, key: str = "id", updated: str = "updated_at") -> DataFrame:
    return master.filter(F.to_date(updated) == F.lit(day).cast("date")).select(key)
