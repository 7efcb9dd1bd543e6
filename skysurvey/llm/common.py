"""What the training-data operators share: tables, shared storage and Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skysurvey.session import local_folder, ship, small_batches

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = local_folder(spark)
    return found


def written(df: DataFrame, tag: str, rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder, with rows of so many rows a file at most: cuts the lineage and survives lost executors.

    The shuffle files of the job that writes it are given back at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("maxRecordsPerFile", rows).parquet(path)
    finally:
        spark.conf.set(clean, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the table that written() made for df, once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def positional(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed c0, c1, ..., whatever their names are, and the new names of the given ones."""
    lower = [c.lower() for c in docs.columns]
    at = [docs.columns.index(n) if n in docs.columns else lower.index(n.lower()) for n in names]
    return docs.toDF(*(f"c{i}" for i in range(len(lower)))), [f"c{i}" for i in at]


def trim() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """What the operators that run Python need on a session."""
    ship(spark)
    small_batches(spark)


def slices(batch: pa.RecordBatch, column: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose binary column holds about size bytes."""
    if not batch.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_columns(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """fn over every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
                trim()

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_input(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and the text, nulls as empty; nothing else is read."""
    return df.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """docs with a column _doc: the key, or an order number by (null last, key, text's hash) where keys repeat or are null.

    docs has no columns of the names _doc, _null, _hash, _key, _part, _own and _before: see positional.
    Rows that repeat both key and text have the same number. Also whether _doc is the key.
    """
    base = docs.withColumn("_doc", F.col(key).cast("bigint"))
    found = base.groupBy("_doc").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.max(F.col("_doc").isNull()).alias("null")).first()
    if (found["most"] or 0) <= 1 and not found["null"]:
        return base, True
    base = docs.withColumn("_null", F.col(key).isNull()).withColumn("_hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    ids = base.select("_null", F.col(key).alias("_key"), "_hash").distinct()
    ids = ids.repartitionByRange(partitions(docs.sparkSession), "_null", "_key", "_hash").withColumn("_part", F.spark_partition_id())
    ids = written(ids, "suffix-order")
    counts = ids.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_key", "_hash"))
    numbers = ids.withColumn("_own", own).join(before, "_part").select("_null", "_key", "_hash", (F.col("_own") + F.col("_before")).alias("_doc"))
    match = (base["_hash"] == numbers["_hash"]) & base[key].eqNullSafe(numbers["_key"])
    return base.join(numbers.select("_key", "_hash", "_doc"), match).select(*[base[c] for c in docs.columns], "_doc"), False
