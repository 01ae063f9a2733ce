"""Shared pieces of the training-data operators: the shared folder and small helpers."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.staging import shared_dir

#: Ids that row_ids gives to rows without one lie below.
NULL_IDS = -(2**62)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df once to the shared folder and reads it back.

    The files survive lost executors. They stay until cleanup(), as the result of
    an operator may read them at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Bytes of a written table from which it is worth a collection to delete the shuffles of its job at once.
RELEASE_BYTES = 16 << 20


def release(done: DataFrame, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more. Unless the table done, written last, is small, also
    has the driver forget the shuffles of jobs that are done, so that executors delete their files now
    and not at some later collection; only those of DataFrames that no variable holds can go."""
    spark = done.sparkSession
    for t in tables:
        _delete(spark, t._written_to)
    if _bytes(done) < RELEASE_BYTES:
        return
    gc.collect()
    # What the first collection lets go of in the JVM is found by the second.
    for wait in (0.05, 0.0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds the Python objects of few rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose hot keys can be split at run time, also where one side comes from an aggregate.

    An aggregate on the same keys leaves its rows dealt by them, and then the other side must
    lie in one task per key too. A second key, a hash of the first, has both sides dealt anew,
    so that adaptive execution may divide what a hot key holds among tasks.
    """
    keyed = [df.withColumn("__k", F.xxhash64(*on)) for df in (left, right)]
    return keyed[0].join(keyed[1], [*on, "__k"], how).drop("__k")


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Columns k1 and k2, two hashes of id and text: a key for rows whose id is null or repeated.
    Only rows with equal id and text share it."""
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return F.xxhash64(F.lit(1), own, text).alias("k1"), F.xxhash64(text, F.lit(2), own).alias("k2")


def row_ids(id_col: str, text_col: str) -> Column:
    """The id of a row's document. A row without one is a document of its own: it takes an id below
    NULL_IDS by a hash of its text, which only rows with the same text share."""
    own = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 2)
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), own)


def _bytes(df: DataFrame) -> int:
    """The size of a written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> bool:
    """Whether a written table is small enough for Spark to broadcast it."""
    return _bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def build_side(df: DataFrame) -> DataFrame:
    """The written table as the build side of a join: broadcast if it is small, else of a hash join, so
    that the rows that meet it are never sorted."""
    return df if small(df) else df.hint("shuffle_hash")


def prefix_sums(df: DataFrame, key: str, value: str, alias: str, by: tuple[str, ...] = (), width: int = 4096) -> DataFrame:
    """df(by..., key long from 0, value) with alias: the sum of value over the smaller keys of the group.

    In two levels, sums of ranges of width keys first, so that no task holds the keys of a group.
    """
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    whole = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    up_to = lambda *c: Window.partitionBy(*c).rowsBetween(Window.unboundedPreceding, -1)
    base = whole.withColumn("__base", F.coalesce(F.sum("__sum").over(up_to(*by).orderBy("__range")), F.lit(0))).drop("__sum")
    within = ranged.withColumn("__in", F.coalesce(F.sum(value).over(up_to(*by, "__range").orderBy(key)), F.lit(0)))
    return within.join(base, [*by, "__range"]).withColumn(alias, F.col("__base") + F.col("__in")).drop("__range", "__base", "__in")


def cleanup(spark: SparkSession) -> None:
    """Deletes what this application's operators wrote to the shared folder."""
    _delete(spark, f"{shared_dir(spark)}/folioflow-{spark.sparkContext.applicationId}")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id (long) and text (string), whatever else df holds."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
