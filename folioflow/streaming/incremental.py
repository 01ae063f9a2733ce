"""Incremental translation: documents arrive as JSON files, the cache grows batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow import schemas
from folioflow.operators import calls, segments
from folioflow.operators.cachelog import CacheLog
from folioflow.sources import files


def read_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Nested documents from a growing folder of JSON lines."""
    return spark.readStream.schema(f"doc_id long, {schemas.DOCUMENT}").option("maxFilesPerTrigger", max_files).json(path)


def translate_stream(docs: DataFrame, provider, cache_root: str | CacheLog, out: str, checkpoint: str, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Translates each batch with the cache of the batch before and writes a new version of it.

    Batch n reads cache version n and writes version n + 1, results go to out/batch=n; both are
    overwritten if a batch runs again, so a restart gives the same files. Only misses are called.
    With a log instead of a folder each batch adds one run to it, also only once, and what is
    written to the cache follows the batch, not the cache.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark, found = batch.sparkSession, segments.collect_segments(batch)
        if isinstance(cache_root, CacheLog):
            done, _ = calls.translate_texts(found, cache_root, provider, n, f"{cache_root.root}/staging/{n}")
        else:
            done, new = calls.translate_texts(found, files.read_cache(spark, f"{cache_root}/v={n}"), provider, n, f"{cache_root}/staging/{n}")
        done.select("doc_id", "seg_id", "text", "translation").write.mode("overwrite").parquet(f"{out}/batch={n}")
        if not isinstance(cache_root, CacheLog):
            files.write_cache(new, f"{cache_root}/v={n + 1}")
        if on_batch:
            on_batch(n)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_rates(calls_log: DataFrame, by: list[str], ts: str = "ts", window: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Calls per key and window of event time, for a stream or a table."""
    return calls_log.withWatermark(ts, late).groupBy(*by, F.window(ts, window)).agg(F.count("*").alias("n"))
