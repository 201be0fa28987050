"""Samples that arrive in batches: append them to a cache and keep mergeable counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fringeworks.operators.stats import count_min_max
from fringeworks.schema import CELL
from fringeworks.sources.cache import ResultCache


def partial_counts(samples: DataFrame) -> DataFrame:
    return count_min_max(samples)


def merge_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*CELL).agg(F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def append_stream(samples: DataFrame, cache: ResultCache, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch to the cache's samples and its counts to ``counts``.
    A batch that is retried replaces its own files, so nothing counts twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{cache.path}/samples_stream/batch={batch_id}")
        partial_counts(batch).write.mode("overwrite").parquet(f"{cache.path}/counts_stream/batch={batch_id}")

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
