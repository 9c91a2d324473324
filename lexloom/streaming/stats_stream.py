"""Corpus statistics as a stream: counts that grow with each batch of records and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import stats


def stats_stream(records: DataFrame, failures: DataFrame | None, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts by (metric, key) as a streaming aggregate: a batch writes the counts that it changed, under its number, so
    that one run again after a failure replaces what it wrote."""

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    counted = stats.stat_keys(records, failures).groupBy("metric", "key").agg(F.count("*").alias("count"))
    return counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(metric, key, count): each count as the last batch that changed it left it."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("metric", "key").agg(F.max_by("count", "batch").alias("count"))
