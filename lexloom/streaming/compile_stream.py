"""Compilation as a stream: JSON lines in, records and failures out, resumed from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators import compile as C


def raw_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """Lines of new files as raw rows; what is no JSON has a null `text` and `bad` holds the line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)
    parsed = F.from_json("value", C.RAW + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r"), "value").select("r.*", F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), F.col("value")).alias("bad"))


def compile_stream(raw: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Each batch is compiled once and its records and failures written under the batch's number, so that a batch run
    again after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        # what is kept are results, not the analysers' tokens; lines that were not read have no text, so they fail too
        compiled = C.compile_records(batch.drop("_bad")).select("record", "failure", "bad", "source", "document_id").persist()
        try:
            C.records(compiled.where("bad is null")).write.mode("overwrite").json(f"{good}/batch={number}")
            unread = compiled.where("bad is not null").select("source", "document_id", F.col("bad").alias("text"), F.lit("invalid_json").alias("reason"), F.lit("input").alias("teacher"), F.lit("").alias("detail"))
            C.failures(compiled.where("bad is null")).unionByName(unread).write.mode("overwrite").json(f"{bad}/batch={number}")
        finally:
            compiled.unpersist()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
