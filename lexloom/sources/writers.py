"""Writers: documents, good and bad rows of one pass, shards, padded training arrays, packed weights, reports."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import compile as C
from lexloom.operators import features, sample
from lexloom.sources.weights import pack_fp16, unpack_fp16  # noqa: F401


def documents_jsonl(docs: DataFrame, path: str) -> None:
    """Documents with an id and a text that is not empty, as JSON lines."""
    docs.where("document_id is not null and length(text) > 0").write.mode("overwrite").json(path)


def good_and_bad(compiled: DataFrame, good: str, bad: str) -> None:
    """One pass writes the tagged rows; records and failures are partitions of it, read by `tag`."""
    rows = compiled.select(F.when(F.col("record").isNotNull(), "record").otherwise("failure").alias("tag"), "record", "failure")
    rows = rows.persist()
    try:
        C.records(rows).write.mode("overwrite").json(good)
        C.failures(rows).write.mode("overwrite").json(bad)
    finally:
        rows.unpersist()


def sharded_jsonl(rows: DataFrame, order: str, n: int, path: str, expected: int | None = None) -> DataFrame:
    """Write contiguous shards and return their manifest; a wrong total is an error."""
    cut = sample.shards(rows, order, n)
    if expected is not None and (have := cut.count()) != expected:
        raise ValueError(f"expected {expected} lines, found {have}")
    cut.repartitionByRange(n, "shard").sortWithinPartitions("shard", "line").write.mode("overwrite").partitionBy("shard").json(path)
    return sample.shard_manifest(cut)


def training_arrays(records: DataFrame, path: str, codepoints: int = 8192, bigrams: int = 8192, make: Callable | None = None) -> None:
    """Features and targets, padded to their bucket, as Parquet by split and bucket. `mask` tells text from padding.

    Rows are in the order of the folders before their arrays are made (make: as training_rows takes it), some 250 bytes a
    place, so that a writer has one file open and no arrays are sorted.
    """
    kept = ["split", "bucket", "text", *(() if make else features.LABELLED)]
    own = features.bucketed(records).select(*kept).sortWithinPartitions("split", "bucket")
    df = features.training_rows(own, codepoints, bigrams, make).select("split", "bucket", "mask", *features.ARRAYS)
    df.write.mode("overwrite").partitionBy("split", "bucket").parquet(path)


def report_json(row: DataFrame) -> str:
    """The one row of a report as indented JSON."""
    return json.dumps(json.loads(row.toJSON().first()), ensure_ascii=False, indent=2) + "\n"


def reproducible_gzip(data: bytes) -> bytes:
    return gzip.compress(data, 9, mtime=0)


def read_weights(data: bytes) -> bytes:
    """Weights, gzipped or raw."""
    return gzip.decompress(data) if data[:2] == struct.pack("<H", 0x8B1F) else data


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
