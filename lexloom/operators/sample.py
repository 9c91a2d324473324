"""Quota sampling, top-k by hash, shards, holdouts and batches."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as X

#: Rows a bin should hold, and bins at most; lines of a block of a shard's digest.
BIN_ROWS, MOST_BINS, BLOCK = 10_000, 10_000, 1024
#: Quotas that are broadcast at most; a longer table is joined as Spark sees fit.
MOST_QUOTAS = 100_000


def _placed(binned: DataFrame, by: list[str], order: list[str | Column], keep: Column | None = None) -> DataFrame:
    """binned rows with `_rank` (from 0 within the group `by`) and `_size` (of the group), by counts of bins and ranks
    within a bin, so that no task sorts a whole group. `_bin` must rise along `order`; keep is a filter of bins."""
    w = W.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n")).select(*by, "_bin", before.alias("_before"), F.sum("_n").over(w).alias("_size"))
    bins = (bins if keep is None else bins.where(keep)).withColumnsRenamed({c: f"_of_{c}" for c in (*by, "_bin")})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_bin")]
    rank = F.row_number().over(W.partitionBy(*by, "_bin").orderBy(*order)) - 1 + F.col("_before")
    return binned.join(bins, same).withColumn("_rank", rank.cast("long")).drop("_bin", "_before", *(f"_of_{c}" for c in (*by, "_bin")))


def _ranked(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """rows with `_rank` and `_size` in groups `by`; the first of `order` is a number, of which quantiles bound the bins
    (rows without it come last)."""
    n = min(MOST_BINS, rows.count() // BIN_ROWS + 1)
    edges = rows.approxQuantile(order[0], [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    splits = [-float("inf"), *(sorted(set(edges)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order[0], outputCol="_bin", handleInvalid="keep").transform(rows)
    return _placed(cut.withColumn("_bin", F.coalesce("_bin", F.lit(float(len(splits))))), by, list(order))


def _by_hash(rows: DataFrame, by: list[str], key: str, keep: Column | None = None) -> DataFrame:
    """rows with `_rank` and `_size` in groups `by`, in the order of a hexadecimal hash; its first digits are the bins."""
    return _placed(rows.withColumn("_bin", F.coalesce(F.substring(key, 1, 3), F.lit(""))), by, [key], keep)


def quota_sample(sentences: DataFrame, quotas: DataFrame) -> DataFrame:
    """Of each source the `quota` sentences of smallest sample key. quotas: (source, quota), broadcast up to MOST_QUOTAS."""
    few = quotas.limit(MOST_QUOTAS + 1).count() <= MOST_QUOTAS
    keyed = sentences.join(F.broadcast(quotas) if few else quotas, "source").withColumn("sample_key", X.sample_key(F.col("source"), F.col("document_id"), F.col("sentence_index")))
    placed = _by_hash(keyed, ["source", "quota"], "sample_key", F.col("_before") < F.col("quota"))
    return placed.withColumn("rank", (F.col("_rank") + 1).cast("int")).where(F.col("rank") <= F.col("quota")).drop("quota", "_rank", "_size")


def quota_shortfall(sentences: DataFrame, quotas: DataFrame) -> DataFrame:
    """(source, requested, selected, shortfall), also of sources without sentences."""
    have = sentences.groupBy("source").count()
    chosen = F.least(F.col("quota"), F.coalesce("count", F.lit(0)))
    return quotas.join(have, "source", "left").select("source", F.col("quota").cast("long").alias("requested"), chosen.cast("long").alias("selected"), (F.col("quota") - chosen).cast("long").alias("shortfall"))


def unknown_sources(quotas: DataFrame, inputs: DataFrame) -> DataFrame:
    """Quotas that no input can fill."""
    return quotas.join(inputs.select("source").distinct(), "source", "left_anti")


def top_by_hash(docs: DataFrame, k: int) -> DataFrame:
    """The k documents of smallest sha256 of source and id, in that order."""
    return docs.withColumn("rank_key", X.stable_hash(X.document_key(F.col("source"), F.col("document_id")))).orderBy("rank_key").limit(k)


def shards(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows with `line` and `shard` (0 to n - 1): contiguous runs in `order`, a number; rows without it come last. The
    first shards get one row more."""
    line = _ranked(rows, [], order).withColumnRenamed("_rank", "line")
    size, extra = F.floor(F.col("_size") / n), F.col("_size") % n
    long = extra * (size + 1)
    shard = F.when(F.col("line") < long, F.floor(F.col("line") / (size + 1))).otherwise(extra + F.floor((F.col("line") - long) / F.greatest(size, F.lit(1))))
    return line.withColumn("shard", shard.cast("int")).drop("_size")


def _sha256(c: Column | str) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def shard_manifest(sharded: DataFrame, text: str = "text") -> DataFrame:
    """(shard, start_line, end_line, lines, sha256). The hash is of the blocks' hashes in order, a block's of its lines'
    hashes in order, so order counts and no task holds the texts of a shard; a null text counts as empty."""
    joined = lambda c: _sha256(F.concat_ws("", F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"])))
    lines = sharded.select("shard", "line", F.floor(F.col("line") / BLOCK).alias("block"), _sha256(F.coalesce(text, F.lit(""))).alias("h"))
    blocks = lines.groupBy("shard", "block").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.count("*").alias("n"), joined(F.struct("line", "h")).alias("h"))
    return blocks.groupBy("shard").agg(F.min("start").alias("start_line"), (F.max("end") + 1).alias("end_line"), F.sum("n").alias("lines"), joined(F.struct("block", "h")).alias("sha256"))


def reconcile(manifest: DataFrame, successes: DataFrame, failures: DataFrame) -> DataFrame:
    """Per shard of the manifest or its parts: lines, successes, failures, and whether they add up."""
    ok = successes.groupBy("shard").agg(F.count("*").alias("successes"))
    bad = failures.groupBy("shard").agg(F.count("*").alias("failures"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = manifest.select("shard", "lines").join(ok, "shard", "full").join(bad, "shard", "full").select("shard", zero("lines"), zero("successes"), zero("failures"))
    return out.withColumn("reconciled", F.col("lines") == F.col("successes") + F.col("failures"))


def merged(manifest: DataFrame, successes: DataFrame, failures: DataFrame) -> DataFrame:
    """The successes of all shards in order of shard and line; an error if any shard's rows do not add up."""
    wrong = reconcile(manifest, successes, failures).where("not reconciled").orderBy("shard").head(10)
    if wrong:
        raise ValueError("shards that do not add up (the first ten): " + "; ".join(f"{r.shard}: {r.lines} lines, {r.successes} successes, {r.failures} failures" for r in wrong))
    return successes.orderBy("shard", "line")


def without_holdout(sentences: DataFrame, holdout: DataFrame) -> DataFrame:
    """Sentences whose dedup_key no holdout text has."""
    return sentences.join(holdout.select("dedup_key").distinct(), "dedup_key", "left_anti")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in an order that the seed decides."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key)


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """rows (split, bucket) with batch and position; buckets' last batches go if not full. The first of order is a number."""
    placed = _ranked(rows, ["split", "bucket"], *order).withColumnRenamed("_rank", "position")
    return placed.withColumn("batch", F.floor(F.col("position") / size)).where((F.col("batch") + 1) * size <= F.col("_size")).drop("_size")


def batch_schedule(batched: DataFrame, seed: int) -> DataFrame:
    """(split, bucket, batch, place): the batches of each split in an order that the seed decides, place from 0. Rows of
    one batch stay together, so every batch has one length bucket."""
    key = _sha256(F.concat_ws(":", F.lit(str(seed)), "split", "bucket", "batch"))
    own = batched.select("split", "bucket", "batch").distinct().withColumn("_key", key)
    return _by_hash(own, ["split"], "_key").select("split", "bucket", "batch", F.col("_rank").alias("place"))
