"""Corpus statistics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V


def _keys(metric: str, values: Column) -> Column:
    """An array of (metric, key) of the values of an array that are not null; none of a null array."""
    own = F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(metric).alias("metric"), x.cast("string").alias("key")))
    return F.coalesce(own, F.array().cast("array<struct<metric:string,key:string>>"))


def stat_keys(records: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(metric, key), a row for each thing that is counted: records are read once, failures once. Batch or stream."""
    level = lambda x: F.transform(F.col(f"boundaries.{x}"), lambda _: F.lit(x))
    every = F.concat(
        _keys("sentence_length", F.array(F.length("text"))), _keys("script", F.transform(X.chars(F.col("text")), X.script)), *[_keys("boundary", level(x)) for x in V.LEVELS],
        _keys("atom_type", F.transform("spans", lambda s: s["atom_type"])), _keys("function", F.transform("spans", lambda s: s["function"])),
        _keys("inflection", F.flatten(F.transform("spans", lambda s: s["inflections"]))), _keys("bunsetsu_role", F.transform("bunsetsu", lambda s: s["role"])),
    )
    out = records.select(F.explode(every).alias("x")).select("x.metric", "x.key")
    if failures is not None:
        out = out.unionByName(failures.where("reason is not null").select(F.lit("drop_reason").alias("metric"), F.col("reason").cast("string").alias("key")))
    return out


def corpus_stats(records: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(metric, key, count): lengths, scripts, boundaries by level, labels, and reasons of failures. Counts of parts of a
    corpus add up to those of the whole (merged)."""
    return stat_keys(records, failures).groupBy("metric", "key").agg(F.count("*").alias("count"))


def merged(*parts: DataFrame) -> DataFrame:
    """The statistics of several parts of a corpus as those of one."""
    return reduce(DataFrame.unionByName, parts).groupBy("metric", "key").agg(F.sum("count").alias("count"))


def summary(compiled: DataFrame) -> DataFrame:
    """One row: total_sentences, successfully_aligned, dropped, drop_percentage (0 if there are none)."""
    total, ok = F.count("*"), F.count("record")
    return compiled.agg(total.alias("total_sentences"), ok.alias("successfully_aligned"), (total - ok).alias("dropped"), F.when(total > 0, 100.0 * (total - ok) / total).otherwise(0.0).alias("drop_percentage"))


def build_report(documents: DataFrame, sentences: DataFrame, unique: DataFrame, selected: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per source, also those with a quota alone: documents by disposition, candidate sentences, duplicates, selected, and
    what was requested (null without a quota) and not found.

    documents: (source, document_id, text, disposition). A kept document with an empty id or text counts as a document
    and as invalid.
    """
    empty = (F.col("disposition") == "kept") & ((F.length("text") == 0) | (F.length("document_id") == 0))
    n = lambda c: F.count(F.when(c, 1))
    d = documents.groupBy("source").agg(
        n(F.col("disposition") == "kept").alias("documents"), n(F.col("disposition") == "exact").alias("exact_duplicate_documents"), n(F.col("disposition") == "near").alias("near_duplicate_documents"),
        n((F.col("disposition") == "invalid") | empty).alias("invalid_documents"),
    )
    size = lambda rows, name: rows.groupBy("source").agg(F.count("*").alias(name))
    out = d.join(size(sentences, "candidate_sentences"), "source", "left").join(size(unique, "_unique"), "source", "left").join(size(selected, "selected"), "source", "left")
    out = out.join(quotas.select("source", F.col("quota").cast("long").alias("requested")), "source", "full")
    out = out.fillna(0, [c for c in out.columns if c not in ("source", "requested")])
    return out.withColumn("duplicates", F.col("candidate_sentences") - F.col("_unique")).withColumn("shortfall", F.col("requested") - F.col("selected")).drop("_unique")


def split_counts(docs: DataFrame) -> DataFrame:
    """(split, rows, documents): rows and distinct documents of each split."""
    return docs.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("source", "document_id").alias("documents"))


def leaking_documents(rows: DataFrame) -> DataFrame:
    """Documents in more than one split."""
    return rows.groupBy("source", "document_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
