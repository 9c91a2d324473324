"""A training-data pipeline over `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read
again. All but the last return the columns of documents.

Rows with nulls in any column, empty and very long texts pass like others; rows that share a doc_id, or have none, are
judged each by its own text; an empty table stays empty. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, jaccard_join, source_mix, token_planes, toxicity
from lexloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below 0.5; a null or empty text has no votes and stays. Rows alike in id
    and text stay or go together; a score of just 0.5 goes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of the n-gram Jaccard join. Rows without a doc_id, or without
    words, link with nothing and stay; rows that repeat the smallest id all stay."""
    return jaccard_join.one_of_each(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that test phrases cover (n_chars counted anew); a document that is covered whole stays
    with what is left. Null items and those without words match nothing."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, twice at most. Null is a source of its own, the last; texts without
    words have no size and are not taken. The same rows are drawn in any partitioning."""
    return source_mix.mixed(docs).select(*[f"`{c}`" for c in docs.columns])


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read back from the files of token ids, in ascending doc_id order (null
    last, ties by text). A null text is empty: its end id alone."""
    return token_planes.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", cut_benchmark_passages),
    ("source_mix", mix_sources),
    ("token_ids", write_token_ids),
]

#: Toxicity and the mix's draws have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline_{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
