"""Queries that write what the tables hold with the library's sinks, and read it back with its sources."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import compile as C
from lexloom.operators import decode, extract, features, infer, near, runs, stats
from lexloom.plans import queries as Q
from lexloom.sources import readers, weights, writers
from lexloom.streaming import compile_stream as streams

LIMIT = 100


def _folder(spark, name: str) -> str:
    return f"{near.shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def wiki_lines(spark, d) -> DataFrame:
    """Documents as JSON lines in folders by language, read at any depth as an extractor's: ids, sizes and titles."""
    folder = _folder(spark, "wiki")
    rows = Q.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("lang", F.lit("none")).alias("lang"))
    rows.write.partitionBy("lang").json(folder)
    good, _ = readers.wiki_jsonl(spark, folder)
    return good.select("source", "document_id", F.length("text").alias("chars"), F.element_at("provenance", "title").alias("title"))


def document_lines(spark, d) -> DataFrame:
    """Documents that have an id and a text, as JSON lines, and how many lines and documents the files hold."""
    folder = _folder(spark, "documents")
    own = Q.documents(spark, d).withColumn("text", F.when(F.col("doc_id") % 10 != 0, F.col("text")))
    writers.documents_jsonl(own.select("source", "document_id", "text"), folder)
    back = readers.jsonl(spark, folder, "source string, document_id string, text string")
    return back.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars")).crossJoin(readers.line_count(spark, folder))


def split_lines(spark, d) -> DataFrame:
    """Documents with their split as JSON lines; those of one split, read by it."""
    folder = _folder(spark, "splits")
    Q.documents(spark, d).select("document_id", X.document_split(F.col("source"), F.col("document_id")).alias("split")).write.json(folder)
    return readers.jsonl(spark, folder, "document_id string, split string", split="dev")


def limited_lines(spark, d) -> DataFrame:
    """How many of the documents' lines a reader with a limit reads."""
    folder = _folder(spark, "limited")
    Q.documents(spark, d).select("document_id").write.json(folder)
    return readers.jsonl(spark, folder, "document_id string", limit=LIMIT).agg(F.count("*").alias("lines"))


def good_and_bad_lines(spark, d) -> DataFrame:
    """Compiled sentences in two sinks: records by their number of atoms, failures by their reason."""
    good, bad = _folder(spark, "good"), _folder(spark, "bad")
    writers.good_and_bad(Q._compiled(spark, d), good, bad)
    records = readers.jsonl(spark, good, "document_id string, spans array<struct<start:int,end:int>>").groupBy(F.concat(F.lit("atoms "), F.size("spans").cast("string")).alias("told")).agg(F.count("*").alias("n"))
    return records.unionByName(readers.jsonl(spark, bad, "reason string").groupBy(F.col("reason").alias("told")).agg(F.count("*").alias("n")))


def compiled_stream(spark, d) -> DataFrame:
    """Raw sentences as JSON lines, some of them cut, compiled by a stream in batches of files: records and failures by reason."""
    folder = _folder(spark, "stream")
    raw = Q._raw(spark, d)
    line = F.to_json(F.struct(*raw.columns))
    cut = F.length("text") % 17 == 0
    raw.select(F.when(cut, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(f"{folder}/in")
    # the same length gate as that of the batch; files of all cores' tasks, so that a batch is work for all
    rows = streams.raw_stream(spark, f"{folder}/in", files_a_batch=max(2, spark.sparkContext.defaultParallelism))
    streams.compile_stream(rows, f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint").awaitTermination()
    good = spark.read.schema("document_id string").json(f"{folder}/good").select(F.lit("compiled").alias("told"))
    bad = spark.read.schema("reason string").json(f"{folder}/bad").select(F.col("reason").alias("told"))
    return good.unionByName(bad).groupBy("told").agg(F.count("*").alias("n"))


def training_files(spark, d) -> DataFrame:
    """Coded records as padded training arrays, read back by split and array: rows, places, characters, sums of targets."""
    folder = _folder(spark, "arrays")
    s = Q.sentences(spark, d).select("source", "document_id", "text")
    writers.training_arrays(s, folder, make=Q._own_coded)
    arrays = ["atom_targets", "role_targets", "boundary_targets"]
    out = None
    for split in ("train", "dev", "test"):
        rows = readers.training_arrays(spark, folder, split, *arrays)
        own = runs.with_fields(rows, _sums, "chars long, atoms long, roles long, ends long", "mask", *arrays).select(F.lit(split).alias("split"), "bucket", "chars", "atoms", "roles", "ends")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("split", "bucket").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("chars", "atoms", "roles", "ends")])


def _sums(*columns: pa.Array) -> pa.Array:
    """The sums of a training row's arrays."""

    def total(x: pa.Array) -> np.ndarray:
        row, values = runs.elements(x)
        own = total(values) if pa.types.is_list(values.type) else runs.ints(values, 0)
        return np.bincount(row, own, len(x)).astype(np.int64)

    return runs.struct(**dict(zip(("chars", "atoms", "roles", "ends"), map(pa.array, map(total, columns)), strict=True)))


def invalid_documents(spark, d) -> DataFrame:
    """Documents of which every tenth has no text and every tenth an empty one: those that cannot be extracted."""
    k = F.col("doc_id") % 10
    docs = Q.documents(spark, d).withColumn("text", F.when(k == 1, "").when(k != 0, F.col("text")))
    return extract.invalid_documents(docs).select("document_id", "reason", F.coalesce(F.length("text"), F.lit(-1)).alias("chars"))


def rejected_texts(spark, d) -> DataFrame:
    """Why documents' texts are rejected by the analysis of single texts."""
    k = F.col("doc_id") % 10
    docs = Q.documents(spark, d).withColumn("text", F.when(k == 1, "").when(k != 0, F.substring("text", 1, F.lit(125) + (F.col("doc_id") % 9).cast("int"))))
    return docs.select("document_id", decode.rejected(docs).alias("reason")).where("reason is not null")


def display_labels(spark, d) -> DataFrame:
    """Display labels of the spans of coded records, and how many there are."""
    spans = Q._coded(Q._identified(spark, d)).select(F.explode("spans").alias("s"))
    return spans.groupBy(X.display_label(F.col("s.atom_type"), F.col("s.function")).alias("label")).agg(F.count("*").alias("n"))


def affine_scans(spark, d) -> DataFrame:
    """The last states of an affine scan over each vector's components, forward and backward."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1, 1)
                mask, decay = np.ones(x.shape[:2]), np.zeros(1)
                ways = [infer.affine_scan(x, mask, decay, reverse)[:, 0 if reverse else -1, 0] for reverse in (False, True)]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], *map(pa.array, ways)], names=["vec_id", "forward", "backward"])

    rows = Q.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, forward double, backward double").select("vec_id", F.round("forward", 6).alias("forward"), F.round("backward", 6).alias("backward"))


def failure_stats(spark, d) -> DataFrame:
    """Statistics of compiled sentences and of why others failed."""
    compiled = near.checkpointed(Q._compiled(spark, d).select("record", "failure"))
    told = stats.corpus_stats(C.records(compiled), C.failures(compiled))
    return told.where("metric in ('drop_reason', 'sentence_length', 'atom_type', 'function', 'inflection')")


def encoded_pairs(spark, d) -> DataFrame:
    """Sums of the categorical features of all sentences, by feature, as the model's input in numpy has them."""
    s = Q.sentences(spark, d).select("text")
    names = features.FEATURE_NAMES

    def run(batches):
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += features.encoded_texts(batch["text"].to_pylist())[2].sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["feature", "n"])

    return s.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def activations(spark, d) -> DataFrame:
    """Sums of the model's activation and of the logistic function over each vector's components."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(infer.gelu(x).sum(1)), pa.array((1 / (1 + np.exp(-x))).sum(1))], names=["vec_id", "gelu", "logistic"])

    rows = Q.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, gelu double, logistic double").select("vec_id", F.round("gelu", 7).alias("gelu"), F.round("logistic", 7).alias("logistic"))


def requested_documents(spark, d) -> DataFrame:
    """Of requested ids (those of the pages) the documents that are there, and the ids that are not."""
    ids = Q.table(spark, d, "pages").select((F.col("page_id") * 7).cast("string").alias("document_id")).distinct()
    found, missing = readers.requested(Q.documents(spark, d).select("document_id", F.length("text").alias("chars")), ids)
    return found.select("document_id", F.lit("found").alias("told"), F.coalesce("chars", F.lit(0)).alias("chars")).unionByName(missing.select("document_id", F.lit("missing").alias("told"), F.lit(0).alias("chars")))


def report_text(spark, d) -> DataFrame:
    """A report of one row as JSON text."""
    docs = Q.documents(spark, d)
    row = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.count_distinct("source").alias("sources"))
    return spark.createDataFrame([(writers.report_json(row),)], "report string")


def weights_in_use(spark, d) -> DataFrame:
    """All sentences analysed with weights written and read back, in batches of one length, against those of the half floats
    themselves in padded batches: sentences, and those whose spans differ; and texts that are rejected."""
    folder = _folder(spark, "weights")
    own = weights.Weights.of("50k", infer.seeded_weights("50k"))
    weights.write_weights(spark, own, f"{folder}/weights.gz", f"{folder}/weights.json")
    read = weights.read_weights(spark, f"{folder}/weights.gz", f"{folder}/weights.json", "50k")
    texts = near.checkpointed(Q.sentences(spark, d).select("text").unionByName(Q.documents(spark, d).select("text")).distinct().select(F.xxhash64("text").alias("id"), "text"))
    one, bad = decode.analyze(texts, read, "id", only=("levels", "spans"))
    other, _ = decode.analyze(texts, own, "id", equal=False, only=("spans",))
    # the text too, for two texts may share an id
    both = one.select("id", "text", "levels", "spans").join(other.select("id", "text", F.col("spans").alias("other")), ["id", "text"], "full")
    told = both.agg(F.count("*").alias("sentences"), F.count_if(~F.col("spans").eqNullSafe(F.col("other"))).alias("differing"))
    return told.crossJoin(bad.agg(F.count("*").alias("rejected")))


QUERIES = {
    f.__name__: f
    for f in (
        wiki_lines, document_lines, split_lines, limited_lines, good_and_bad_lines, compiled_stream, training_files, invalid_documents, rejected_texts, display_labels, affine_scans, failure_stats, encoded_pairs, activations,
        requested_documents, report_text, weights_in_use,
    )
}
