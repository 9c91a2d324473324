"""Readers of documents, records and gold corpora. Malformed lines go to a failure frame, never to an exception."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.sources.record_source import records

OPTIONAL = ["url", "dump", "date", "file_path", "language", "language_score", "language_script"]
WIKI = "id string, text string, title string, url string, revid string, _bad string"


def documents(rows: DataFrame, source: str, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with id and text to (source, document_id, text, provenance) and the rows that are not documents."""
    good = F.coalesce(F.col("id").isNotNull() & (F.length("text") > 0), F.lit(False))
    pairs = [x for c in kept for x in (F.lit(c), F.col(c).cast("string"))]
    provenance = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    out = rows.where(good).select(F.lit(source).alias("source"), F.col("id").cast("string").alias("document_id"), "text", provenance.alias("provenance"))
    return out, rows.where(~good)


def web_parquet(spark: SparkSession, path: str, source: str = "web") -> tuple[DataFrame, DataFrame]:
    """Parquet with id and text; of the optional columns those that are there are read."""
    rows = spark.read.parquet(path)
    missing = {"id", "text"} - set(rows.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    kept = [c for c in OPTIONAL if c in rows.columns]
    return documents(rows.select("id", "text", *kept), source, kept)


def wiki_jsonl(spark: SparkSession, path: str, source: str = "wiki") -> tuple[DataFrame, DataFrame]:
    """JSON lines of an extractor, below path at any depth."""
    reader = spark.read.schema(WIKI).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true")
    return documents(reader.json(path), source, ["title", "url", "revid"])


def jsonl(spark: SparkSession, path: str, schema: str, split: str | None = None, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    rows = rows.where(F.col("split") == split) if split else rows
    return rows.limit(limit) if limit else rows


def conllu_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (value: lines of one sentence) to (comments, tokens); only lines of ten fields with a whole number stay."""
    lines = F.split("value", "\n")
    about = F.filter(lines, lambda x: x.startswith("#") & (F.instr(x, " = ") > 0))
    entry = F.transform(about, lambda x: F.struct(F.split(F.substring(x, 3, 1 << 30), " = ", 2)[0].alias("k"), F.split(F.substring(x, 3, 1 << 30), " = ", 2)[1].alias("v")))
    # of repeated names the last counts
    entry = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda o: o["k"] == e["k"]))
    fields = F.transform(F.filter(lines, lambda x: ~x.startswith("#")), lambda x: F.split(x, "\t", -1))
    tokens = F.filter(fields, lambda t: (F.size(t) == 10) & F.get(t, F.lit(0)).rlike("^[0-9]+$"))
    return blocks.select(F.map_from_entries(entry).alias("comments"), tokens.alias("tokens")).where(F.size("tokens") > 0)


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of CoNLL-U files, LF or CRLF, read in byte ranges."""
    return conllu_blocks(records(spark, path, "blank"))


def knp_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (value: lines up to EOS, document_id) to (sentence_id, document_id, tokens, b_starts, bunsetsu_starts)."""
    # a line is looked at once, in Arrow batches: as array functions each token's line was split for each of its fields
    out = blocks.select("document_id", F.arrow_udf(_knp_lines, f"struct<{KNP_LINES}>")("value").alias("_found"))
    return out.select(F.col("_found.sentence_id").alias("sentence_id"), "document_id", *[F.col(f"_found.{c}").alias(c) for c in ("tokens", "b_starts", "bunsetsu_starts")]).where("sentence_id is not null and size(tokens) > 0")


KNP_LINES = "sentence_id string, tokens array<struct<surface:string,lemma:string,pos:string,subpos:string,conj_type:string,conj_form:string>>, b_starts array<int>, bunsetsu_starts array<int>"
_SID, _SPACES = re.compile(r"# S-ID:([^ \t\n\x0b\f\r]+)"), re.compile(r"[ \t\n\x0b\f\r]+")


def _knp_lines(value: pa.Array) -> pa.Array:
    """KNP_LINES of each block; without a head line all is null."""
    ids, sizes, fields, marks = [], [], [], {"+": ([], []), "*": ([], [])}
    for block in value.to_pylist():
        head, n, starts = None, 0, {"+": 0, "*": 0}
        for line in (block or "").split("\n"):
            first = line[:1]
            if first == "#":
                if head is None and line.startswith("# S-ID:"):
                    head = line
            elif first in marks and first:
                marks[first][1].append(n)
                starts[first] += 1
            elif first:
                own = _SPACES.split(line.strip(" "))
                if len(own) >= 10:
                    fields.append(own)
                    n += 1
        found = _SID.match(head) if head else None
        ids.append(None if head is None else found[1] if found else "")
        sizes.append(n)
        for m, (count, _) in marks.items():
            count.append(starts[m])
    lists = lambda count, values: pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(count)], pa.int32()), values)
    names = {"surface": 0, "lemma": 2, "pos": 3, "subpos": 5, "conj_type": 7, "conj_form": 9}
    tokens = pa.StructArray.from_arrays([pa.array([x[k] for x in fields], pa.string()) for k in names.values()], names=[*names])
    made = [pa.array(ids, pa.string()), lists(sizes, tokens), *[lists(marks[m][0], pa.array(marks[m][1], pa.int32())) for m in ("+", "*")]]
    return pa.StructArray.from_arrays(made, names=["sentence_id", "tokens", "b_starts", "bunsetsu_starts"])


def knp(spark: SparkSession, path: str, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Sentences of a directory of KNP files named by document; with ids (document_id), only those, and the ids missing."""
    blocks = records(spark, path, "eos").withColumn("document_id", F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1))
    if ids is None:
        return knp_blocks(blocks), None
    found, missing = requested(blocks, ids)
    return knp_blocks(found), missing


def requested(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (document_id) those of the requested ids (document_id), and the ids that no row has."""
    return rows.join(ids.select("document_id"), "document_id", "left_semi"), ids.join(rows.select("document_id").distinct(), "document_id", "left_anti")


def line_numbers(lines: DataFrame, *order: str) -> DataFrame:
    """lines with `line` from 0, within each file (`file`)."""
    return lines.withColumn("line", F.row_number().over(W.partitionBy("file").orderBy(*order)) - 1)


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """(lines): the lines of the files at path, counted where they lie."""
    return spark.read.option("recursiveFileLookup", "true").text(path).agg(F.count("*").alias("lines"))


def training_arrays(spark: SparkSession, path: str, split: str, *arrays: str) -> DataFrame:
    """Padded training rows of a split (bucket, mask and the named arrays, else all); other splits and columns stay unread."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    return df.select("bucket", "mask", *arrays) if arrays else df.drop("split")


def quota_inputs(spark: SparkSession, quotas: dict[str, str | int], inputs: dict[str, str]) -> DataFrame:
    """(source, quota) of quotas by source, checked against the inputs' paths by source: counts are whole numbers, each
    source has an input, and each path (or pattern) leads to a file that Spark can see."""
    counts = {}
    for source, count in quotas.items():
        try:
            counts[source] = int(str(count))
        except ValueError:
            raise ValueError(f"quota count must be an integer: {source}={count}") from None
    missing = sorted(set(counts) - set(inputs))
    if missing:
        raise ValueError("quota sources missing inputs: " + ", ".join(missing))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for source, path in inputs.items():
        place = hadoop(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
            raise ValueError(f"input does not exist: {source}={path}")
    return spark.createDataFrame(list(counts.items()), "source string, quota int")


def named_input(value: str) -> tuple[str, str]:
    """The name and path of SOURCE=PATH; the path may hold more equals signs."""
    source, _, path = value.partition("=")
    if not source or not path:
        raise ValueError(f"expected SOURCE=PATH, found {value!r}")
    return source, path
