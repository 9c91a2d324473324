"""Synthetic verb forms: a lexicon joined with paradigms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V


def paradigms(spark) -> DataFrame:
    rows = [(c, p, ending, flags) for c, table in V.PARADIGMS.items() for p, (ending, flags) in table.items()]
    return spark.createDataFrame(rows, "conjugation string, paradigm string, ending string, flags array<string>")


def generate(lexicon: DataFrame, strict: bool = True) -> DataFrame:
    """All forms of lexicon (lemma, conjugation), with spans; splits go by lemma. A conjugation without a paradigm is an
    error, or else (strict false) its lemmas are left out."""
    df = lexicon.join(F.broadcast(paradigms(lexicon.sparkSession)), "conjugation", "left")
    unknown = F.raise_error(F.concat(F.lit("unsupported conjugation: "), F.coalesce("conjugation", F.lit("none")))) if strict else F.lit(False)
    df = df.where(F.when(F.col("paradigm").isNull(), unknown.cast("boolean")).otherwise(True))
    stem = F.expr("left(lemma, length(lemma) - 1)")
    df = df.withColumn("text", F.concat(stem, "ending"))
    cut = F.length("lemma") - 1
    none = F.array().cast("array<string>")
    span = lambda a, b, atom, flags: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(atom).alias("atom_type"), F.lit(None).cast("string").alias("function"), flags.alias("inflections"))
    spans = F.array(span(F.lit(0), cut, "VERB_STEM", none), span(cut, F.length("text"), "AUXILIARY", F.col("flags")))
    return df.select(
        "text", F.lit(V.SYNTHETIC_SOURCE).alias("source"), F.concat(F.lit("lemma:"), "lemma").alias("document_id"), "lemma", X.lemma_split(F.col("lemma")).alias("split"), "paradigm",
        spans.alias("spans"), F.lit(V.SYNTHETIC_FRACTION).alias("synthetic_batch_max_fraction"),
    )


def unsupported(lexicon: DataFrame) -> DataFrame:
    """Entries whose conjugation has no paradigm."""
    return lexicon.join(F.broadcast(paradigms(lexicon.sparkSession).select("conjugation").distinct()), "conjugation", "left_anti")
