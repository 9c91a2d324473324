"""Documents to sentences with exact code point offsets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import runs

MIN_CHARS, MAX_CHARS = 4, 128
#: Java and Python spell the end of a text differently.
_PIECE = re.compile(X.PIECE.replace("\\z", "\\Z"))


def valid_document(source: Column, document_id: Column, text: Column) -> Column:
    """True where source, id and text are there and not empty."""
    return F.coalesce((F.length(source) > 0) & (F.length(document_id) > 0) & (F.length(text) > 0), F.lit(False))


def _pieces(text: str, least: int, most: int) -> Iterator[tuple[str, int]]:
    """The trimmed pieces of least to most code points of a text, and where they start. str.strip takes what X.WS lists."""
    at = 0
    for piece in _PIECE.findall(text):
        own = piece.strip()
        if least <= len(own) <= most:
            yield own, at + len(piece) - len(piece.lstrip())
        at += len(piece)


def extract_sentences(docs: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """Sentences of docs (source, document_id unique within it, text); invalid documents give none.

    Pieces end after an ender and its closers or at a line end and tile the text, so a running sum of their lengths is
    their start. Trimming moves offsets; kept are trimmed pieces of least to most code points, numbered as kept. All of
    this happens within a document's row, in Arrow batches: nothing is shuffled. Java tests a character against each
    member of such a class in turn, Python looks it up.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, document, text in (own for part in batches for own in runs.pieces(*(part[c] for c in ("source", "document_id", "text")))):
            cut = [list(_pieces(x, least, most)) for x in text.to_pylist()]
            sizes = np.array([len(x) for x in cut], np.int64)
            row = pa.array(np.repeat(np.arange(len(cut)), sizes))
            index = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = [pa.array([x[k] for own in cut for x in own], t) for k, t in enumerate((pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([found[0], source.take(row), document.take(row), pa.array(index.astype(np.int32)), found[1]], names=names)

    names = ["text", "source", "document_id", "sentence_index", "document_start"]
    docs = docs.where(valid_document(F.col("source"), F.col("document_id"), F.col("text"))).select(*[F.col(c).cast("string") for c in ("source", "document_id", "text")])
    rows = docs.mapInArrow(run, "text string, source string, document_id string, sentence_index int, document_start int")
    return rows.select(
        *names, (F.col("document_start") + F.length("text")).alias("document_end"),
        X.split_for_document(F.col("source"), F.col("document_id")).alias("split"), X.dedup_key(F.col("text")).alias("dedup_key"),
    )


def first_of_each_sentence(sentences: DataFrame, *precedence: Column) -> DataFrame:
    """Of sentences with one dedup_key the first by precedence, across sources.

    Copies are compared before the shuffle as well, so a sentence with very many copies is no large group.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in sentences.columns])
    order = F.struct(*[p.alias(f"p{k}") for k, p in enumerate(precedence)])
    return sentences.groupBy(F.col("dedup_key").alias("_of")).agg(F.min_by(own, order).alias("_first")).select("_first.*")


def invalid_documents(docs: DataFrame) -> DataFrame:
    """Failure rows of documents that cannot be extracted."""
    return docs.where(~valid_document(F.col("source"), F.col("document_id"), F.col("text"))).select("source", "document_id", "text", F.lit("invalid_document").alias("reason"))
