"""First writers as a stream: of documents or sentences with one key the first stays, across batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexloom.functions import text as X

#: The state store that keyed state in Python needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _First(StatefulProcessor):
    """Of each key the row of the smallest order in the batch that brings the key; nothing after that batch.

    The state of a key is one value: that it is taken. Rows are looked at a part at a time and one of them is held.
    """

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self.taken.exists(), None
        for part in rows:  # read to its end in any case
            if known or part.empty:
                continue
            least = part.sort_values(self.order, kind="stable").head(1)
            if first is None or least[self.order].iloc[0] < first[self.order].iloc[0]:
                first = least
        if first is not None:
            self.taken.update((True,))
            yield first

    def close(self) -> None:
        pass


def _combined(order: str, key: str):
    """Of each batch of rows the first of each key: what copies a task reads together need not all be sent on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(order, kind="stable").drop_duplicates(key)

    return run


def first_writers(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of a stream (key string, order bigint, ...) the first row of each key: of the earliest batch that has the key the
    row of the smallest order, and nothing after it. If batches come in ascending order, that is the first row of all.

    Rows without a key or an order go. The keys stay in the state store, whose copies lie in the query's checkpoint.
    """
    spark = rows.sparkSession
    for name, value in STORE.items():
        spark.conf.set(name, value)
    own = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    own = own.mapInPandas(_combined(order, key), own.schema)
    return own.groupBy(key).transformWithStateInPandas(_First(order), own.schema, "Append", "None")


def first_documents(docs: DataFrame, seq: str = "seq") -> DataFrame:
    """(document_key, seq) of the first document of each text of a stream (seq bigint, text). Texts are not shuffled."""
    return first_writers(docs.select(X.stable_hash(F.col("text")).alias("document_key"), F.col(seq).cast("long").alias("seq")), "document_key", "seq")


def first_sentences(sentences: DataFrame, seq: Column) -> DataFrame:
    """(dedup_key, place) of the first of each sentence of a stream of extract.extract_sentences, in order of the
    documents' numbers (seq, below 2^39) and of the sentences in them: place is seq * 2^24 + sentence_index."""
    place = F.shiftleft(seq.cast("long"), 24) + F.col("sentence_index")
    return first_writers(sentences.select("dedup_key", place.alias("place")), "dedup_key", "place")


def written(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of first rows to Parquet files, each once, up to what there is to read; started again with the
    same checkpoint it goes on after the last batch that was committed."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
