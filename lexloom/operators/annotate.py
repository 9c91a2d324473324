"""Analysers from outside (morphological teachers and the like) over rows of text, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts that an analyser is given at once.
BATCH = 64

Analyser = Callable[[list[str]], list[dict]]


def each(analyse: Callable[[str], dict]) -> Analyser:
    """An analyser of batches that takes one text after another."""
    return lambda texts: [analyse(t) for t in texts]


def told(analyse: Analyser, texts: list[str]) -> list[tuple[dict | None, str | None]]:
    """A record or an error for each text. A batch that fails is halved until the texts that fail are alone."""
    if not texts:
        return []
    try:
        found = list(analyse(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} records for {len(texts)} texts")
        return [(r, None) for r in found]
    except Exception as e:  # whatever an analyser raises is a failure of some row
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    half = len(texts) // 2
    return told(analyse, texts[:half]) + told(analyse, texts[half:])


def told_arrays(analyse: Callable[[pa.Array], pa.Array], texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The same of an analyser of Arrow arrays of texts: records, and errors where there are none.

    Such an analyser gives null for a text that it cannot handle, so the others need not be given again; a batch on which
    it raises all the same is halved. It must take no texts, too.
    """
    if not len(texts):
        return analyse(texts), pa.array([], pa.string())
    try:
        found = analyse(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} records for {len(texts)} texts")
        why = np.where(texts.is_null(), "no text", np.where(found.is_null(), "no record", None))
        return pc.if_else(texts.is_valid(), found, pa.scalar(None, found.type)) if texts.null_count else found, pa.array(why, pa.string())
    except Exception as e:  # whatever an analyser raises is a failure of some row
        if len(texts) == 1:
            return pa.nulls(1, analyse(texts[:0]).type), pa.array(["no text" if texts.null_count else f"{type(e).__name__}: {e}"])
    half = len(texts) // 2
    return tuple(pa.concat_arrays(x) for x in zip(told_arrays(analyse, texts[:half]), told_arrays(analyse, texts[half:]), strict=True))


def annotated(rows: DataFrame, load: Callable[[], Analyser], record: T.StructType, batch: int = BATCH) -> DataFrame:
    """rows (text and others) with `record`, what the analyser makes of the text, or `error`, why it made nothing.

    load() makes the analyser, once a task; it is given up to `batch` texts at once. Texts on which it raises lose their
    own record only; null texts are errors. Columns named record and error are replaced.
    """
    own = [f for f in rows.schema.fields if f.name not in ("record", "error")]
    schema = T.StructType([*own, T.StructField("record", record), T.StructField("error", T.StringType())])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyse = load()
        for frame in frames:
            texts = frame["text"]
            there = texts[texts.notna()]
            found = {}
            for at in range(0, len(there), batch):
                part = there.iloc[at : at + batch]
                found |= dict(zip(part.index, told(analyse, part.tolist()), strict=True))
            out = [found.get(i, (None, "no text")) for i in frame.index]
            yield frame.assign(record=pd.Series([r for r, _ in out], frame.index, object), error=pd.Series([e for _, e in out], frame.index, object))

    return rows.select(*[f"`{f.name}`" for f in own]).mapInPandas(run, schema)


def successes(rows: DataFrame, *key: str) -> DataFrame:
    """The records of annotated rows with their key, fields as columns."""
    return rows.where("error is null").select(*key, "record.*")


def failures(rows: DataFrame, *key: str) -> DataFrame:
    return rows.where("error is not null").select(*key, "error")
