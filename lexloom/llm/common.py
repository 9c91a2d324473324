"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one numpy step, in bytes; a longer document is a step of its own.
PIECE_BYTES = 2 << 20
#: Tasks whose sums are added in the first of two steps.
TASKS_OF_A_SUM = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: Bytes of words cut at ASCII white space, and of words of digits, a-z and everything beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses no part of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def array_sums(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """The rows (key int, values array<double>, from many tasks) with the arrays summed by key.

    Sums are made in two steps, so that no group holds a row of every task.
    """
    import pandas as pd

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: group[key].iloc[:1].to_numpy(), **{v: [np.sum(np.stack(group[v]), 0)] for v in values}})

    schema = f"{key} int, " + ", ".join(f"{v} array<double>" for v in values)
    some = rows.withColumn("part", F.floor(F.spark_partition_id() / TASKS_OF_A_SUM)).groupBy(key, "part").applyInPandas(add, schema)
    return some.groupBy(key).applyInPandas(add, schema)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: what decides which rows are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus)


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of whole rows of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def tidy(run: Callable) -> Callable:
    """run (batches to batches); at its end freed memory goes back to the system, for workers outlive their tasks."""

    @functools.wraps(run)
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and the offsets of the texts; null is empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of mask within each text, and the number of runs of each text."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | first[1:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Words:
    """The words of some texts: bytes lower-cased (A-Z), a word being a run of bytes of `kind`.

    codes: for each word its place in `distinct`; starts, ends: its bytes; counts: words of each text.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = True):
        data, self.offsets = text_bytes(texts)
        self.raw = data
        if lower:
            data = LOWER_BYTES[data]
        mask = kind[data]
        self.starts, self.ends, self.counts = runs(mask, self.offsets)
        own = data[mask]
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(own))
        coded = words.dictionary_encode()
        self.codes = np.asarray(coded.indices)
        self.distinct = coded.dictionary
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])

    def of(self) -> np.ndarray:
        """For each word, the place of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor, shift, multiply), on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: the sum of a random value for each (place, byte)."""
    data, offsets = text_bytes(words)
    sizes = np.diff(offsets)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1], sizes).astype(np.uint64)
    each = mix((place << np.uint64(8)) + data + np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + sizes.astype(np.uint64))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    sizes = np.asarray(sizes, dtype=np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - before, sizes)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list column from its values and the size of each list."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))
