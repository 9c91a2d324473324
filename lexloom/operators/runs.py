"""Spans of all texts of an Arrow batch at once: numpy arrays over their characters, text after text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Cut:
    """Spans that tile each of the texts: `at`, the last character of each among those of all texts, its text (row), and
    start and end in it."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        first = np.cumsum(sizes) - sizes
        self.at, self.rows = at, len(sizes)
        self.row = np.repeat(np.arange(len(sizes)), sizes)[at]
        self.end = at - first[self.row] + 1
        self.start = np.zeros(len(at), np.int64)
        same = self.row[1:] == self.row[:-1]
        self.start[1:][same] = self.end[:-1][same]

    def lists(self, values: pa.Array) -> pa.Array:
        """A list of values, one a span, for each text."""
        return lists(np.bincount(self.row, minlength=self.rows), values)

    def inside(self, coarser: Cut) -> np.ndarray:
        """How many of these spans end in each span of a coarser cut."""
        return np.diff(np.searchsorted(self.at, coarser.at, side="right"), prepend=0)

    def spans(self, **fields: pa.Array) -> pa.Array:
        return struct(start=whole(self.start), end=whole(self.end), **fields)

    def texts(self, text: list[str]) -> pa.Array:
        return pa.array([text[r][a:b] for r, a, b in zip(self.row.tolist(), self.start.tolist(), self.end.tolist(), strict=True)], pa.string())


def cut(ends: np.ndarray, sizes: np.ndarray) -> Cut:
    """The spans that end where a character is marked, and at the end of each text."""
    ends = ends.copy()
    ends[(np.cumsum(sizes) - 1)[sizes > 0]] = True
    return Cut(np.flatnonzero(ends), sizes)


def whole(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=None if known is None else ~known)


def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def struct(**fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def named(labels: list[str], codes: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """The labels of codes, null where they are not known."""
    return pa.array(labels, pa.string()).take(whole(codes, known))


def flagged(labels: list[str], flags: np.ndarray) -> pa.Array:
    """A list of those labels that each row of flags has."""
    return lists(flags.sum(1), pa.array(labels, pa.string()).take(pa.array(np.nonzero(flags)[1])))


def fields(column: pa.Array) -> dict[str, pa.Array]:
    """The fields of a struct column by name, null where the struct is."""
    return dict(zip([f.name for f in column.type], column.flatten(), strict=True))


def elements(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def sizes_of(text: pa.Array) -> np.ndarray:
    """Code points of each text, 0 of null."""
    return pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def points_of(text: pa.Array) -> np.ndarray:
    """The code points of all texts, text after text."""
    if pa.types.is_string(text.type) and not text.null_count and len(text):
        # the bytes of all texts are one piece already
        ends = np.frombuffer(text.buffers()[1], np.int32)[[text.offset, text.offset + len(text)]].tolist()
        own = text.buffers()[2]
        return np.frombuffer((own[ends[0] : ends[1]].to_pybytes() if own else b"").decode().encode("utf-32-le"), "<u4").astype(np.int64)
    return np.frombuffer("".join(t or "" for t in text.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)


def ints(values: pa.Array, none: int) -> np.ndarray:
    """Whole numbers, with a number for null."""
    return pc.fill_null(values.cast(pa.int64()), none).to_numpy(zero_copy_only=False)


def known(values: pa.Array) -> np.ndarray:
    return values.is_valid().to_numpy(zero_copy_only=False)


def some_lists(there: np.ndarray, sizes: np.ndarray, values: pa.Array) -> pa.Array:
    """A list of values for each row that is there, null for others; sizes are of those that are there."""
    every = np.zeros(len(there), np.int64)
    every[there] = sizes
    offsets = pa.array(np.concatenate([[0], np.cumsum(every)]).astype(np.int32), mask=np.append(~there, False))
    return pa.ListArray.from_arrays(offsets, values)


def look_up(table: dict[str, str], keys: pa.Array) -> pa.Array:
    """table[key], null where there is none."""
    return pa.array([*table.values()], pa.string()).take(pc.index_in(keys, pa.array([*table], pa.string())))


def marks(points: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """A flag a character: whether a list of ends (from 1) has it; others than 1 to the text's size count for nothing."""
    row, at = elements(points)
    at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(int(sizes.sum()), bool)
    inside = (at >= 1) & (at <= sizes[row])
    out[((np.cumsum(sizes) - sizes)[row] + at - 1)[inside]] = True
    return out


#: Rows, and about the bytes, that are taken at once: what is made of them may be many times as large.
PIECE_ROWS, PIECE_BYTES = 1 << 10, 1 << 20


def pieces(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """The columns in pieces of consecutive rows, so that what is made of a batch is never held as a whole."""
    rows, size = len(columns[0]), sum(c.nbytes for c in columns)
    step = max(1, min(PIECE_ROWS, rows * PIECE_BYTES // max(size, 1)))
    for a in range(0, rows, step):
        yield tuple(c.slice(a, step) for c in columns)


def with_fields(rows: DataFrame, make: Callable, schema: str, *inputs: str | Column) -> DataFrame:
    """rows with the fields of struct<schema>, which make(arrays) gives of the inputs, as columns; computed once a row,
    in pieces."""

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from (make(*own) for own in pieces(*batch))

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return many((batch,) for batch in batches)

    own = F.arrow_udf(many if len(inputs) > 1 else one, f"struct<{schema}>")
    names = T.StructType.fromDDL(schema).names
    kept = [f"`{c}`" for c in rows.columns if c not in names]
    return rows.withColumn("_made", own(*inputs)).select(*kept, *[f"_made.{c}" for c in names])
