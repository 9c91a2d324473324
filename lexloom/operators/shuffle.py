"""Bounded shuffle: rows leave a task in a seeded order through a buffer of slots, without a sort or an exchange."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X

SLOTS = 4096


def slots_of(numbers: np.ndarray, slots: int, seed: int, epoch: int, part: int) -> np.ndarray:
    """The slot that each row of a part takes, by its number: a hash of seed, epoch, part and number."""
    start = X.mix64(X.mix64(X.mix64(np.array([seed])) + np.uint64(epoch)) + np.uint64(part))
    return (X.mix64(numbers.astype(np.uint64) + start) % np.uint64(slots)).astype(np.int64)


class SlotBuffer:
    """Holds up to `slots` rows. Once it is full, each row takes a slot and the row that was there leaves; at the end the
    rows that are left leave in the order of their hashes. Batches go through whole: who leaves is the last row that
    took the same slot, in the batch or before."""

    def __init__(self, slots: int, seed: int, epoch: int, part: int):
        if slots < 1:
            raise ValueError("a buffer has one slot at least")
        self.slots, self.by, self.held, self.number = slots, (seed, epoch, part), None, 0

    def _next(self, n: int) -> np.ndarray:
        out = slots_of(np.arange(self.number, self.number + n), self.slots, *self.by)
        self.number += n
        return out

    def push(self, rows: pa.Table) -> pa.Table:
        """The rows that leave when these come."""
        if self.held is None:
            self.held = rows.slice(0, 0)
        fill = min(self.slots - self.held.num_rows, rows.num_rows)
        if fill:
            self.held = pa.concat_tables([self.held, rows.slice(0, fill)])
            self.number += fill
        rest = rows.slice(fill)
        if not rest.num_rows:
            return rest
        slot = self._next(rest.num_rows)
        by = np.argsort(slot, kind="stable")
        same = np.concatenate([[False], slot[by][1:] == slot[by][:-1]])
        # places in held and rest, one after the other
        leaves = np.empty(rest.num_rows, np.int64)
        leaves[by] = np.where(same, self.slots + np.concatenate([[0], by[:-1]]), slot[by])
        stay = np.arange(self.slots)
        last = np.concatenate([slot[by][1:] != slot[by][:-1], [True]])
        stay[slot[by][last]] = self.slots + by[last]
        both = pa.concat_tables([self.held, rest]).combine_chunks()
        self.held = both.take(pa.array(stay))
        return both.take(pa.array(leaves))

    def drain(self) -> pa.Table | None:
        """What is left."""
        if self.held is None:
            return None
        n = self.held.num_rows
        start = slots_of(np.arange(self.number, self.number + n), 1 << 62, *self.by)
        return self.held.take(pa.array(np.argsort(start, kind="stable")))


def buffered(rows: DataFrame, slots: int = SLOTS, seed: int = 0, epoch: int = 0) -> DataFrame:
    """rows in a shuffled order within each part, with `part` and `place` (from 0 in the part), where they leave it.

    No row moves to another task and no task holds more than `slots` rows and a batch. The same rows in the same parts
    come in the same order again; another seed or epoch gives another. Rows without a part before them (an empty table)
    give none; columns named part or place are replaced.
    """
    own = [c for c in rows.columns if c not in ("part", "place")]
    schema = rows.select(*[f"`{c}`" for c in own], F.lit(0).alias("part"), F.lit(0).cast("long").alias("place")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        buffer, place = SlotBuffer(slots, seed, epoch, part), 0

        def told(out: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal place
            n = out.num_rows
            out = out.append_column("part", pa.array(np.full(n, part, np.int32))).append_column("place", pa.array(np.arange(place, place + n)))
            place += n
            yield from out.to_batches()

        for batch in batches:
            if batch.num_rows:
                yield from told(buffer.push(pa.Table.from_batches([batch])))
        left = buffer.drain()
        if left is not None:
            yield from told(left)

    return rows.select(*[f"`{c}`" for c in own]).mapInArrow(run, schema)


def seeded_batches(rows: DataFrame, size: int, slots: int = SLOTS, seed: int = 0, epoch: int = 0) -> DataFrame:
    """buffered(rows) with `batch`: runs of `size` rows of a part, the last of a part as long as what is left."""
    return buffered(rows, slots, seed, epoch).withColumn("batch", F.floor(F.col("place") / size))
