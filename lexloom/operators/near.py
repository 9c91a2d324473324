"""Near fingerprints: all that differ in a few bits, as groups, as links and as a scan in order decides.

Fingerprints are cut into blocks. Two that differ in at most `distance` bits agree on all blocks but `distance`, so they
share a key of one of the choices of that many blocks (64 bits in six blocks, three bits: 20 keys of some 32 bits). Rows
of one key meet in numpy, a block of rows with a block of rows, so what leaves a task grows with its rows and not with
their pairs; a pair that shares several keys counts at the first of them.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTANCE, BITS, BLOCKS = 3, 64, 6
#: From this bit on a key has the number of its choice.
NUMBER = 48
#: Rows of a key that meet all others of it in one task; a larger key is dealt out in pairs of blocks of that size.
BLOCK_ROWS = 2048
#: Pairs of rows that are held at once.
PAIRS = 1 << 21


def shared_folder(spark) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where the session names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexloom-"))
    return sc.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """frame, computed once and kept in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def blocks_of(bits: int = BITS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, width) of each block, low bits first."""
    edges = [bits * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def choices(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(blocks), blocks - distance))


def block_keys(fp: Column, distance: int = DISTANCE, bits: int = BITS, blocks: int = BLOCKS) -> Column:
    """The keys of a fingerprint: an array<bigint>, the number of the choice from bit NUMBER, the blocks' bits below."""
    cut = blocks_of(bits, blocks)
    part = [F.shiftrightunsigned(fp.cast("long"), first).bitwiseAND(F.lit((1 << width) - 1)) for first, width in cut]
    out = []
    for number, own in enumerate(choices(distance, blocks)):
        key, at = F.lit(number << NUMBER), 0
        for b in own:
            key, at = key.bitwiseOR(F.shiftleft(part[b], at)), at + cut[b][1]
        if at > NUMBER or number >= 1 << (63 - NUMBER):
            raise ValueError("a key does not fit a long")
        out.append(key)
    return F.array(*out)


def _first_choice(distance: int, blocks: int) -> np.ndarray:
    """By the set of blocks that two fingerprints share, the first choice among them; -1 for none."""
    out = np.full(1 << blocks, -1)
    for number, own in reversed(list(enumerate(choices(distance, blocks)))):
        need = sum(1 << b for b in own)
        out[(np.arange(1 << blocks) & need) == need] = number
    return out


def _pairs(cols: dict[str, np.ndarray], distance: int, bits: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b) of rows that are near and whose first common key is the one they meet at. Rows lie group by
    group (key, i, j); in a group of two blocks (i < j) only rows of different blocks are compared."""
    n = len(cols["key"])
    new = np.ones(n, bool)
    new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])
    starts = np.flatnonzero(new)
    end = np.append(starts[1:], n)[np.cumsum(new) - 1]
    later = end - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    cut, first = blocks_of(bits, blocks), _first_choice(distance, blocks)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(at, to), later[at:to])
        b = np.arange(len(a)) - np.repeat(total[at:to] - total[at], later[at:to]) + a + 1
        x = cols["fp"][a] ^ cols["fp"][b]
        near = (np.bitwise_count(x) <= distance) & ((cols["i"][a] == cols["j"][a]) | (cols["block"][a] != cols["block"][b]))
        a, b, x = a[near], b[near], x[near]
        same = sum((((x >> np.uint64(s)) & np.uint64((1 << w) - 1)) == 0).astype(np.int64) << k for k, (s, w) in enumerate(cut))
        own = first[same]
        mine = cols["key"][a] >> NUMBER == own
        yield a[mine], b[mine]
        at = to


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The sorted rows as arrays, cut between groups only."""

    def arrays(table: pa.Table) -> dict[str, np.ndarray]:
        out = {c: table[c].to_numpy() for c in table.column_names}
        return out | {"fp": out["fp"].astype(np.int64).view(np.uint64)}

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = [table[c][-1].as_py() for c in ("key", "i", "j")]
        open_ = np.logical_and.reduce([table[c].to_numpy() == v for c, v in zip(("key", "i", "j"), last, strict=True)])
        to = int(open_.argmax())
        if to:
            yield arrays(table.slice(0, to))
        held = table.slice(to).combine_chunks()
    if held is not None:
        yield arrays(held)


def met(rows: DataFrame, result: Callable, schema: str, distance: int = DISTANCE, bits: int = BITS, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What result(columns, pairs) gives for rows (seq, fp, ...) that meet at their keys, as record batches of `schema`.

    columns: arrays of the rows of some groups; pairs: an iterator of index pairs of near rows, each pair of rows once
    in all groups together.
    """
    keyed = rows.withColumn("key", F.explode(block_keys(F.col("fp"), distance, bits, blocks)))
    shared = keyed.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"), F.count("*").alias("of")).where("of > 1").drop("of")
    block = F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int")
    keyed = keyed.join(shared, "key").withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = keyed.withColumn("other", other).select(*rows.columns, "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_groups(batches):
            yield from result(cols, _pairs(cols, distance, bits, blocks))

    return dealt.mapInArrow(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that the links (a, b) reach from each of n nodes."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(seq, component): the smallest node that edges (a, b) reach from each node with an edge.

    Every node points at the smallest of itself and its neighbours; edges move to what their ends point at, until none
    is left between two nodes.
    """
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    at = edges.select(F.col("a").alias("seq")).union(edges.select("b")).distinct().withColumn("component", F.col("seq"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        points = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        ends = edges.join(points.toDF("a", "to_a"), "a").join(points.toDF("b", "to_b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        # what a node points at may itself point on
        on = points.select(F.col("to").alias("node")).distinct().join(points, "node").select(F.col("node").alias("a"), F.col("to").alias("b"))
        edges = checkpointed(ends.union(on).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        at = checkpointed(at.join(points.toDF("component", "to"), "component", "left").select("seq", F.coalesce("to", "component").alias("component")))
    return at


def _links(cols: dict[str, np.ndarray], pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(seq, n, root): of each row with links how many rows they lead to, and a row of its group that it is connected to."""
    size = len(cols["seq"])
    n, ends = np.zeros(size, np.int64), []
    for a, b in pairs:
        n += np.bincount(a, cols["weight"][b], size).astype(np.int64) + np.bincount(b, cols["weight"][a], size).astype(np.int64)
        near = roots(size, a, b)
        moved = np.flatnonzero(near != np.arange(size))
        ends.append((moved, near[moved]))
    root = roots(size, *[np.concatenate(x) for x in zip(*ends, strict=True)]) if ends else np.arange(size)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(cols["seq"][some]), pa.array(n[some]), pa.array(cols["seq"][root[some]])], names=["seq", "n", "root"])


def near_groups(prints: DataFrame, **cut: int) -> DataFrame:
    """(seq, first, n_links, component_id) of each row of prints (seq, fp).

    first: the smallest seq of the row's fingerprint; n_links: how many other rows are at most `distance` bits away;
    component_id: the smallest seq that such links reach. seq is unique and not null; a null fp links with nothing.
    """
    of = prints.where("fp is not null").groupBy("fp").agg(F.min("seq").alias("first"), F.count("*").alias("weight"))
    of = checkpointed(of)
    links = checkpointed(met(of.select(F.col("first").alias("seq"), "fp", "weight"), _links, "seq bigint, n bigint, root bigint", **cut))
    counts = links.groupBy("seq").agg(F.sum("n").alias("n"))
    at = components(links.select(F.col("seq").alias("a"), F.col("root").alias("b")))
    told = of.join(counts.withColumnRenamed("seq", "first"), "first", "left").join(at.withColumnRenamed("seq", "first"), "first", "left")
    # only fingerprints that have links or copies are joined with the rows
    told = told.where("n is not null or weight > 1").select("fp", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = prints.select("seq", "fp").join(told, "fp", "left")
    return out.select("seq", F.coalesce("first", "seq").alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "seq").alias("component_id"))


def _standing(cols: dict[str, np.ndarray], pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(seq, near, behind, before): is the row near an earlier kept one, behind an earlier open one, before a later one."""
    size = len(cols["seq"])
    near, behind, before = (np.zeros(size, bool) for _ in range(3))
    for a, b in pairs:
        swap = cols["seq"][a] > cols["seq"][b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        kept = cols["kept"][a]
        near[b[kept]] = True
        behind[b[~kept]] = True
        before[a] = True
    some = np.flatnonzero(near | behind | before)
    yield pa.RecordBatch.from_arrays([pa.array(cols["seq"][some]), *[pa.array(x[some]) for x in (near, behind, before)]], names=["seq", "near", "behind", "before"])


def scan_keeps(prints: DataFrame, **cut: int) -> DataFrame:
    """(seq) of prints (seq, fp), fingerprints distinct, that a scan in order of seq drops: near one that it kept before.

    Rounds: an open row with no earlier open row near it is kept; what is near a kept row is dropped. Rows without
    any near row leave after the first round, so later rounds are small; there are as many as the longest chain has links.
    """
    schema = "seq bigint, near boolean, behind boolean, before boolean"
    stands = lambda rows: met(rows, _standing, schema, **cut).groupBy("seq").agg(*[F.max(c).alias(c) for c in ("near", "behind", "before")])
    told = stands(prints.select("seq", "fp", F.lit(False).alias("kept")))
    rows = checkpointed(prints.select("seq", "fp").join(told, "seq").select("seq", "fp", (~F.col("behind")).alias("kept")))
    dropped = None
    while not rows.where("not kept").isEmpty():
        told = checkpointed(stands(rows))
        gone = told.where("near").select("seq")
        dropped = gone if dropped is None else dropped.union(gone)
        left = rows.where("not kept").join(told, "seq", "left").where("not coalesce(near, false)")
        rows = checkpointed(left.select("seq", "fp", (~F.coalesce("behind", F.lit(False))).alias("kept")))
    return dropped if dropped is not None else prints.select("seq").limit(0)
