"""Approximate nearest neighbours by a hash-prefix forest.

Rows are dealt to shards of bounded size by their id. A shard keeps, for each of its trees, its rows sorted by a long
string of hash bits (sides of random hyperplanes). A query descends every tree to the place of its own string and takes
what shares the longest prefix; then all trees ascend together, one bit at a time, until enough candidates are found.
The distances of the candidates are exact. Packed shards meet packed blocks of queries, so a task holds one of each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, table

#: Rows of a shard, queries of a block, trees, bits of a string, and the share of a shard's rows to gather at least.
#: Recall follows the share: vectors without clusters need a large one (README), clustered ones a small one.
SHARD_ROWS, BLOCK_QUERIES, TREES, BITS, SHARE, SEED = 4096, 1024, 24, 32, 0.55, 11


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, trees * bits))


def strings(x: np.ndarray, w: np.ndarray, trees: int, center: np.ndarray) -> np.ndarray:
    """(trees, rows): the hash bits of each row as a number, first bit highest."""
    bits = w.shape[1] // trees
    sides = ((x - center) @ w > 0).reshape(len(x), trees, bits)
    return (sides.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(2).T


class Forest:
    """The sorted strings of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.ids, self.x, self.trees, self.bits = ids, x, trees, bits
        self.w, self.center = planes(x.shape[1], trees, bits), np.zeros(x.shape[1])
        keys = strings(x, self.w, trees, self.center)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def candidates(self, q: np.ndarray, least: int) -> list[np.ndarray]:
        """Rows of the shard for each query: those that share the longest prefix at which all trees hold `least`."""
        keys = strings(q, self.w, self.trees, self.center)
        low, high = np.zeros((self.trees, len(q)), np.int64), np.full((self.trees, len(q)), len(self.ids))
        open_ = np.arange(len(q))
        done_low, done_high = low.copy(), high.copy()
        for depth in range(self.bits, -1, -1):
            shift = np.uint64(self.bits - depth)
            for t in range(self.trees):
                prefix = keys[t, open_] >> shift
                own = self.keys[t] >> shift
                low[t, open_], high[t, open_] = np.searchsorted(own, prefix, "left"), np.searchsorted(own, prefix, "right")
            total = (high[:, open_] - low[:, open_]).sum(0)
            enough = open_[(total >= least) | (depth == 0)]
            # trees overlap, so the rows are counted once each before a query is done
            full = [i for i in enough if depth == 0 or len(self._rows(low[:, i], high[:, i])) >= least]
            done_low[:, full], done_high[:, full] = low[:, full], high[:, full]
            open_ = np.setdiff1d(open_, full)
            if not len(open_):
                break
        return [self._rows(done_low[:, i], done_high[:, i]) for i in range(len(q))]

    def _rows(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.ids), bool)
        for t in range(self.trees):
            seen[self.order[t, low[t] : high[t]]] = True
        return np.flatnonzero(seen)


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of packed ids and vectors; rows alike in both count once."""
    x = np.stack(rows["v"]).astype(np.float64)
    ids = rows["vec_id"].to_numpy(np.int64)
    same = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
    both = np.unique(np.stack([ids, same], 1), axis=0, return_index=True)[1]
    return pd.DataFrame({"dim": rows["dim"].iloc[:1].to_numpy(), "part": rows["part"].iloc[:1].to_numpy(), "ids": [ids[both].tobytes()], "vectors": [x[both].tobytes()]})


def _search(k: int, share: float):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids, x = _unpacked(r.ids, r.vectors, r.dim)
                qid, q = _unpacked(r.q_ids, r.q_vectors, r.dim)
                forest = Forest(ids, x)
                out = []
                for i, rows in enumerate(forest.candidates(q, min(len(ids), max(4 * k, int(share * len(ids)))))):
                    rows = rows[ids[rows] != qid[i]]
                    gap = x[rows] - q[i]
                    score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    best = np.lexsort((ids[rows], score))
                    best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])][:k]
                    out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[rows][best], "score": score[best]}))
                if out:
                    yield pd.concat(out)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): rows with an id and a vector that is not null, empty or zero and whose components are finite."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok).withColumn("dim", F.size("v"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest found by Euclidean distance, ties to the smaller id.

    vectors, queries: (vec_id, embedding). A query never finds its own id; vectors of another length are not compared;
    rows that are not usable take no part; of rows that share an id the nearest counts. Each shard gathers at least
    `share` of its rows for each query, by the forest.
    """
    rows, asked = checkpointed(usable(vectors)), checkpointed(usable(queries))
    counts = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    q_counts = asked.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("q_parts"))
    packed = "dim int, part int, ids binary, vectors binary"
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    shards = rows.join(counts, "dim").select("vec_id", "v", "dim", part("parts").alias("part")).groupBy("dim", "part").applyInPandas(_pack, packed)
    blocks = asked.join(q_counts, "dim").select("vec_id", "v", "dim", part("q_parts").alias("part")).groupBy("dim", "part").applyInPandas(_pack, packed)
    # every shard meets every block: a block is sent once to each shard
    blocks = blocks.withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "part": "q_part"}).join(counts, "dim")
    sent = blocks.select("dim", "q_ids", "q_vectors", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = shards.join(sent, ["dim", "part"]).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = met.select("dim", "ids", "vectors", "q_ids", "q_vectors").mapInPandas(_search(k, share), "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_prefix_forest(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
