"""Centroid clustering (k-means on integers) by ball-tree filtering.

Each task builds metric trees over its own rows: a node is a ball with its radius, its number of points and their
integer sum. A round walks every tree from its root with the centroids that may still be nearest: by the triangle
inequality a ball whose points all have one nearest centroid is assigned as a whole, by count and sum; any other ball is
opened, down to leaves, whose points are compared exactly. What leaves a task is one sum for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, table, tidy

#: Components, centroids, rounds, points of a tree and of a leaf at most.
DIM, CENTROIDS, ROUNDS, TREE_ROWS, LEAF_ROWS = 64, 16, 3, 8192, 32
#: Integers stop at this size on both sides (a component of two millions), so that a squared distance fits a long.
LIMIT = 1 << 27
#: Up to this size of integers, products of doubles are exact.
EXACT = 1 << 22

TREES = "ids array<bigint>, points binary, first binary, count binary, left binary, right binary, radius binary, sums binary"
TREE = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("points", "first", "count", "left", "right", "radius", "sums")]])


def integer_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x array<bigint>): floor(64 * component) of the vectors with `dim` components, none null or non-finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * 64, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long"))
    return v.where(F.size("v") == dim).where(ok).select("vec_id", whole.alias("x"))


class Tree:
    """A ball tree. Node k holds points first[k] to first[k] + count[k]; left and right are -1 in a leaf."""

    def __init__(self, points, first, count, left, right, radius, sums):
        self.points, self.first, self.count, self.left, self.right, self.radius, self.sums = points, first, count, left, right, radius, sums

    @classmethod
    def built(cls, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
        """The tree of the points, and the order in which it holds them."""
        order, x = np.arange(len(points)), points.astype(np.float64)
        first, count, left, right, radius, todo = [0], [len(points)], [-1], [-1], [], 0
        while todo < len(first):
            own = order[first[todo] : first[todo] + count[todo]]
            off = x[own] - x[own].mean(0)
            far = np.sqrt(np.einsum("ij,ij->i", off, off))
            radius.append(far.max())
            if len(own) > leaf_rows and radius[-1] > 0:
                # halves along the line from the point farthest from the centre to the point farthest from that
                a = off[far.argmax()]
                b = off[((off - a) ** 2).sum(1).argmax()]
                half = len(own) // 2
                order[first[todo] : first[todo] + len(own)] = own[np.argpartition(off @ (b - a), half)]
                left[todo], right[todo] = len(first), len(first) + 1
                first += [first[todo], first[todo] + half]
                count += [half, len(own) - half]
                left += [-1, -1]
                right += [-1, -1]
            todo += 1
        held = points[order]
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(held, 0, dtype=np.int64)])
        first, count = np.array(first), np.array(count)
        return cls(held, first, count, np.array(left), np.array(right), np.array(radius), total[first + count] - total[first]), order

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls that go whole and their centroids; single points and their centroids. Ties go to the smaller number."""
        balls, to, points, of = [], [], [], []
        live, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(live):
            centre = self.sums[live] / self.count[live][:, None]
            gap = np.where(may, np.sqrt(((centre[:, None, :] - centroids[None, :, :]) ** 2).sum(2)), np.inf)
            best = gap.min(1, keepdims=True)
            # the slack is far above what rounding can do, and only ever opens a ball
            may = gap <= best + 2 * self.radius[live][:, None] + 1e-9 * (1 + best + self.radius[live][:, None])
            one, leaf = may.sum(1) == 1, self.left[live] < 0
            balls.append(live[one])
            to.append(may[one].argmax(1))
            at = live[leaf & ~one]
            if len(at):
                rows = np.concatenate([np.arange(f, f + c) for f, c in zip(self.first[at], self.count[at], strict=True)])
                allowed = np.repeat(may[leaf & ~one], self.count[at], axis=0)
                gap = np.where(allowed, squared(self.points[rows], centroids), np.iinfo(np.int64).max)
                points.append(rows)
                of.append(gap.argmin(1))
            down = ~leaf & ~one
            live, may = np.concatenate([self.left[live[down]], self.right[live[down]]]), np.concatenate([may[down], may[down]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(balls or none), np.concatenate(to or none), np.concatenate(points or none), np.concatenate(of or none)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of each centroid."""
        balls, to, points, of = self.nearest(centroids)
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        np.add.at(count, to, self.count[balls])
        np.add.at(sums, to, self.sums[balls])
        np.add.at(count, of, 1)
        for k in np.unique(of):
            sums[k] += self.points[points[of == k]].sum(0, dtype=np.int64)
        return count, sums

    def clusters(self, centroids: np.ndarray) -> np.ndarray:
        """The centroid of each point, in the tree's order."""
        balls, to, points, of = self.nearest(centroids)
        out = np.zeros(len(self.points), np.int64)
        for b, k in zip(balls, to, strict=True):
            out[self.first[b] : self.first[b] + self.count[b]] = k
        out[points] = of
        return out


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row a point."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p**2).sum(1)[:, None] - 2 * (p @ c.T) + (c**2).sum(1)).astype(np.int64)
    return np.stack([((points.astype(np.int64) - c) ** 2).sum(1) for c in centroids], 1)


def _trees(dim: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def grown() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            x = whole["x"].combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.int32)
            tree, order = Tree.built(x)
            ids = whole["vec_id"].combine_chunks().take(pa.array(order))
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            packed = [tree.points, tree.first, tree.count, tree.left, tree.right, tree.radius, tree.sums]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([a.tobytes()], pa.binary()) for a in packed]], schema=TREE)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TREE_ROWS - rows)
                held.append(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows == TREE_ROWS:
                    yield from grown()
                    held, rows = [], 0
        if rows:
            yield from grown()

    return run


def _opened(batch: pa.RecordBatch, k: int, dim: int) -> Tree:
    def of(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(batch[name][k].as_buffer(), kind)

    return Tree(of("points", np.int32).reshape(-1, dim), *[of(c, np.int64) for c in ("first", "count", "left", "right")], of("radius", np.float64), of("sums", np.int64).reshape(-1, dim))


def _totals(centroids: np.ndarray):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                c, s = _opened(batch, k, centroids.shape[1]).totals(centroids)
                count, sums = count + c, sums + s
        yield pa.RecordBatch.from_arrays([pa.array(range(len(count)), pa.int32()), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tree = _opened(batch, k, centroids.shape[1])
                of = tree.clusters(centroids)
                gap = ((tree.points.astype(np.int64) - centroids[of]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch["ids"][k].values, pa.array(of.astype(np.int32)), pa.array(gap)], names=["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with `dim` finite components.

    Vectors become floor(64 * component), at most LIMIT on either side. Centroids start as the k vectors whose ids hash
    smallest (rows of one id in the order of their vectors; rows without an id last), fewer if there are fewer rows. Each
    round moves every non-empty centroid to the exact floor of its mean. Rows that repeat an id, or all of a row, count
    one by one; other columns have no effect; no vector, no row. Sums are longs: exact up to 2^36 rows of the largest
    integers, and a sum of distances beyond a long stops at the largest long.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, dim)
    start = rows.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    z = np.array([r["x"] for r in start], np.int64).reshape(-1, dim)
    trees = checkpointed(rows.mapInArrow(_trees(dim), TREES))
    for _ in range(rounds if len(z) else 0):
        totals = trees.drop("ids").mapInArrow(_totals(z), "cluster int, n bigint, sums array<bigint>")
        added = totals.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
        for r in added.where("n > 0").collect():  # a row a centroid
            z[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
    placed = checkpointed(trees.mapInArrow(_assigned(z), "vec_id bigint, cluster int, distance bigint"))
    most = (1 << 63) - 1
    inertia = {r["cluster"]: int(r["inertia"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("inertia")).collect()}
    known = [(c, min(i, most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for c, i in inertia.items()]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_ball_tree(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    gap = "list_inner_product({0}, {0}) - 2 * list_inner_product({0}, {1}) + list_inner_product({1}, {1})".format("p.x", "z.x")
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f"""
a{r} AS MATERIALIZED (SELECT vec_id, p.x, arg_min(z.c, ({gap}) * 64 + z.c) AS c, min({gap})::BIGINT AS distance FROM p, z{r} z GROUP BY p.row, vec_id, p.x),"""
        if r < ROUNDS:
            rounds += f"""
u{r} AS (SELECT c, unnest(x)::HUGEINT AS x, generate_subscripts(x, 1) AS i FROM a{r}),
s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM u{r} GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM s{r} GROUP BY c),
z{r + 1} AS MATERIALIZED (SELECT z.c, coalesce(m.x, z.x) AS x FROM z{r} z LEFT JOIN m{r} m ON z.c = m.c),"""
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = {DIM}),
p AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda e: floor(64 * e)) AS x, row_number() OVER () AS row FROM v
  WHERE len(list_filter(v, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
z0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), x)) - 1 AS c, x FROM p
  WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}),{rounds}
f AS (SELECT c, sha256(array_to_string(list_transform(x, lambda e: e::BIGINT), ',')) AS centroid_sha256 FROM z{ROUNDS})
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN f USING (c)
"""


ORACLE = _oracle()
