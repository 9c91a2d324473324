"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors form a class. A class has its home in the cell of its nearest centroid, and visits those cells whose border
is near. The border between two cells is the great circle halfway between their centroids. If two vectors of different
cells are at most an angle t apart, the arc between them crosses that border, so one of the two is within t / 2 of it:
if each vector visits the cells whose border is within t / 2, every link is seen in the home cell of one of its ends.
No link is lost to the cells, wherever the centroids lie; they are fitted on a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, lists, table, tidy
from lexloom.llm.components import components

COSINE = 0.95
#: Vectors of a cell on average, cells at most, vectors that the cells are fitted on at most, and rounds of the fit.
CELL_ROWS, MOST_CELLS, SAMPLE, FIT_ROUNDS = 1024, 1 << 14, 1 << 15, 6
#: Vectors of the two sides of a product.
LEFT, RIGHT = 2048, 4096
#: Entries of a matrix of similarities that is held at once.
ENTRIES = 1 << 21


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """k unit centroids of unit vectors, started at the first k."""
    c = x[:k].copy()
    step = max(1, ENTRIES // k)
    for _ in range(rounds):
        of = np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)])
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        size = np.sqrt((total**2).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def units(v: np.ndarray) -> np.ndarray:
    """Vectors (not zero) of length 1; they are scaled first, so that no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _homes(centroids, cosine: float):
    """Adds to each class the cell it lives in and those it visits."""
    near = math.sin(math.acos(cosine) / 2) + 1e-9

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in centroids.value:
                own = batch.filter(pc.equal(batch["dim"], c.shape[1]))
                apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
                step = max(1, ENTRIES // len(c))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    u = units(_matrix(part["v"], c.shape[1]))
                    like = u @ c.T
                    home = like.argmax(1)
                    visits = like.max(1)[:, None] - like <= near * apart[home]
                    visits[np.arange(len(u)), home] = False
                    yield pa.RecordBatch.from_arrays(
                        [part["cid"], part["weight"], part["dim"], part["v"], pa.array(home.astype(np.int32)), lists(np.nonzero(visits)[1].astype(np.int32), visits.sum(1))],
                        names=["cid", "weight", "dim", "v", "home", "visits"],
                    )

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
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


def _products(cosine: float):
    """The links of one block of a cell's own vectors with one block of all that are in the cell.

    Gives (cid, n, root): of each vector that has links here how many vectors they lead to, and one it is connected to.
    A vector from another cell is counted from its side too, for it meets this one only here, unless this one visits
    its cell: then the link is seen in both cells and counts in the smaller.
    """
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cell, dim = group["cell"][0].as_py(), group["dim"][0].as_py()
        own = group["left"].to_numpy().astype(bool)
        u = units(_matrix(group["v"].combine_chunks(), dim))
        cid, weight, home = (group[c].to_numpy() for c in ("cid", "weight", "home"))
        left, right = np.flatnonzero(own), np.flatnonzero(~own)
        homes, of_right = np.unique(home[right], return_inverse=True)
        # which of the left visit the homes of the right
        visits = group["visits"].combine_chunks().take(pa.array(left))
        flat, row = visits.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(left)), visits.value_lengths().to_numpy(zero_copy_only=False))
        meets = np.zeros((len(left), len(homes)), bool)
        at = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
        meets[row[homes[at] == flat], at[homes[at] == flat]] = True
        twice = meets & (homes < cell)
        n, pairs, step = np.zeros(len(cid), np.int64), [], max(1, ENTRIES // max(1, len(right)))
        for k in range(0, len(left), step):
            i, j = np.nonzero(u[left[k : k + step]] @ u[right].T >= cosine)
            i += k
            keep = (cid[left[i]] != cid[right[j]]) & ~twice[i, of_right[j]]
            i, j = left[i[keep]], right[j[keep]]
            n += np.bincount(i, weight[j], len(cid)).astype(np.int64)
            guest = home[j] != cell
            n += np.bincount(j[guest], weight[i[guest]], len(cid)).astype(np.int64)
            nodes = _roots(len(cid), i, j)
            pairs.append((np.flatnonzero(nodes != np.arange(len(cid))), nodes[nodes != np.arange(len(cid))]))
        # one vector may be on both sides
        known, node = np.unique(cid, return_inverse=True)
        if pairs:
            a, b = (node[np.concatenate(x)] for x in zip(*pairs, strict=True))
        else:
            a = b = np.zeros(0, np.int64)
        root = _roots(len(known), a, b)[node]
        some = np.flatnonzero((n > 0) | (known[root] != cid))
        return pa.Table.from_arrays([pa.array(cid[some]), pa.array(n[some]), pa.array(known[root[some]])], schema=schema)

    return run


def _cells(classes: DataFrame, cell_rows: int) -> list[np.ndarray]:
    """Unit centroids, for each length of vectors, fitted on SAMPLE vectors at most (about), picked by hash."""
    out = []
    for r in classes.groupBy("dim").count().orderBy("dim").collect():
        k = max(1, min(MOST_CELLS, -(-r["count"] // cell_rows)))
        own = classes.where(F.col("dim") == r["dim"])
        if r["count"] > SAMPLE:
            own = own.where(F.pmod(F.col("h1"), F.lit(1 << 20)) < int((1 << 20) * 0.9 * SAMPLE / r["count"]) + 1)
        sample = own.select("h1", "h2", "v").limit(2 * SAMPLE).toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")]).combine_chunks()
        out.append(spherical_kmeans(units(_matrix(sample["v"].combine_chunks(), r["dim"])), min(k, sample.num_rows)))
    return out


def linked(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding).

    Two vectors link if their cosine (0 < cosine < 1), in double precision, is at least `cosine`. n_links counts the other
    rows that a row links with, component_id is the smallest vec_id that links reach, kept says whether it is the row's
    own. Vectors that are null, empty, zero or have null or non-finite components link with nothing, nor do rows without
    a vec_id (no component, kept) or vectors of different lengths. Rows that repeat a vec_id count one by one, each
    with its own links. Other columns have no effect. cell_rows, left and right change how the work is cut, never
    the result.
    """
    spark = vectors.sparkSession
    # vectors travel in their own precision, and are compared in double
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    v = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda c: c + F.lit(0.0).cast(kind))  # no -0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok, F.lit(False))
    hashed = [F.when(ok, F.xxhash64("v")).alias("h1"), F.when(ok, F.xxhash64(F.lit("second"), "v")).alias("h2")]
    classes = rows.where(ok).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = classes.select("v", "rep", "weight", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"), F.monotonically_increasing_id().alias("cid"))
    classes = checkpointed(classes)

    centroids = spark.sparkContext.broadcast(_cells(classes, cell_rows))
    placed = classes.select("cid", "weight", "dim", "v").mapInArrow(_homes(centroids, cosine), f"cid bigint, weight bigint, dim int, v array<{kind}>, home int, visits array<int>")
    placed = checkpointed(placed)
    there = placed.select("dim", "home", F.explode(F.concat(F.array("home"), "visits")).alias("cell"))
    # a row a cell, MOST_CELLS for each length
    sizes = there.groupBy("dim", "cell").agg(F.sum((F.col("home") == F.col("cell")).cast("long")).alias("own"), F.count("*").alias("all"))
    sizes = sizes.select("dim", "cell", F.ceil(F.col("own") / left).cast("int").alias("lefts"), F.ceil(F.col("all") / right).cast("int").alias("rights")).where("lefts > 0")
    sizes = F.broadcast(checkpointed(sizes))
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["dim", "cell", "cid", "weight", "v", "home", "visits", "lefts", "rights"]
    own = placed.withColumn("cell", F.col("home")).join(sizes, ["dim", "cell"]).select(*columns, part("lefts").alias("i"), every("rights").alias("j"), F.lit(1).alias("left"))
    met = placed.withColumn("cell", F.explode(F.concat(F.array("home"), "visits"))).join(sizes, ["dim", "cell"]).select(*columns, every("lefts").alias("i"), part("rights").alias("j"), F.lit(0).alias("left"))
    links = own.unionByName(met).drop("lefts", "rights").groupBy("dim", "cell", "i", "j").applyInArrow(_products(cosine), "cid bigint, n bigint, root bigint")
    links = checkpointed(links)

    counts = links.groupBy("cid").agg(F.sum("n").alias("n"))
    at = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    smallest = classes.join(at, "cid").groupBy("component").agg(F.min("rep").alias("least"))
    at = at.join(smallest, "component").select("cid", "least")
    found = classes.select("cid", "h1", "h2", "rep", "weight").join(counts, "cid", "left").join(at, "cid", "left")
    found = found.where("n is not null or weight > 1").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("vec_id", *hashed).join(found, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def one_of_each(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors without those whose group holds a smaller vec_id; rows that repeat a vec_id stay, and those without."""
    gone = linked(vectors, cosine).where(~F.col("kept")).select("vec_id").distinct()
    return vectors.join(gone, "vec_id", "left_anti").select(*[f"`{c}`" for c in vectors.columns])


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM v WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda e: e IS NOT NULL AND isfinite(e))) = len(v)
  AND len(list_filter(v, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
