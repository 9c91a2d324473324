"""Operators 11 to 13 against brute force: clusters, whitening, near copies of vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ball_tree, embedding_dedup, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def grouped(n: int, dim: int = 64, seed: int = 3) -> np.ndarray:
    """Some vectors at random, some in tight groups, as floats."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[rng.integers(0, 5, n - n // 2)] + rng.normal(size=(n - n // 2, dim)) * rng.uniform(0.01, 0.35, (n - n // 2, 1))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], SCHEMA)


def brute_clusters(ids, x, k=16, rounds=3):
    x = [[math.floor(64 * float(c)) for c in v] for v in x]
    x = np.array(x, object)
    first = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), list(x[i])))[:k]
    z = x[first]
    for r in range(rounds + 1):
        gap = np.array([[int(((p - c) ** 2).sum()) for c in z] for p in x], object)
        of = [min(range(len(z)), key=lambda j: (row[j], j)) for row in gap]
        if r < rounds:
            z = np.array([x[[i for i in range(len(x)) if of[i] == j]].sum(0) // of.count(j) if j in of else z[j] for j in range(len(z))], object)
    own = [int(gap[i][of[i]]) for i in range(len(x))]
    return [(ids[i], of[i], own[i], sum(d for d, j in zip(own, of, strict=True) if j == of[i]), sum(own), hashlib.sha256(",".join(map(str, z[of[i]])).encode()).hexdigest()) for i in range(len(x))]


@pytest.mark.parametrize("scale", [1, 0.05, 400_000])
def test_clusters_equal_brute_force(spark, scale):
    x = grouped(300) * np.float32(scale)
    x[7] = x[8] = x[9]
    got = ball_tree.clusters(table(spark, x).repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(brute_clusters(list(range(300)), x))


def test_ball_tree_takes_whole_balls_and_meets_every_point_once():
    x = np.repeat(np.array([[0, 0], [100, 0], [0, 100], [3, 2]]), 200, axis=0) + np.random.default_rng(0).integers(-2, 3, (800, 2))
    z = np.array([[0, 0], [100, 0], [0, 100]])
    tree, order = ball_tree.Tree.built(x.astype(np.int32), 16)
    assert (tree.points == x[order]).all()
    for a, b, node in zip(tree.left, tree.right, range(len(tree.left)), strict=True):
        own = tree.points[tree.first[node] : tree.first[node] + tree.count[node]]
        assert (own.sum(0) == tree.sums[node]).all()
        assert np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
        assert a < 0 or tree.count[a] + tree.count[b] == tree.count[node]
    balls, _, points, _ = tree.nearest(z)
    assert len(points) == 0 and len(balls) < 20 and tree.count[balls].sum() == 800
    count, sums = tree.totals(z)
    of = ((x[:, None] - z) ** 2).sum(2).argmin(1)
    assert count.tolist() == np.bincount(of, minlength=3).tolist()
    assert (sums == np.array([x[of == k].sum(0) for k in range(3)])).all()


def test_clusters_of_odd_rows(spark):
    x = grouped(20)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None), (30, None, 0), (31, [], 0), (32, [1.0] * 63, 0), (33, [1.0] * 65, 0)]
    rows += [(34, [1.0] * 63 + [None], 0), (35, [1.0] * 63 + [float("nan")], 0), (36, [1.0] * 63 + [float("inf")], 0), (37, [3e38] * 64, 0), (38, [-3e38] * 64, 0)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"label": "cluster"}).withColumn("x", F.lit(1))
    got = ball_tree.clusters(odd).collect()
    assert sorted(r["vec_id"] for r in got if r["vec_id"] is not None) == sorted([*range(20), 3, 3, 37, 38])
    assert sum(r["vec_id"] is None for r in got) == 1
    assert len({r["inertia"] for r in got}) == 1
    assert ball_tree.clusters(odd.limit(0)).collect() == []
    few = ball_tree.clusters(odd.where("vec_id in (1, 2)")).collect()
    assert sorted(r["distance"] for r in few) == [0, 0]


def covariance(x):
    off = x - x.mean(0)
    return off.T @ off / len(x)


def test_whitening_equals_numpy(spark):
    x = grouped(400) * np.linspace(0.2, 2, 64, dtype=np.float32)
    got = whitening.whitened(table(spark, x).repartition(3)).toPandas()
    assert len(got) == 400 * 32
    whole = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in x])
    sums = whole.sum(0)
    assert got.groupby("vec_id")["deviation"].first().tolist() == [sum((400 * int(c) - int(s)) ** 2 for c, s in zip(v, sums, strict=True)) for v in whole]
    v = covariance(whole.astype(float))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    w = got.sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(400, 32)
    want = (whole - sums / 400) @ u[:, :32] / np.sqrt(e[:32])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-6
    assert all(len({bool(s) for s in (w[:, k] * want[:, k] > 0)[np.abs(want[:, k]) > 1e-3]}) == 1 for k in range(32))
    explained = got.drop_duplicates("component").sort_values("component")["explained"]
    assert np.allclose(explained, e[:32] / e.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    assert np.abs(covariance(w) - np.eye(32)).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 5.0], 0), (1, [1.0, 2.0, 5.0], 0), (2, [3.0, -2.0, 5.0], 0), (None, [4.0, 0.5, 5.0], 1), (3, None, 0), (4, [], 0)]
    rows += [(5, [None, 1.0, 2.0], 0), (6, [float("nan"), 1.0, 2.0], 0), (7, [float("-inf"), 1.0, 2.0], 0), (8, [1.0, 2.0], 0)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "n").withColumn("white", F.lit(0))
    got = whitening.whitened(odd).toPandas()
    three = got[got["n"] == 4]
    assert len(three) == 12 and sorted(three["vec_id"].dropna()) == [1.0] * 6 + [2.0] * 3
    assert three[three["component"] == 3]["whitened"].isna().all() and three[three["component"] < 3]["whitened"].notna().all()
    assert three["identity_error"].max() < 1e-9
    one = got[got["n"] == 1]  # a length of its own, one row: no variance
    assert sorted(one["component"]) == [1, 2] and one["whitened"].isna().all() and (one["deviation"] == 0).all() and (one["explained"] == 0).all()
    assert whitening.whitened(odd.limit(0)).collect() == []


def test_deviation_is_exact_or_null(spark):
    rows = [(i, [float(3e38 if i == 0 else i), 1.0], 0) for i in range(4)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] is None
    rows[0] = (0, [float(2**24), 1.0], 0)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [[64 * 2**24, 64], [64, 64], [128, 64], [192, 64]]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: (d if (d := sum((4 * a - b) ** 2 for a, b in zip(x[i], s, strict=True))) < 2**63 else None) for i in range(4)}


def brute_links(ids, x, cosine=0.95):
    u = x.astype(np.float64)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    at = list(ids)
    while True:
        new = [min([at[i], *(at[j] for j in np.flatnonzero(near[i]))]) for i in range(len(at))]
        if new == at:
            return [(int(ids[i]), int(near[i].sum()), int(at[i]), bool(ids[i] == at[i])) for i in range(len(at))]
        at = new


@pytest.mark.parametrize(("cell_rows", "left", "right"), [(1024, 2048, 4096), (20, 7, 11), (3, 64, 64)])
def test_links_equal_brute_force_however_the_work_is_cut(spark, cell_rows, left, right):
    x = grouped(600, 16)
    x[50:60] = x[300]
    x[60:70] = 3 * x[301]
    ids = np.random.default_rng(1).permutation(5000)[:600]
    got = embedding_dedup.linked(table(spark, x, ids).repartition(3), cell_rows=cell_rows, left=left, right=right)
    want = brute_links(ids, x)
    assert sum(n for _, n, _, _ in want) > 5000
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_links_across_cell_borders(spark):
    """Vectors all around a circle, a chain of links that crosses every border."""
    angle = np.arange(0, 2 * np.pi, 0.05)
    x = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
    got = embedding_dedup.linked(table(spark, x), cell_rows=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute_links(np.arange(len(x)), x))


def test_links_of_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    rows = [(5, a, 0), (4, b, 0), (4, a, 0), (None, a, 0), (9, None, 0), (10, [], 0), (11, [0.0, 0.0, 0.0], 0), (12, [None, 1.0, 0.0], 0), (13, [float("nan"), 0.0, 1.0], 0)]
    rows += [(14, [1.0, 0.0], 0), (15, [3e38, 0.0, 0.0], 0), (16, [1e-44, -0.0, 0.0], 0), (17, [0.0, 1.0, 0.0], 0), (17, [0.0, 1.0, -0.0], 0)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "cell").withColumn("home", F.lit(1))
    got = sorted(map(tuple, embedding_dedup.linked(odd).collect()), key=str)
    none = [(i, 0, i, True) for i in (None, 9, 10, 11, 12, 13, 14)]
    assert got == sorted(none + [(5, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (15, 4, 4, False), (16, 4, 4, False), (17, 1, 17, True), (17, 1, 17, True)], key=str)
    assert embedding_dedup.linked(odd.limit(0)).collect() == []
    kept = embedding_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r["vec_id"]) for r in kept.collect()) == sorted(map(str, [4, 4, None, 9, 10, 11, 12, 13, 14, 17, 17]))
