"""Embedding whitening by upper-triangle column aggregates.

One aggregation sums the centred product of every pair of dimensions, each a Spark SQL expression; the covariance is put
together from these sums, decomposed by LAPACK on the driver (dim x dim numbers), and rows are projected in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import TASKS_OF_A_SUM, checkpointed, table, tidy

#: Components that are returned, and pairs of dimensions that one aggregation sums (90 dimensions; more take several).
COMPONENTS, PAIRS = 32, 4096
#: Integers stop at this size on both sides. An eigenvalue of a smaller share of the trace is no variance.
LIMIT, NO_VARIANCE = 1 << 40, 1e-13
#: What is added to each integer; it cancels wherever vectors are centred.
OFFSET = 1_000_000


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, x array<bigint>): floor(64 * entry), without OFFSET, of vectors without null or non-finite entries."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * 64, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long"))
    return v.where(F.col("v").isNotNull()).where(ok).select("vec_id", F.size("v").alias("dim"), whole.alias("x"))


def _in_two_steps(rows: DataFrame, sums: dict[str, str]) -> dict[str, object]:
    """The aggregates (sums, by name) of all rows, added by groups of tasks first."""
    some = rows.groupBy(F.floor(F.spark_partition_id() / TASKS_OF_A_SUM).alias("part")).agg(*[F.expr(e).alias(n) for n, e in sums.items()])
    return some.selectExpr(*[f"sum({n}) AS {n}" for n in sums]).head().asDict()


def covariance(rows: DataFrame, column: str, dim: int, centre: list[float], n: int) -> np.ndarray:
    """The covariance (divisor n) of an array column over all rows: the products of each pair of centred dimensions."""
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    centred = rows.selectExpr(*[f"{column}[{i}] - {c!r}D AS d{i}" for i, c in enumerate(centre)])
    out = np.zeros((dim, dim))
    for at in range(0, len(pairs), PAIRS):
        own = pairs[at : at + PAIRS]
        for name, value in _in_two_steps(centred, {f"s{i}_{j}": f"sum(d{i} * d{j})" for i, j in own}).items():
            i, j = map(int, name[1:].split("_"))
            out[i, j] = out[j, i] = value / n
    return out


def decomposed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; of either sign the one whose largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)


def _projected(n: int, sums: list[int], largest: int, w: np.ndarray):
    """deviation: exact, null beyond a long. The arithmetic of longs where it can't overflow, else that of Python's integers."""
    most = (1 << 63) - 1
    far = n * largest + max(map(abs, sums))
    kind = np.int64 if len(sums) * far * far <= most else object

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            off = x.astype(kind) * n - np.array(sums, kind)
            deviation = [int(d) if d <= most else None for d in (off**2).sum(1)]
            white = (off / n).astype(np.float64) @ w
            lists = pa.FixedSizeListArray.from_arrays(pa.array(white.reshape(-1)), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "white"])

    return run


def _of_one_length(rows: DataFrame, dim: int, n: int, components: int) -> DataFrame:
    k = min(components, dim)
    wide = "CAST(x[{0}] AS DECIMAL(20, 0))"
    sums = _in_two_steps(rows, {f"s{i}": f"sum({wide.format(i)})" for i in range(dim)})
    s = [int(sums[f"s{i}"]) for i in range(dim)]
    largest = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).head()[0]
    # centred by the rounded mean first, which is exact, and by what is left of it
    v = covariance(rows, "x", dim, [t / n for t in s], n)
    e, u = decomposed(v)
    trace, some = float(np.trace(v)), e[:k] > NO_VARIANCE * np.trace(v)
    w = np.where(some, u[:, :k] / np.sqrt(np.where(some, e[:k], 1)), 0.0)
    white = checkpointed(rows.mapInArrow(_projected(n, s, int(largest), w), "vec_id bigint, deviation bigint, white array<double>"))
    means = _in_two_steps(white, {f"m{i}": f"sum(white[{i}])" for i in range(k)})
    off = np.abs(covariance(white, "white", k, [means[f"m{i}"] / n for i in range(k)], n) - np.diag(some.astype(float)))
    at = F.col("at")
    explained = F.array(*[F.lit(float(x) / trace if trace else 0.0) for x in e[:k]])
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "white")).select(
        "vec_id",
        (at + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.array(*[F.lit(bool(x)) for x in some])[at], F.col("white")).alias("whitened"),
        explained[at].alias("explained"),
        F.lit(float(off.max())).alias("identity_error"),
    )


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component.

    vectors: (vec_id, embedding); null vectors and those with null or non-finite entries are left out. The fit is over
    all others; vectors of different lengths are fits of their own (a few aggregations each), empty ones have no
    component. Rows that repeat an id, or without one, count like others; other columns have no effect. A component
    without variance (a constant dimension, one row) has a null `whitened`, explains nothing and does not count in
    identity_error. deviation is exact, and null where it exceeds a long; integers stop at LIMIT on both sides.
    """
    spark = vectors.sparkSession
    rows = checkpointed(integers(vectors))
    out = spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    for r in rows.where("dim > 0").groupBy("dim").count().orderBy("dim").collect():
        out = out.unionByName(_of_one_length(rows.where(F.col("dim") == r["dim"]), r["dim"], r["count"], components))
    return out


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
