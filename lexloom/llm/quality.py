"""Quality classifier: a Gaussian kernel over document statistics, approximated by random Fourier features.

Each partition of the labelled rows sums its normal equations; their total gives the ridge weights. Isotonic regression
on labelled rows of another fold turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import NOT_SPACE, Words, array_sums, checkpointed, pieces, remainder, table

#: Random features, their seed, the ridge, and the width of the bins (of raw scores) that calibration counts.
FEATURES, SEED, RIDGE, BIN = 256, 7, 0.3, 0.002

_BYTE = np.arange(256)
#: Kinds of bytes whose shares are statistics.
KINDS = {
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "space": np.isin(_BYTE, [9, 11, 12, 13, 32]),
    "line_end": _BYTE == 10,
    "beyond_ascii": _BYTE >= 128,
    "sentence": np.isin(_BYTE, list(b".!?,;:'\"()-")),
    "markup": np.isin(_BYTE, list(b"<>{}[]\\/=_`~^|")),
    "sign": np.isin(_BYTE, list(b"#$%&*+@")),
}
STATISTICS = [*KINDS, "log_bytes", "word_bytes", "distinct_words", "top_word", "word_again", "bytes_a_line", "distinct_lines", "short_lines", "end_of_line"]
NOT_NEWLINE = _BYTE != 10


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text, and how often its most frequent one occurs."""
    n = len(words.counts)
    pairs, times = np.unique(words.of() * np.int64(len(words.distinct) + 1) + words.codes, return_counts=True)
    of = pairs // (len(words.distinct) + 1)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, times)
    return np.bincount(of, minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, statistics): shares and means; an empty text has zeros."""
    words, rows = Words(texts, NOT_SPACE), Words(texts, NOT_NEWLINE)
    data, offsets, n = words.raw, words.offsets, len(texts)
    size = np.maximum(1, np.diff(offsets))
    out = [_per_text(kind[data], offsets) / size for kind in KINDS.values()]
    count, lines = np.maximum(1, words.counts), np.maximum(1, rows.counts)
    distinct, most = _distinct(words)
    again = np.zeros(len(words.codes), bool)
    again[1:] = words.codes[1:] == words.codes[:-1]
    again[words.firsts[:-1][words.counts > 0]] = False
    same = np.bincount(words.of(), again, n) if len(again) else np.zeros(n)
    own_lines, _ = _distinct(rows)
    row_sizes = rows.ends - rows.starts
    last = rows.raw[rows.ends - 1] if len(rows.ends) else np.zeros(0, np.uint8)
    per_line = lambda x: np.bincount(rows.of(), x, n) if len(row_sizes) else np.zeros(n)
    out += [
        np.log1p(np.diff(offsets)), np.log1p(_per_text(NOT_SPACE[data], offsets) / count), distinct / count, most / count, same / count,
        np.log1p(np.diff(offsets) / lines), own_lines / lines, per_line(row_sizes < 30) / lines, per_line(np.isin(last, list(b".!?\""))) / lines,
    ]
    return np.stack(out, 1)


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, statistics(batch["text"]).T)], names=["doc_id", *STATISTICS])


class Kernel:
    """cos(x W + b) of standardized statistics, and a constant."""

    def __init__(self, means: np.ndarray, spreads: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.means, self.spreads = means, spreads
        self.w = rng.normal(size=(len(means), features)) / np.sqrt(len(means))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.means) / self.spreads, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch[c]) for c in STATISTICS], 1)


def _normal_equations(kernel: Kernel):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kernel.b) + 1, len(kernel.b) + 2))
        for batch in batches:
            z = kernel.of(_matrix(batch))
            total += z.T @ np.concatenate([z, np.asarray(batch["quality"], dtype=float)[:, None]], 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist())], names=["row", "sums"])

    return run


def _raw(kernel: Kernel, weights: np.ndarray, keep: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(kernel.of(_matrix(batch)) @ weights)], names=[*keep, "raw"])

    return run


def isotonic(at: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over bins in order: points (raw score, probability) to interpolate between."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at, ones, counts, strict=True):
        blocks.append([x * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.5) / (b[:, 2] + 1)


def quality(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text): the probability that its quality is 1.

    learn: (doc_id, quality, fold); fold 0 fits the weights, fold 1 calibrates (either does both, if the other has no
    rows). Rows with nulls are ignored. With no rows to learn from each score is 0.5. Null and empty texts, and rows with
    a null or repeated doc_id, are scored by their own statistics.
    """
    found = checkpointed(docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)))
    learn = learn.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("fold").alias("fold"))
    rows = checkpointed(found.join(learn, "doc_id"))
    about = rows.agg(F.count("*").alias("n"), F.sum((F.col("fold") == 0).cast("int")).alias("n0"), *[f(c).alias(f"{k}_{c}") for c in STATISTICS for k, f in (("mean", F.avg), ("spread", F.stddev_pop))]).head()
    if not about.n:
        return found.select("doc_id", F.lit(0.5).alias("score"))
    kernel = Kernel(np.array([about[f"mean_{c}"] for c in STATISTICS]), np.array([about[f"spread_{c}"] or 1.0 for c in STATISTICS]))
    both = about.n0 in (0, about.n)
    fit = rows if both else rows.where("fold = 0")
    sums = fit.mapInArrow(_normal_equations(kernel), "row int, sums array<double>")
    total = np.stack(array_sums(sums, "row", "sums").toPandas().sort_values("row")["sums"])
    weights = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(len(total)), total[:, -1])
    bins = (rows if both else rows.where("fold = 1")).mapInArrow(_raw(kernel, weights, ["quality"]), "quality int, raw double")
    bins = bins.groupBy(F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(3.0), "raw")) / BIN).alias("bin")).agg(F.avg("raw").alias("at"), F.sum("quality").alias("ones"), F.count("*").alias("n")).orderBy("bin").toPandas()
    x, p = isotonic(bins["at"].to_numpy(), bins["ones"].to_numpy(float), bins["n"].to_numpy(float))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.interp(kernel.of(_matrix(batch)) @ weights, x, p))], names=["doc_id", "score"])

    return found.mapInArrow(score, "doc_id long, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 3)
    learn = table(spark, sf_dir, "labels").where(fold != 1).select("doc_id", F.col("quality").cast("int").alias("quality"), (fold == 2).cast("int").alias("fold"))
    out = quality(table(spark, sf_dir, "documents"), learn)
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
