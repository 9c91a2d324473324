"""Scores of predicted records against gold ones, joined by record id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V


def paired(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, gold, pred) structs; a record on one side only is an error."""
    pack = lambda df, name: X.computed(df, **{name: F.struct(*df.columns)}).select(key, name)
    out = pack(gold, "gold").join(pack(predicted, "pred"), key, "full")
    return out.where(F.when(F.col("gold").isNull() | F.col("pred").isNull(), F.raise_error(F.lit("gold/prediction lengths differ"))).otherwise(F.lit(True)))


def prf(counted: DataFrame) -> DataFrame:
    """counted (tp, fp, fn) with precision, recall and f1; 0 where nothing is counted."""
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counted.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), total))


#: By metric: its labels, in order. Characters without a gold value count for none but atoms and roles, which have one.
LABELS = {"boundaries": V.LEVELS, "atom": V.ATOM_TYPES, "particle_function": V.PARTICLE_FUNCTIONS, "bunsetsu_role": V.BUNSETSU_ROLES, "inflection": V.INFLECTIONS, "complete_tree": ["exact_match"]}
COUNTED = pa.schema([("metric", pa.string()), ("label", pa.string()), ("tp", pa.int64()), ("fp", pa.int64()), ("fn", pa.int64())])


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _codes(values: pa.Array, labels: list[str], null: int) -> np.ndarray:
    """The place of each value in the labels; null for none, len(labels) for one that is not listed."""
    at = pc.fill_null(pc.index_in(values, pa.array(labels)), len(labels)).to_numpy(zero_copy_only=False)
    return np.where(values.is_null().to_numpy(zero_copy_only=False), null, at)


def _painted(out: np.ndarray, first: np.ndarray, size: np.ndarray, row: np.ndarray, spans: pa.Array, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """out (a value a character of all texts) with the codes of the spans `own` written over it in order, so the last
    span over a character stands. One pass over spans and characters."""
    start, end = (np.clip(pc.fill_null(spans.field(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)[own], 0, size[row[own]]) for c in ("start", "end"))
    wide = np.maximum(end - start, 0)
    at = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first[row[own]] + start, wide)
    out[at] = np.repeat(codes[own], wide)
    return out


def _characters(batch: Mapping[str, pa.Array], side: str, metric: str, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The code of each character: of its atom type, function, role or (a bit each) inflections; -1 for none."""
    column = batch[f"{side}_{'bunsetsu' if metric == 'bunsetsu_role' else 'spans'}"]
    row, spans = _lists(column)
    total, every = int(size.sum()), np.arange(len(row))
    if metric in ("atom", "bunsetsu_role"):
        labels, field, none = (V.ATOM_TYPES, "atom_type", "OTHER") if metric == "atom" else (V.BUNSETSU_ROLES, "role", "UNKNOWN")
        return _painted(np.full(total, labels.index(none)), first, size, row, spans, _codes(spans.field(field), labels, labels.index(none)), every)
    kinds = ["PARTICLE"] if metric == "particle_function" else V.INFLECTED
    own = np.flatnonzero(pc.fill_null(pc.is_in(spans.field("atom_type"), pa.array(kinds)), False).to_numpy(zero_copy_only=False))
    if metric == "particle_function":
        codes = _codes(spans.field("function"), V.PARTICLE_FUNCTIONS, V.PARTICLE_FUNCTIONS.index("UNKNOWN"))
    else:
        of, names = _lists(spans.field("inflections"))
        bits = _codes(names, V.INFLECTIONS, len(V.INFLECTIONS))
        codes = np.zeros(len(row), np.int64)
        np.bitwise_or.at(codes, of, np.where(bits < len(V.INFLECTIONS), 1 << bits, 0))
    return _painted(np.full(total, -1), first, size, row, spans, codes, own)


def _unique(keys: np.ndarray) -> np.ndarray:
    return keys if (keys[1:] > keys[:-1]).all() else np.unique(keys)


def _met(gold: np.ndarray, pred: np.ndarray) -> int:
    """How many of sorted, unique numbers are in both."""
    return int((np.append(gold, -1)[np.searchsorted(gold, pred)] == pred).sum())


def _ends(gold: pa.Array, pred: pa.Array) -> list[int]:
    """tp, fp and fn of endpoints, as sets of each row."""
    # a null or negative endpoint is moved below its row's others, so rows keep apart
    gold, pred = (_unique((row.astype(np.int64) << 33) + (1 << 32) + pc.fill_null(x.cast(pa.int64()), -(1 << 32)).to_numpy(zero_copy_only=False)) for row, x in map(_lists, (gold, pred)))
    both = _met(gold, pred)
    return [both, len(pred) - both, len(gold) - both]


def counted(columns: Mapping[str, pa.Array], metrics: Iterable[str], levels: Iterable[str] = V.LEVELS) -> dict[str, np.ndarray]:
    """By metric, (tp, fp, fn) of each label, of the pairs of an Arrow batch: columns n (characters), gold_ and pred_
    ends_<level>, spans and bunsetsu, and same, as the metrics need them. Endpoints are counted of the levels named."""
    out = {m: np.zeros((len(LABELS[m]), 3), np.int64) for m in metrics}
    size = columns["n"].to_numpy().astype(np.int64)
    first = np.cumsum(size) - size
    for m, own in out.items():
        if m == "complete_tree":
            same = int(pc.sum(columns["same"].cast(pa.int64())).as_py())
            own += [[same, 0, len(size) - same]]
        elif m == "boundaries":
            for level in levels:
                own[V.LEVELS.index(level)] = _ends(*[columns[f"{side}_ends_{level}"] for side in ("gold", "pred")])
        else:
            gold, pred = (_characters(columns, side, m, first, size) for side in ("gold", "pred"))
            gold, pred = gold[keep := gold >= 0], pred[keep]
            if m == "inflection":
                width = len(V.INFLECTIONS)
                met = np.bincount(gold << width | np.maximum(pred, 0))
                some = np.flatnonzero(met)
                n, bits = met[some], 1 << np.arange(width)
                e, a = ((x[:, None] & bits) > 0 for x in (some >> width, some & (1 << width) - 1))
                own += np.stack([n @ (e & a), n @ (a & ~e), n @ (e & ~a)], 1)
            else:
                k = len(LABELS[m])
                met = np.bincount(gold * (k + 2) + pred + 1, minlength=(k + 1) * (k + 2)).reshape(k + 1, k + 2)[:, 1:]
                hit = np.diag(met)[:k]
                own += np.stack([hit, met.sum(0)[:k] - hit, 0 * hit], 1)
                # all gold characters that were not hit, also where nothing was predicted
                own[:, 2] += np.bincount(gold, minlength=k + 1)[:k] - hit
    return out


def _counted(metrics: list[str]):
    """Batches of pairs to counts: arrays of (tp, fp, fn) by metric and label, one set of rows a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((len(LABELS[m]), 3), np.int64) for m in metrics}
        for batch in batches:
            if batch.num_rows:
                for m, x in counted(dict(zip(batch.schema.names, batch.columns, strict=True)), metrics).items():
                    total[m] += x
        rows = [(m, label, *map(int, x)) for m in metrics for label, x in zip(LABELS[m], total[m], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTED, strict=True)], schema=COUNTED)

    return run


def counts(pairs: DataFrame, *metrics: str) -> DataFrame:
    """(metric, label, tp, fp, fn) of pairs (gold, pred), for all metrics or those named, in one pass.

    Characters up to the shorter text of a pair count. A character has the label of the last span over it; without one
    its atom type is OTHER, its role UNKNOWN; functions count in particles, inflections in inflected types. Labels are
    counted one against the rest, endpoints and inflections as sets. Every label has a row.
    """
    own, sides = list(metrics or LABELS), ("gold", "pred")
    need = [F.least(*[F.coalesce(F.length(f"{x}.text"), F.lit(0)) for x in sides]).alias("n")]
    if "boundaries" in own:
        need += [F.col(f"{x}.boundaries.{level}").alias(f"{x}_ends_{level}") for x in sides for level in V.LEVELS]
    if {"atom", "particle_function", "inflection"} & {*own}:
        need += [F.col(f"{x}.spans").alias(f"{x}_spans") for x in sides]
    if "bunsetsu_role" in own:
        need += [F.col(f"{x}.bunsetsu").alias(f"{x}_bunsetsu") for x in sides]
    if "complete_tree" in own:
        need.append(reduce(lambda a, b: a & b, [F.col(f"gold.{c}").eqNullSafe(F.col(f"pred.{c}")) for c in ("boundaries", "spans", "b_spans", "bunsetsu")]).alias("same"))
    told = pairs.select(*need).mapInArrow(_counted(own), "metric string, label string, tp long, fp long, fn long")
    none = pairs.sparkSession.createDataFrame([(m, label, 0, 0, 0) for m in own for label in LABELS[m]], told.schema)
    return told.unionByName(none).groupBy("metric", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def boundary_scores(pairs: DataFrame) -> DataFrame:
    """(level, tp, fp, fn, precision, recall, f1) of endpoint sets."""
    return prf(counts(pairs, "boundaries")).drop("metric").withColumnRenamed("label", "level")


def label_scores(pairs: DataFrame, metric: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of one metric."""
    return prf(counts(pairs, metric)).drop("metric")


def _macro(f1: Column) -> Column:
    """The mean f1 of labels with any count, 0 if there are none."""
    return F.coalesce(F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, f1)), F.lit(0.0))


def macro_f1(scores: DataFrame) -> DataFrame:
    """One row: the macro f1 of a table of label scores."""
    return scores.agg(_macro(F.col("f1")).alias("macro_f1"))


def tree_exact_match(pairs: DataFrame) -> DataFrame:
    """One row: sentences, and the share of records whose boundaries, spans, B spans and chunks are all equal."""
    total = F.col("tp") + F.col("fn")
    return counts(pairs, "complete_tree").select(total.alias("sentences"), F.when(total > 0, F.col("tp") / F.when(total > 0, total)).otherwise(0.0).alias("complete_tree_exact_match"))


def score_corpus(pairs: DataFrame) -> DataFrame:
    """(metric, label, tp, fp, fn, precision, recall, f1): all scores in one long table, of one pass over the pairs.

    Macro rows carry f1 alone, micro rows (atom, inflection) the sums; of complete trees f1 is the share that is equal.
    """
    return scored(counts(pairs))


def scored(counted: DataFrame, *by: str) -> DataFrame:
    """(by, metric, label, tp, fp, fn, precision, recall, f1) of counts (by, metric, label, tp, fp, fn)."""
    cols = ["label", "tp", "fp", "fn", "precision", "recall", "f1"]
    one = F.struct(*cols)
    # a metric's rows, at most as many as it has labels, and what is told of them together
    of = prf(counted).groupBy(*by, "metric").agg(F.collect_list(one).alias("rows"), F.struct(*[F.sum(c).alias(c) for c in cols[1:4]]).alias("sum"), _macro(F.col("f1")).alias("macro"))
    of = prf(of.select(*by, "metric", "rows", "macro", "sum.*"))
    null = {c: F.lit(None).cast("long" if c in cols[1:4] else "double").alias(c) for c in cols[1:6]}
    micro = F.struct(F.lit("micro").alias("label"), *cols[1:])
    macro = F.struct(F.lit("macro").alias("label"), *null.values(), F.col("macro").alias("f1"))
    total = F.col("tp") + F.col("fn")
    exact = F.struct(F.lit("exact_match").alias("label"), *null.values(), F.when(total > 0, F.col("tp") / F.when(total > 0, total)).otherwise(0.0).alias("f1"))
    rows = (
        F.when(F.col("metric") == "boundaries", F.col("rows")).when(F.col("metric") == "complete_tree", F.array(exact))
        .when(F.col("metric").isin("atom", "inflection"), F.concat("rows", F.array(macro, micro))).otherwise(F.concat("rows", F.array(macro)))
    )
    return of.select(*by, "metric", F.explode(rows).alias("x")).select(*by, "metric", "x.*")


def common_rows(systems: dict[str, DataFrame], *key: str) -> dict[str, DataFrame]:
    """Of each system's successes those that every system has, so that all are scored on the same rows."""
    both = reduce(lambda a, b: a.join(b, [*key], "left_semi"), [s.select(*key) for s in systems.values()]).distinct()
    return {name: s.join(both, [*key], "left_semi") for name, s in systems.items()}


def combined_prediction(tokens: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Records of which a, b and spans come from one analyser and bunsetsu, clauses and sentences from another."""
    c = chunks.select(key, F.col("boundaries").alias("_b"), F.col("bunsetsu").alias("_c"))
    joined = tokens.join(c, key)
    bounds = F.struct("boundaries.a", "boundaries.b", "_b.bunsetsu", "_b.clause", "_b.sentence")
    return joined.withColumn("boundaries", bounds).withColumn("bunsetsu", F.col("_c")).drop("_b", "_c")


def attach_gaps(chunks: Column, n: Column, to_next: bool) -> Column:
    """Chunks (start, end, ...) made to cover 0..n: gaps join the chunk after them (the last takes the tail) or before."""
    size = F.size(chunks)

    def wide(c: Column, i: Column) -> Column:
        before, after = F.when(i == 0, F.lit(0)), F.when(i == size - 1, n)
        start = F.coalesce(before, F.get(chunks, i - 1)["end"] if to_next else c["start"])
        end = F.coalesce(after, c["end"] if to_next else F.get(chunks, i + 1)["start"])
        return c.withField("start", start.cast("int")).withField("end", end.cast("int"))

    return F.transform(chunks, wide)
