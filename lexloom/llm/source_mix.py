"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are put in a random order and cut into blocks. A source gives a whole number of passes over
all its blocks plus the first blocks of one more pass, so its words meet its target up to what whole documents allow;
in the pass that is cut, the last block gives those documents that still fit, larger ones first. The numbers of blocks
that the sources give are then split down a binary tree: each node deals half of its blocks to its left child, so many
of each source as a multivariate hypergeometric draw says. The leaves are the output shards; a shard takes its
numbers of the sources' permuted blocks, no two shards the same, and orders its documents at random.

Everything is DataFrame operations. Draws come from hashes of what a row holds (and, of rows alike, its number among
them), so they agree however the input is partitioned.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import checkpointed, table

#: Weights by the rank of the source, repeating; words of the mix as a share of all words; most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Documents of a block; rows of a source that are ranked in one sort; blocks whose words are summed in one sort; rows
#: alike that one row of numbers stands for.
BLOCK_DOCS, BIN_ROWS, RUN_BLOCKS, NUMBERS = 32, 4096, 128, 1 << 16
#: Sources up to which a table of one row a source is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Words of an output shard; the splitting tree has as many levels as that takes, and LEVELS at least.
SHARD_WORDS, LEVELS = 1 << 26, 4
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that a hash of the parts gives."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size): the shares by weight, none over passes * size.

    Sources whose share would be over their limit get the limit, the rest is shared anew by weight; in order of limit
    over weight, the sources that get their limit come first, so one running sum finds them.
    """
    one = W.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(one) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", passes * F.col("source_size"))
    by = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    every = W.partitionBy()
    s = s.withColumn("total", share * F.sum("source_size").over(every))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("others", F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("others"))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(every))
    return s.select("source", "source_size", "weight", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit")).alias("target"))


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, from n + 8 downwards for small n."""

    def series(n: Column) -> Column:
        x = n + 9.0
        tail = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
        return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + tail - F.log(reduce(lambda a, b: a * b, [n + float(k) for k in range(1, 9)]))

    return let(n.cast("double"), series)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(good: Column, other: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of good + other are good: the smallest k whose distribution function reaches u.

    Probabilities are summed over the mean and ten standard deviations either way (all of the support, if it is less).
    """

    def support(a: Column) -> Column:
        total = (a.good + a.other).cast("double")
        mean = F.when(total > 0, a.drawn * a.good / total).otherwise(0.0)
        part = F.when(total > 1, (a.other / total) * ((total - a.drawn) / (total - 1))).otherwise(0.0)
        low, high = F.greatest(F.lit(0).cast("long"), a.drawn - a.other), F.least(a.good, a.drawn)
        return let(F.struct(a.alias("a"), mean.alias("mean"), part.alias("part"), low.alias("low"), high.alias("high")), window)

    def window(m: Column) -> Column:
        spread = 10 * F.sqrt(F.greatest(F.lit(0.0), m["mean"] * m.part)) + 10
        first, last = F.greatest(m.low, F.floor(m["mean"] - spread).cast("long")), F.least(m.high, F.ceil(m["mean"] + spread).cast("long"))
        return F.when(m.high <= m.low, m.low).otherwise(let(F.struct(m.a.alias("a"), first.alias("first"), last.alias("last")), invert))

    def invert(w: Column) -> Column:
        a = w.a
        start = F.exp(_ln_choose(a.good, w.first) + _ln_choose(a.other, a.drawn - w.first) - _ln_choose(a.good + a.other, a.drawn))
        steps = F.when(w.last > w.first, F.sequence(w.first + 1, w.last)).otherwise(F.array().cast("array<bigint>"))

        def step(s: Column, k: Column) -> Column:
            p = s.p * ((a.good - k + 1) * (a.drawn - k + 1)).cast("double") / (k * (a.other - a.drawn + k)).cast("double")
            return F.when(s["sum"] < a.u, let(p, lambda p: F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), k.alias("k")))).otherwise(s)

        return let(start, lambda p: F.aggregate(steps, F.struct(p.alias("p"), p.alias("sum"), w.first.alias("k")), step, lambda s: s.k))

    return let(F.struct(good.alias("good"), other.alias("other"), drawn.alias("drawn"), u.alias("u")), support)


def _draw(*key: Column):
    def draw(s: Column, x: Column) -> Column:
        k = hypergeometric(x.blocks, s.rest - x.blocks, s.want, uniform(*key, F.col("node"), x.source_no))
        return let(k, lambda k: F.struct((s.rest - x.blocks).alias("rest"), (s.want - k).alias("want"), F.concat(s.left, F.array(k)).alias("left")))

    return draw


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """(shard, source_no, first, n): how many blocks of each source each shard takes, and from where in its order.

    quotas: (source_no, blocks). A node's blocks are halved level by level; within a node the sources are drawn one
    after another, each from what the earlier ones have left.
    """
    item = F.struct(F.col("source_no").cast("long").alias("source_no"), F.col("blocks").cast("long").alias("blocks"))
    nodes = quotas.agg(F.array_sort(F.collect_list(item)).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    zero = F.lit(0).cast("long")
    for level in range(levels):
        total = F.aggregate("q", zero, lambda a, x: a + x.blocks)
        nodes = nodes.withColumn("total", total).withColumn("half", F.floor((F.col("total") + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node"), F.lit(2))) / 2).cast("long"))
        nothing = F.array().cast("array<bigint>")
        begin = F.struct(F.col("total").alias("rest"), F.col("half").alias("want"), nothing.alias("left"))

        nodes = nodes.withColumn("left", F.aggregate("q", begin, _draw(F.lit(seed), F.lit(level)), lambda s: s.left))
        pick = lambda c: F.transform("q", lambda x, i: F.struct(x.source_no.alias("source_no"), c(x, i).alias("blocks")))
        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), pick(lambda x, i: F.col("left")[i]).alias("q")),
            F.struct((2 * F.col("node") + 1).alias("node"), pick(lambda x, i: x.blocks - F.col("left")[i]).alias("q")),
        )
        nodes = checkpointed(nodes.select(F.explode(halves).alias("h")).select("h.node", "h.q"))
    leaves = nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source_no", F.col("x.blocks").alias("n")).where("n > 0")
    first = F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), zero)
    return leaves.withColumn("first", first)


def draws(sized: DataFrame, seed: int = 0, levels: int | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """What the mix takes: (row_id, shard, place), a row for each time, and the sources' (source, source_size, target).

    sized: (row_id, source, size); row_id, unique and of any type that has an order, decides the draws. Documents without words have no part in the order and are never taken.
    """
    known = checkpointed(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")))
    targets = source_targets(known.select("source", "source_size"), **params)
    targets = targets.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")).cast("long"))
    # near whole passes are whole, so that rounding never cuts one
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    targets = targets.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))
    targets = checkpointed(targets.join(known.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    plan = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    u = F.xxhash64(F.lit(seed), F.lit("order"), "row_id")
    rows = sized.where("size > 0").join(plan.select(F.col("source").alias("s"), "source_no", "n", "passes", "rest"), F.col("source").eqNullSafe(F.col("s")))
    bins = F.floor(F.shiftrightunsigned(u, 12) / float(1 << 52) * F.ceil(F.col("n") / BIN_ROWS)).cast("long")
    rows = checkpointed(rows.select("row_id", "source_no", "size", "passes", "rest", u.alias("u"), bins.alias("bin")))
    per_bin = rows.groupBy("source_no", "bin").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    earlier = W.partitionBy("source_no").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    per_bin = per_bin.select("source_no", "bin", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    inside = W.partitionBy("source_no", "bin").orderBy("u", "row_id")
    ranked = rows.withColumn("k", F.row_number().over(inside) - 1).join(per_bin, ["source_no", "bin"])
    ranked = checkpointed(ranked.select("row_id", "source_no", "size", "passes", "rest", "u", F.floor((F.col("k") + F.col("rows_before")) / BLOCK_DOCS).cast("long").alias("block")))

    blocks = ranked.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    # words of the blocks before: sums of runs of blocks, then sums within a run
    blocks = checkpointed(blocks.withColumn("run", F.floor(F.col("block") / RUN_BLOCKS)))
    runs = blocks.groupBy("source_no", "run").agg(F.sum("words").alias("words"))
    runs = runs.select("source_no", "run", F.coalesce(F.sum("words").over(W.partitionBy("source_no").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("runs_before"))
    within = F.coalesce(F.sum("words").over(W.partitionBy("source_no", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", within).join(runs, ["source_no", "run"]).withColumn("before", F.col("before") + F.col("runs_before"))
    left = F.col("rest") - F.col("before")
    blocks = checkpointed(blocks.select("source_no", "block", "passes", F.when(left >= F.col("words"), F.col("words")).otherwise(F.greatest(left, F.lit(0))).alias("part"), "words"))

    # blocks of the mix: each source's blocks once for each whole pass, then those of the pass that is cut
    given = blocks.select("source_no", "block", "part", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass"), "passes")
    given = given.where("pass < passes or part > 0").select("source_no", "block", "pass", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("part")).alias("part"), "words")
    last = given.where("part < words").select("source_no", "block", "part")
    fold = F.aggregate(
        F.reverse(F.array_sort(F.collect_list(F.struct("size", "u", "row_id")))),
        F.struct(F.first("part").alias("left"), F.array().cast(T.ArrayType(sized.schema["row_id"].dataType)).alias("ids")),
        lambda s, x: F.when(x["size"] <= s.left, F.struct((s.left - x["size"]).alias("left"), F.concat(s.ids, F.array(x.row_id)).alias("ids"))).otherwise(s),
        lambda s: s.ids,
    )
    fits = ranked.join(F.broadcast(last) if targets.count() <= BROADCAST_SOURCES else last, ["source_no", "block"]).groupBy("source_no", "block").agg(fold.alias("ids")).select(F.explode("ids").alias("fit"))

    if levels is None:
        levels = max(LEVELS, math.ceil(math.log2(1 + (targets.agg(F.sum("target")).head()[0] or 0) / SHARD_WORDS)))
    quotas = given.groupBy("source_no").agg(F.count("*").alias("blocks"))
    shards = split_quotas(quotas, levels, seed)
    # a block's place in its source's random order of given blocks, by bins as above
    v = F.xxhash64(F.lit(seed), F.lit("deal"), "source_no", "block", "pass")
    given = given.join(F.broadcast(quotas) if targets.count() <= BROADCAST_SOURCES else quotas, "source_no")
    given = checkpointed(given.select("source_no", "block", "pass", (F.col("part") < F.col("words")).alias("cut"), v.alias("v"), F.floor(F.shiftrightunsigned(v, 12) / float(1 << 52) * F.ceil(F.col("blocks") / BIN_ROWS)).cast("long").alias("bin")))
    base = given.groupBy("source_no", "bin").agg(F.count("*").alias("rows")).select("source_no", "bin", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))
    dealt = given.withColumn("k", F.row_number().over(W.partitionBy("source_no", "bin").orderBy("v", "block", "pass")) - 1).join(base, ["source_no", "bin"]).withColumn("k", F.col("k") + F.col("rows_before"))
    # the shards' ranges of places, met by stretches of BIN_ROWS places
    stretch = lambda place: F.floor(place / BIN_ROWS).cast("long")
    ranges = shards.select(F.col("source_no").alias("s"), "shard", "first", "n", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("first") + F.col("n") - 1))).alias("stretch"))
    inside = (F.col("source_no") == F.col("s")) & (stretch(F.col("k")) == F.col("stretch")) & (F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("n"))
    dealt = dealt.join(ranges, inside).select("source_no", "block", "pass", "cut", "shard")

    taken = ranked.select("row_id", "source_no", "block").join(dealt, ["source_no", "block"]).join(fits, F.col("row_id") == F.col("fit"), "left").where("not cut or fit is not null")
    place = F.xxhash64(F.lit(seed), F.lit("local"), "shard", "pass", "row_id")
    return taken.select("row_id", "shard", place.alias("place"), "pass"), targets.select("source", "source_size", "target")


def _key() -> Column:
    """What tells rows apart that share a doc_id: a hash of it, the source and the text, and of which of them are null."""
    return F.xxhash64("doc_id", "source", "text", *[F.col(c).isNull() for c in ("doc_id", "source", "text")])


def _numbered(docs: DataFrame) -> DataFrame:
    """(row_id, source, size) of the rows of docs; row_id: id (0 for null), key, and a number among rows alike."""
    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), _key().alias("key"), "source", F.col("doc_id").isNull().alias("no_id"), n_words(F.col("text")).alias("size"))
    known = known.groupBy("id", "key", "no_id", "source", "size").agg(F.count("*").alias("alike"))
    # numbers 0, 1, ... of rows alike, a stretch at a time
    runs = known.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / NUMBERS))))
    number = F.explode(F.sequence(F.col("run") * NUMBERS, F.least(F.col("alike"), (F.col("run") + 1) * NUMBERS) - 1))
    return checkpointed(runs.withColumn("number", number).select(F.struct("id", "key", "number").alias("row_id"), "no_id", "source", "size"))


def mix_words(docs: DataFrame, **params) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target of its source, and the words that the mix takes of it.

    A null source is a source of its own, after all others; a null or empty text has size 0 and is never taken; rows
    that repeat a doc_id are rows of their own. A source without words has target 0. The result is the same for every
    order and partitioning of docs.
    """
    rows = _numbered(docs)
    taken, targets = draws(rows.select("row_id", "source", "size"), **params)
    times = taken.groupBy("row_id").agg(F.count("*").alias("times"))
    few = targets.count() <= BROADCAST_SOURCES
    t = targets.withColumnRenamed("source", "s")
    t = F.broadcast(t) if few else t
    doc_id = F.when(~F.col("no_id"), F.col("row_id.id")).alias("doc_id")
    return rows.join(times, "row_id", "left").join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        doc_id, "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken")
    )


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix: the taken rows of docs, so often as they are taken, with shard and place (their order in it) added.

    Texts are joined with what is taken of them by id and a key of id, source and text. Rows alike in all three are drawn
    as rows of their own; any of them then stands for each draw. Columns of docs named shard or place are replaced.
    """
    rows = _numbered(docs)
    taken, _ = draws(rows.select("row_id", "source", "size"), **params)
    taken = checkpointed(taken.select("row_id.id", "row_id.key", "shard", "place"))
    own = [c for c in docs.columns if c not in ("shard", "place")]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), _key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    alike = checkpointed(rows.where("row_id.number = 1").select("row_id.id", "row_id.key"))
    if alike.isEmpty():
        return keyed.join(taken, ["id", "key"]).select("row.*", "shard", "place")
    single = keyed.join(alike, ["id", "key"], "left_anti").unionByName(keyed.join(alike, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.any_value("row").alias("row")))
    return single.join(taken, ["id", "key"]).select("row.*", "shard", "place")


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def source_mix_targets(spark, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets of op9, the part of it that SQL can repeat."""
    docs = table(spark, sf_dir, "documents").select("source", n_words(F.col("text")).alias("size"))
    told = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    return told.select("source", F.col("source_size").cast("long").alias("source_size"), F.round("target", 4).alias("target"))


#: Of the levels that each set of full sources would give, the one at which all targets add up to the total.
TARGETS_ORACLE = r"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT a.total, (a.total - coalesce(sum(b.most) FILTER (b.most / b.weight < a.most / a.weight), 0)) / sum(b.weight) FILTER (b.most / b.weight >= a.most / a.weight) AS level
  FROM w a, w b GROUP BY a.source, a.total),
best AS (SELECT level FROM l ORDER BY abs((SELECT sum(least(w.most, l.level * w.weight)) FROM w) - l.total), level LIMIT 1)
SELECT source, source_size, round(least(most, level * weight), 4) AS target FROM w, best
"""
