"""N-gram Jaccard join by prefix filtering under several global orders.

Documents with equal shingle sets form a class; the smallest doc_id stands for it. Two sets of Jaccard similarity t or
more share a token among the first n - ceil(t n) + 1 of either set, under any order of all tokens. The first order puts
frequent tokens last (counted approximately; every document uses the same order, so nothing is lost), the others are
random. Candidates share prefix tokens under the first order and pass its length and position bounds; before the exact
count they must share prefix tokens under each other order as well.

Links are needed only as far as they connect. A first round compares the documents of each shared token with one of
them (the one with the fewest rare tokens); a second takes every pair of documents that share a token and are not
connected yet. So the cost of a group of near copies grows with its size, not with the square of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import NOT_SPACE, Words, array_sums, checkpointed, hashes, lists, mix, pieces, ragged, table, tidy
from lexloom.llm.components import components

SHINGLE, PERCENT = 4, 85
#: What shapes the first order (how well it prunes, never what is found): tokens that a task keeps counters for, documents
#: from which a token counts as frequent, and frequent tokens at most; and cells in which all tokens are counted by hash,
#: with the standard deviations over the mean from which all tokens of a cell count as frequent.
COUNTERS, FREQUENT, MOST_FREQUENT, CELLS, CELL_PART, HOT = 1 << 16, 4, 1 << 18, 1 << 18, 1 << 12, 8
#: Ids up to which a list of documents is broadcast (8 bytes each); beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Ratio of the sizes in one bin.
BIN = 1.085
#: Seeds of the random orders.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and the size of each set."""
    words = Words(texts, NOT_SPACE)
    of_word = hashes(words.distinct)[words.codes]
    n, at, counts = len(of_word), words.of(), words.counts
    whole = np.flatnonzero((counts > 0) & (counts < size))
    total = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        total = mix(total + of_word[i : n - size + 1 + i] + np.uint64(i + 1))
    inside = at[size - 1 :] == at[: len(total)] if len(total) else np.zeros(0, bool)
    values, owner = total[inside], at[: len(total)][inside]
    if len(whole):
        short = []
        for d in whole:
            h = np.zeros(1, np.uint64)
            for i, w in enumerate(of_word[words.firsts[d] : words.firsts[d] + counts[d]]):
                h = mix(h + w + np.uint64(i + 1))
            short.append(mix(h + np.uint64(counts[d] << 32))[0])
        values, owner = np.concatenate([values, np.array(short, np.uint64)]), np.concatenate([owner, whole])
        by = np.argsort(owner, kind="stable")
        values, owner = values[by], owner[by]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(sets) if sets else values), np.array([len(s) for s in sets], np.int64)


class Frequent:
    """Counts of frequent values in bounded memory: all counters drop by the largest that has to go."""

    def __init__(self, most: int = COUNTERS):
        self.most, self.keys, self.counts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        keys, counts = np.unique(values, return_counts=True)
        again = counts > 1
        both, at = np.unique(np.concatenate([self.keys, keys[again]]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, counts[again]]), len(both)).astype(np.int64)
        if len(both) > self.most:
            total -= np.partition(total, len(total) - self.most - 1)[len(total) - self.most - 1]
        self.keys, self.counts = both[total > 0], total[total > 0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(CELLS)).astype(np.int64)


MEASURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("token", pa.int64()), ("count", pa.int64()), ("part", pa.int32()), ("cells", pa.list_(pa.float64()))])


@tidy
def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, digest) of documents, rows (token, count) of tokens that repeat within a piece of this task, and
    rows (part, cells) with the counts of all its tokens by cell."""
    seen, cells = Frequent(), np.zeros(CELLS, np.int64)

    def rows(k: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(k, f.type)) for f in MEASURES], schema=MEASURES)

    for batch in pieces(batches):
        values, sizes = shingle_sets(batch["text"])
        ends = np.cumsum(sizes)
        digests = [hashlib.blake2b(values[e - s : e].tobytes(), digest_size=16).hexdigest() if s else None for s, e in zip(sizes, ends, strict=True)]
        seen.add(values)
        cells += np.bincount(_cell(values), minlength=CELLS)
        yield rows(len(sizes), doc_id=batch["doc_id"], n=pa.array(sizes), digest=pa.array(digests, pa.string()))
    yield rows(len(seen.keys), token=pa.array(_signed(seen.keys)), count=pa.array(seen.counts))
    if cells.any():
        parts = CELLS // CELL_PART
        yield rows(parts, part=pa.array(range(parts), pa.int32()), cells=lists(cells.astype(float), np.full(parts, CELL_PART)))


def prefix_size(n, percent: int = PERCENT):
    return n + (-percent * n) // 100 + 1


def ranked(values: np.ndarray, keys: np.ndarray, counts: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The rank of each token in the first order: 0 for rare ones, a count for frequent ones (of the token, or what its
    cell has over the mean)."""
    rank = cells[_cell(values)]
    if len(keys):
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        rank = np.maximum(rank, np.where(keys[at] == values, counts[at], 0))
    return rank


def _prefixes(known):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values, sizes = shingle_sets(batch["text"])
            rank = ranked(values, *known.value)
            of = np.repeat(np.arange(len(sizes)), sizes)
            # each set by rank, and by hash among equals
            order = np.lexsort((values, rank, of))
            own = np.where(sizes > 0, prefix_size(sizes), 0)
            flat = values[order][ragged(np.cumsum(sizes) - sizes, own)]
            rare = np.bincount(of[rank == 0], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes), pa.array(rare), lists(_signed(flat), own)], names=["doc_id", "n", "rare", "prefix"])

    return run


@tidy
def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values, sizes = shingle_sets(batch["text"])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], lists(_signed(values), sizes)], names=["doc_id", "tokens"])


@tidy
def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sketch): the low 24 bits of each token, ascending, three bytes each."""
    for batch in pieces(batches):
        values, sizes = shingle_sets(batch["text"])
        ends = np.cumsum(sizes)
        own = [np.sort((values[e - s : e] & np.uint64(0xFFFFFF)).astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for s, e in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own, pa.binary())], names=["doc_id", "sketch"])


def _opened(sketch: pa.BinaryScalar) -> np.ndarray:
    low = np.frombuffer(sketch.as_buffer(), np.uint8).reshape(-1, 3)
    out = np.zeros((len(low), 4), np.uint8)
    out[:, :3] = low
    return out.reshape(-1).view("<u4")


def _random_prefix(tokens: np.ndarray, seed: int) -> np.ndarray:
    k = prefix_size(len(tokens))
    order = mix(tokens.astype(np.uint64) ^ np.uint64(seed))
    return np.partition(order, k - 1)[:k] if k < len(order) else order


def _may_link(x: np.ndarray, y: np.ndarray) -> bool:
    """Equal tokens have equal low bits: the prefixes of linked sets share some, and no overlap is larger than theirs."""
    if not all(len(np.intersect1d(_random_prefix(x, s), _random_prefix(y, s))) for s in ORDERS):
        return False
    values, times = np.unique(x, return_counts=True)
    others, of_others = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    most = int(np.minimum(times[i], of_others[j]).sum())
    return (100 + PERCENT) * most >= PERCENT * (len(x) + len(y))


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _kept(test, opened):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(opened(x), opened(y)) for x, y in zip(batch["own_a"], batch["own_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _checked(pairs: DataFrame, docs: DataFrame, read, schema: str, test, opened) -> DataFrame:
    """The pairs (a, b) whose documents pass the test. Only documents of pairs are read again."""
    near = checkpointed(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    few = near.count() <= BROADCAST_IDS
    if few:
        own = docs.join(F.broadcast(near), "doc_id", "left_semi").mapInArrow(read, schema).toDF("doc_id", "own")
    else:  # what is read of the texts is shuffled, not the texts
        own = docs.mapInArrow(read, schema).toDF("doc_id", "own").join(near, "doc_id", "left_semi")
    own = checkpointed(own)
    a = own.select(F.col("doc_id").alias("a"), F.col("own").alias("own_a"))
    b = own.select(F.col("doc_id").alias("b"), F.col("own").alias("own_b"))
    return checkpointed(pairs.join(a, "a").join(b, "b").mapInArrow(_kept(test, opened), "a long, b long").distinct())


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of representatives those that link: by sketches first, then exactly."""
    possible = _checked(checkpointed(pairs), docs, _sketches, "doc_id long, sketch binary", _may_link, _opened)
    return _checked(possible, docs, _sets, "doc_id long, tokens array<long>", _links, lambda tokens: tokens.values.to_numpy())


def _bounds(pos_a: str, n_a: str, pos_b: str, n_b: str):
    """What a linked pair meets at its first shared token: enough tokens are left, and the sizes are close."""
    left = F.least(F.col(n_a) - F.col(pos_a), F.col(n_b) - F.col(pos_b))
    close = 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)
    return close & ((100 + PERCENT) * left >= PERCENT * (F.col(n_a) + F.col(n_b)))


def _bin(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(BIN)))


def _apart(mixed: DataFrame) -> DataFrame:
    """(a, b): documents of a token, not connected yet, that may still link; mixed: (token, doc_id, n, pos, component, main).

    Of two linked sets the smaller has its first shared token early, for half of both sizes is at least its own size; and
    where a set has it says how large the other is at most. So rows meet by token and a bin of their size, and rows whose
    token comes too late meet no one. Boilerplate comes late in all documents that have much of their own.
    """
    left = (100 + PERCENT) * (F.col("n") - F.col("pos"))
    room = F.floor((left - PERCENT * F.col("n")) / PERCENT)  # the size of the other set at most
    lowest = F.ceil(PERCENT * F.col("n") / 100)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "pos", "component")]
    bins = lambda a, b: F.explode(F.sequence(_bin(a), _bin(b))).alias("bin")
    small, large = mixed.where(room >= F.col("n")), mixed.where(room >= lowest)
    lone = F.col("component") != F.col("main")
    # at least one of two lies outside the token's largest component; its rows go to the bins of the other's
    pairs = small.where(lone).select("token", bins(F.col("n"), room), *side("a")).join(large.select("token", _bin(F.col("n")).alias("bin"), *side("b")), ["token", "bin"])
    pairs = pairs.unionByName(small.where(~lone).select("token", _bin(F.col("n")).alias("bin"), *side("a")).join(large.where(lone).select("token", bins(lowest, F.least("n", room)), *side("b")), ["token", "bin"]))
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_id_a") < F.col("doc_id_b")))
    near = first & (F.col("component_a") != F.col("component_b")) & _bounds("pos_a", "n_a", "pos_b", "n_b")
    return pairs.where(near).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def _frequent(seen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent tokens, ascending, their counts, and what each cell has over the mean (0 where that may be chance).

    As many of the most frequent tokens are taken as whole classes of counts allow, MOST_FREQUENT at most, so what
    reaches the driver is bounded.
    """
    counts = checkpointed(seen.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT))
    size, total, least = F.floor(8 * F.log2("count")), 0, None
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = r["size"]
    top = (counts.where(size >= least) if least is not None else counts.limit(0)).toPandas()
    keys = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    cells = np.zeros(CELLS)
    for r in array_sums(seen.where("part is not null").select("part", "cells"), "part", "cells").collect():
        cells[r["part"] * CELL_PART : (r["part"] + 1) * CELL_PART] = r["cells"]
    over = cells - np.median(cells)
    over[over < HOT * np.sqrt(np.median(cells)) + FREQUENT] = 0
    return keys[order], top["count"].to_numpy().astype(np.int64)[order], over.astype(np.int64)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Two documents link if their sets of 4-word shingles have a Jaccard similarity of 0.85 or more; a document of fewer
    words is one shingle; null or wordless texts have an empty set and link with nothing. component_id is the smallest
    doc_id that links reach. Rows that repeat a doc_id stay as they are; if their texts differ, each counts by its own
    set and they share a component. A row without doc_id links with nothing and has no component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measures = "doc_id long, n long, digest string, token long, count long, part int, cells array<double>"
    seen = checkpointed(docs.mapInArrow(_measure, measures))
    sizes = seen.where("token is null and part is null").select("doc_id", "n", "digest")
    known = spark.sparkContext.broadcast(_frequent(seen))

    ided = sizes.where("doc_id is not null and digest is not null")
    classes = checkpointed(ided.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    known_ids = docs.where("doc_id is not null")
    schema = "doc_id long, n long, rare long, prefix array<long>"
    # a document whose every row has the set of a smaller id is a copy
    copies = ided.join(classes, "digest").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("rep")).cast("int")).alias("own")).where("own = 0").select("doc_id")
    copies = checkpointed(copies)
    if copies.count() <= BROADCAST_IDS:
        prefixes = known_ids.join(F.broadcast(copies), "doc_id", "left_anti").mapInArrow(_prefixes(known), schema)
    else:
        prefixes = known_ids.mapInArrow(_prefixes(known), schema).join(copies, "doc_id", "left_anti")
    prefixes = checkpointed(prefixes.where("n > 0"))
    # n and place in one long, to keep the rows that are shuffled small
    postings = prefixes.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "doc_id", (F.shiftleft("n", 32) + F.col("pos")).alias("n_pos"))
    again = prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("of")).where("of > 1").select("token")
    shared = postings.join(again, "token").join(prefixes.select("doc_id", "rare"), "doc_id")
    shared = checkpointed(shared.select("token", "doc_id", F.shiftright("n_pos", 32).alias("n"), F.col("n_pos").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "rare"))
    lead = shared.groupBy("token").agg(F.min(F.struct("rare", "doc_id", "n", "pos")).alias("lead"))
    led = shared.join(lead, "token").select("doc_id", "n", "pos", F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos"))
    first = led.where("doc_id <> lead").where(_bounds("pos", "n", "lead_pos", "lead_n")).select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    links = _linked(first, known_ids)
    at = components(links)
    placed = shared.select("token", "doc_id", "n", "pos").join(at.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    by = placed.groupBy("token", "component").agg(F.count("*").alias("of"))
    main = by.groupBy("token").agg(F.max(F.struct("of", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    mixed = checkpointed(placed.join(main.select("token", F.col("main.component").alias("main")), "token"))
    links = links.union(_linked(_apart(mixed), known_ids))

    # copies of one id with different texts hold together through the id
    doubles = ided.join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    doubles = doubles.join(doubles.groupBy("a").agg(F.countDistinct("b").alias("of")).where("of > 1"), "a", "left_semi")
    at = components(links.union(doubles)).select(F.col("node").alias("rep"), "component")
    placed = sizes.join(classes, "digest", "left").join(at, "rep", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those whose component holds a smaller doc_id; rows that repeat a doc_id stay, and those without."""
    gone = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s FROM s),
e AS (SELECT doc_id, n, unnest(s) AS token FROM n),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.token = b.token AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, ways.b FROM r JOIN ways ON r.y = ways.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
