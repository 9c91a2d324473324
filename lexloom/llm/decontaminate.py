"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of whole documents inside a task. Its words become symbols: those of the test phrases' alphabet, and one
separator for everything else and for the ends of documents (no phrase holds a separator; stretches of fewer words than
the shortest phrase are left out). From the suffix array come the Burrows-Wheeler transform, held as a wavelet matrix,
and sampled suffix positions. All phrases are searched backward at once by wavelet ranks; their occurrences are located by
walking to a sampled position and merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import ALNUM, Words, checkpointed, hashes, lists, pieces, ragged, table, tidy, unused

#: Words of a test phrase; text of test items that one pass over the documents searches for. A word has a byte and a
#: separator, so a block has 2 M windows at most and its broadcast some 120 MB; of prose, a sixth of that.
WINDOW, BLOCK_CHARS = 10, 4 << 20
#: Every SAMPLE-th suffix position is kept, and each that follows a separator.
SAMPLE = 16


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            low = np.where(one, zeros + ones[low], low - ones[low])
        return at - low


def suffix_array(symbols: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Suffixes in order; each separator is a symbol of its own, smaller than all words."""
    n, k = len(symbols), 1
    rank = symbols + len(separators)
    rank[separators] = np.arange(len(separators))
    while True:
        beyond = np.zeros(n, np.int64)
        beyond[: n - k] = rank[k:] + 1
        order = np.argsort(rank * (n + len(separators) + int(symbols.max()) + 2) + beyond, kind="stable") if k == 1 else np.argsort(rank * (n + 2) + beyond, kind="stable")
        pair = np.stack([rank[order], beyond[order]])
        new = np.concatenate([[0], np.cumsum((pair[:, 1:] != pair[:, :-1]).any(0))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class FmIndex:
    """Backward search over symbols 1, 2, ... with 0 as separator; the sequence ends with a separator.

    before: the Burrows-Wheeler transform; kept: which suffixes' positions are sampled; sampled: those positions. All
    else follows from them without a sort.
    """

    def __init__(self, before: np.ndarray, kept: np.ndarray, sampled: np.ndarray):
        self.n, self.before, self.largest = len(before), before, int(before.max())
        self.tree = WaveletMatrix(before.astype(np.int64), self.largest)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=self.largest + 1))])
        self.kept, self.sampled = np.concatenate([[0], np.cumsum(kept)]), sampled

    @staticmethod
    def parts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What an index is made of: the one sort of the symbols' suffixes."""
        order = suffix_array(symbols.astype(np.int64), np.flatnonzero(symbols == 0))
        before = symbols[order - 1]
        before[order == 0] = 0
        kept = (order % SAMPLE == 0) | (before == 0)
        return before, kept, order[kept]

    @classmethod
    def of(cls, symbols: np.ndarray) -> FmIndex:
        return cls(*cls.parts(symbols))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length (a row each): from which to which suffix they begin."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        alive = np.flatnonzero((phrases <= self.largest).all(1))
        high[(phrases > self.largest).any(1)] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.smaller[c] + self.tree.rank(c, low[alive])
            high[alive] = self.smaller[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: each walks back to a sampled one."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.kept[at + 1] > self.kept[at]
            done = open_[hit]
            found[done] = self.sampled[self.kept[rows[done]]] + steps[done]
            open_ = open_[~hit]
            c = self.before[rows[open_]].astype(np.int64)
            rows[open_] = self.smaller[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
        return found


class Phrases:
    """The test items of one block: their distinct windows by length, and the items of each window. alphabet: the sorted
    hashes of all items' words, if other blocks share it; shortest: the words of the shortest window of all."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int = WINDOW, alphabet: np.ndarray | None = None, shortest: int | None = None):
        words = Words(pa.array(texts, pa.string()), ALNUM)
        own = hashes(words.distinct)
        self.alphabet = np.unique(own) if alphabet is None else alphabet
        code = np.searchsorted(self.alphabet, own)
        of = code[words.codes] + 1 if len(words.codes) else np.zeros(0, np.int64)
        counts, id_of = words.counts, np.array(ids, np.int64)
        #: by length: phrases (a row each), where the items of each begin, and the items
        self.groups = []
        for size in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            own = np.flatnonzero(np.minimum(counts, window) == size)
            per = counts[own] - size + 1
            rows = of[ragged(words.firsts[own], per)[:, None] + np.arange(size)].astype(np.int32)
            phrases, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), np.repeat(id_of[own], per)], 1), axis=0)
            self.groups.append((phrases, np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)), pairs[:, 1]))
        self.shortest = min((p.shape[1] for p, *_ in self.groups), default=0) if shortest is None else shortest

    def occurrences(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """(phrase number, first word, words of the phrase, where each phrase's items begin, items) of all occurrences
        in these texts."""
        found = self.symbols(words) if self.groups else None
        if found is not None:
            yield from self.in_index(FmIndex.of(found[0]), found[1])

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray] | None:
        """The symbols of the texts' stretches of known words, each with a separator, and the word that each is of; None
        if there are none."""
        if not len(words.codes) or not len(self.alphabet):
            return None
        h = hashes(words.distinct)
        at = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[at] == h, at + 1, 0)[words.codes]
        known = symbol > 0
        first = np.zeros(len(known), bool)
        first[words.firsts[:-1][words.counts > 0]] = True
        begin, end = known.copy(), known.copy()
        begin[1:] &= ~known[:-1] | first[1:]
        end[:-1] &= ~known[1:] | first[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = ends - starts >= self.shortest
        starts, sizes = starts[long], (ends - starts)[long]
        if not len(starts):
            return None
        place = ragged(starts, sizes + 1)  # the place after each stretch stands for its separator
        last = np.cumsum(sizes + 1) - 1
        own = symbol[np.minimum(place, len(symbol) - 1)]
        own[last] = 0
        return own, place

    def in_index(self, index: FmIndex, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        for phrases, begin, items in self.groups:
            low, high = index.search(phrases)
            rows = ragged(low, high - low)
            if len(rows):
                yield np.repeat(np.arange(len(phrases)), high - low), place[index.locate(rows)], phrases.shape[1], begin, items


def _spans(marks: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marked words, cut at the ends of documents."""
    begin, end, first = marks.copy(), marks.copy(), np.zeros(len(marks) + 1, bool)
    first[firsts] = True
    begin[1:] &= ~marks[:-1] | first[1:-1]
    end[:-1] &= ~marks[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _search(phrases, keep: list[str], cut: bool, names: list[str]):
    """Adds what the items hit. names: of the columns for the number of words, the spans (word numbers) and the items; the
    latter two may hold what is known to be hit already (phrases is None)."""
    n_words, all_spans, all_items = names

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch["text"], ALNUM)
            marks = np.zeros(len(words.codes) + 1, np.int32)
            items: list[set] = [set(x) for x in batch[all_items].to_pylist()]
            for d, spans in enumerate(batch[all_spans].to_pylist()):
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    marks[words.firsts[d] + a] += 1
                    marks[words.firsts[d] + b] -= 1
            for phrase, at, size, begin, of in phrases.value.occurrences(words) if phrases else ():
                np.add.at(marks, at, 1)
                np.add.at(marks, at + size, -1)
                doc = np.searchsorted(words.firsts, at, side="right") - 1
                pairs = np.unique(np.stack([doc, phrase], 1), axis=0)
                for d, p in pairs.tolist():
                    items[d].update(of[begin[p] : begin[p + 1]].tolist())
            hit = np.cumsum(marks)[:-1] > 0
            starts, ends = _spans(hit, words.firsts[:-1][words.firsts[:-1] < len(hit)]) if len(hit) else (np.zeros(0, np.int64),) * 2
            doc = np.searchsorted(words.firsts, starts, side="right") - 1
            per = np.bincount(doc, minlength=batch.num_rows)
            flat = np.stack([starts - words.firsts[doc], ends - words.firsts[doc]], 1).ravel() if len(starts) else np.zeros(0, np.int64)
            columns = {c: batch[c] for c in keep}
            if cut:
                columns["text"] = pa.array(_cut(batch["text"].to_pylist(), words, starts, ends, doc), pa.string())
            columns[n_words] = pa.array(words.counts.astype(np.int64))
            columns[all_spans] = lists(flat.astype(np.int64), 2 * per)
            columns[all_items] = pa.array([sorted(x) for x in items], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _cut(texts: list, words: Words, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list:
    """The texts without the bytes from each span's first word to its last."""
    for d in np.unique(doc):
        raw, kept, at = texts[d].encode(), [], 0
        for a, b in zip(starts[doc == d], ends[doc == d], strict=True):
            kept.append(raw[at : words.starts[a] - words.offsets[d]])
            at = words.ends[b - 1] - words.offsets[d]
        texts[d] = b"".join([*kept, raw[at:]]).decode()
    return texts


def _searched(docs: DataFrame, benchmark: DataFrame, cut: bool) -> tuple[DataFrame, list[str]]:
    """docs with three columns more, and the names of those: number of words, spans, items."""
    spark = docs.sparkSession
    names = unused(docs.columns, "words", "spans", "items")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    none = F.array().cast("array<bigint>")
    keep = docs.columns if cut else [c for c in docs.columns if c in ("doc_id", "text")]
    out = docs.select(*[f"`{c}`" for c in keep])
    if blocks == 1:
        own = items.orderBy("item_id").collect()
        phrases = spark.sparkContext.broadcast(Phrases([r.item_id for r in own], [r.text for r in own]))
        out = out.withColumns(dict(zip(names, (F.lit(0).cast("long"), none, none), strict=True)))
    else:
        phrases, key, id_ = None, *unused([*docs.columns, *names], "key", "id")
        hits = _in_blocks(docs, items, blocks).toDF(id_, key, *names[1:])
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (_text_key() == F.col(key))
        out = out.join(hits, same, "left").drop(id_, key).withColumn(names[0], F.lit(0).cast("long")).withColumns({n: F.coalesce(n, none) for n in names[1:]})
    held = keep if cut else [c for c in keep if c != "text"]
    fields = [docs.schema[c] for c in held]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField(names[0], T.LongType()), *[T.StructField(n, T.ArrayType(T.LongType())) for n in names[1:]]])
    return out.mapInArrow(_search(phrases, held, cut, names), schema), names


def _text_key() -> Column:
    """With doc_id, what tells rows apart; rows alike in both are hit alike."""
    return F.xxhash64("text")


def _in_blocks(docs: DataFrame, items: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, text_key, spans, items) of documents that are hit by the items, searched a block after another.

    Each piece of the documents is indexed once; the indices are kept (about five bytes for each word that any item has),
    and each block, of bounded size, is one pass over them.
    """
    sc = docs.sparkSession.sparkContext
    known = checkpointed(items.select("text").mapInArrow(_known_words, "word bigint, size int").distinct())
    alphabet = np.sort(known.select("word").where("word is not null").distinct().toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    shortest = known.agg(F.min("size")).head()[0] or 0
    shared = sc.broadcast(Phrases([], [], alphabet=alphabet, shortest=shortest))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
    indices = checkpointed(rows.mapInArrow(_indices(shared), INDEX))
    found = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        phrases = sc.broadcast(Phrases([r.item_id for r in own], [r.text for r in own], alphabet=alphabet, shortest=shortest))
        hit = checkpointed(indices.mapInArrow(_in_indices(phrases), "doc_id bigint, text_key bigint, spans array<bigint>, items array<bigint>"))
        found = hit if found is None else found.unionByName(hit)
    # a row of a document and a block, and of rows alike in id and text
    flat = lambda c: F.flatten(F.collect_set(c))
    return found.groupBy("doc_id", "text_key").agg(flat("spans").alias("spans"), F.array_distinct(flat("items")).alias("items"))


#: A piece's index: its documents, the words of each, and what FmIndex and Phrases.symbols give, as bytes.
INDEX = "ids array<bigint>, keys array<bigint>, firsts binary, before binary, kept binary, sampled binary, place binary"


@tidy
def _known_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of items' words, and (alone) the sizes of their shortest windows."""
    for batch in pieces(batches):
        words = Words(batch["text"], ALNUM)
        sizes = np.unique(np.minimum(words.counts[words.counts > 0], WINDOW)).astype(np.int32)
        own = hashes(words.distinct).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(own), pa.nulls(len(sizes), pa.int64())]), pa.concat_arrays([pa.nulls(len(own), pa.int32()), pa.array(sizes)])], names=["word", "size"])


def _indices(shared):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch["text"], ALNUM)
            found = shared.value.symbols(words)
            if found is None:
                continue
            before, kept, sampled = FmIndex.parts(found[0].astype(np.int32))
            packed = [words.firsts.astype(np.int64), before.astype(np.int32), np.packbits(kept), sampled.astype(np.int32), found[1].astype(np.int32)]
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch[c])
            yield pa.RecordBatch.from_arrays([one("doc_id"), one("text_key"), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names=["ids", "keys", "firsts", "before", "kept", "sampled", "place"])

    return run


def _in_indices(phrases):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                of = lambda c, kind: np.frombuffer(batch[c][k].as_buffer(), kind)  # noqa: B023, E731
                firsts, before = of("firsts", np.int64), of("before", np.int32)
                index = FmIndex(before, np.unpackbits(of("kept", np.uint8))[: len(before)].astype(bool), of("sampled", np.int32).astype(np.int64))
                spans: dict[int, set] = {}
                items: dict[int, set] = {}
                for phrase, at, size, begin, found in phrases.value.in_index(index, of("place", np.int32).astype(np.int64)):
                    doc = np.searchsorted(firsts, at, side="right") - 1
                    for d, a, p in zip(doc.tolist(), at.tolist(), phrase.tolist(), strict=True):
                        spans.setdefault(d, set()).add((a - int(firsts[d]), a - int(firsts[d]) + size))
                        items.setdefault(d, set()).update(found[begin[p] : begin[p + 1]].tolist())
                if spans:
                    hit = pa.array(sorted(spans))
                    flat = pa.array([[x for s in _merged(spans[d]) for x in s] for d in sorted(spans)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch["ids"][k].values.take(hit), batch["keys"][k].values.take(hit), flat, pa.array([sorted(items[d]) for d in sorted(spans)], pa.list_(pa.int64()))], names=["doc_id", "text_key", "spans", "items"])

    return run


def _merged(spans: set) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row of docs (doc_id, text).

    spans: pairs of word numbers, from and up to, that occurrences of test windows cover, merged; items: the test items
    they are of. A window is 10 consecutive words of an item, or the whole item if it has fewer. Null or wordless texts
    have no words; items that are null or have no words match nothing; of items with one id all texts count. Item ids
    are integers. Documents of any length are searched whole; rows with a null or repeated doc_id each by their own text.
    """
    out, (n_words, spans, items) = _searched(docs, benchmark, cut=False)
    return out.select("doc_id", F.col(n_words).alias("n_words"), F.col(spans).alias("spans"), F.col(items).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the covered spans cut out of their texts (and n_chars counted anew, if there); rows without hits, null
    and empty texts and all other columns, whatever their names, stay as they are."""
    out, (_, spans, _) = _searched(docs, benchmark, cut=True)
    hit = F.size(spans) > 0
    own = [F.when(hit, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.col("spans")[i + 1] - F.col("spans")[i])
    covered = F.when(F.size("spans") > 0, covered).otherwise(F.lit(0).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
hit AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
