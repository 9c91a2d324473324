"""Toxicity by weak supervision.

Sixteen voters look at each document: lists of insults, lists of words and word beginnings that the labelled rows mark,
and patterns. A generative label model, fitted by expectation-maximization to the counts of all vote combinations
(2 ** 16 at most, whatever the corpus), estimates each voter's accuracy and, by a tree of the strongest dependences in
each class, their correlations. A linear classifier learns the model's posteriors of all documents from lexicon and
pattern features, by Newton steps whose sums each partition makes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ALNUM, Words, array_sums, checkpointed, lists, pieces, remainder, table, tidy

#: Labelled rows of each class from which words are mined, about: those whose hash of the id is under a threshold.
MINE_ROWS = 12_000
#: Ridge, Newton steps at most, the largest change of a weight that ends them, rows of one step in numpy.
RIDGE, ROUNDS, CLOSE, ROWS = 1.0, 10, 1e-2, 2048
#: Mined words and word beginnings, how many documents must have one, and the log of how much oftener toxic ones do.
MINED, MINED_DOCS, MINED_LIFT = 512, 4, 2.5
#: Beginnings of words that are mined, in code points.
STEMS = (4, 5, 6, 7)
VOTERS, MINED_VOTERS = 16, 8

#: Insults by kind; each kind is a voter.
INSULTS = {
    "stupidity": "idiot idiots moron morons stupid dumb dimwit imbecile fool fools idiota imbécil estúpido tonto crétin imbécile stupide idiote dumm dummkopf trottel",
    "contempt": "pathetic worthless disgusting loser losers clown clowns useless patético inútil asqueroso minable pathétique dégoûtant erbärmlich wertlos widerlich versager",
    "filth": "trash scum garbage vermin filth filthy basura escoria ordure racaille abschaum dreck müll",
    "profanity": "damn crap bitch bastard asshole shit fuck fucking mierda puta merde putain connard scheiße arschloch",
}
VERY_LOUD = re.compile(r"!{3,}|\?!+")
MASKED = re.compile(r"\b[A-Za-z]\*{2,}[A-Za-z]*")


def _keys(word: str) -> list[str]:
    """The word itself and, marked, its beginnings."""
    return [word, *(word[:k] + "~" for k in STEMS if len(word) > k)]


@tidy
def _mine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, clean): in how many documents of each class a word or beginning is."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in pieces(batches):
        words = Words(batch["text"], ALNUM)
        names = words.distinct.to_pylist()
        for d, toxic in enumerate(batch["toxic"].to_pylist()):
            own = np.unique(words.codes[words.firsts[d] : words.firsts[d + 1]])
            counts[toxic].update({k for w in own for k in _keys(names[w])})
    keys = list(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0].get(k, 0) for k in keys], pa.int64())], names=["key", "toxic", "clean"])
    rest = [k for k in counts[0] if k not in counts[1]]
    yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][k] for k in rest], pa.int64())], names=["key", "toxic", "clean"])


def mined_keys(docs: DataFrame, learn: DataFrame, rows: int = MINE_ROWS) -> list[str]:
    """Words and beginnings that mark toxic rows of `learn` (doc_id, toxic), strongest first."""
    there = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("mine"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    some = checkpointed(learn.where(place < F.when(F.col("toxic") == 1, rows / there.get(1, 1)).otherwise(rows / there.get(0, 1))))
    of = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    if not of.get(0) or not of.get(1):
        return []
    counts = docs.join(F.broadcast(some), "doc_id").select("text", "toxic").mapInArrow(_mine, "key string, toxic long, clean long")
    counts = counts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= MINED_DOCS)
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    lift = F.log(t / (of[1] + 1)) - F.log(c / (of[0] + 1))
    strong = counts.withColumn("z", lift / F.sqrt(1 / t + 1 / c)).where(lift > MINED_LIFT).orderBy(F.desc("z"), "key").limit(MINED)
    return [r["key"] for r in strong.collect()]


class Lexicon:
    """Feature numbers of keys, and the voter of each feature."""

    def __init__(self, mined: list[str]):
        self.at: dict[str, int] = {}
        voter = []
        for v, words in enumerate(INSULTS.values()):
            for w in words.split():
                if self.at.setdefault(w, len(voter)) == len(voter):
                    voter.append(v)
        for k, key in enumerate(mined):
            if key in self.at:
                continue
            self.at[key] = len(voter)
            voter.append(len(INSULTS) + k % MINED_VOTERS)
        self.voter = np.array(voter, np.int64)
        self.size = len(voter)


#: A document is dense in marked words from this share of its words, and this number.
DENSE_SHARE, DENSE_WORDS = 0.008, 2
#: Pattern features: all in capitals, loud punctuation, masked words, dense in marked words (each a voter); share and log
#: number of marked words, log length.
PATTERNS = 7


def _patterns(texts: list[str | None], marked: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), PATTERNS), np.float32)
    share = marked / np.maximum(1, words)
    for i, t in enumerate(texts):
        if t:
            dense = share[i] >= DENSE_SHARE and marked[i] >= DENSE_WORDS
            out[i] = [t.isupper(), min(1.0, len(VERY_LOUD.findall(t)) / 3), min(1.0, len(MASKED.findall(t)) / 3), dense, min(3.0, 60 * share[i]), np.log1p(marked[i]), np.log1p(len(t)) / 10]
    return out


def _features(lexicon: Lexicon):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch["text"], ALNUM)
            some = np.zeros(len(words.distinct), bool)
            place: dict[int, list[int]] = {}
            for w, name in enumerate(words.distinct.to_pylist()):
                own = [lexicon.at[k] for k in _keys(name) if k in lexicon.at]
                if own:
                    some[w], place[w] = True, own
            hit = np.flatnonzero(some[words.codes])
            found = [set() for _ in range(batch.num_rows)]
            for d, w in set(zip(np.searchsorted(words.firsts, hit, side="right") - 1, words.codes[hit], strict=True)):
                found[d].update(place[w])
            marked = np.bincount(np.searchsorted(words.firsts, hit, side="right") - 1, minlength=batch.num_rows)
            patterns = _patterns(batch["text"].to_pylist(), marked, words.counts)
            votes = np.zeros(batch.num_rows, np.int64)
            for d, own in enumerate(found):
                for f in own:
                    votes[d] |= 1 << lexicon.voter[f]
            for p in range(4):
                votes |= (patterns[:, p] > 0).astype(np.int64) << (VOTERS - 4 + p)
            sizes = np.array([len(f) for f in found], np.int64)
            flat = np.array([f for own in found for f in sorted(own)], np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(votes), lists(flat, sizes), lists(patterns.ravel(), np.full(batch.num_rows, PATTERNS))], names=["doc_id", "text_key", "votes", "found", "patterns"])

    return run


class LabelModel:
    """P(toxic), and the votes' distribution in each class as a tree: each vote given one other vote."""

    def __init__(self, prior: float):
        self.prior, self.parent = prior, np.full(VOTERS, -1)

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 40) -> LabelModel:
        """votes: (combinations, voters) of 0 and 1; begins with: toxic is what is dense in marked words."""
        post = np.where(votes[:, -1] == 1, 0.95, np.where(votes[:, : VOTERS - 4].any(1), 0.05, 0.01))
        for k in range(rounds):
            if k in (0, 10):
                self.parent = self._tree(votes, counts, post) if k else self.parent
            self._rates(votes, counts, post)
            new = self.posterior(votes)
            if np.abs(new - post).max() < 1e-6 and k > 12:
                break
            post = new
        return self

    def _tree(self, votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> np.ndarray:
        """A maximum spanning tree by the voters' mutual information within the classes."""
        gain = np.zeros((VOTERS, VOTERS))
        for w in (post * counts, (1 - post) * counts):
            total = w.sum() + 4
            for i in range(VOTERS):
                for j in range(i):
                    p = np.array([[w[(votes[:, i] == a) & (votes[:, j] == b)].sum() + 1 for b in (0, 1)] for a in (0, 1)]) / total
                    gain[i, j] += total * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0)))).sum()
        gain += gain.T
        parent, inside = np.full(VOTERS, -1), {0}
        while len(inside) < VOTERS:
            i, j = max(((i, j) for i in inside for j in range(VOTERS) if j not in inside), key=lambda x: gain[x])
            if gain[i, j] > 10:
                parent[j] = i
            inside.add(j)
        return parent

    def _rates(self, votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        self.rate = np.zeros((2, VOTERS, 2))
        for y, w in ((1, post * counts), (0, (1 - post) * counts)):
            for j in range(VOTERS):
                overall = (w @ votes[:, j] + 0.5) / (w.sum() + 1)
                for b in (0, 1):
                    own = w * (votes[:, self.parent[j]] == b) if self.parent[j] >= 0 else w
                    self.rate[y, j, b] = (own @ votes[:, j] + 2 * overall) / (own.sum() + 2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.zeros((2, len(votes)))
        for y in (0, 1):
            log[y] = np.log(self.prior if y else 1 - self.prior)
            for j in range(VOTERS):
                given = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), int)
                r = self.rate[y, j][given]
                log[y] += np.where(votes[:, j] == 1, np.log(r), np.log1p(-r))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS)) & 1


def _opened(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of features: the sizes of the found lists, their places, and the dense features with the constant."""
    sizes, flat = np.diff(np.asarray(batch["found"].offsets)), np.asarray(batch["found"].flatten())
    patterns = np.asarray(batch["patterns"].flatten()).reshape(-1, PATTERNS)
    return sizes, flat, np.concatenate([patterns, np.log1p(sizes)[:, None], np.ones((len(sizes), 1))], 1).astype(float)


def _logits(sizes: np.ndarray, flat: np.ndarray, dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    own = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[flat], len(sizes)) if len(flat) else np.zeros(len(sizes))
    return np.clip(own + dense @ weights[-dense.shape[1] :], -30, 30)


def _newton_sums(size: int, weights: np.ndarray, posteriors):
    """(row, sums): this task's part of each row of [Hessian | gradient] of the log loss on the posteriors."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(weights)
        total, any_ = np.zeros((n, n + 1)), False
        combinations, of = posteriors.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, any_ = whole.slice(at, ROWS), True
                sizes, flat, dense = _opened(batch, size)
                y = of[np.searchsorted(combinations, np.asarray(batch["votes"]))]
                p = 1 / (1 + np.exp(-_logits(sizes, flat, dense, weights)))
                s = p * (1 - p) + 1e-6
                total[size:, size:n] += (dense * s[:, None]).T @ dense
                total[size:, n] += dense.T @ (y - p)
                with_words = np.flatnonzero(sizes)
                x = np.zeros((len(with_words), size))
                x[np.repeat(np.arange(len(with_words)), sizes[with_words]), flat] = 1
                weighted = x * s[with_words][:, None]
                total[:size, :size] += weighted.T @ x
                total[:size, size:n] += weighted.T @ dense[with_words]
                total[:size, n] += x.T @ (y - p)[with_words]
        if any_:
            total[size:, :size] = total[:size, size:n].T
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), lists(total.ravel(), np.full(n, n + 1))], names=["row", "sums"])

    return run


def fit_linear(features: DataFrame, size: int, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Logistic regression of all rows on the posteriors of their votes, by Newton steps; a step is one pass."""
    sc = features.sparkSession.sparkContext
    order = np.argsort(votes)
    known = sc.broadcast((votes[order], posterior[order]))
    # as many sums as the cluster runs tasks at once, however many partitions there are
    rows = features.select("votes", "found", "patterns").coalesce(2 * sc.defaultParallelism)
    weights = np.zeros(size + PATTERNS + 2)
    for _ in range(ROUNDS):
        sums = array_sums(rows.mapInArrow(_newton_sums(size, weights, known), "row int, sums array<double>"), "row", "sums").toPandas().sort_values("row")
        total = np.stack(sums["sums"])
        step = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(len(weights)), total[:, -1] - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < CLOSE:
            break
    return weights


def _scores(size: int, weights: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _logits(*_opened(batch, size), weights)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "text_key", "score"])

    return run


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def toxicity(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """(doc_id, text_key, score) for each row of docs (doc_id, text): the probability that it is toxic.

    text_key is a hash of the text, which tells rows apart that share a doc_id or have none.

    learn: (doc_id, toxic); rows with nulls or other values are ignored. They choose the mined words and the prior; the
    classifier itself learns the label model's posteriors. Without toxic and clean rows to learn from, the lists of
    insults alone vote and the prior is 0.05. A null or empty text has no votes. Rows with a null or repeated doc_id
    are scored by their own text.
    """
    docs = docs.select("doc_id", "text", _text_key().alias("text_key"))
    learn = checkpointed(learn.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = learn.agg(F.avg("toxic")).head()[0]
    lexicon = Lexicon(mined_keys(docs, learn))
    features = checkpointed(docs.mapInArrow(_features(lexicon), "doc_id long, text_key long, votes long, found array<int>, patterns array<float>"))
    seen = features.groupBy("votes").count().toPandas()
    if not len(seen):
        return features.select("doc_id", "text_key", F.lit(0.0).alias("score"))
    votes, counts = _bits(seen["votes"].to_numpy()), seen["count"].to_numpy(float)
    model = LabelModel(min(0.5, max(0.005, 0.05 if share is None else share))).fit(votes, counts)
    weights = fit_linear(features, lexicon.size, seen["votes"].to_numpy(), model.posterior(votes))
    return features.mapInArrow(_scores(lexicon.size, weights), "doc_id long, text_key long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_key, score) by the labels whose rows may be learned from."""
    learn = labels.where(remainder("doc_id", 5) != 0).select("doc_id", "toxic")
    return toxicity(docs, learn)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more, each by its own text, also where ids are null or repeat."""
    gone = scored(docs, labels).where("score >= 0.5").select(F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), "text_key", F.col("doc_id").isNull().alias("no_id")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), _text_key().alias("text_key"), F.col("doc_id").isNull().alias("no_id"))
    return own.join(gone, ["id", "text_key", "no_id"], "left_anti").select("row.*")
