"""Exact and near duplicates of documents: keep the first of each, in input order."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as X
from lexloom.operators import near

MIN_CHARS, DISTANCE, BAND_BITS = 80, 3, 16
#: The tag that fingerprints are hashed with, and the characters of a gram.
PERSON, GRAM = b"jplex-v1", 3
#: Stands for a code point that a short gram lacks; grams that are counted at a time.
FILL, STEP = 0x1FFFFF, 1 << 17
_SPACE = re.compile(f"[{X.WS}]+")


def grams(text: Column, n: int = GRAM) -> Column:
    """Sliding n-grams of the comparison text; the whole of a shorter one; none of an empty one."""

    def slide(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(c) - n)), lambda i: F.array_join(F.slice(c, i + 1, n), ""))

    return X.let(X.chars(X.comparison_text(text)), lambda c: F.when(F.size(c) > 0, slide(c)).otherwise(F.array().cast("array<string>")))


def _gram(gram: int) -> bytes:
    """A gram, given as its code points, 21 bits each, the first lowest; FILL is none."""
    points = (gram >> (21 * k) & FILL for k in range(GRAM))
    return "".join(chr(p) for p in points if p != FILL).encode()


@functools.lru_cache(1 << 17)
def _digest(gram: int) -> bytes:
    return hashlib.blake2b(_gram(gram), digest_size=8, person=PERSON).digest()


@functools.lru_cache(1 << 17)
def _md5(gram: int) -> bytes:
    """The first 32 bits of a gram's md5, as the low ones of 64."""
    return bytes(4) + hashlib.md5(_gram(gram)).digest()[:4]


def _window(points: np.ndarray, at: int, to: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams that begin at places at..to of all texts' code points, and how many each of the texts (that lie there) has."""
    padded = np.full(to - at + GRAM - 1, FILL, np.int64)
    own = points[at : to + GRAM - 1]
    padded[: len(own)] = own
    gram = padded[: to - at].copy()
    for k in range(1, GRAM):
        gram |= padded[k : to - at + k] << (21 * k)
    keep = np.ones(to - at, bool)
    sizes = ends - starts
    for k in range(1, GRAM):
        # the last places of a text begin no gram, but the first place of a short text does
        last = (ends - k)[sizes > k]
        keep[last[(last >= at) & (last < to)] - at] = False
        short = starts[(sizes == k) & (starts >= at) & (starts < to)] - at
        for j in range(k, GRAM):
            gram[short] |= FILL << (21 * j)
    before = np.concatenate([[0], np.cumsum(keep)])
    return gram[keep], before[np.minimum(ends, to) - at] - before[np.maximum(starts, at) - at]


def counted(texts: list[str], digest: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of its grams' hashes that have each of 64 bits, high bits first, and of its grams. Distinct
    grams are hashed once; STEP grams are counted at a time, however long a text is.

    Bits are summed as bytes, eight to a word, over runs of 255 grams at most, then by text.
    """
    values = [_SPACE.sub(" ", t).strip(" ") for t in texts]
    sizes = np.array([len(v) for v in values], np.int64)
    points = np.frombuffer("".join(values).encode("utf-32-le"), "<u4")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for at in range(0, len(points), STEP):
        to = min(at + STEP, len(points))
        i, j = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, to)
        gram, own = _window(points, at, to, starts[i:j], ends[i:j])
        if not len(gram):
            continue
        coded = pa.array(gram).dictionary_encode()
        digests = b"".join(map(digest, coded.dictionary.to_pylist()))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).view(np.uint64)
        texts_here = np.flatnonzero(own)
        parts = -(-own[texts_here] // 255)
        before = np.cumsum(parts) - parts
        first = (np.cumsum(own) - own)[texts_here]
        runs = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(before, parts))
        summed = np.add.reduceat(bits[coded.indices.to_numpy()], runs, axis=0).view(np.uint8)
        ones[i + texts_here] += np.add.reduceat(summed, before, axis=0, dtype=np.int64)
        total[i + texts_here] += own[texts_here]
    return ones, total


def votes(texts: list[str]) -> np.ndarray:
    """The 64-bit fingerprint of each text: of each bit, whether at least half of the grams' hashes have it; 0 of an empty
    text."""
    ones, total = counted(texts, _digest)
    up = (2 * ones >= total[:, None]) & (total > 0)[:, None]
    return np.packbits(up, axis=1).view(">i8")[:, 0].astype(np.int64)


@F.pandas_udf(T.LongType())
def simhash64(text: pd.Series) -> pd.Series:
    """Fingerprints by blake2b, which Spark lacks; signed, null of null."""
    known = text.notna()
    out = pd.Series(pd.NA, index=text.index, dtype="Int64")
    out[known] = votes(text[known].tolist())
    return out


def simhash_md5(docs: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, fp): a 32-bit fingerprint of the same kind by md5, of all grams of a key's texts; none of a key without grams.

    Tasks count the votes of each row, so no gram is shuffled and no array of grams is sliced for each of them; Spark adds
    up rows of one key.
    """
    bits = [f"v{b}" for b in range(32)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                ones, total = counted(part["text"].to_pylist(), _md5)
                up = 2 * ones[:, :31:-1] - total[:, None]
                yield pa.RecordBatch.from_arrays([part[key], *map(pa.array, up.T), pa.array(total)], names=[key, *bits, "grams"])

    kind = docs.schema[key].dataType.simpleString()
    there = docs.where("text is not null").select(key, "text")
    votes = there.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{b} long" for b in [*bits, "grams"])).where("grams > 0")
    fp = sum((F.when(F.col(f"v{b}") >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(32)), F.lit(0).cast("long"))
    return votes.groupBy(key).agg(*[F.sum(b).alias(b) for b in bits]).select(key, fp.alias("fp"))


def bands(fp: Column, width: int = BAND_BITS, bits: int = 64) -> Column:
    """(band, value) structs, low bits first; fingerprints of distance 3 or less share one of four bands."""
    mask = F.lit((1 << width) - 1)
    return F.array(*[F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(fp, b * width).bitwiseAND(mask).alias("value")) for b in range(bits // width)])


def near_pairs(docs: DataFrame, distance: int = DISTANCE, width: int = BAND_BITS, bits: int = 64) -> DataFrame:
    """(a, b) with a before b: documents (seq, fp) that share a band and differ in at most `distance` bits.

    Documents of one fingerprint are one class: a class is linked through its first document, so that a group of copies
    gives as many pairs as it has members. There are more bands than bits that may differ, so all near pairs share one.
    """
    if bits // width <= distance:
        raise ValueError(f"{bits // width} bands miss pairs that differ in {distance} bits")
    first = docs.groupBy("fp").agg(F.min("seq").alias("seq"))
    return first_pairs(first, distance, bits).union(copies(docs).select(F.col("first").alias("a"), F.col("seq").alias("b")))


def copies(docs: DataFrame) -> DataFrame:
    """(seq, first) of documents (seq, fp) that are not the first of their fingerprint."""
    first = docs.groupBy("fp").agg(F.min("seq").alias("first"))
    return docs.join(first, "fp").where("seq <> first").select("seq", "first")


def _pairs_met(cols: dict[str, np.ndarray], pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in pairs:
        ends = np.sort(np.stack([cols["seq"][a], cols["seq"][b]]), axis=0)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, ends)), names=["a", "b"])


def first_pairs(first: DataFrame, distance: int, bits: int) -> DataFrame:
    """(a, b) with a before b, of documents (seq, fp) of distinct fingerprints. They meet at keys of all blocks but as many
    as may differ, which few share; a band has no more values than 2^16, however many documents there are."""
    return near.met(first.select("seq", "fp"), _pairs_met, "a long, b long", distance, bits, distance + 2)


def first_texts(docs: DataFrame) -> DataFrame:
    """(document_key, seq) of the first document (seq, text) of each text, in one scan and one aggregation."""
    return docs.groupBy(X.stable_hash(F.col("text")).alias("document_key")).agg(F.min("seq").alias("seq"))


def first_copies(docs: DataFrame) -> DataFrame:
    """docs (seq, text) with document_key and whether the row is the first of its text."""
    keyed = docs.withColumn("document_key", X.stable_hash(F.col("text")))
    # firsts are found before the shuffle as well and joined by seq, so copies of one text meet in no task
    first = keyed.groupBy("document_key").agg(F.min("seq").alias("_first")).select("_first")
    return keyed.join(first, F.col("seq") == F.col("_first"), "left").withColumn("is_first", F.col("_first").isNotNull()).drop("_first")


def prints(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(seq, document_key, fp) of the documents, in one scan: fp is null of texts under `least` code points."""
    return docs.select("seq", X.stable_hash(F.col("text")).alias("document_key"), simhash64(F.when(F.length("text") >= least, F.col("text"))).alias("fp"))


def judged(rows: DataFrame, stored=None, **cut: int) -> tuple[DataFrame, DataFrame]:
    """(seq, disposition) of rows (seq, document_key, fp): kept, exact or near; and the kept (seq, document_key, fp).

    stored: what was kept before all these rows, with `of_keys(texts)`, the document keys it has, and `near(prints)`,
    the fingerprints (fp) it has a near one of. cut: what is near, as near.met takes it.
    """
    texts = rows.groupBy("document_key").agg(F.min("seq").alias("first"), F.max("fp").alias("fp"))
    if stored is not None:
        texts = texts.join(stored.of_keys(texts.select("document_key")).withColumn("old", F.lit(True)), "document_key", "left")
    else:
        texts = texts.withColumn("old", F.lit(None).cast("boolean"))
    texts = near.checkpointed(texts)
    # whatever becomes of the first text of a fingerprint, later ones are near it or near what dropped it
    first = texts.where("old is null and fp is not null").groupBy("fp").agg(F.min("first").alias("seq"))
    if stored is not None:
        first = near.checkpointed(first)
        first = first.join(stored.near(first.select("fp")), "fp", "left_anti")
    first = near.checkpointed(first)
    keeps = first.join(near.scan_keeps(first, **cut), "seq", "left_anti").select(F.col("seq").alias("keeper"))
    told = texts.join(keeps, F.col("first") == F.col("keeper"), "left")
    text_kept = F.col("keeper").isNotNull() | F.col("fp").isNull()
    told = near.checkpointed(told.select("document_key", "first", "fp", F.when(F.col("old"), "old").when(text_kept, "kept").otherwise("near").alias("state")))
    # of texts that are kept, only the first row is; most texts have one row, so few meet by their key
    at = rows.select("seq", "document_key").join(told.select("document_key", "first", "state"), "document_key")
    exact = (F.col("state") == "old") | ((F.col("state") == "kept") & (F.col("seq") != F.col("first")))
    return at.select("seq", F.when(exact, "exact").otherwise(F.col("state")).alias("disposition")), told.where("state = 'kept'").select(F.col("first").alias("seq"), "document_key", "fp")


def dispositions(docs: DataFrame, least: int = MIN_CHARS, distance: int = DISTANCE) -> DataFrame:
    """docs (seq, source, document_id, text) with disposition: kept, exact, near or invalid, as a scan in order decides.

    Near duplicates are judged against what was kept; a copy of a text that was dropped as near is near again. Texts
    under `least` code points are neither compared nor compared with. A null text is invalid; an empty text or id is
    kept at first and counts as invalid as well, for no sentence can be taken from it.
    """
    ok = docs.where(F.col("text").isNotNull() & F.col("document_id").isNotNull())
    told, _ = judged(near.checkpointed(prints(ok, least)), distance=distance)
    return docs.join(told, "seq", "left").withColumn("disposition", F.coalesce("disposition", F.lit("invalid")))
