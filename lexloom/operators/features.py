"""Character features, targets and padded batches."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as X
from lexloom.functions import vocabulary as V
from lexloom.operators import runs

#: Arrays of a training row, one value a character.
ARRAYS = [
    "codepoints", "bigrams", "categorical", "boundary_targets", "atom_targets", "function_targets", "inflection_targets", "role_targets", "function_mask", "inflection_mask",
]
FEATURE_NAMES = [*(f"script:{s}" for s in V.SCRIPTS), "script_transition", "small_kana", "prolonged_mark", "iteration_mark", *(f"punct:{p}" for p in V.PUNCT_CLASSES), *(f"digit:{d}" for d in V.DIGIT_CLASSES)]


def characters(rows: DataFrame, *key: str) -> DataFrame:
    """(key, pos, ch, next_ch, prev_ch): one row for each code point, with its neighbours."""
    ch = X.chars(F.col("text"))
    out = rows.select(*key, ch.alias("_c")).select(*key, "_c", F.posexplode("_c").alias("pos", "ch"))
    return out.select(*key, "pos", "ch", F.get("_c", F.col("pos") + 1).alias("next_ch"), F.when(F.col("pos") > 0, F.get("_c", F.col("pos") - 1)).alias("prev_ch"))


def _classes(ch: Column) -> dict[str, Column]:
    """What the features of a character say: its classes and marks."""
    return {"script": X.script(ch), "punct": X.punct_class(ch), "digit": X.digit_class(ch), "small_kana": X.small_kana(ch), "prolonged_mark": X.prolonged_mark(ch), "iteration_mark": X.iteration_mark(ch)}


def _features(own, script_before: Column) -> dict[str, Column]:
    """The 22 features as 0 and 1; own: classes by name, script_before: null at the start."""
    out = {f"script:{x}": own["script"] == x for x in V.SCRIPTS}
    out |= {"script_transition": script_before != own["script"]} | {k: own[k] for k in ("small_kana", "prolonged_mark", "iteration_mark")}
    out |= {f"punct:{x}": own["punct"] == x for x in V.PUNCT_CLASSES} | {f"digit:{x}": own["digit"] == x for x in V.DIGIT_CLASSES}
    return {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in out.items()}


def feature_columns(ch: Column, prev: Column) -> dict[str, Column]:
    """The 22 categorical features of a character as 0 and 1."""
    return _features(_classes(ch), F.when(prev.isNotNull(), X.script(prev)))


def categorical(text: Column) -> Column:
    """Array of the features of each character, whose classes are looked up once."""
    told = F.transform(X.chars(text), lambda c: F.struct(*[v.alias(k) for k, v in _classes(c).items()]))
    return X.let(told, lambda all_: F.transform(all_, lambda own, i: F.array(*_features(own, F.when(i > 0, F.get(all_, i - 1)["script"])).values())))


def codepoint_buckets(rows: DataFrame, buckets: int = 8192) -> DataFrame:
    """(ch, bucket) of the distinct characters of rows."""
    ch = rows.select(F.explode(X.chars(F.col("text"))).alias("ch")).distinct()
    return ch.select("ch", X.hash_bucket(F.ascii("ch"), buckets).alias("bucket"))


def bigram_buckets(rows: DataFrame, buckets: int = 8192) -> DataFrame:
    """(ch, next_ch, bucket) of the distinct pairs of neighbours; the last character's neighbour is none."""
    pair = characters(rows).select("ch", "next_ch").distinct()
    key = X.bigram_key(F.ascii("ch"), F.coalesce(F.ascii("next_ch"), F.lit(0)))
    return pair.select("ch", F.coalesce("next_ch", F.lit("")).alias("next_ch"), X.hash_bucket(key, buckets).alias("bucket"))


def encode_text(rows: DataFrame, codepoints: int = 8192, bigrams: int = 8192) -> DataFrame:
    """rows with arrays codepoints, bigrams and categorical. Empty and null texts give none and are left out.

    Arrow batches are encoded as a whole.
    """

    def run(text: pa.Array) -> pa.Array:
        cp, bg, flags, sizes = encoded_texts(pc.fill_null(text, "").to_pylist(), codepoints, bigrams)
        return runs.struct(codepoints=runs.lists(sizes, runs.whole(cp)), bigrams=runs.lists(sizes, runs.whole(bg)), categorical=runs.lists(sizes, _matrix(flags)))

    return runs.with_fields(rows.where(F.length("text") > 0), run, "codepoints array<int>, bigrams array<int>, categorical array<array<int>>", "text")


def _matrix(values: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    return runs.lists(np.full(len(values), values.shape[1], np.int64), runs.whole(values.ravel()))


@functools.lru_cache(1 << 17)
def _own_features(point: int) -> bytes:
    """The 22 features of a character as bytes, that of the script before it left out, after the number of its script."""
    ch = chr(point)
    kind = unicodedata.category(ch)
    if 0x3040 <= point <= 0x309F:
        script = "HIRAGANA"
    elif 0x30A0 <= point <= 0x30FF:
        script = "KATAKANA"
    elif 0x4E00 <= point <= 0x9FFF or 0x3400 <= point <= 0x4DBF:
        script = "KANJI"
    elif ch.isascii() and ch.isalpha():
        script = "LATIN"
    else:
        script = "DIGIT" if ch.isdigit() else "PUNCT" if kind[0] == "P" else "SYMBOL" if kind[0] == "S" else "WHITESPACE" if ch.isspace() else "OTHER"
    punct = next((name for name in ("SENTENCE", "OPEN", "CLOSE", "COMMA") if ch in V.PUNCT_SETS[name]), "NONE")
    digit = "ASCII" if "0" <= ch <= "9" else "FULLWIDTH" if 0xFF10 <= point <= 0xFF19 else "OTHER" if script == "DIGIT" else "NONE"
    marks = [ch in V.SMALL_KANA, ch in V.PROLONGED, ch in V.ITERATION]
    one = lambda x, names: [x == y for y in names]
    return bytes([V.SCRIPTS.index(script), *one(script, V.SCRIPTS), 0, *marks, *one(punct, V.PUNCT_CLASSES), *one(digit, V.DIGIT_CLASSES)])


def encoded_texts(texts: list[str], codepoints: int = 8192, bigrams: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What encode_text gives of texts that are not empty, in numpy: buckets of code points and of pairs, features
    (22 a character), one character after another, and the number of characters of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.zeros(len(points) + 1, bool)
    first[np.concatenate([[0], np.cumsum(sizes)])] = True
    right = np.append(points[1:], 0)
    right[first[1:]] = 0
    bucket = lambda x, n: (X.mix64(x) & np.uint64(n - 1)).astype(np.int32)
    known, at = np.unique(points, return_inverse=True)
    own = np.frombuffer(b"".join(map(_own_features, known.tolist())), np.uint8).reshape(-1, len(FEATURE_NAMES) + 1)[at]
    flags = own[:, 1:].copy()
    flags[1:, len(V.SCRIPTS)] = (own[1:, 0] != own[:-1, 0]) & ~first[1:-1]
    return bucket(points, codepoints), bucket((points << 21) ^ right ^ 0x9E3779B9, bigrams), flags, sizes


#: What targets adds to a record.
TARGETS = (
    "boundary_targets array<array<int>>, atom_targets array<int>, function_targets array<int>, inflection_targets array<array<int>>, role_targets array<int>, "
    "function_mask array<boolean>, inflection_mask array<boolean>"
)


def _last_covering(spans: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """For each character of all texts the number of the last span over it, -1 for none; and the fields of the spans."""
    row, values = runs.elements(spans)
    own = runs.fields(values)
    there = pc.and_(own["start"].is_valid(), own["end"].is_valid()).to_numpy(zero_copy_only=False)
    start, end = (np.clip(pc.fill_null(own[c], 0).to_numpy(zero_copy_only=False).astype(np.int64), 0, sizes[row]) for c in ("start", "end"))
    wide = np.where(there, np.maximum(end - start, 0), 0)
    out = np.full(int(sizes.sum()), -1)
    # in order, so the last one written stays
    at = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat((np.cumsum(sizes) - sizes)[row] + start, wide)
    out[at] = np.repeat(np.arange(len(row)), wide)
    return out, own


def _numbers(labels: list[str], values: pa.Array, of: np.ndarray, none: str) -> np.ndarray:
    """The class of each character's span: -1 for a label that is not listed, that of `none` without a label or a span."""
    at = pc.fill_null(pc.index_in(values, pa.array(labels)), -1).to_numpy(zero_copy_only=False)
    at = np.append(np.where(values.is_null().to_numpy(zero_copy_only=False), labels.index(none), at), labels.index(none))
    return at[of]


def target_values(text: pa.Array, boundaries: pa.Array, spans: pa.Array, bunsetsu: pa.Array) -> dict[str, np.ndarray]:
    """The targets of all characters, text after text."""
    sizes = runs.sizes_of(text)
    bounds = runs.fields(boundaries)
    bound = np.stack([runs.marks(bounds[level], sizes) for level in V.LEVELS], 1)
    of, own = _last_covering(spans, sizes)
    chunk, roles = _last_covering(bunsetsu, sizes)
    row, flags = runs.elements(own["inflections"])
    at = pc.fill_null(pc.index_in(flags, pa.array(V.INFLECTIONS)), len(V.INFLECTIONS)).to_numpy(zero_copy_only=False)
    has = np.zeros((len(own["start"]) + 1, len(V.INFLECTIONS) + 1), bool)
    has[row, at] = True
    kind = own["atom_type"]
    # the last place stands for no span
    is_in = lambda kinds: np.append(pc.is_in(kind, pa.array(kinds)).to_numpy(zero_copy_only=False), False)[of]
    return {
        "boundary_targets": bound, "atom_targets": _numbers(V.ATOM_TYPES, kind, of, "OTHER"), "function_targets": _numbers(V.PARTICLE_FUNCTIONS, own["function"], of, "UNKNOWN"), "inflection_targets": has[of, :-1],
        "role_targets": _numbers(V.BUNSETSU_ROLES, roles["role"], chunk, "UNKNOWN"), "function_mask": is_in(["PARTICLE"]), "inflection_mask": is_in(V.INFLECTED),
    }


def _each(sizes: np.ndarray, values: dict[str, np.ndarray]) -> pa.Array:
    """A list for each text of the values of its characters, flags as integers but for masks."""
    one = lambda c, x: _matrix(x) if x.ndim > 1 else pa.array(x) if c.endswith("mask") else runs.whole(x)
    return runs.struct(**{c: runs.lists(sizes, one(c, x)) for c, x in values.items()})


def _targets(text: pa.Array, *record: pa.Array) -> pa.Array:
    return _each(runs.sizes_of(text), target_values(text, *record))


def targets(record: DataFrame) -> DataFrame:
    """record with class numbers and masks for each character: boundaries, atom, function, inflection, role; of the last
    span over it. Arrow batches are taken as a whole: one pass over spans and characters."""
    return runs.with_fields(record, _targets, TARGETS, "text", "boundaries", "spans", "bunsetsu")


#: What targets takes of a record besides its text.
LABELLED = ("boundaries", "spans", "bunsetsu")


def training_rows(record: DataFrame, codepoints: int = 8192, bigrams: int = 8192, make: Callable | None = None) -> DataFrame:
    """record (bucket, text and what targets takes) with ARRAYS padded to the bucket, and `mask`: what encode_text,
    targets and padded_to_bucket give, in one pass. Empty and null texts are left out. With make, which gives structs of
    texts, what targets takes is made where it is padded, and passes not through Spark."""

    def run(bucket: pa.Array, text: pa.Array, *own: pa.Array) -> pa.Array:
        text = pc.fill_null(text, "")
        if make:
            made = runs.fields(make(text))
            own = [made[c] for c in LABELLED]
        cp, bg, flags, sizes = encoded_texts(text.to_pylist(), codepoints, bigrams)
        wide = np.maximum(bucket.to_numpy(zero_copy_only=False), sizes).astype(np.int64)
        at = np.arange(sizes.sum()) + np.repeat(np.cumsum(wide) - wide - (np.cumsum(sizes) - sizes), sizes)

        def spread(x: np.ndarray) -> np.ndarray:
            out = np.zeros((int(wide.sum()), *x.shape[1:]), x.dtype)
            out[at] = x
            return out

        told = {"codepoints": cp, "bigrams": bg, "categorical": flags} | target_values(text, *own) | {"mask": np.ones(len(at), bool)}
        return _each(wide, {c: spread(x) for c, x in told.items()})

    schema = f"codepoints array<int>, bigrams array<int>, categorical array<array<int>>, {TARGETS}, mask array<boolean>"
    return runs.with_fields(record.where(F.length("text") > 0), run, schema, "bucket", "text", *(() if make else LABELLED))


def padded(rows: DataFrame, values: str, by: list[str], zero=0) -> DataFrame:
    """rows with `values` padded to the longest of each group, and the mask of what was there."""
    most = F.max(F.size(values)).over(W.partitionBy(*by))
    df = rows.withColumn("_most", most)
    gap = F.col("_most") - F.size(values)
    mask = F.transform(F.sequence(F.lit(1), F.col("_most")), lambda i: i <= F.size(values))
    return df.withColumn("mask", mask).withColumn(values, F.concat(F.col(values), F.array_repeat(F.lit(zero), gap))).drop("_most")


def _zero(of: T.DataType, like: Column) -> Column:
    """The padding of one place: zero or false, in arrays as wide as `like`."""
    if isinstance(of, T.ArrayType):
        return F.transform(like, lambda x: _zero(of.elementType, x))
    return F.lit(False) if isinstance(of, T.BooleanType) else F.lit(0).cast(of)


def padded_to_bucket(rows: DataFrame, *arrays: str) -> DataFrame:
    """rows (bucket, text) with the named arrays, one value a character, padded to the bucket, and `mask`."""
    places = F.sequence(F.lit(1), "bucket")
    wide = {c: F.concat(F.col(c), F.array_repeat(_zero(rows.schema[c].dataType.elementType, F.get(c, F.lit(0))), F.col("bucket") - F.size(c))) for c in arrays}
    return rows.withColumns(wide | {"mask": F.transform(places, lambda i: i <= F.length("text"))})


def bucketed(rows: DataFrame) -> DataFrame:
    """rows with split (85, 10, 5) and length bucket; texts beyond the last bucket go."""
    df = rows.withColumn("split", X.document_split(F.col("source"), F.col("document_id"))).withColumn("bucket", X.length_bucket(F.length("text")))
    return df.where(F.col("bucket").isNotNull())
