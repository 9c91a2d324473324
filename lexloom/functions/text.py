"""Text, hash and character columns. Offsets count code points; texts are never normalized."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import vocabulary as V

#: All white space of Unicode and the ASCII separators U+001C to U+001F; regex engines differ on \s.
WS = "\t-\r\x1c-\x1f \x85\xa0  -     　"
PIECE = f"[^{V.ENDERS}\r\n]*(?:[{V.ENDERS}][{V.CLOSERS}]*|[\r\n]|\\z)"


def let(value: Column, body) -> Column:
    """body of value, computed once (a column inside a lambda would be computed for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: later filters and field accesses do not copy their expressions."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def comparison_text(text: Column) -> Column:
    """White space runs as one space, none at the ends; for comparing only."""
    return F.btrim(F.regexp_replace(text, f"[{WS}]+", " "))


def stable_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def dedup_key(text: Column) -> Column:
    return stable_hash(comparison_text(text))


def hash_bucket_100(key: Column) -> Column:
    """The first 32 bits of the sha256, modulo 100."""
    return (F.conv(F.substring(stable_hash(key), 1, 8), 16, 10).cast("long") % 100).cast("int")


def document_key(source: Column, document_id: Column) -> Column:
    return F.concat(source, F.lit("\0"), document_id)


def _split(bucket: Column, train: int, dev: int) -> Column:
    return F.when(bucket < train, "train").when(bucket < train + dev, "dev").otherwise("test")


def split_for_document(source: Column, document_id: Column) -> Column:
    """train, dev, test: 98, 1, 1 of 100."""
    return _split(hash_bucket_100(document_key(source, document_id)), 98, 1)


def document_split(source: Column, document_id: Column) -> Column:
    """train, dev, test: 85, 10, 5 of 100."""
    return _split(hash_bucket_100(document_key(source, document_id)), 85, 10)


def lemma_split(lemma: Column) -> Column:
    """train, dev, test: 80, 10, 10 of 100."""
    return _split(hash_bucket_100(lemma), 80, 10)


def sample_key(source: Column, document_id: Column, index: Column) -> Column:
    return stable_hash(F.concat(source, F.lit("\0"), document_id, F.lit("\0"), index.cast("string")))


def script(ch: Column) -> Column:
    """One of nine classes of a character."""
    cp = F.ascii(ch)
    # digits by value beyond the decimal ones: superscripts, subscripts, circled and similar
    other_digits = "²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
    return (
        F.when(cp.between(0x3040, 0x309F), "HIRAGANA").when(cp.between(0x30A0, 0x30FF), "KATAKANA")
        .when(cp.between(0x4E00, 0x9FFF) | cp.between(0x3400, 0x4DBF), "KANJI")
        .when(cp.between(65, 90) | cp.between(97, 122), "LATIN").when(cp == 32, "WHITESPACE").when(cp.between(48, 57), "DIGIT")
        .when(ch.rlike(f"^[\\p{{Nd}}{other_digits}]"), "DIGIT")
        .when(ch.rlike("^\\p{P}"), "PUNCT").when(ch.rlike("^\\p{S}"), "SYMBOL").when(ch.rlike(f"^[{WS}]"), "WHITESPACE").otherwise("OTHER")
    )


def _among(ch: Column, chars: str) -> Column:
    return F.instr(F.lit(chars), ch) > 0


def punct_class(ch: Column) -> Column:
    out = F.when(_among(ch, V.PUNCT_SETS["SENTENCE"]), "SENTENCE")
    for name in ("OPEN", "CLOSE", "COMMA"):
        out = out.when(_among(ch, V.PUNCT_SETS[name]), name)
    return out.otherwise("NONE")


def digit_class(ch: Column) -> Column:
    return F.when(ch.between("0", "9") & (F.octet_length(ch) == 1), "ASCII").when(F.ascii(ch).between(0xFF10, 0xFF19), "FULLWIDTH").when(script(ch) == "DIGIT", "OTHER").otherwise("NONE")


def small_kana(ch: Column) -> Column:
    return _among(ch, V.SMALL_KANA)


def prolonged_mark(ch: Column) -> Column:
    return _among(ch, V.PROLONGED)


def iteration_mark(ch: Column) -> Column:
    return _among(ch, V.ITERATION)


def chars(text: Column) -> Column:
    """The code points of a text, one string each."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 32, 32).when(n <= 64, 64).when(n <= 128, 128)


def mix64(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: two rounds of xor-shift and multiply, and a last xor-shift. uint64 in and out."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def hash_bucket(value: Column, buckets: int) -> Column:
    """mix64 of the value in [0, buckets). Spark's checked multiplication cannot wrap, so this is an Arrow function."""
    if buckets <= 0 or buckets & (buckets - 1):
        raise ValueError("bucket count must be a positive power of two")

    @F.pandas_udf("int")
    def bucket(v: pd.Series) -> pd.Series:
        return pd.Series((mix64(v.to_numpy(np.int64)) & np.uint64(buckets - 1)).astype(np.int32))

    return bucket(value)


def bigram_key(cp: Column, right: Column) -> Column:
    return F.shiftleft(cp.cast("long"), 21).bitwiseXOR(right.cast("long")).bitwiseXOR(F.lit(0x9E3779B9).cast("long"))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def display_label(atom: Column, function: Column) -> Column:
    """What a viewer shows: no _LIKE, and the particle function if there is one."""
    return F.concat_ws(" · ", F.regexp_replace(atom, "_LIKE$", ""), function)
