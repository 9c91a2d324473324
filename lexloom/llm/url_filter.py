"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A list entry is a canonical prefix, host + path ("example.org/es/"): it covers its host, all subdomains, and paths that
start with its path. Each distinct (host, path) is expanded into its host suffixes joined with path prefixes of the
listed lengths; the Bloom filter passes what may be listed, the hash join with the list removes false positives, and the
longest entry wins. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import UPPER, table, unused

#: 512 bits, eight longs, make a block; a key sets PROBES bits of one block.
BLOCK_BITS, PROBES, BITS_PER_KEY = 512, 6, 16
#: Up to these many entries the list, and its filter (2 bytes an entry, some 4 as rows), are broadcast; beyond, that join
#: shuffles. So with a long list only what the filter passes is shuffled.
BROADCAST_ENTRIES, FILTER_ENTRIES = 100_000, 20_000_000
#: Parts into which the pages of one (host, path) are dealt.
SALTS = 32

#: The rules of op1: entry and verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bloom_blocks(n: int) -> int:
    return max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """The PROBES bits of a key within its block."""
    h = F.xxhash64(F.lit("bits"), key)
    return F.array(*[F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)])


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, words): one row for each block of the filter that has bits; words: its eight longs."""
    bits = listed.select(_block(F.col("entry"), blocks).alias("block"), F.explode(_bits(F.col("entry"))).alias("bit"))
    one = F.expr("shiftleft(1L, bit % 64)")
    word = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, one).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(BLOCK_BITS // 64)]
    return bits.groupBy("block").agg(*word).select("block", F.array(*[f"w{w}" for w in range(BLOCK_BITS // 64)]).alias("words"))


def _may_hold(words: str, key: str) -> Column:
    return F.forall(_bits(F.col(key)), lambda b: F.getbit(F.element_at(F.col(words), F.floor(b / 64).cast("int") + 1), b % 64) == 1)


def url_verdicts(pages: DataFrame, rules: DataFrame, unlisted: str = "allow", broadcast_entries: int = BROADCAST_ENTRIES, filter_entries: int = FILTER_ENTRIES) -> DataFrame:
    """pages (with url) plus host, path, rule (null if no entry covers the page) and verdict (unlisted if none).

    rules: entry, verdict; entries are host + path with a path, null entries are ignored, of repeated ones the smallest
    verdict stays. Among entries that cover a url the longest wins, of equals the one with the longer host. Null urls
    and urls without :// have an empty host and path and no rule. Rows stay as they are, repeated ones too. Pages of one
    (host, path) are dealt to SALTS parts by their numbers, pages without host or path meet no join.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*[f"`{c}`" for c in own], url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    listed = rules.where("entry is not null and instr(entry, '/') > 1").groupBy("entry").agg(F.min("verdict").alias("entry_verdict"))
    listed = listed.withColumn("path_chars", F.length("entry") - F.instr("entry", "/") + 1)
    about = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path_chars")).alias("sizes")).head()
    if not about.n:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(unlisted).alias("verdict"))
    small = lambda df, most: F.broadcast(df) if about.n <= most else df
    blocks = bloom_blocks(about.n)
    labels = F.split("host", r"\.", -1)
    # null where there is nothing to look up, so that such a page meets no join
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    prefixes = F.array(*[F.when(F.length("path") >= s, F.substring("path", 1, s)) for s in about.sizes])
    numbers = [F.col(f"`{f.name}`") for f in pages.schema.fields if isinstance(f.dataType, T.NumericType)]
    (salt,) = unused(pages.columns, "salt")
    pages = pages.withColumn(salt, F.pmod(F.xxhash64(*numbers), F.lit(SALTS)) if numbers else F.lit(0).cast("long"))
    listable = (F.col("host") != "") & (F.col("path") != "")
    asked = (
        pages.where(listable).select("host", "path", salt).distinct()
        .withColumn("labels", labels)
        .select("host", "path", salt, F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", salt, "suffix", F.explode(F.array_compact("prefixes")).alias("prefix"))
        .select("host", "path", salt, F.length("suffix").alias("host_chars"), F.concat("suffix", "prefix").alias("entry"))
        .withColumn("block", _block(F.col("entry"), blocks))
    )
    possible = asked.join(small(bloom_filter(listed, blocks), filter_entries), "block").where(_may_hold("words", "entry")).select("host", "path", salt, "host_chars", "entry")
    best = (
        possible.join(small(listed.select("entry", "entry_verdict"), broadcast_entries), "entry")
        .groupBy("host", "path", salt)
        .agg(F.max(F.struct(F.length("entry"), "host_chars", "entry", "entry_verdict")).alias("best"))
        .select("host", "path", salt, F.col("best.entry").alias("rule"), F.col("best.entry_verdict").alias("verdict"))
    )
    judged = pages.where(listable).join(best, ["host", "path", salt], "left").unionByName(pages.where(~listable), allowMissingColumns=True)
    return judged.select(*[f"`{c}`" for c in own], "host", "path", "rule", F.coalesce("verdict", F.lit(unlisted)).alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "entry string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(entry, v) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
s AS (SELECT entry, v, split_part(entry, '/', 1) AS rh, substr(entry, instr(entry, '/')) AS rp FROM r)
SELECT page_id, host, path, max_by(entry, length(entry)) AS rule, coalesce(max_by(v, length(entry)), 'allow') AS verdict
FROM q LEFT JOIN s ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path
"""
