"""Line dedup: levelled sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. What earlier batches have seen lies in runs: bucketed, sorted
tables of 128-bit line hashes. Each batch is joined with the runs (their buckets are read in place, without a shuffle),
loses what they hold and adds a run of its own; `fanout` runs of one level are compacted into one of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import UPPER, checkpointed, table, unused

#: Keys with fewer code points are never dropped. Lines with more copies than HOT_LINES in a batch meet their documents
#: by a broadcast, if such keys are BROADCAST_KEYS (32 bytes each) at most.
MIN_CHARS, HOT_LINES, BROADCAST_KEYS = 10, 1 << 20, 1 << 20
#: Stands for a null doc_id, after all others; a real id of this value counts as null.
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, UPPER.lower())


class LineRuns:
    """The runs: tables bucketed and sorted by hash, by level."""

    def __init__(self, spark, buckets: int, fanout: int):
        sc = spark.sparkContext
        if not sc.master.startswith("local") and not sc.getConf().contains("spark.sql.warehouse.dir"):
            raise ValueError("spark.sql.warehouse.dir must name a folder that driver and executors share")
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = [[]]

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        keys.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def add(self, keys: DataFrame) -> None:
        """Write keys that no run holds as a run of level 0, then compact what is full."""
        self.levels[0].append(self._write(keys))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                old, self.levels[k] = self.levels[k], []
                merged = self.spark.table(old[0])
                for t in old[1:]:
                    merged = merged.unionByName(self.spark.table(t))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(merged))
                for t in old:
                    self.spark.sql(f"DROP TABLE {t} PURGE")

    def close(self) -> None:
        for t in [t for level in self.levels for t in level]:
            self.spark.sql(f"DROP TABLE {t} PURGE")


def dropped_lines(docs: DataFrame, batches: int = 4, buckets: int | None = None, fanout: int = 2, min_chars: int = MIN_CHARS, hot_lines: int = HOT_LINES) -> DataFrame:
    """(doc_id, text_hash, lines, positions): of each text that loses lines its hash and number of lines, and their places,
    ascending.

    A line goes if its key has at least min_chars code points and a smaller doc_id holds the key too. Rows that repeat a
    doc_id are one document: a line that only they hold stays in each of them; what goes is decided for each row's own
    text. Rows with a null doc_id are one document as well, after all others. batches, buckets and fanout change how the
    work is cut, never the result; there are as many buckets as shuffle partitions unless given. Null and empty texts are
    one empty line, which is never dropped.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), text_hash().alias("text_hash"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("line"))
    ids = ids.withColumn("lines", F.size("line"))
    edges = ids.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).head()[0] or []
    batch = sum((F.col("doc_id") > e).cast("int") for e in edges) if edges else F.lit(0)
    key = line_key(F.col("line"))
    lines = checkpointed(
        ids.select("doc_id", "text_hash", "lines", F.posexplode("line").alias("pos", "line"))
        .select("doc_id", "text_hash", "lines", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(batch.alias("batch"), "doc_id", "text_hash", "lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    runs, gone = LineRuns(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout), []
    try:
        for b in range(batches):
            own = lines.where(F.col("batch") == b)
            keys = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("copies"))
            for k, run in enumerate(runs.tables()):
                keys = keys.join(run.withColumn(f"in{k}", F.lit(1)), ["h1", "h2"], "left")
            seen = F.coalesce(*[f"in{k}" for k in range(len(runs.tables()))], F.lit(0)) if runs.tables() else F.lit(0)
            keys = checkpointed(keys.select("h1", "h2", "first", "last", "copies", seen.alias("seen")))
            runs.add(keys.where("seen = 0").select("h1", "h2"))
            again = keys.where("seen = 1 or last > first").select("h1", "h2", F.when(F.col("seen") == 0, F.col("first")).alias("keeper"), "copies")
            hot = again.where(F.col("copies") > hot_lines)
            met = own.join(again, ["h1", "h2"])
            if 0 < hot.count() <= BROADCAST_KEYS:
                met = own.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(again.where(F.col("copies") <= hot_lines), ["h1", "h2"]).unionByName(own.join(F.broadcast(hot), ["h1", "h2"]))
            gone.append(checkpointed(met.where("keeper is null or doc_id > keeper").select("doc_id", "text_hash", "lines", "pos")))
    finally:
        runs.close()
    union = gone[0]
    for g in gone[1:]:
        union = union.unionByName(g)
    # rows alike in id and text lose the same lines
    return union.groupBy("doc_id", "text_hash", "lines").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def text_hash() -> Column:
    """With doc_id and the number of lines, what tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added (columns of these names are replaced); all other columns, whatever
    their names, and rows with a null or repeated id, stay."""
    own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    id_, hash_, size, line, gone, at = unused(docs.columns, "id", "hash", "size", "line", "gone", "at")
    lost = dropped_lines(docs, **params).toDF(id_, hash_, size, at)
    same = (F.coalesce("doc_id", F.lit(LAST)) == F.col(id_)) & (text_hash() == F.col(hash_)) & (F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)) == F.col(size))
    joined = docs.join(lost, same, "left")
    joined = joined.select(*[f"`{c}`" for c in own], F.split(F.coalesce("text", F.lit("")), "\n", -1).alias(line), F.coalesce(at, F.array().cast("array<int>")).alias(gone))
    kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), gone)
    return joined.select(
        *[f"`{c}`" for c in own],
        F.array_join(F.transform(kept, lambda i: F.col(line)[i]), "\n").alias("kept_text"),
        F.size(line).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
