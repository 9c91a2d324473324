"""A stored index of kept documents, for builds that go on where an earlier one stopped.

What was kept lies in runs: bucketed, sorted Parquet tables of document keys and of the block keys of fingerprints. A new
batch is shuffled to the runs' buckets and joined with each run as it lies there; old runs are never shuffled. Runs of
one level are merged into one of the next, so there are few. A manifest names the runs; it is written last, so a batch
that fails leaves nothing behind that counts, and an index is opened again from its folder alone.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import dedup, near

#: Columns of the two kinds of runs; the first is what they are bucketed and sorted by.
KINDS = {"keys": "document_key string", "blocks": "block_key bigint, seq bigint, fp bigint"}
MANIFEST = "version int, batch int, kind string, name string, level int"


class NearIndex:
    """The documents kept so far, in a folder that driver and executors share.

    buckets: of each run, fixed when the folder is first used; fanout: runs of a level that are merged; distance: the
    bits up to which fingerprints are near; least: code points from which texts are compared.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, fanout: int = 4, distance: int = near.DISTANCE, least: int = dedup.MIN_CHARS):
        self.spark, self.folder, self.buckets, self.fanout, self.distance, self.least = spark, folder.rstrip("/"), buckets, fanout, distance, least
        self.prefix = "near_" + hashlib.sha256(self.folder.encode()).hexdigest()[:16]
        self.version, self.batches, self.runs = 0, 0, []
        try:
            all_ = spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
            last = all_.agg(F.max("version")).head()[0]
        except AnalysisException:  # a new folder
            last = None
        if last is not None:
            rows = all_.where(F.col("version") == last).collect()
            self.version, self.batches = last, rows[0]["batch"]
            self.runs = [(r["kind"], r["name"], r["level"]) for r in rows if r["name"]]
            settings = spark.read.json(f"{self.folder}/settings").head()
            if (settings["distance"], settings["least"]) != (distance, least):
                raise ValueError(f"the index was made with distance {settings['distance']} and least {settings['least']}")
            self.buckets = settings["buckets"]

    def _table(self, kind: str, name: str) -> DataFrame:
        """A run as a bucketed table; this session may not know it yet."""
        known = f"{self.prefix}_{name}"
        if not self.spark.catalog.tableExists(known):
            by = KINDS[kind].split()[0]
            self.spark.sql(f"CREATE TABLE {known} ({KINDS[kind]}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(known)

    def of_kind(self, kind: str) -> list[DataFrame]:
        return [self._table(k, name) for k, name, _ in self.runs if k == kind]

    def _write(self, kind: str, rows: DataFrame) -> str:
        name, by = f"{kind}_{uuid.uuid4().hex}", KINDS[kind].split()[0]
        own = rows.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).option("path", f"{self.folder}/{name}")
        own.saveAsTable(f"{self.prefix}_{name}")
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def of_keys(self, texts: DataFrame) -> DataFrame:
        """(document_key): those of the texts that were kept before."""
        texts = texts.repartition(self.buckets, "document_key")
        return _union([texts.join(run, "document_key", "left_semi") for run in self.of_kind("keys")], texts)

    def near(self, prints: DataFrame) -> DataFrame:
        """(fp): the fingerprints that one kept before is near to."""
        keyed = prints.select("fp", F.explode(near.block_keys(F.col("fp"), self.distance)).alias("block_key")).repartition(self.buckets, "block_key")
        found = []
        for run in self.of_kind("blocks"):
            old = run.select(F.col("block_key").alias("old_key"), F.col("fp").alias("old_fp"))
            close = (F.col("block_key") == F.col("old_key")) & (X.hamming_distance(F.col("fp"), F.col("old_fp")) <= self.distance)
            found.append(keyed.join(old, close, "left_semi").select("fp"))
        return _union(found, prints).distinct()

    def add(self, docs: DataFrame) -> DataFrame:
        """docs (seq, source, document_id, text) with disposition, as dedup.dispositions gives it after all batches before.

        seq: greater than those of all earlier batches. The batch is committed when this returns.
        """
        ok = docs.where(F.col("text").isNotNull() & F.col("document_id").isNotNull())
        told, kept = dedup.judged(near.checkpointed(dedup.prints(ok, self.least)), self, distance=self.distance)
        told = near.checkpointed(told)
        blocks = kept.where("fp is not null").select(F.explode(near.block_keys(F.col("fp"), self.distance)).alias("block_key"), "seq", "fp")
        runs, gone = [*self.runs, ("keys", self._write("keys", kept.select("document_key")), 0), ("blocks", self._write("blocks", blocks), 0)], []
        for kind in KINDS:
            level = 0
            while len(full := [r for r in runs if r[0] == kind and r[2] == level]) >= self.fanout:
                merged = self._write(kind, _union([self._table(kind, name) for _, name, _ in full], None))
                runs, gone, level = [*[r for r in runs if r not in full], (kind, merged, level + 1)], [*gone, *[r[1] for r in full]], level + 1
        self._commit(runs)
        for name in gone:
            self._drop(name)
        return docs.join(told, "seq", "left").withColumn("disposition", F.coalesce("disposition", F.lit("invalid")))

    def _commit(self, runs: list[tuple[str, str, int]]) -> None:
        if not self.version:
            self.spark.createDataFrame([(self.buckets, self.distance, self.least)], "buckets int, distance int, least int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/settings")
        self.version, self.batches, self.runs = self.version + 1, self.batches + 1, runs
        rows = [(self.version, self.batches, *r) for r in runs]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")


def _union(frames: list[DataFrame], none: DataFrame | None) -> DataFrame:
    """All rows of the frames; without any, no row of `none`."""
    if not frames:
        return none.limit(0)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
