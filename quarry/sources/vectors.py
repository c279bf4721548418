"""A store of embedded chunks in versions, below one folder that all executors share.

    segments/<name>/   source, chunk, total, text, embedding, born: the rows that a version added, Parquet
    manifests/<n>/     source, digest, born, and the segment that holds the source's rows: one row a source, Parquet
    versions/<n>.json  what the version was made with; the file appears by a rename once all else is written

The latest file in versions/ is what readers see, so they see a version whole or not at all, and one that was begun and not finished never. A version adds only the rows of new and modified
sources; the rows of others stay in the segments of earlier versions, and its manifest says which of them count. Two writers of one version collide at the rename: the second gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source string, digest string, born int, segment string"
ROWS = "source string, chunk int, total int, text string, embedding array<float>, born int"


@dataclass(frozen=True)
class Decision:
    """What has to be done: 'none', 'incremental' or 'rebuild', and why."""

    mode: str
    why: str


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm, where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The finished versions, in order."""
        _, where, files = self._hadoop("versions")
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def settings(self, version: int | None = None) -> dict:
        """signature, dimension, chunks, mode and segments of a version, the latest by default; {} if there is none."""
        known = self.versions()
        if not known:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{known[-1] if version is None else version}.json").first()[0])

    def manifest(self, version: int | None = None) -> DataFrame:
        """(source, digest, born, segment) of a version."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{known[-1] if version is None else version}")

    def read(self, version: int | None = None) -> DataFrame:
        """(source, chunk, total, text, embedding, born) of a version: the rows of its segments that its manifest names."""
        segments = self.settings(version).get("segments", [])
        if not segments:
            return self.spark.createDataFrame([], ROWS)
        rows = self.spark.read.schema(ROWS).parquet(*(f"{self.path}/segments/{s}" for s in segments))
        return rows.join(self.manifest(version).select("source", "born"), ["source", "born"], "left_semi").select(*(c.split()[0] for c in ROWS.split(", ")))

    def where(self, **metadata: str | int) -> DataFrame:
        """Rows of the latest version whose columns have the given values; the tests are pushed to the Parquet files."""
        out = self.read()
        for column, value in metadata.items():
            out = out.where(F.col(column) == value)
        return out

    def changes(self, docs: DataFrame) -> DataFrame:
        """(source, change): new, modified, deleted or same, by digest. docs: (source, text). Only digests are shuffled."""
        after = docs.where("source IS NOT NULL").select(F.col("source").cast("string").alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("after"))
        before = self.manifest().select("source", F.col("digest").alias("before"))
        kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "same").otherwise("modified")
        return before.join(after, "source", "full_outer").select("source", kind.alias("change"))

    def decide(self, docs: DataFrame, signature: str, dimension: int, force: bool = False) -> Decision:
        """Rebuild if there is no version or an empty one, if the dimension or the signature of the embedding is another, or by force; else whatever the digests say."""
        known = self.settings()
        if not known:
            return Decision("rebuild", "no version")
        if force:
            return Decision("rebuild", "forced")
        if not known["chunks"]:
            return Decision("rebuild", "empty")
        if known["dimension"] != dimension:
            return Decision("rebuild", f"dimension {known['dimension']} to {dimension}")
        if known["signature"] != signature:
            return Decision("rebuild", f"signature {known['signature']} to {signature}")
        if self.changes(docs).where("change <> 'same'").isEmpty():
            return Decision("none", "no change")
        return Decision("incremental", "changed sources")

    def sync(self, docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], signature: str, dimension: int, force: bool = False) -> Decision:
        """Bring the store in step with docs (source, text), as decide() says.

        chunk: of (source, text) to (source, chunk, total, text); embed: adds embedding. signature names the model and its prefixes. A vector of another dimension is an error, and
        the version isn't finished; so is a source that stands twice in docs. Rows without a source are left out.
        """
        decision = self.decide(docs, signature, dimension, force)
        if decision.mode == "none":
            return decision
        known = self.versions()
        number, segment, rebuild = (known[-1] + 1 if known else 1), uuid.uuid4().hex, decision.mode == "rebuild"
        named = docs.select(F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text")).where("source IS NOT NULL")
        touched = named if rebuild else named.join(self.changes(docs).where("change IN ('new', 'modified')"), "source", "left_semi")
        rows = embed(chunk(touched)).select("source", F.col("chunk").cast("int").alias("chunk"), F.col("total").cast("int").alias("total"), "text", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(number).alias("born"))
        rows.write.parquet(f"{self.path}/segments/{segment}")
        written = self.spark.read.schema(ROWS).parquet(f"{self.path}/segments/{segment}")
        added, wrong = written.agg(F.count("*"), F.count_if(F.coalesce(F.size("embedding") != dimension, F.lit(True)))).first()
        if wrong:
            raise ValueError(f"{wrong} vectors don't have {dimension} dimensions")
        self._write_manifest(number, segment, named, touched, rebuild)
        if rebuild:
            segments, chunks = [segment], added
        else:
            segments = [*self.settings()["segments"], segment]
            old = self.read().join(self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{number}").select("source", "born"), ["source", "born"], "left_semi")
            chunks = added + old.count()
        self._finish(number, {"signature": signature, "dimension": dimension, "chunks": chunks, "mode": decision.mode, "why": decision.why, "segments": segments})
        return decision

    def _write_manifest(self, number: int, segment: str, named: DataFrame, touched: DataFrame, rebuild: bool) -> None:
        fresh = touched.select("source", F.md5("text").alias("digest"), F.lit(number).alias("born"), F.lit(segment).alias("segment"))
        if not rebuild:
            kept = self.manifest().join(self.changes(named).where("change = 'same'"), "source", "left_semi")
            fresh = kept.unionByName(fresh)
        path = f"{self.path}/manifests/{number}"
        fresh.write.mode("overwrite").parquet(path)  # what an unfinished version left there goes
        if not self.spark.read.schema(MANIFEST).parquet(path).groupBy("source").count().where("count > 1").isEmpty():
            raise ValueError("a source stands twice in the documents")

    def _finish(self, number: int, settings: dict) -> None:
        jvm, there, files = self._hadoop(f"versions/{number}.json")
        _, draft, _ = self._hadoop(f"versions/.{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(settings).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, there, options)

    def compact(self) -> None:
        """A new version with the same rows in one segment."""
        known, number, segment = self.settings(), self.versions()[-1] + 1, uuid.uuid4().hex
        self.read().withColumn("born", F.lit(number)).write.parquet(f"{self.path}/segments/{segment}")
        self.manifest().withColumns({"born": F.lit(number), "segment": F.lit(segment)}).write.mode("overwrite").parquet(f"{self.path}/manifests/{number}")
        self._finish(number, known | {"mode": "compact", "why": "asked", "segments": [segment]})

    def drop_before(self, version: int) -> None:
        """Remove the versions before one, and the segments that only they and unfinished versions have. Nobody may be writing meanwhile."""
        for old in self.versions():
            if old < version:
                _, marker, files = self._hadoop(f"versions/{old}.json")
                files.delete(marker, False)
                _, rows, files = self._hadoop(f"manifests/{old}")
                files.delete(rows, True)
        used = {s for v in self.versions() for s in self.settings(v)["segments"]}
        _, where, files = self._hadoop("segments")
        for status in files.listStatus(where):
            if status.getPath().getName() not in used:
                files.delete(status.getPath(), True)
