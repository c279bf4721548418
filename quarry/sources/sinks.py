"""Writers: manifests, upserts by source, append-only logs, crawls with their time, exports and tables of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, digest, size): what the next run compares with."""
    return docs.select(key, F.md5(content).alias("digest"), F.length(content).alias("size"))


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, target: str) -> None:
    """Write to `target` the rows of `path` without those of new's keys, plus new. Readers change over once it is whole."""
    stored = spark.read.parquet(path)
    stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new).write.parquet(target)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, n: int, ts: str = "ts") -> DataFrame:
    """The last n entries, newest first."""
    return spark.read.schema(schema).json(path).orderBy(F.desc(ts)).limit(n)


def save_crawl(pages: DataFrame, path: str, at: str) -> None:
    """Keep the pages of a crawl, as JSON lines below the time it was made at, e.g. 20240131T120000; earlier crawls stay."""
    pages.write.mode("error").json(f"{path}/at={at}")


def load_crawl(spark: SparkSession, path: str, schema: str, since: str = "") -> DataFrame:
    """The pages of the latest crawl, with its time as column at; no rows if it was made before `since`. A folder without crawls is an error."""
    rows = spark.read.schema(f"{schema}, at string").option("basePath", path).json(path)
    newest = rows.agg(F.max("at").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("at") == F.col("newest")).where(F.col("at") >= since).drop("newest")


def marker(pages: DataFrame, signature: str) -> DataFrame:
    """One row (pages, digest, signature) that says what an index was built of, whatever the order of its pages; an index with an equal one needn't be built again."""
    each = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(pages.columns)))), 1, 15), 16, 10).cast("decimal(38,0)")
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("digest")).withColumn("signature", F.lit(signature))


def save_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Extractions as JSON lines, or tables of an evaluation as CSV with a header; arrays and maps go into CSV as JSON."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
        return
    nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    rows.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)
