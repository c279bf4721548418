"""The corpus pipeline: quality classifier, near duplicates, repeated passages, source mixing, token pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, jaccard_join, quality_classifier, sentencepiece_codec, source_mixing, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows that a task and its Python worker exchange at once, at most.
ROWS_AT_ONCE = "1000"


def _small_batches(spark: SparkSession) -> None:
    """Texts are long rows, so the stages exchange fewer of them at once than Spark's 10,000; an executor holds several such batches for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > int(ROWS_AT_ONCE):
        spark.conf.set(key, ROWS_AT_ONCE)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go.

    Null texts are judged as empty ones, texts of any length whole; repeated rows get one verdict; without labels of both classes all get the same score and stay from 0.5 on; an empty
    table stays empty.
    """
    _small_batches(spark)
    model = quality_classifier.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one of the smallest id.

    Each different text of an id, and of the rows without one, is a document of its own (they come after all ids, by a digest). Of rows with one id and text the one of the least source, lang
    and n_chars stays, nulls first. Texts without words are in no group and stay; texts of any length are compared whole; an empty table stays empty.
    """
    _small_batches(spark)
    rows, _ = jaccard_join.numbered(docs.select(*COLUMNS), "row_", unnamed=True)
    gone = jaccard_join.similarity_groups(rows, id_col="row_").where("class_id <> doc_id").select(F.col("doc_id").alias("row_"))
    left = rows.join(gone, "row_", "left_anti")
    if not rows.groupBy("row_").count().where("count > 1").isEmpty():
        least = F.min(F.struct("source", "lang", "n_chars")).alias("least")
        left = left.groupBy("row_").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), least).select("doc_id", "text", "least.*")
    return left.select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that also stand in a document of a smaller id are cut out.

    A changed text is its kept words, joined by a space; one with none left goes. Texts of fewer words, empty and null ones stay as they are; rows of one id lose nothing to each other;
    an empty table stays empty.
    """
    _small_batches(spark)
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    return out.selectExpr("doc_id", "if(n_removed > 0, kept, text) AS text", "lang", "source", "if(n_removed > 0, cast(length(kept) AS long), n_chars) AS n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their Poisson draws say, in a global random order. A source without any text is left out; equal ids draw equal counts; texts pass whole; an empty table stays empty."""
    _small_batches(spark)
    return source_mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text: none for a null or empty one; repeated rows are encoded each."""
    _small_batches(spark)
    return sentencepiece_codec.encode(docs).select("doc_id", "lang", "source", "ids", "n_pieces", F.col("ids_crc32"))


STAGES = [
    ("quality_classifier", keep_good),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A trained classifier can't be expressed in SQL; tests/llm/test_pipeline.py follows the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.checkpoint(stage(spark, docs, sf_dir))
    return docs
