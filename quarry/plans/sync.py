"""Whole jobs put together from the operators: keeping an index in step with a corpus, and answering a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import retrieval, routing


def sync(old: DataFrame, new: DataFrame, stored: DataFrame) -> DataFrame:
    """The chunks of a corpus after its change from old to new, where only changed documents are chunked again."""
    changes = retrieval.corpus_diff(old, new)
    changed = changes.where("change in ('new', 'modified')").select("doc_id")
    return retrieval.apply_diff(stored, retrieval.chunks(new.join(changed, "doc_id", "left_semi")), changes)


def answer(questions: DataFrame, docs: DataFrame, rules: list, scorer: Column | None = None, k: int = 5) -> DataFrame:
    """(query, intent, rank, doc, score): questions routed by rules and answered with the best documents: lexical ranks, fused with
    those of title words, reranked by a pluggable scorer."""
    lexical = retrieval.bm25(docs, questions, 2 * k)
    fused = retrieval.rerank(retrieval.fuse(lexical, n=2 * k), scorer, k)
    return fused.join(questions.select("query", routing.first_match("text", rules, "other").alias("intent")), "query").select("query", "intent", "rank", "doc", "score")


def batch_embed(docs: DataFrame, embed, batch: int = 64, text_col: str = "text") -> DataFrame:
    """Rows with an embedding column from a pluggable function of a list of texts, called with `batch` texts at a time."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames):
        for frame in frames:
            values = []
            for at in range(0, len(frame), batch):
                values += embed(frame[text_col].iloc[at : at + batch].fillna("").tolist())
            yield frame.assign(embedding=[[float(x) for x in v] for v in values])

    return docs.mapInPandas(run, schema)


def vectors_by_hash(c: Column | str, dims: int = 64) -> Column:
    """A stand-in for an embedding model: tokens hashed into `dims` counts."""
    from quarry.functions import text

    places = F.transform(text.tokens(c), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))
