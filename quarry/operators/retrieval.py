"""Lexical and vector retrieval, fusion and diversification."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import checkpoint
from quarry.operators.similarity import cosine

#: The usual parameters of BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Vectors, documents and queries of a block, and sums of documents and queries that are held at once.
VECTORS, DOCS, QUERIES, CELLS = 8192, 8192, 1024, 1 << 20


#: Most query terms, and queries of a vector search, that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_TERMS, MAX_BROADCAST_QUERIES = 50_000, 2_000


def few(rows: DataFrame, most: int) -> DataFrame:
    """The rows, marked for a broadcast if there are at most `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, doc, score): the k best documents of each query by BM25 (Okapi), ties to the smaller id.

    docs: (doc_id, text), an id a row; queries: (query, text). Negative inverse document frequencies become EPSILON times the mean one. A repeated query
    term counts as often as it is repeated. Texts are cut into tokens twice: for the documents that hold each term, the number of documents and their mean
    length, all counted in one pass with one shuffle of counts by term; and for the postings of query terms, the only ones that are shuffled.
    """
    cut = docs.select(F.col("doc_id").alias("doc"), text.tokens("text").alias("t"))
    # the null term counts the documents and their lengths
    counted = cut.select(F.explode(F.array_append(F.array_distinct("t"), F.lit(None).cast("string"))).alias("term"), F.size("t").alias("dl"))
    df = checkpoint(counted.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length")))
    size = df.where("term is null").select(F.col("df").alias("docs"), (F.col("length") / F.col("df")).alias("mean"))
    raw = df.where("term is not null").crossJoin(F.broadcast(size)).select("term", (F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean_idf = raw.agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select("query", F.explode(text.tokens("text")).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    idf = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    weight = checkpoint(asked.join(raw, "term").crossJoin(F.broadcast(mean_idf)).select("query", "term", (F.col("qf") * idf).alias("weight")))
    terms = few(weight.select("term").distinct(), MAX_BROADCAST_TERMS)
    held = cut.select("doc", F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms, "term").groupBy("doc", "dl", "term").agg(F.count("*").alias("f"))
    share = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return best_sums(held.crossJoin(F.broadcast(size)).select("doc", "term", share.alias("share")), weight, docs, k)


def best_sums(postings: DataFrame, asked: DataFrame, docs: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(query, rank, doc, score): the k documents of each query with the highest sums of weight * share over the terms they have in common, at least `least`; ties to the smaller id.

    postings: (doc, term, share); asked: (query, term, weight); docs: what the postings are of, only counted. A block of documents meets a block of queries in one task and only k rows of a block and query
    leave it, so the pairs of documents and queries, nearly all of which share a word, are never rows.
    """
    # a query's terms stay together, as do a document's
    blocks = [max(1, -(-docs.count() // DOCS)), max(1, -(-asked.select("query").distinct().count() // QUERIES))]
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    kinds = {c: dict(rows.dtypes)[c] for c, rows in (("doc", postings), ("query", asked))}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = postings.where("doc is not null").select(own("doc", blocks[0]).alias("b"), each(blocks[1]).alias("q"), none("query"), "doc", "term", F.col("share").cast("double").alias("x"), F.lit(False).alias("asks")).unionAll(
        asked.select(each(blocks[0]).alias("b"), own("query", blocks[1]).alias("q"), "query", none("doc"), "term", F.col("weight").cast("double"), F.lit(True))
    )

    def run(group: pa.Table) -> pa.Table:
        mask = group.column("asks").combine_chunks()
        q, d = group.filter(mask), group.filter(pc.invert(mask))
        out = [group.schema.field(c) for c in ("query", "doc")]
        schema = pa.schema([*out, pa.field("score", pa.float64())])
        if not q.num_rows or not d.num_rows:
            return schema.empty_table()
        names = q.column("term").combine_chunks().dictionary_encode()
        at = pc.index_in(d.column("term"), names.dictionary)
        d, at = d.filter(at.is_valid()), at.drop_null().to_numpy()
        queries = q.column("query").combine_chunks().dictionary_encode("encode")
        ids = d.column("doc").combine_chunks().unique()
        ids = ids.take(pc.sort_indices(ids))
        # the queries of each term, one after another
        term, asks, weight = names.indices.to_numpy(), queries.indices.to_numpy(), q.column("x").to_numpy()
        order = np.argsort(term, kind="stable")
        asks, weight = asks[order], weight[order]
        start = np.searchsorted(term[order], np.arange(len(names.dictionary) + 1))
        doc, share = pc.index_in(d.column("doc"), ids).to_numpy(), d.column("x").to_numpy()
        order = np.lexsort([at, doc])
        doc, at, share = doc[order], at[order], share[order]
        n, found = len(queries.dictionary), []
        step = max(1, CELLS // n)
        for low in range(0, len(ids), step):
            i, j = np.searchsorted(doc, [low, low + step])
            m, t = min(step, len(ids) - low), at[i:j]
            many = start[t + 1] - start[t]
            entry = np.repeat(start[t] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            cell = asks[entry] * m + np.repeat(doc[i:j] - low, many)
            score = np.round(np.bincount(cell, weight[entry] * np.repeat(share[i:j], many), n * m), 6).reshape(n, m) + 0.0
            score[np.bincount(cell, minlength=n * m).reshape(n, m) == 0] = -np.inf
            if least is not None:
                score[score < least] = -np.inf
            last = np.partition(score, -k, axis=1)[:, -k, None] if k < m else -np.inf
            a, b = np.nonzero((score >= last) & (score > -np.inf))
            order = np.lexsort([b, -score[a, b], a])
            a, b = a[order], b[order]
            top = np.arange(len(a)) - np.searchsorted(a, a) < k
            found.append((a[top], b[top] + low, score[a, b][top]))
        a, b, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table([queries.dictionary.take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], schema=schema)

    return best(rows.groupBy("b", "q").applyInArrow(run, f"query {kinds['query']}, doc {kinds['doc']}, score double"), "query", "doc", k)


def best(scored: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """(group, rank, item, score): the k best items of each group, ties to the smaller item."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(group, "rank", item, "score")


def weighted_overlap(sections: DataFrame, queries: DataFrame, fields: dict[str, tuple[Column, float]], k: int = 20, floor: float = 2.0) -> DataFrame:
    """(query, rank, id, score): weighted numbers of query tokens that fields of a section hold, at least `floor`.

    sections: with id; fields: name -> (array of distinct tokens, weight); queries: (query, tokens).
    """
    asked = checkpoint(queries.select("query", F.explode("tokens").alias("token")).distinct())
    tokens = few(asked.select("token").distinct(), MAX_BROADCAST_TERMS)
    # of each field's tokens only those that queries hold get a weight and are shuffled
    held = [sections.select("id", F.explode(F.array_distinct(c)).alias("token")).join(tokens, "token").withColumn("w", F.lit(float(weight))) for c, weight in fields.values()]
    postings = functools.reduce(DataFrame.unionAll, held).groupBy("id", "token").agg(F.sum("w").alias("w")).toDF("doc", "term", "share")
    return best_sums(postings, asked.select("query", F.col("token").alias("term"), F.lit(1.0).alias("weight")), sections, k, floor).withColumnRenamed("doc", "id")


def expanded(tokens: Column, acronyms: dict[str, list[str]]) -> Column:
    """Distinct tokens, with the words that the acronyms among them stand for."""
    if not acronyms:
        return F.array_distinct(tokens)
    table = F.create_map(*(x for a, words in acronyms.items() for x in (F.lit(a), F.array(*map(F.lit, words)))))
    more = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(tokens, more))


#: What a question's token counts in a section's title, in the path of its page, and in the first characters of its text, and the least that a section must have.
TITLE, PATH, BODY, HEAD, KEYWORD = 2.0, 1.5, 1.0, 1000, 2.0


def site_sections(sections: DataFrame, questions: DataFrame, acronyms: dict[str, list[str]], stop_words: tuple[str, ...] = (), k: int = 2) -> DataFrame:
    """(query, rank, id, score): the k sections of a site that share the most with each question, by title, path and text. sections: (id, url, title, text); questions: (query, text)."""
    cut = lambda c: text.token_set(c, stop_words=stop_words, acronyms=tuple(acronyms))
    asked = questions.select("query", expanded(cut(F.coalesce("text", F.lit(""))), acronyms).alias("tokens"))
    fields = {
        "title": (cut(F.coalesce("title", F.lit(""))), TITLE), "path": (cut(F.coalesce(text.path_words("url"), F.lit(""))), PATH),
        "text": (cut(F.substring(F.coalesce("text", F.lit("")), 1, HEAD)), BODY),
    }
    return weighted_overlap(sections, asked, fields, k, KEYWORD)


def fuse(*ranked: DataFrame, k: int = 60, n: int = 10) -> DataFrame:
    """(query, rank, doc, score): reciprocal rank fusion of (query, doc, rank) lists."""
    rows = None
    for r in ranked:
        part = r.select("query", "doc", (1.0 / (k + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionAll(part)
    return best(rows.groupBy("query", "doc").agg(F.round(F.sum("s"), 9).alias("score")), "query", "doc", n)


def rank_scores(ranked: DataFrame) -> DataFrame:
    """Adds position_score = (n - rank + 1) / n within each query."""
    n = F.count("*").over(Window.partitionBy("query"))
    return ranked.withColumn("position_score", F.round((n - F.col("rank") + 1) / n, 6))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, doc, score): the k vectors of the highest cosine (0 where either has no length), but for the query's own id; ties to the smaller id.

    vectors: (id, v), an id a row; queries: (query, v), a stated set. Both are packed into blocks; a block of vectors meets a block of queries in one task, as a product of
    matrices, and only k rows of a block and query leave it.
    """
    pack = lambda df, key: checkpoint(df.where(f"{key} is not null and v is not null").select(F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    data, asked = pack(vectors, "id"), pack(queries, "query")
    blocks = [max(1, -(-rows.count() // most)) for rows, most in ((data, VECTORS), (asked, QUERIES))]
    own = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = data.select(own(blocks[0]).alias("b"), each(blocks[1]).alias("q"), F.lit(False).alias("asks"), "id", "v").unionAll(
        asked.select(each(blocks[0]).alias("b"), own(blocks[1]).alias("q"), F.lit(True).alias("asks"), "id", "v")
    )

    def unit(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        group = group.sort_by("id")
        v = np.nan_to_num(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(group.num_rows, -1)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return group.column("id").to_numpy(), v / np.where(size > 0, size, 1)

    def run(group: pa.Table) -> pa.Table:
        mask = group.column("asks").combine_chunks()
        out = []
        if group.filter(mask).num_rows and group.filter(pc.invert(mask)).num_rows:
            (q_ids, q), (ids, v) = unit(group.filter(mask)), unit(group.filter(pc.invert(mask)))
            for at in range(0, len(q_ids), 64):
                score = np.round(q[at : at + 64] @ v.T, 6) + 0.0
                score[q_ids[at : at + 64, None] == ids] = -np.inf
                last = np.partition(score, -k, axis=1)[:, -k, None] if k < score.shape[1] else -np.inf
                i, j = np.nonzero((score >= last) & (score > -np.inf))
                order = np.lexsort([j, -score[i, j], i])
                i, j = i[order], j[order]
                best_ = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((q_ids[at : at + 64][i[best_]], ids[j[best_]], score[i, j][best_]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "doc", "score"])

    return best(rows.groupBy("b", "q").applyInArrow(run, "query long, doc long, score double"), "query", "doc", k)


def mmr(candidates: DataFrame, n: int = 10, weight: float = 0.7) -> DataFrame:
    """(query, position, doc): maximal marginal relevance over the candidates (query, doc, score, v) of each query.

    Greedy and so sequential per query; a query's candidates are few (the fetched k), so they are one small group.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "doc"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(group["v"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        alike, chosen, left = v @ v.T, [], list(range(len(group)))
        while left and len(chosen) < n:
            value = [weight * group["score"][i] - (1 - weight) * (alike[i, chosen].max() if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(np.round(value, 9)))))
        return pd.DataFrame({"query": group["query"].iloc[chosen], "position": range(1, len(chosen) + 1), "doc": group["doc"].iloc[chosen]})

    return candidates.groupBy("query").applyInPandas(pick, "query long, position int, doc long")


def centroids(vectors: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """(label, centroid): mean vectors, components rounded to 9 places."""
    means = vectors.select(label, F.posexplode(v).alias("i", "x")).groupBy(label, "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def route(vectors: DataFrame, centers: DataFrame, threshold: float | None = None) -> DataFrame:
    """(id, route, score): the label of the nearest centroid, or null below the threshold, if there is one. Labels are few: centers is broadcast only up to 1,000."""
    small = centers.limit(1001).count() <= 1000
    scored = vectors.select("id", "v").crossJoin(F.broadcast(centers) if small else centers).select("id", "label", F.round(cosine(F.col("v"), F.col("centroid")), 6).alias("score"))
    top = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("label")).alias("label"))).alias("m"))
    label = -F.col("m.label")
    return top.select("id", (label if threshold is None else F.when(F.col("m.score") >= threshold, label)).alias("route"), F.col("m.score").alias("score"))


def adaptive_threshold(scored: DataFrame, ceiling: float = 0.55, margin: float = 0.15) -> DataFrame:
    """Rows of (query, doc, score) at or over the smaller of `ceiling` and the query's median plus `margin`."""
    limit = F.least(F.lit(ceiling), F.median("score") + margin)
    limits = scored.groupBy("query").agg(F.round(limit, 6).alias("limit"))
    return scored.join(limits, "query").where("score >= limit").select("query", "doc", "score", "limit")


def relative_cutoff(scored: DataFrame, most: int) -> DataFrame:
    """Rows at or over max(2, (best + 1) div 2) of their query, at most `most` of them."""
    top = F.max("score").over(Window.partitionBy("query"))
    kept = scored.withColumn("cut", F.greatest(F.lit(2), F.floor((top + 1) / 2))).where("score >= cut").drop("cut")
    return best(kept, "query", "doc", most)


def rerank(candidates: DataFrame, scorer: Column | None, k: int) -> DataFrame:
    """The k best of each query by a pluggable scorer column (a cross-encoder, say); without one the given order stays."""
    return best(candidates.drop("rank").withColumn("score", F.col("score") if scorer is None else scorer), "query", "doc", k)


def chunks(docs: DataFrame, size: int = 1500, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, total, text): texts of up to `size` characters whole, longer ones in windows of `size` that overlap."""
    step = size - overlap
    n = F.when(F.length(text_col) <= size, 1).otherwise(F.ceil((F.length(text_col) - overlap) / step)).cast("int")
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("whole"), n.alias("total"))
    return counted.select("doc_id", "whole", "total", F.explode(F.sequence(F.lit(1), "total")).alias("chunk")).selectExpr(
        "doc_id", "chunk", "total", f"substring(whole, (chunk - 1) * {step} + 1, {size}) AS text"
    )


def split_text(docs: DataFrame, size: int = 1500, overlap: int = 150, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> DataFrame:
    """(doc_id, chunk, total, text): chunks that end at the best separator: paragraphs, else lines, sentences, words.

    docs: (doc_id, text). Each chunk after the first repeats up to `overlap` characters of the one before it.
    """

    def cut(whole: str) -> list[str]:
        found, at = [], 0
        while len(whole) - at > size:
            window = whole[at : at + size]
            end = next((p + len(s) for s in separators if (p := window.rfind(s)) > overlap), size)
            found.append(window[:end])
            at += end - overlap if end > overlap else end
        found.append(whole[at:])
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, len(parts), p) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for parts in [cut(t or "")] for i, p in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "total", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, total int, text string")


def corpus_diff(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, change): new, modified, deleted or same, by digest of the text. Only digests are shuffled."""
    a = old.select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("before"))
    b = new.select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("after"))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "same").otherwise("modified")
    return a.join(b, "doc_id", "full_outer").select("doc_id", change.alias("change"))


def apply_diff(stored: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored rows after the changes: those of modified and deleted documents go, those of new and modified ones come."""
    stale = changes.where("change in ('modified', 'deleted')").select("doc_id")
    fresh = changes.where("change in ('modified', 'new')").select("doc_id")
    return stored.join(stale, "doc_id", "left_anti").unionByName(new.join(fresh, "doc_id", "left_semi"))


def keyword_score(docs: DataFrame, queries: DataFrame, weights: list[tuple[str, str, float]], k: int = 10) -> DataFrame:
    """(query, rank, doc, score): additive scores: a weight for each (query word, document word) rule both sides meet, plus 20 for each query
    token of over six letters in the document.

    docs: (doc, text); queries: (query, text). Rules are a fixed small table; postings of asked words only are joined.
    """
    asked = queries.select("query", F.explode(F.array_distinct(text.tokens("text"))).alias("asked"))
    rules = docs.sparkSession.createDataFrame(weights, "asked string, word string, weight double")
    wanted = asked.join(F.broadcast(rules), "asked").select("query", "word", "weight").unionAll(asked.where("length(asked) > 6").select("query", F.col("asked").alias("word"), F.lit(20.0).alias("weight")))
    weight = checkpoint(wanted.groupBy("query", "word").agg(F.sum("weight").alias("weight")).select("query", F.col("word").alias("term"), "weight"))
    terms = few(weight.select("term").distinct(), MAX_BROADCAST_TERMS)
    held = docs.select("doc", F.explode(F.array_distinct(text.tokens("text"))).alias("term")).join(terms, "term").select("doc", "term", F.lit(1.0).alias("share"))
    return best_sums(held, weight, docs, k)
