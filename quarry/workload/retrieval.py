"""Queries on documents, pages and vectors: tokens, ranking, fusion, chunks."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import checkpoint, remove, shared_dir
from quarry.operators import regulations, retrieval, splitting
from quarry.sources.vectors import VectorStore
from quarry.tables import table
from quarry.workload.graph import KEY

TOKENS = "regexp_extract_all(lower({0}), '[a-zà-ú0-9]+')"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr("item_id AS query", "text")


def _ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that serve as queries."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS v")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS v", "label")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), 10)


def _keyword(spark: SparkSession, sf_dir: str, k: int = 12) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text", "split(text, '\\n')[0] AS title")
    asked = _questions(spark, sf_dir).select("query", text.token_set("text").alias("tokens"))
    fields = {"title": (text.token_set("title"), 2.0), "head": (text.token_set("text"), 1.0)}
    return retrieval.weighted_overlap(docs, asked, fields, k)


def keyword_weighted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir)


#: Acronyms of the questions' words, for a site of the given pages.
EXPANSIONS = {"the": ["thention", "statre"], "und": ["ungheiten"], "que": ["quemente"]}


def site_sections_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sections of a site, for each benchmark item; words of six letters or more that stand in many texts are left out."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", text.html_title("html").alias("title"), text.html_to_text("html").alias("text"))
    return retrieval.site_sections(pages, _questions(spark, sf_dir), EXPANSIONS, ("example", "quemente"))


def page_site_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with a site's name added after a dash, without it again."""
    named = F.regexp_replace("html", r"(?is)(</h1>|</title>)", " - The SITE of page$1")
    return table(spark, sf_dir, "pages").select("page_id", text.site_title(named, "the site").alias("title"))


def regulation_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("the", "license", 15.0), ("of", "apache", 10.0), ("and", "version", 5.0), ("de", "licensed", 5.0), ("der", "released", 8.0)]
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS doc", "text")
    return retrieval.keyword_score(docs, _questions(spark, sf_dir), rules, 10)


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(text.tokens("text")).alias("term"))
    one = rows.groupBy("lang", "term").agg(F.count("*").alias("n"))
    return one.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("terms"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("once"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.graph_key("text")).alias("graph_key"), F.md5(text.text_key("text")).alias("text_key"), F.md5(text.slug("text")).alias("slug"),
        text.truncate_words("text", 60).alias("short"), text.singular(F.lower(F.split(F.trim("text"), " ")[0])).alias("singular"),
    )


def dup_normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(text.graph_key("p_name").alias("key"), "p_partkey")
    return names.groupBy("key").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first")).where("parts > 1")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(_vectors(spark, sf_dir).select("id", "v"), _ask(spark, sf_dir), 10)


def centroid_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.route(v, retrieval.centroids(v))


def centroid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return retrieval.route(v, retrieval.centroids(v), 0.45)


def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.adaptive_threshold(retrieval.nearest(_vectors(spark, sf_dir).select("id", "v"), _ask(spark, sf_dir), 20), 0.55, 0.05)


def relative_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.relative_cutoff(_keyword(spark, sf_dir, 20).withColumnRenamed("id", "doc"), 2)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = retrieval.bm25(table(spark, sf_dir, "documents"), _questions(spark, sf_dir), 20)
    return retrieval.fuse(lexical, _keyword(spark, sf_dir).withColumnRenamed("id", "doc"), n=10)


def _lowest(rows: DataFrame, n: int) -> DataFrame:
    """The n smallest ids of each label: first of each of 64 parts of it, then of those."""
    found = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["label", "part"], ["label"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        found = found.withColumn("r", rank).where(F.col("r") <= n).drop("r")
    return found.drop("part")


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by cosine, fused with those of the query's label by id, with position scores."""
    v = _vectors(spark, sf_dir)
    near = retrieval.nearest(v.select("id", "v"), _ask(spark, sf_dir), 20)
    asked = v.where("id % 50 = 0").selectExpr("id AS query", "label")
    # a label's 13 smallest ids hold the 12 smallest others of any of its queries
    low = _lowest(v.select("label", "id"), 13)
    same = retrieval.best(low.join(asked, "label").where("id <> query").selectExpr("query", "id AS doc", "0.0D AS score"), "query", "doc", 12)
    return retrieval.rank_scores(retrieval.fuse(near, same, n=20))


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("id", "v")
    near = retrieval.nearest(v, _ask(spark, sf_dir), 20)
    return retrieval.mmr(near.join(v.withColumnRenamed("id", "doc"), "doc").select("query", "doc", "score", "v"), 10)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.chunks(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "chunk", "total", F.length("text").alias("size"), F.md5("text").alias("digest"))


#: Weights for texts of the given tables, as the fixed ones are for Portuguese.
RULES = {"the": 3, "license": 12, "quan": 7, "und ": 4, "ment": 2, "eletiva": 8}


def regulation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of made-up kinds for every benchmark item, which asks for a term, an acronym and electives too; the semantic list is of ids alike."""
    kind = "element_at(array('question', 'objective', 'term', 'summary', 'article'), int(doc_id % 5) + 1)"
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS doc", "concat(text, if(doc_id % 3 = 0, ' pergunta', ''), if(doc_id % 7 = 0, ' eletiva', ''), if(doc_id % 11 = 0, ' grupo', '')) AS text", f"{kind} AS kind",
        "if(doc_id % 4 = 0, concat('X', doc_id % 9), '') AS acronym", "int(doc_id % 10 + 1) AS number",
    )
    asked = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query", "concat(substring(text, 1, 60), ' no ', element_at(array('segundo termo', 'termo 7', 'dia 3o'), int(item_id % 3) + 1), ' de x', item_id % 9, if(item_id % 2 = 0, ' grupo', '')) AS text")
    semantic = asked.select("query").join(docs.select("doc"), F.expr("query % 50 = doc % 50")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc"))).where("rank <= 8")
    return regulations.united(regulations.by_weight(docs, asked, RULES), semantic, docs)


def split_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in chunks of 1,500 characters at the best separators, with their source as header where a text is cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = splitting.split(docs, 1500, 100, F.concat(F.lit("[Continued - "), "source", F.lit("]\n\n")))
    return out.select("doc_id", "chunk", "total", "start", F.md5("chunk_text").alias("digest"))


def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's lines as paragraphs, packed to 1,400 characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return splitting.pack(docs).select("doc_id", "chunk", "total", F.md5("chunk_text").alias("digest"))


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_marks("text")).alias("digest"))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.split_text(table(spark, sf_dir, "documents"))


def corpus_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a later state: some deleted, some changed, some added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    later = docs.where("doc_id % 10 <> 3").selectExpr("doc_id", "if(doc_id % 10 = 4, concat(text, ' more'), text) AS text")
    return retrieval.corpus_diff(docs, later.unionAll(docs.where("doc_id % 10 = 5").selectExpr("doc_id + 10000000", "text")))


def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after taking in the changes, counted by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    later = docs.where("doc_id % 10 <> 3").selectExpr("doc_id", "if(doc_id % 10 = 4, concat(text, ' more'), text) AS text")
    stored, fresh = retrieval.chunks(docs), retrieval.chunks(later)
    after = retrieval.apply_diff(stored, fresh, retrieval.corpus_diff(docs, later))
    return after.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_title("html").alias("title"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.html_to_text("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).alias("size"), F.md5(plain).alias("digest"))


def vector_store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of a store's versions: built, built again for another signature, and brought in step with changed and deleted documents; vectors are stand-ins of two numbers."""
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    store = VectorStore(spark, path)
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id AS string) AS source", "text")
    later = docs.where("source % 10 <> 1").withColumn("text", F.expr("if(source % 10 = 0, concat(text, '!'), text)"))
    cut = lambda rows: retrieval.chunks(rows, id_col="source").withColumnRenamed("doc_id", "source")
    embed = lambda scale: lambda rows: rows.withColumn("embedding", F.array(F.length("text") * scale, F.col("chunk")))
    for rows, scale in ((docs, 1), (docs, 2), (later, 2), (later, 2)):
        store.sync(rows, cut, embed(scale), f"scale {scale}", 2)
    kept = [store.read(v).select(F.lit(v).alias("version"), "source", "chunk", "total", F.md5("text").alias("digest"), F.col("embedding")[0].cast("double").alias("first"), "born") for v in store.versions()]
    out = checkpoint(functools.reduce(DataFrame.unionAll, kept))
    remove(spark, path)
    return out


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.html_links("html")).alias("link"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), text.path_words(url).alias("words"), text.canonical_url(url).alias("canonical")
    )


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections at paragraph starts (these pages have no lower headings), of at least 80 characters."""
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("section", "part"))
    plain = parts.select("page_id", "section", text.html_to_text("part").alias("body")).where("section > 0 AND length(body) >= 80")
    return plain.select("page_id", "section", F.length("body").alias("size"), F.md5("body").alias("digest"))


_BM25 = f"""
d AS (SELECT doc_id AS doc, {TOKENS.format("text")} AS t FROM documents),
tf AS (SELECT doc, term, count(*) AS f FROM (SELECT doc, unnest(t) AS term FROM d) GROUP BY ALL),
size AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
raw AS (SELECT term, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, size GROUP BY term, docs),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT query, term, count(*) AS qf FROM (SELECT item_id AS query, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
hit AS (SELECT query, doc, round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / mean))), 6) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN d USING (doc), size GROUP BY ALL),
bm25 AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank, doc, score FROM hit)"""
_FOLD = "translate(lower({0}), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy')"
_SET = "list_distinct(list_filter(regexp_extract_all(" + _FOLD + ", '[a-z0-9]+'), lambda w: length(w) > 3))"
_SITE = "list_distinct(list_filter(regexp_extract_all(" + _FOLD + ", '[a-z0-9]+'), lambda w: (length(w) > 3 OR w IN ('the', 'und', 'que')) AND w NOT IN ('example', 'quemente')))"
_KEYWORD = f"""
kd AS (SELECT doc_id AS id, {_SET.format("split_part(text, chr(10), 1)")} AS title, {_SET.format("text")} AS body FROM documents),
kp AS (SELECT id, unnest(title) AS token, 2.0::DOUBLE AS w FROM kd UNION ALL SELECT id, unnest(body), 1.0 FROM kd),
kq AS (SELECT item_id AS query, unnest({_SET.format("text")}) AS token FROM benchmark),
ks AS (SELECT query, id, sum(w) AS score FROM kq JOIN kp USING (token) GROUP BY ALL HAVING sum(w) >= 2),
kr AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM ks)"""
_NEAR = """
near AS (
  SELECT q.vec_id AS query, d.vec_id AS doc, round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 0), 6) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
nr AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank, doc, score FROM near)"""
_ROUTE = """
m AS (SELECT label, i, round(avg(x::DOUBLE), 9) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM m GROUP BY label),
s AS (SELECT vec_id AS id, c.label, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS score FROM embeddings, c)"""
_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0},
  '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""
_CHUNKS = """(SELECT doc_id, chunk::INTEGER AS chunk, total::INTEGER AS total, substr(text, ((chunk - 1) * 1350 + 1)::BIGINT, 1500) AS text
  FROM (SELECT *, unnest(range(1, total + 1)) AS chunk FROM (SELECT *, CASE WHEN length(text) <= 1500 THEN 1 ELSE ceil((length(text) - 150) / 1350)::BIGINT END AS total FROM {0})))"""

SQL = {
    "bm25_topk": f"WITH {_BM25} SELECT * FROM bm25 WHERE rank <= 10",
    "keyword_weighted_topk": f"WITH {_KEYWORD} SELECT * FROM kr WHERE rank <= 12",
    "site_sections_topk": f"""WITH p AS (SELECT page_id AS id, url, coalesce(nullif({_HTML.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), nullif({_HTML.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '')) AS title, {_HTML.format("html")} AS text FROM pages),
d AS (SELECT id, {_SITE.format("coalesce(title, '')")} AS t, {_SITE.format("regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[/_.-]+', ' ', 'g')")} AS u, {_SITE.format("substr(text, 1, 1000)")} AS b FROM p),
k AS (SELECT id, unnest(t) AS token, 2.0::DOUBLE AS w FROM d UNION ALL SELECT id, unnest(u), 1.5 FROM d UNION ALL SELECT id, unnest(b), 1.0 FROM d),
q0 AS (SELECT item_id AS query, {_SITE.format("text")} AS t FROM benchmark),
q AS (SELECT query, unnest(list_distinct(t || {" || ".join(f"CASE WHEN list_contains(t, '{a}') THEN {w} ELSE []::VARCHAR[] END" for a, w in EXPANSIONS.items())})) AS token FROM q0),
s AS (SELECT query, id, sum(w) AS score FROM q JOIN k USING (token) GROUP BY ALL HAVING sum(w) >= 2)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank, id, score FROM s QUALIFY rank <= 2""",
    "page_site_titles": f"""SELECT page_id, coalesce(nullif({_HTML.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), nullif({_HTML.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '')) AS title FROM pages""",
    "regulation_keyword_score": f"""WITH r AS (SELECT * FROM (VALUES ('the', 'license', 15.0::DOUBLE), ('of', 'apache', 10), ('and', 'version', 5), ('de', 'licensed', 5), ('der', 'released', 8)) t(asked, word, weight)),
a AS (SELECT item_id AS query, unnest(list_distinct({TOKENS.format("text")})) AS asked FROM benchmark),
w AS (SELECT query, word, weight FROM a JOIN r USING (asked) UNION ALL SELECT query, asked, 20 FROM a WHERE length(asked) > 6),
h AS (SELECT doc_id AS doc, unnest(list_distinct({TOKENS.format("text")})) AS word FROM documents),
s AS (SELECT query, doc, sum(weight) AS score FROM h JOIN w USING (word) GROUP BY ALL)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank, doc, score FROM s QUALIFY rank <= 10""",
    "token_stats": f"""WITH t AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({TOKENS.format("text")}) AS term FROM documents) GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS tokens, count(*) AS terms, max(n) AS most, count(*) FILTER (n = 1) AS once FROM t GROUP BY lang""",
    "normalize_text": f"""SELECT doc_id, md5({KEY.format("text")}) AS graph_key,
  md5(trim(regexp_replace({_FOLD.format("text")}, '\\s+', ' ', 'g'))) AS text_key,
  md5(regexp_replace(regexp_replace({_FOLD.format("text")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substr(text, 1, 60), ' [^ ]*$', '') || '…' END AS short,
  CASE WHEN length(w) > 3 AND w LIKE '%s' THEN substr(w, 1, length(w) - 1) ELSE w END AS singular
FROM (SELECT *, lower(split_part(trim(text), ' ', 1)) AS w FROM documents)""",
    "dup_normalized_names": f"SELECT {KEY.format('p_name')} AS key, count(*) AS parts, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1",
    "cosine_topk": f"WITH {_NEAR} SELECT * FROM nr WHERE rank <= 10",
    "centroid_route": f"WITH {_ROUTE} SELECT id, label AS route, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1",
    "centroid_threshold": f"WITH {_ROUTE} SELECT id, CASE WHEN score >= 0.45 THEN label END AS route, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1",
    "adaptive_threshold": f"""WITH {_NEAR}, t AS (SELECT * FROM nr WHERE rank <= 20),
l AS (SELECT query, round(least(0.55, median(score) + 0.05), 6) AS "limit" FROM t GROUP BY query)
SELECT query, doc, score, "limit" FROM t JOIN l USING (query) WHERE score >= "limit" """,
    "relative_cutoff": f"""WITH {_KEYWORD}, t AS (SELECT query, id AS doc, score, max(score) OVER (PARTITION BY query) AS top FROM kr WHERE rank <= 20)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank, doc, score FROM t WHERE score >= greatest(2, floor((top + 1) / 2)) QUALIFY rank <= 2""",
    "rrf_fusion": f"""WITH {_BM25}, {_KEYWORD},
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
  SELECT query, doc, rank FROM bm25 WHERE rank <= 20 UNION ALL SELECT query, id, rank FROM kr WHERE rank <= 12) GROUP BY ALL)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank, doc, score FROM f QUALIFY rank <= 10""",
    "hybrid_rank": f"""WITH {_NEAR},
same AS (SELECT q.vec_id AS query, d.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY d.vec_id) AS rank
  FROM embeddings q JOIN embeddings d USING (label) WHERE q.vec_id <> d.vec_id AND q.vec_id % 50 = 0),
f AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
  SELECT query, doc, rank FROM nr WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM same WHERE rank <= 12) GROUP BY ALL),
t AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank, doc, score FROM f QUALIFY rank <= 20)
SELECT *, round((count(*) OVER (PARTITION BY query) - rank + 1) / count(*) OVER (PARTITION BY query), 6) AS position_score FROM t""",
    "regulation_candidates": f"""WITH d AS (SELECT doc_id AS doc, text || CASE WHEN doc_id % 3 = 0 THEN ' pergunta' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' eletiva' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' grupo' ELSE '' END AS text,
  ['question', 'objective', 'term', 'summary', 'article'][doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 4 = 0 THEN 'x' || doc_id % 9 ELSE '' END AS acronym, doc_id % 10 + 1 AS number FROM documents),
q AS (SELECT item_id AS query, lower(strip_accents(substr(text, 1, 60) || ' no ' || ['segundo termo', 'termo 7', 'dia 3o'][item_id % 3 + 1] || ' de x' || item_id % 9 || CASE WHEN item_id % 2 = 0 THEN ' grupo' ELSE '' END)) AS q FROM benchmark),
l AS (SELECT *, lower(strip_accents(text)) AS s FROM d),
t AS (SELECT *, list_distinct(regexp_extract_all(q, '([a-zà-ú0-9]+)', 1)) AS qt FROM q), u AS (SELECT *, list_distinct(regexp_extract_all(s, '([a-zà-ú0-9]+)', 1)) AS dt FROM l),
f AS (SELECT query, number, count(*) AS n FROM q, (SELECT unnest([{", ".join(f"{{'n': {n}, 'f': '{w}'}}" for n in range(1, 11) for w in regulations.forms(n))}], recursive := true)) x(number, form) WHERE contains(q, form) GROUP BY ALL),
c AS (SELECT query, doc, kind, {" + ".join(f"CASE WHEN contains(q, '{w}') AND contains(s, '{w}') THEN {n} ELSE 0 END" for w, n in RULES.items())}
  + CASE kind WHEN 'question' THEN 10 WHEN 'objective' THEN 3 WHEN 'summary' THEN 5 ELSE 0 END
  + CASE WHEN kind = 'question' AND contains(s, 'pergunta') THEN 5 * len(list_filter(list_intersect(qt, dt), lambda w: length(w) > 3)) ELSE 0 END
  + CASE WHEN acronym <> '' AND list_contains(qt, acronym) THEN 15 ELSE 0 END + CASE WHEN kind = 'term' THEN 20 * coalesce(f.n, 0) ELSE 0 END
  + CASE WHEN kind IN ('term', 'summary', 'electives') AND (contains(q, 'eletiva') OR contains(q, 'grupo')) THEN CASE WHEN contains(s, 'eletiva') AND contains(s, 'grupo') THEN 12 WHEN contains(s, 'eletiva') OR contains(s, 'grupo') THEN 6 ELSE 0 END ELSE 0 END AS score
  FROM t CROSS JOIN u LEFT JOIN f USING (query, number)),
w AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM c WHERE score > 0 QUALIFY place <= 10),
m AS (SELECT query, doc, 1000000 + row_number() OVER (PARTITION BY query ORDER BY doc) AS place FROM q JOIN d ON query % 50 = doc % 50 QUALIFY place <= 1000008),
o AS (SELECT query, doc, place FROM (FROM w UNION ALL FROM m) JOIN d USING (doc) QUALIFY row_number() OVER (PARTITION BY query, substr(text, 1, 120) ORDER BY place, doc) = 1)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY place, doc)::INTEGER AS rank, doc FROM o QUALIFY rank <= 8""",
    "folded_texts": "SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents",
    "chunk_documents": f"SELECT doc_id, chunk, total, length(text)::INTEGER AS size, md5(text) AS digest FROM {_CHUNKS.format('documents')}",
    "vector_store_versions": f"""WITH later AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1),
a AS (SELECT * FROM {_CHUNKS.format("documents")}), b AS (SELECT * FROM {_CHUNKS.format("later")})
SELECT 1 AS version, doc_id::VARCHAR AS source, chunk, total, md5(text) AS digest, length(text)::DOUBLE AS first, 1 AS born FROM a
UNION ALL SELECT 2, doc_id::VARCHAR, chunk, total, md5(text), 2 * length(text), 2 FROM a
UNION ALL SELECT 3, doc_id::VARCHAR, chunk, total, md5(text), 2 * length(text), CASE WHEN doc_id % 10 = 0 THEN 3 ELSE 2 END FROM b""",
    "corpus_diff": """SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'deleted' WHEN 4 THEN 'modified' ELSE 'same' END AS change FROM documents
UNION ALL SELECT doc_id + 10000000, 'new' FROM documents WHERE doc_id % 10 = 5""",
    "incremental_sync": f"""WITH later AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN text || ' more' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3)
SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM {_CHUNKS.format("later")} GROUP BY doc_id""",
    "page_titles": f"""SELECT page_id, coalesce(nullif({_HTML.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''),
  nullif({_HTML.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '')) AS title FROM pages""",
    "page_text": f"SELECT page_id, length({_HTML.format('html')})::INTEGER AS size, md5({_HTML.format('html')}) AS digest FROM pages",
    "page_links": """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1))) AS link FROM pages""",
    "url_parts": r"""SELECT page_id, host, path, trim(regexp_replace(path, '[/_.-]+', ' ', 'g')) AS words,
  regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(host) || regexp_replace(path, '/+$', '') AS canonical
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""",
    "page_sections": f"""SELECT page_id, section::INTEGER AS section, length(body)::INTEGER AS size, md5(body) AS digest FROM (
  SELECT page_id, section, {_HTML.format("part")} AS body FROM (
    SELECT page_id, unnest(string_split(html, '<p>')) AS part, unnest(range(0, len(string_split(html, '<p>')))) AS section FROM pages))
WHERE section > 0 AND length(body) >= 80""",
}

QUERIES = {name: globals()[name] for name in (*SQL, "mmr_select", "split_documents", "split_recursive", "packed_paragraphs")}
