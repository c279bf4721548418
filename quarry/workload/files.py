"""Queries on files: Markdown written from the tables by Spark and read back, feeds, manifests, prefixes, embeddings and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import curriculum, retrieval
from quarry.plans import sync
from quarry.sources import markdown, sinks, web
from quarry.tables import table, with_views
from quarry.workload.retrieval import _BM25


def _course_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A course file for each part: two programmes, its brand as teacher, and the two parts that it follows."""
    before = tables.prerequisites(spark, sf_dir).groupBy("dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda s: F.format_string("- Course %d (Código: C%d)", s, s)), "\n").alias("before"))
    part = table(spark, sf_dir, "part").join(before, F.col("p_partkey") == F.col("dst"), "left")
    content = F.format_string(
        "# %s\n\n**Código:** C%d\n**Sigla:** %s\n**Curso(s):** %s, Core\n**Termo:** %dº\n\n## Docentes\n\n- Ana %s\n- Nenhum\n\n## Pré-requisitos\n\n%s\n\n## Ementa\n\nOn %s.\n\n## Outros\n\nx\n",
        "p_name", "p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("S"), F.col("p_size").cast("string"))), "p_brand", F.expr("1 + p_size % 10"), "p_brand", F.coalesce("before", F.lit("- Nenhum")), "p_type",
    )
    return part.select(F.concat(F.lit("courses/"), F.col("p_partkey").cast("string")).alias("path"), content.alias("content"))


def course_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.courses(_course_files(spark, sf_dir))
    return found.select("path", "name", "code", "acronym", "term", F.array_join("programmes", "|").alias("programmes"), F.array_join("teachers", "|").alias("teachers"), "syllabus")


def course_file_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.course_prerequisites(_course_files(spark, sf_dir))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course files as they are, without their code line, in a curriculum's folder, and with a teacher's heading."""
    n = F.substring_index("path", "/", -1).cast("long") % 4
    path = F.when(n == 2, F.concat(F.lit("Matriz/"), "path")).otherwise(F.col("path"))
    content = F.when(n == 1, F.regexp_replace("content", r"\*\*Código:[^\n]*\n", "")).when(n == 3, F.concat(F.lit("### Prof. X\n\n"), F.regexp_replace("content", r"\*\*Código:[^\n]*\n", ""))).otherwise(F.col("content"))
    return _course_files(spark, sf_dir).select(path.alias("path"), markdown.kind(content, path).alias("kind"))


def teacher_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with a block for each supplier; every third one has no areas."""
    block = F.format_string(
        "### Prof. Dr. %s\n\n**Email:** s%d@example.org\n**Sala:** %s\n**Áreas:** %s\n", F.initcap("s_name"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "none").otherwise("B1"), F.when(F.col("s_suppkey") % 3 == 0, "N/A").otherwise(F.concat(F.lit("Area "), (F.col("s_suppkey") % 7).cast("string"), F.lit(", Nets")))
    )
    files = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("b")))), lambda s: s["b"]), "\n").alias("content"))
    return markdown.teachers(files)


def curriculum_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curriculum file for each brand, with a table for each term and one of electives."""
    line = F.format_string("| %s | %d |", "p_name", F.expr("2 + p_size % 5"))
    part = table(spark, sf_dir, "part").withColumn("term", F.expr("if(p_size % 7 = 0, 99, 1 + p_size % 10)"))
    terms = part.groupBy("p_brand", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda s: s["l"]), "\n").alias("rows"))
    head = F.when(F.col("term") == 99, F.lit("## Eletivas")).otherwise(F.format_string("### Termo %d", "term"))
    text_ = F.concat(head, F.lit("\n\n| Disciplina | Créditos |\n|---|---|\n"), "rows", F.lit("\n\n"))
    files = terms.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", text_.alias("t")))), lambda s: s["t"]), "").alias("body"))
    return markdown.curricula(files.select(F.col("p_brand").alias("path"), F.concat(F.lit("# Matriz Curricular - Programme "), "p_brand", F.lit(" (PX)\n\n"), "body").alias("content")))


def regulation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, one for each nation below its region's heading, that refer to the next one."""
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.format_string("### %s\n**Art. %d.** On %s.\nSee art. %d and Art. %d.\n", "r_name", "n_nationkey", "n_name", F.expr("n_nationkey + 1"), "n_nationkey")
    files = named.agg(F.lit("rules").alias("path"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda s: s["row"]), "\n").alias("content"))
    return markdown.articles(files).select("path", "number", "heading", F.md5("body").alias("digest"), F.array_join(F.col("refers_to").cast("array<string>"), ",").alias("refers_to"))


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of orders' days, one for each customer nation."""
    day = F.date_format("o_orderdate", "d MMM yyyy")
    item = F.concat(F.lit("<item><title><![CDATA[Order & "), F.col("o_orderkey").cast("string"), F.lit("]]></title><link>u"), F.col("o_orderkey").cast("string"), F.lit("</link><pubDate>Mon, "), day, F.lit(" 10:30:00 +0000</pubDate><description>&lt;b&gt; "), "o_orderpriority", F.lit("</description></item>"))
    orders = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").join(table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey AS feed"), "o_custkey")
    feeds = orders.groupBy("feed").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), ""), F.lit("</rss>")).alias("xml"))
    return web.feed_items(feeds).select("feed", "title", "link", "published", "summary")


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(table(spark, sf_dir, "documents"), "doc_id", "text")


def prefixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the prefixes of three models, and the headers in brackets of their sources."""
    model = F.element_at(F.array(F.lit("Nomic-embed"), F.lit("multilingual-E5"), F.lit("other")), (F.col("item_id") % 3 + 1).cast("int"))
    cited = F.concat(F.lit("[S "), (F.col("item_id") % 2).cast("string"), F.lit("] first\n[T]\ntext [no]\n[T] again"))
    shown = [F.md5(curriculum.with_prefix("text", model, q)).alias(name) for name, q in (("query", True), ("document", False))]
    return table(spark, sf_dir, "benchmark").select("item_id", *shown, F.array_join(curriculum.source_headers(cited), "").alias("headers"))


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded in batches by a stand-in for a model: their length and the number of their line feeds."""
    rows = sync.batch_embed(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda texts: [[len(t), t.count("\n")] for t in texts])
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("length"), F.col("embedding")[1].cast("double").alias("breaks"))


def reranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of twenty lexical candidates by another scorer, a stand-in for a cross-encoder."""
    asked = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query", "text")
    found = retrieval.bm25(table(spark, sf_dir, "documents"), asked, 20)
    return retrieval.rerank(found, ((F.col("doc") * 7 + F.col("query")) % 101).cast("double"), 5)


SQL = {
    "course_files": """SELECT 'courses/' || p_partkey AS path, p_name AS name, 'C' || p_partkey AS code, CASE WHEN p_size % 2 = 1 THEN 'S' || p_size END AS acronym, (1 + p_size % 10)::INTEGER AS term,
  p_brand || '|Core' AS programmes, 'Ana ' || p_brand AS teachers, 'On ' || p_type || '.' AS syllabus FROM part""",
    "course_file_prerequisites": with_views("dag") + "SELECT p_name AS course, 'Course ' || src AS prerequisite, 'C' || src AS code FROM dag JOIN part ON p_partkey = dst",
    "file_kinds": """SELECT CASE WHEN p_partkey % 4 = 2 THEN 'Matriz/' ELSE '' END || 'courses/' || p_partkey AS path,
  ['course', 'regulation', 'curriculum', 'teacher'][p_partkey % 4 + 1] AS kind FROM part""",
    "teacher_files": """WITH s AS (SELECT array_to_string(list_transform(string_split(s_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name, s_suppkey AS k FROM supplier)
SELECT name, 's' || k || '@example.org' AS email, CASE WHEN k % 2 = 1 THEN 'B1' END AS room, unnest(CASE WHEN k % 3 = 0 THEN [NULL] ELSE ['Area ' || k % 7, 'Nets'] END) AS area FROM s""",
    "curriculum_files": """SELECT 'Programme ' || p_brand AS programme, 'PX' AS acronym, (CASE WHEN p_size % 7 <> 0 THEN 1 + p_size % 10 END)::INTEGER AS term, p_name AS course, (2 + p_size % 5)::INTEGER AS credits FROM part""",
    "regulation_files": """SELECT 'rules' AS path, n_nationkey::INTEGER AS number, r_name AS heading, md5('On ' || n_name || '.' || chr(10) || 'See art. ' || (n_nationkey + 1) || ' and Art. ' || n_nationkey || '.') AS digest,
  (n_nationkey + 1)::VARCHAR AS refers_to FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "feed_entries": """SELECT c_nationkey AS feed, 'Order & ' || o_orderkey AS title, 'u' || o_orderkey AS link, o_orderdate::DATE + INTERVAL 10 HOURS + INTERVAL 30 MINUTES AS published, '<b> ' || o_orderpriority AS summary
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate IS NOT NULL""",
    "file_manifest": "SELECT doc_id, md5(text) AS digest, length(text)::INTEGER AS size FROM documents",
    "prefixed_texts": """SELECT item_id, md5(['search_query: ', 'query: ', ''][item_id % 3 + 1] || text) AS query, md5(['search_document: ', 'passage: ', ''][item_id % 3 + 1] || text) AS document, '[S ' || item_id % 2 || '][T]' AS headers FROM benchmark""",
    "embedded_texts": "SELECT doc_id, length(text)::DOUBLE AS length, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS breaks FROM documents",
    "reranked_topk": f"WITH {_BM25} SELECT query, row_number() OVER (PARTITION BY query ORDER BY (doc * 7 + query) % 101 DESC, doc)::INTEGER AS rank, doc, ((doc * 7 + query) % 101)::DOUBLE AS score FROM bm25 WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY query ORDER BY (doc * 7 + query) % 101 DESC, doc) <= 5",
}

QUERIES = {name: globals()[name] for name in SQL}
