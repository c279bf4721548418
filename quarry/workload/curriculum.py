"""Queries of the curriculum operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import tables
from quarry.operators import curriculum, graph
from quarry.sources import sections
from quarry.tables import table, with_views
from quarry.workload.graph import KEY, _structure, similarity
from quarry.workload.graph import SQL as GRAPH_SQL

ALIASES = [("steel", "BRAND#11"), ("brass things", "BRAND#12"), ("nickel", "BRAND#99")]
TOPICS = ["steel", "economy", "standard brass", "small things"]
SYNONYMS = [("small things", "small"), ("economy", "promo")]


def listed_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed: by key those of every 50th part, by name those of three parts, and two that don't exist."""
    part = table(spark, sf_dir, "part")
    courses = part.selectExpr("p_partkey AS course", "concat('C', p_partkey) AS code", "p_name AS name")
    listed = part.where("p_partkey % 50 = 0").selectExpr("concat('C', p_partkey) AS code", "'no such name' AS name")
    listed = listed.unionAll(part.where("p_partkey IN (3, 4, 5)").selectExpr("cast(NULL AS string)", "upper(p_name)")).unionAll(spark.createDataFrame([("X1", "Nowhere One"), ("X2", "Nowhere Two")], "code string, name string"))
    return curriculum.flag_listed(courses, listed)


def programme_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    terms = part.selectExpr("p_type AS term").unionAll(part.selectExpr("lower(p_brand)")).unionAll(part.selectExpr("lower(p_type)")).distinct()
    programmes = part.selectExpr("p_brand AS programme", "p_brand AS acronym").distinct()
    return curriculum.match_programmes(terms, programmes, spark.createDataFrame(ALIASES, "alias string, acronym string"))


def teachers_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    experts = tables.teaches(spark, sf_dir).join(tables.courses(spark, sf_dir), "course").select("teacher", "area").distinct()
    topics = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    return curriculum.teachers_by_topic(topics, experts, spark.createDataFrame(SYNONYMS, "topic string, synonym string"))


def study_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts are the words of part names; texts are part types and names."""
    part = table(spark, sf_dir, "part")
    covers = part.select(F.explode(F.split("p_name", " ")).alias("concept"), F.col("p_partkey").alias("course")).distinct()
    texts = part.selectExpr("p_partkey AS id", "concat(p_type, ' ', p_name) AS text")
    found = graph.mentions(texts, covers.selectExpr("concept AS name").distinct(), 4)
    return curriculum.tracks(found, covers, part.where("p_size % 2 = 0").selectExpr("p_partkey AS course"))


def typed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A course file for each part, and a regulation file with an article for each nation, as typed documents."""
    needs = "if(p_partkey % 2 = 0, concat('- Course ', p_partkey div 2, ' (Código: ', p_partkey div 2, ')\\n- Other\\n'), 'none\\n')"
    course = f"concat('# ', p_name, '\\n\\n**Código:** ', p_partkey, '\\n**Termo:** ', 1 + p_size % 10, 'º\\n\\n## Docentes\\n\\n- ', p_brand, '\\n\\n## Pré-requisitos\\n\\n', {needs}, '\\n## Ementa\\n\\n', p_type, '\\n\\n### Tópicos\\n\\n- ', p_type, '\\n')"
    files = table(spark, sf_dir, "part").selectExpr("concat('course/', p_partkey) AS path", f"{course} AS content")
    row = F.format_string("### %s\n\n**Art. %d.** About %s.\n\n", "r_name", "n_nationkey", "n_name")
    rules = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda s: s["row"]), "")
    regulation = rules.agg(F.lit("rules").alias("path"), F.concat(F.lit("# Rules\n\n## Estrutura\n\n"), body).alias("content"))
    return sections.documents(files.unionAll(regulation)).select("path", "at", "kind", "title", F.md5("text").alias("digest"))


def controlled_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = line.selectExpr("l_suppkey AS item", "p_type AS term", "l_quantity / 50 AS confidence")
    return curriculum.controlled(found, table(spark, sf_dir, "part").where("p_size < 5").selectExpr("p_type AS term"))


def enrichment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = similarity.top_similar(_structure(spark, sf_dir), 5)
    predicted = similarity.predict_missing(top.select("course", "similar"), tables.prerequisites(spark, sf_dir))
    return curriculum.enrichment(top, predicted).select("course", F.length("note").alias("size"))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.source_counts(table(spark, sf_dir, "documents"))


def sections_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("syllabus", ("what",)), ("hours", ("how", "hours")), ("people", ("who",))]
    return table(spark, sf_dir, "conversations").groupBy(curriculum.section_for("text", rules, "info").alias("section")).agg(F.count("*").alias("turns"))


_W = lambda c: f"list_distinct(list_transform(string_split({KEY.format(c)}, ' '), lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' THEN substr(x, 1, length(x) - 1) ELSE x END))"
_PREDICT, _MISSING = GRAPH_SQL["predict_missing"].rsplit("SELECT course, prereq", 1)
SQL = {
    "enrichment_notes": f"""{_PREDICT.rstrip()}, pm AS (SELECT course, prereq{_MISSING}),
a AS (SELECT course, string_agg("similar"::VARCHAR, ', ' ORDER BY rank) AS s FROM top GROUP BY course),
b AS (SELECT course, string_agg(DISTINCT prereq::VARCHAR, ', ' ORDER BY prereq::VARCHAR) AS p FROM pm GROUP BY course)
SELECT course, length(concat_ws(chr(10), 'Similar: ' || s, 'Likely needs: ' || p))::INTEGER AS size FROM a FULL JOIN b USING (course)""",
    "listed_courses": f"""WITH c AS (SELECT p_partkey AS course, 'C' || p_partkey AS code, p_name AS name, {KEY.format("p_name")} AS k FROM part),
n AS (SELECT DISTINCT k FROM c WHERE course IN (3, 4, 5))
SELECT course, code, name, course % 50 = 0 OR k IN (SELECT k FROM n) AS listed FROM c
UNION ALL SELECT NULL, 'X' || i, CASE i WHEN 1 THEN 'Nowhere One' ELSE 'Nowhere Two' END, true FROM range(1, 3) t(i)""",
    "programme_match": f"""WITH al AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in ALIASES)}) t(alias, acronym)),
t AS (SELECT DISTINCT term, {KEY.format("term")} AS k FROM (SELECT p_type AS term FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT lower(p_type) FROM part)),
p AS (SELECT DISTINCT p_brand AS programme, upper(p_brand) AS acronym, {KEY.format("p_brand")} AS pk FROM part),
r AS (SELECT term, k, coalesce((SELECT min(acronym) FROM al WHERE alias = k), upper(k)) AS a FROM t WHERE k <> ''),
e AS (SELECT term, min(programme) AS programme FROM r JOIN p ON a = acronym GROUP BY term)
SELECT * FROM e UNION ALL SELECT term, min(programme) FROM r JOIN p ON contains(pk, k) OR contains(k, pk) WHERE length(k) > 3 AND term NOT IN (SELECT term FROM e) GROUP BY term""",
    "teachers_by_topic": with_views("teaches", "courses")
    + f""", x AS (SELECT DISTINCT teacher, area, {_W("area")} AS w FROM teaches JOIN courses USING (course)),
t AS (SELECT unnest([{", ".join(f"'{t}'" for t in TOPICS)}]) AS topic),
s AS (SELECT topic, topic AS said FROM t UNION ALL SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS)}) v(topic, said))
SELECT DISTINCT topic, teacher FROM s JOIN x ON list_has_all(x.w, {_W("said")})""",
    "study_tracks": f"""WITH cv AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS concept, p_partkey AS course, p_size % 2 = 0 AS e FROM part),
n AS (SELECT {KEY.format("concept")} AS k, min(concept) AS name FROM cv GROUP BY k HAVING k <> ''),
m AS (SELECT DISTINCT id, name, length(k) AS l FROM (SELECT p_partkey AS id, unnest(string_split({KEY.format("p_type || ' ' || p_name")}, ' ')) AS k FROM part) JOIN n USING (k)),
r AS (SELECT id, name FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC, name) <= 4)
SELECT id, name AS concept, count(DISTINCT course) AS courses, count(DISTINCT course) FILTER (e) AS electives, min(course) AS first FROM r JOIN cv ON concept = name GROUP BY id, name""",
    "typed_documents": """WITH p AS (SELECT 'course/' || p_partkey AS path, p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS t, 1 + p_size % 10 AS term, p_partkey // 2 AS need,
  'DISCIPLINA: ' || p_name || ' (Código: ' || p_partkey || ')' AS head, '- Total: N/A' || chr(10) || '- Teórica: N/A' || chr(10) || '- Prática: N/A' || chr(10) || '- Extensão: N/A' AS hours FROM part),
d AS (
  SELECT path, 0 AS a, 'info' AS kind, NULL AS title, 'DISCIPLINA: ' || name || chr(10) || 'Código: ' || id || chr(10) || 'Termo: ' || term || 'º' || chr(10) || 'DOCENTES: ' || brand || chr(10) || 'PRÉ-REQUISITOS: ' ||
    CASE WHEN id % 2 = 0 THEN 'Course ' || need || ' (Código: ' || need || '); Other' ELSE 'Nenhum' END || chr(10) || hours AS text FROM p
  UNION ALL SELECT path, 1, 'teachers', NULL, head || chr(10) || 'DOCENTES:' || chr(10) || '- ' || brand FROM p
  UNION ALL SELECT path, 2, 'prerequisites', NULL, head || chr(10) || 'PRÉ-REQUISITOS:' || chr(10) || '- Course ' || need || ' (Código: ' || need || ')' || chr(10) || '- Other' FROM p WHERE id % 2 = 0
  UNION ALL SELECT path, 3, 'hours', NULL, head || chr(10) || 'CARGA HORÁRIA:' || chr(10) || hours FROM p
  UNION ALL SELECT path, 4, 'syllabus', NULL, head || chr(10) || 'EMENTA:' || chr(10) || t || chr(10) || 'TÓPICOS:' || chr(10) || '- ' || t FROM p
  UNION ALL SELECT 'rules', -1, 'info', NULL, 'DOCUMENTO: Rules'
  UNION ALL SELECT 'rules', n_nationkey, 'article', r_name, 'DOCUMENTO: Rules' || chr(10) || 'SEÇÃO: ' || r_name || chr(10) || 'Art. ' || n_nationkey || '. About ' || n_name || '.' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'rules', 1000, 'summary', NULL, 'DOCUMENTO: Rules' || chr(10) || '- Estrutura')
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY a) - 1)::INTEGER AS "at", kind, title, md5(text) AS digest FROM d""",
    "controlled_terms": f"""SELECT l_suppkey AS item, {KEY.format("p_type")} AS term, max(least(greatest(l_quantity / 50, 0), 0.8)) AS confidence,
  {KEY.format("p_type")} IN (SELECT {KEY.format("p_type")} FROM part WHERE p_size < 5) AS known FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "source_counts": "SELECT count(DISTINCT source) AS sources, count(*) AS chunks FROM documents",
    "sections_asked": """WITH s AS (SELECT CASE WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(what)($|[^\\p{L}\\p{N}_])') THEN 'syllabus'
  WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(how|hours)($|[^\\p{L}\\p{N}_])') THEN 'hours' WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(who)($|[^\\p{L}\\p{N}_])') THEN 'people'
  ELSE 'info' END AS section FROM conversations) SELECT section, count(*) AS turns FROM s GROUP BY section""",
}

QUERIES = {name: globals()[name] for name in SQL}
