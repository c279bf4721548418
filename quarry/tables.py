"""The input tables and the views of them that the operators work on.

Courses are parts, teachers suppliers, programmes brands, areas part types, students customers, and transcripts order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASS_GRADE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst, conf): course src comes before dst. Course p needs p div 2 and p div 3."""
    part = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") + 50) / 100.0).alias("conf"))
    return part.select(F.explode(F.expr("array_distinct(array(p_partkey div 2, p_partkey div 3))")).alias("src"), F.col("p_partkey").alias("dst"), "conf").where("src > 0")


def entangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prerequisite edges (src, dst, conf) with wrongly entered ones: courses of size 1 and 2 also come before the course p div 8, and those of size 50 before themselves."""
    part = table(spark, sf_dir, "part").where("p_size <= 2 AND p_partkey >= 8 OR p_size = 50")
    wrong = part.selectExpr("p_partkey AS src", "if(p_size = 50, p_partkey, p_partkey div 8) AS dst", "1.0D AS conf")
    return prerequisites(spark, sf_dir).unionAll(wrong)


def teaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (teacher, course) pairs."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity >= 30")
    return line.select(F.col("l_suppkey").alias("teacher"), F.col("l_partkey").alias("course")).distinct()


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS course", "p_name AS name", "p_brand AS programme", "p_type AS area", "1 + p_size % 10 AS term", "2 + p_size % 5 AS credits"
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(course, programme, term): every course is in the programme of its brand and in one of three larger ones; it is an elective, without a term, of the latter if its size is divisible by 7."""
    part = table(spark, sf_dir, "part")
    own = part.selectExpr("p_partkey AS course", "p_brand AS programme", "1 + p_size % 10 AS term")
    return own.unionAll(part.selectExpr("p_partkey", "concat('core ', p_partkey % 3)", "if(p_size % 7 = 0, null, 1 + int(p_partkey % 8))"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student, course, credits, grade, ordered): one row per order line."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey AS course", "l_quantity AS credits", "round(l_discount * 100, 1) AS grade")
    order = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey AS student", "o_orderdate AS ordered")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("student", "course", "credits", "grade", "ordered")


def passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (student, course) with a passing grade."""
    return transcript(spark, sf_dir).where(F.col("grade") >= PASS_GRADE).select("student", "course").distinct()


def star_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Property graph: nodes (node_id, kind, name) and edges (src, dst, relation, conf)."""
    part = courses(spark, sf_dir)
    kinds = [
        part.selectExpr("concat('COURSE:', course) AS node_id", "'course' AS kind", "name"),
        table(spark, sf_dir, "supplier").selectExpr("concat('TEACHER:', s_suppkey)", "'teacher'", "s_name"),
        part.select("programme").distinct().selectExpr("concat('PROGRAMME:', programme)", "'programme'", "programme"),
        part.select("area").distinct().selectExpr("concat('AREA:', area)", "'area'", "area"),
        table(spark, sf_dir, "nation").selectExpr("concat('UNIT:', n_nationkey)", "'unit'", "n_name"),
        table(spark, sf_dir, "region").selectExpr("concat('ROOT:', r_regionkey)", "'root'", "r_name"),
    ]
    nodes = kinds[0]
    for k in kinds[1:]:
        nodes = nodes.unionAll(k)
    taught = teaches(spark, sf_dir)
    area = taught.join(part, "course").select("teacher", "area").distinct()
    relations = [
        prerequisites(spark, sf_dir).selectExpr("concat('COURSE:', src) AS src", "concat('COURSE:', dst) AS dst", "'PREREQUISITE_OF' AS relation", "conf"),
        taught.selectExpr("concat('TEACHER:', teacher)", "concat('COURSE:', course)", "'TEACHES'", "1.0D"),
        part.selectExpr("concat('PROGRAMME:', programme)", "concat('COURSE:', course)", "'OFFERS'", "1.0D"),
        area.selectExpr("concat('TEACHER:', teacher)", "concat('AREA:', area)", "'EXPERT_IN'", "1.0D"),
        table(spark, sf_dir, "nation").selectExpr("concat('ROOT:', n_regionkey)", "concat('UNIT:', n_nationkey)", "'CONTAINS'", "1.0D"),
        table(spark, sf_dir, "supplier").selectExpr("concat('UNIT:', s_nationkey)", "concat('TEACHER:', s_suppkey)", "'CONTAINS'", "1.0D"),
    ]
    edges = relations[0]
    for r in relations[1:]:
        edges = edges.unionAll(r)
    return nodes, edges


#: The same views for DuckDB, as common table expressions.
SQL_VIEWS = {
    "dag": """dag AS (
        SELECT p_partkey // 2 AS src, p_partkey AS dst, (p_size + 50) / 100.0::DOUBLE AS conf FROM part WHERE p_partkey // 2 > 0
        UNION ALL SELECT p_partkey // 3, p_partkey, (p_size + 50) / 100.0::DOUBLE FROM part WHERE p_partkey // 3 > 0 AND p_partkey // 3 <> p_partkey // 2)""",
    "entangled": """entangled AS (
        SELECT src, dst FROM dag UNION ALL SELECT p_partkey, CASE WHEN p_size = 50 THEN p_partkey ELSE p_partkey // 8 END FROM part
        WHERE (p_size <= 2 AND p_partkey >= 8) OR p_size = 50)""",
    "teaches": "teaches AS (SELECT DISTINCT l_suppkey AS teacher, l_partkey AS course FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 30)",
    "courses": """courses AS (SELECT p_partkey AS course, p_name AS name, p_brand AS programme, p_type AS area,
        1 + p_size % 10 AS term, 2 + p_size % 5 AS credits FROM part)""",
    "places": """places AS (SELECT p_partkey AS course, p_brand AS programme, 1 + p_size % 10 AS term FROM part
        UNION ALL SELECT p_partkey, 'core ' || p_partkey % 3, CASE WHEN p_size % 7 <> 0 THEN 1 + p_partkey % 8 END FROM part)""",
    "transcript": """transcript AS (SELECT o_custkey AS student, l_partkey AS course, l_quantity AS credits, round(l_discount * 100, 1) AS grade,
        o_orderdate AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL_VIEWS[n] for n in names)
