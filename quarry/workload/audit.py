"""Queries on transcripts, activities, requirements and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import tables
from quarry.lineage import checkpoint, shuffled
from quarry.operators import audit, curriculum
from quarry.sources import records
from quarry.tables import table, with_views

CAPS = {"purchase": 400.0, "click": 300.0, "view": 300.0}
RULES = [("purchase", 0.6, 36.0), ("click", 0.45, 180.0), ("view", 1.0, 80.0)]


def _activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS student", "event_type AS axis", "event_type AS kind", "value AS hours", "user_id % 10 AS institution", "get_json_object(props, '$.k') AS k")


def gpa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.weighted_mean(tables.transcript(spark, sf_dir))


def gpa_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.transcript(spark, sf_dir)
    supposed = lines.select("student").distinct().selectExpr("student", "10.0D AS grade", "4.0D AS credits")
    return audit.what_if(lines, supposed)


def grade_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.grade_needed(tables.transcript(spark, sf_dir), 400.0, 6.5, digits=6)


def activity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.axis_audit(_activities(spark, sf_dir), CAPS, 50.0, 900.0)


def activity_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.capped_hours(_activities(spark, sf_dir), spark.createDataFrame(RULES, "kind string, factor double, ceiling double"))


def institution_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "events").selectExpr("user_id AS student", "get_json_object(props, '$.k') AS institution")
    return audit.over_limit(some, 2)


def progress_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.progress(tables.courses(spark, sf_dir).select("course", "programme"), tables.passed(spark, sf_dir), tables.prerequisites(spark, sf_dir))


def enrolment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each student wants the courses that follow the first of those they passed."""
    passed = tables.passed(spark, sf_dir)
    wanted = passed.groupBy("student").agg(F.min("course").alias("c")).select("student", F.explode(F.expr("array(c * 2, c * 3)")).alias("course")).distinct()
    return audit.enrolment_check(wanted, passed, tables.prerequisites(spark, sf_dir))


def requirement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = spark.createDataFrame([(f"Brand#{i}", 2) for i in range(1, 6)] + [("none", 1)], "requirement string, required int")
    done = tables.passed(spark, sf_dir).join(tables.courses(spark, sf_dir), "course").groupBy("student", F.col("programme").alias("requirement")).agg(F.count("*").alias("done"))
    return audit.requirement_matrix(need, done)


def leading_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tables.passed(spark, sf_dir).join(tables.courses(spark, sf_dir), "course").groupBy("student", "term").agg(F.count("*").alias("n"))
    students = done.select("student").distinct()
    all_terms = students.withColumn("term", F.explode(F.sequence(F.lit(1), F.lit(10)))).join(done, ["student", "term"], "left")
    return audit.leading_terms(all_terms.select("student", "term", F.coalesce(F.col("n") >= 2, F.lit(False)).alias("ok")))


def offer_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A course is offered in its own term and in the terms of its namesakes of the same programme."""
    c = tables.courses(spark, sf_dir)
    return audit.offer_parity(c.selectExpr("concat(programme, '/', name) AS course", "term"))


def curriculum_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.courses(spark, sf_dir).groupBy("programme", "term").agg(F.count("*").alias("courses"), F.sum("credits").alias("credits"), F.min("course").alias("first"))


def teachers_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = tables.teaches(spark, sf_dir).join(tables.courses(spark, sf_dir), "course").groupBy("area", "teacher").agg(F.count("*").alias("courses"))
    return area.groupBy("area").agg(F.count("*").alias("teachers"), F.sum("courses").alias("courses"), F.max("courses").alias("most"))


def course_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per course: teachers, prerequisites, dependents, sorted."""
    needs, taught = tables.prerequisites(spark, sf_dir), tables.teaches(spark, sf_dir)

    def listed(rows: DataFrame, key: str, item: str, name: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("course")).agg(F.array_join(F.array_sort(F.collect_set(item)).cast("array<string>"), ",").alias(name))

    out = tables.courses(spark, sf_dir).select("course", "programme", "term")
    for part in (listed(taught, "course", "teacher", "teachers"), listed(needs, "dst", "src", "needs"), listed(needs, "src", "dst", "opens")):
        out = out.join(part, "course", "left")
    return out.fillna("", ["teachers", "needs", "opens"])


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A student's pending courses: those tried and not passed yet, and what these need directly and is not passed either."""
    taken = tables.transcript(spark, sf_dir).groupBy("student", "course").agg(F.coalesce(F.max(F.col("grade") >= tables.PASS_GRADE), F.lit(False)).alias("passed"))
    taken = checkpoint(taken)
    passed, failed = (taken.where(c).select("student", "course") for c in ("passed", "NOT passed"))
    needed = failed.join(shuffled(tables.prerequisites(spark, sf_dir).selectExpr("src", "dst AS course")), "course").selectExpr("student", "src AS course")
    open_ = failed.unionAll(needed.join(passed, ["student", "course"], "left_anti")).distinct()
    return open_.join(tables.courses(spark, sf_dir).select("course", "credits", "term"), "course").select("student", "course", "credits", "term")


def semester_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.plan_semesters(_pending(spark, sf_dir), tables.prerequisites(spark, sf_dir), 20)


def _own(spark: SparkSession, sf_dir: str, passed: DataFrame | None = None) -> DataFrame:
    """A student's programme: that of the first course they passed. passed: tables.passed(), if it was asked before."""
    return (tables.passed(spark, sf_dir) if passed is None else passed).groupBy("student").agg(F.min("course").alias("course")).join(tables.courses(spark, sf_dir), "course").select("student", "programme")


def progress_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth student has also taken a course that no one knows."""
    passed = checkpoint(tables.passed(spark, sf_dir))
    odd = passed.where("student % 100 = 0").selectExpr("student", "course + 100000000").distinct()
    return audit.progress_detail(passed.unionAll(odd), _own(spark, sf_dir, passed), tables.courses(spark, sf_dir), tables.prerequisites(spark, sf_dir))


def pending_semesters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pending_semesters(_pending(spark, sf_dir), tables.prerequisites(spark, sf_dir))


def enrolment_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each student wants all courses that follow those they passed; recommended are the two courses before a course's number."""
    passed, courses = tables.passed(spark, sf_dir), tables.courses(spark, sf_dir)
    wanted = passed.select("student", F.explode(F.expr("array(course * 2, course * 3)")).alias("course")).distinct()
    base = courses.select("course", F.posexplode(F.expr("array(course - 1, course - 2)")).alias("rank", "base")).where("base > 0")
    return audit.enrolment_advice(wanted, passed, tables.prerequisites(spark, sf_dir), base, audit.offer_parity(courses.select("course", "term")), courses)


def plan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the failed and passed courses of a student, as a plan in which the failed ones come first."""
    passed = tables.passed(spark, sf_dir)
    failed = tables.transcript(spark, sf_dir).select("student", "course").distinct().join(passed, ["student", "course"], "left_anti")
    return audit.plan_elements(failed.withColumn("semester", F.lit(1)), passed, tables.prerequisites(spark, sf_dir))[1]


_T = with_views("transcript")
_PASSED = with_views("dag", "courses", "transcript") + ", passed AS (SELECT DISTINCT student, course FROM transcript WHERE grade >= 5)"
def requirement_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments' first letters as acronyms, with every third one in the evening; nations are the seeds, of either shift, in their order."""
    students = table(spark, sf_dir, "customer").selectExpr("c_custkey AS student", "substring(lower(c_mktsegment), 1, 1) AS acronym", "if(c_custkey % 3 = 0, 'Curso NOTURNO', c_name) AS programme")
    seeds = table(spark, sf_dir, "nation").selectExpr("element_at(split('A B F M', ' '), int(n_nationkey % 4) + 1) AS acronym", "if(n_nationkey % 8 < 4, 'integral', 'noturno') AS shift", "n_nationkey AS at", "n_name AS seed")
    return audit.requirement_seed(students, seeds.where("acronym <> 'F' OR shift = 'integral'"))


def plan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed courses by their term, told as a plan's events."""
    courses = tables.courses(spark, sf_dir).select("course", F.col("term").alias("semester"), "credits")
    return audit.plan_events(tables.passed(spark, sf_dir).join(courses, "course"))


def programme_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as programmes: parts of sizes divisible by 7 are electives, in three groups; suppliers of numbers up to 30 lead."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS course", "p_name AS name", "p_brand AS programme", "2 + p_size % 5 AS credits", "if(p_size % 7 = 0, null, 1 + p_size % 10) AS term", "1 + p_size % 3 AS group")
    led = tables.teaches(spark, sf_dir).where("teacher <= 30").join(part.select("course", "programme"), "course").join(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS teacher", "s_name AS name"), "teacher")
    return curriculum.overview(part, part.where("term IS NULL"), led.select("programme", "name")).withColumn("names", F.md5("names"))


def transcript_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's order lines written as a transcript, in three shapes, and read back; every fifth one states a mean that is off."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber AS n", "1000 + l_partkey % 9000 AS code", "cast(l_quantity AS int) AS credits", "round(l_discount * 100, 1) AS grade")
    rows = line.join(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS student", "o_orderdate AS day"), "l_orderkey")
    term = F.format_string("ANO/SEM | %d/%d Coeficiente de Rendimento (CR): 5,0", F.year("day"), F.expr("if(month(day) <= 6, 1, 2)"))
    figures = F.expr("""CASE n % 3 WHEN 0 THEN format_string('Docente: A B 121 DF 72 1,5 %d 90 %s APROVADO', credits, replace(cast(grade AS string), '.', ','))
        WHEN 1 THEN format_string('Docente: C 102 E 36 %d 100 %s REPROVADO', credits, cast(grade AS string)) ELSE format_string('Docente: 182 AE 36 %d EM  CURSO', credits) END""")
    piece = F.concat_ws("\n", term, F.format_string("%d - NAME %d", "code", "code"), F.lit("(between)"), figures)
    graded = F.expr("n % 3 < 2")
    weighed = F.sum(F.when(graded, F.col("grade").cast("decimal(6,2)") * F.col("credits"))).cast("double") / F.sum(F.when(graded, F.col("credits")))
    mean = F.floor((weighed + F.when(F.col("student") % 5 == 0, 0.2).otherwise(0.0)) * 100) / 100
    by = rows.groupBy("student").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "l_orderkey", "n", piece.alias("piece")))), lambda s: s["piece"]), "\n").alias("lines"), mean.alias("mean"))
    stated = F.concat(F.lit("\nFIXAS 90\nCoeficiente de Rendimento (CR) Geral: "), F.replace(F.col("mean").cast("string"), F.lit("."), F.lit(",")))
    files = by.select(F.col("student").cast("string").alias("path"), F.concat(F.lit("Curso: X\n"), "lines", F.coalesce(stated, F.lit(""))).alias("content"))
    return records.summary(files).select("path", "programme", "courses", "credits", "running", "mean", "stated", "agrees", "fixed_hours")


SQL = {
    "requirement_seed": """WITH s AS (SELECT ['A', 'B', 'F', 'M'][n_nationkey % 4 + 1] AS acronym, CASE WHEN n_nationkey % 8 < 4 THEN 'integral' ELSE 'noturno' END AS shift, n_nationkey AS k, n_name FROM nation),
c AS (SELECT c_custkey AS student, upper(substr(c_mktsegment, 1, 1)) AS acronym, CASE WHEN c_custkey % 3 = 0 THEN 'noturno' ELSE 'integral' END AS want FROM customer)
SELECT student, arg_min(n_name, (shift <> want, k)) AS seed FROM c JOIN s USING (acronym) WHERE acronym <> 'F' OR shift = 'integral' GROUP BY student""",
    "plan_events": _PASSED
    + """, b AS (SELECT student, term AS semester, list_sort(list(course)) AS c, sum(credits)::BIGINT AS credits FROM passed JOIN courses USING (course) GROUP BY ALL),
w AS (SELECT student, count(*) AS n, sum(len(c))::BIGINT AS courses, sum(credits)::BIGINT AS credits FROM b GROUP BY student)
SELECT student, row_number() OVER (PARTITION BY student ORDER BY semester) AS seq, 'semester' AS event,
  '{"semester":' || semester || ',"courses":[' || array_to_string(c, ',') || '],"credits":' || credits || '}' AS payload FROM b
UNION ALL SELECT student, 0, 'start', '{"semesters":' || n || '}' FROM w UNION ALL SELECT student, n + 1, 'done', '{"courses":' || courses || ',"credits":' || credits || '}' FROM w""",
    "programme_overview": with_views("teaches")
    + """, p AS (SELECT p_partkey AS course, p_name AS name, p_brand AS programme, 2 + p_size % 5 AS credits, CASE WHEN p_size % 7 <> 0 THEN 1 + p_size % 10 END AS term, 1 + p_size % 3 AS g FROM part),
l AS (SELECT programme, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS names FROM teaches JOIN p USING (course) JOIN supplier ON s_suppkey = teacher WHERE teacher <= 30 GROUP BY programme)
SELECT programme, 'term' AS section, term::VARCHAR AS item, count(*) AS courses, sum(credits)::BIGINT AS credits, md5(string_agg(DISTINCT name, '; ' ORDER BY name)) AS names FROM p WHERE term IS NOT NULL GROUP BY ALL
UNION ALL SELECT programme, 'electives', g::VARCHAR, count(*), sum(credits)::BIGINT, md5(string_agg(DISTINCT name, '; ' ORDER BY name)) FROM p WHERE term IS NULL GROUP BY ALL
UNION ALL SELECT programme, 'total', '', courses, credits, md5(coalesce(names, '')) FROM (SELECT programme, count(*) AS courses, sum(credits)::BIGINT AS credits FROM p WHERE term IS NOT NULL GROUP BY programme) LEFT JOIN l USING (programme)""",
    "transcript_summary": """WITH r AS (SELECT o_custkey AS student, l_linenumber % 3 AS shape, l_quantity::INTEGER AS credits, round(l_discount * 100, 1) AS grade FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT student, count(*) AS courses, sum(credits)::BIGINT AS credits, count(*) FILTER (shape = 2) AS running,
  (sum(grade::DECIMAL(6,2) * credits) FILTER (shape < 2))::DOUBLE / sum(credits) FILTER (shape < 2) AS exact FROM r GROUP BY student)
SELECT student::VARCHAR AS path, 'X' AS programme, courses, credits, running, round(exact, 3) AS mean, floor((exact + CASE WHEN student % 5 = 0 THEN 0.2::DOUBLE ELSE 0 END) * 100) / 100 AS stated,
  exact IS NOT NULL AND student % 5 <> 0 AS agrees, CASE WHEN exact IS NOT NULL THEN 90 END::INTEGER AS fixed_hours FROM m""",
    "gpa": _T + "SELECT student, round(sum(grade * credits) / sum(credits), 3) AS gpa, sum(credits) AS credits FROM transcript WHERE credits > 0 GROUP BY student",
    "gpa_what_if": _T
    + """, a AS (SELECT student, grade, credits FROM transcript UNION ALL SELECT DISTINCT student, 10.0, 4.0 FROM transcript)
SELECT student, round(sum(grade * credits) / sum(credits), 3) AS gpa, sum(credits) AS credits FROM a WHERE credits > 0 GROUP BY student""",
    "grade_needed": _T
    + """SELECT student, round((6.5 * (sum(credits) + 400) - sum(grade * credits)) / 400, 6) AS needed, needed <= 10 AS possible FROM transcript WHERE credits > 0 GROUP BY student""",
    "activity_audit": """WITH h AS (SELECT user_id AS student, event_type AS axis, sum(value) AS hours FROM events GROUP BY ALL),
v AS (SELECT student, axis, least(hours, CASE axis WHEN 'purchase' THEN 400 WHEN 'click' THEN 300 WHEN 'view' THEN 300 ELSE hours END) AS valid FROM h)
SELECT student, round(sum(valid), 4) AS hours, (3 - count(*) FILTER (valid >= 50 AND axis IN ('purchase', 'click', 'view')))::INTEGER AS missing_axes,
  round(greatest(0, 900 - sum(valid)), 4) AS missing_hours FROM v GROUP BY student""",
    "activity_caps": """WITH r AS (SELECT * FROM (VALUES ('purchase', 0.6::DOUBLE, 36.0::DOUBLE), ('click', 0.45, 180), ('view', 1, 80)) t(kind, factor, ceiling))
SELECT user_id AS student, kind, round(least(sum(value * factor), ceiling), 4) AS hours FROM events JOIN r ON event_type = kind GROUP BY user_id, kind, ceiling""",
    "institution_limit": """SELECT user_id AS student, json_extract_string(props, '$.k') AS institution, count(*) AS certificates FROM events GROUP BY ALL HAVING count(*) > 2""",
    "progress_audit": _PASSED
    + """, open_ AS (
  SELECT b.student, c.programme, c.course FROM (SELECT DISTINCT student, programme FROM passed JOIN courses USING (course)) b JOIN courses c USING (programme)),
miss AS (SELECT DISTINCT o.student, o.course FROM open_ o JOIN dag ON dst = o.course LEFT JOIN passed p ON p.student = o.student AND p.course = src WHERE p.course IS NULL),
s AS (SELECT o.*, p.course IS NOT NULL AS done, m.course IS NOT NULL AS missing FROM open_ o LEFT JOIN passed p USING (student, course) LEFT JOIN miss m USING (student, course))
SELECT student, programme, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done) AS pending,
  count(*) FILTER (NOT done AND NOT missing) AS available, count(*) FILTER (NOT done AND missing) AS blocked FROM s GROUP BY ALL""",
    "enrolment_check": _PASSED
    + """, w AS (SELECT DISTINCT student, unnest([min(course) * 2, min(course) * 3]) AS course FROM passed GROUP BY student),
m AS (SELECT w.student, w.course, string_agg(DISTINCT src::VARCHAR, ',' ORDER BY src::VARCHAR) AS missing, list_sort(list(DISTINCT src)) AS l
  FROM w JOIN dag ON dst = w.course WHERE NOT EXISTS (SELECT 1 FROM passed p WHERE p.student = w.student AND p.course = src) GROUP BY ALL)
SELECT w.student, w.course, EXISTS (SELECT 1 FROM passed p WHERE p.student = w.student AND p.course = w.course) AS taken, coalesce(array_to_string(l, ','), '') AS missing
FROM w LEFT JOIN m USING (student, course)""",
    "progress_detail": _PASSED
    + """, own AS (SELECT student, programme FROM (SELECT student, min(course) AS course FROM passed GROUP BY student) JOIN courses USING (course)),
had AS (SELECT * FROM passed UNION SELECT student, course + 100000000 FROM passed WHERE student % 100 = 0),
plan AS (SELECT student, programme, course FROM own JOIN courses USING (programme)),
lack AS (SELECT p.student, p.course, array_to_string(list_sort(list(DISTINCT src)), ',') AS missing FROM plan p ANTI JOIN had USING (student, course) JOIN dag ON dst = p.course
  JOIN courses c ON c.course = src AND c.programme = p.programme LEFT JOIN had h ON h.student = p.student AND h.course = src WHERE h.course IS NULL GROUP BY ALL)
SELECT student, course, 'done' AS status, '' AS missing FROM plan SEMI JOIN had USING (student, course)
UNION ALL SELECT student, course, CASE WHEN missing IS NULL THEN 'available' ELSE 'blocked' END, coalesce(missing, '') FROM (FROM plan ANTI JOIN had USING (student, course)) LEFT JOIN lack USING (student, course)
UNION ALL SELECT student, course, CASE WHEN course IN (SELECT course FROM courses) THEN 'elective' ELSE 'unknown' END, '' FROM had ANTI JOIN plan USING (student, course)""",
    "pending_semesters": _PASSED.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, failed AS (SELECT DISTINCT student, course FROM transcript EXCEPT SELECT * FROM passed),
pend AS (SELECT * FROM failed UNION (SELECT student, src FROM failed JOIN dag ON dst = course EXCEPT SELECT * FROM passed)),
inner_ AS (SELECT p.student, src, dst FROM pend p JOIN dag ON dst = p.course JOIN pend q ON q.student = p.student AND q.course = src),
walk AS (SELECT student, course, 1 AS n FROM pend UNION SELECT w.student, dst, n + 1 FROM walk w JOIN inner_ i ON i.student = w.student AND i.src = w.course)
SELECT student, max(n)::INTEGER AS semesters FROM walk GROUP BY student""",
    "enrolment_advice": _PASSED
    + """, p AS MATERIALIZED (FROM passed),
w AS MATERIALIZED (SELECT DISTINCT student, unnest([course * 2, course * 3]) AS course FROM p),
m AS (SELECT w.student, w.course, array_to_string(list_sort(list(DISTINCT src)), ',') AS missing FROM w JOIN dag ON dst = w.course LEFT JOIN p ON p.student = w.student AND p.course = src WHERE p.course IS NULL GROUP BY ALL),
b AS MATERIALIZED (SELECT student, course, k, course - k AS base FROM w JOIN (SELECT course, unnest([1, 2]) AS k FROM courses) USING (course) WHERE course > k),
s AS (SELECT b.student, b.course, string_agg(base::VARCHAR, ',' ORDER BY k) AS base FROM b LEFT JOIN p ON p.student = b.student AND p.course = b.base WHERE p.course IS NULL GROUP BY ALL),
t AS (SELECT w.student, w.course, p.course IS NOT NULL AS taken FROM w LEFT JOIN p ON p.student = w.student AND p.course = w.course)
SELECT student, course, CASE WHEN c.course IS NULL THEN 'unknown' WHEN taken OR missing IS NOT NULL THEN 'risk' ELSE 'ok' END AS status, taken, coalesce(missing, '') AS missing,
  coalesce(base, '') AS base, CASE WHEN c.course IS NULL THEN NULL WHEN term % 2 = 1 THEN 'odd' ELSE 'even' END AS parity
FROM t LEFT JOIN m USING (student, course) LEFT JOIN s USING (student, course) LEFT JOIN courses c USING (course)""",
    "plan_edges": _PASSED
    + """, had AS (SELECT DISTINCT t.student, t.course FROM transcript t WHERE student IN (SELECT student FROM (SELECT DISTINCT student, course FROM transcript EXCEPT SELECT * FROM passed)))
SELECT DISTINCT a.student, src, dst FROM had a JOIN dag ON dst = a.course JOIN had b ON b.student = a.student AND b.course = src""",
    "requirement_matrix": _PASSED
    + """, r AS (SELECT 'Brand#' || i AS requirement, 2 AS required FROM range(1, 6) t(i) UNION ALL SELECT 'none', 1),
a AS (SELECT student, programme AS requirement, count(*) AS done FROM passed JOIN courses USING (course) GROUP BY ALL)
SELECT s.student, r.requirement, required::INTEGER AS required, done, done >= required AS met FROM (SELECT DISTINCT student FROM a) s CROSS JOIN r LEFT JOIN a USING (student, requirement)""",
    "leading_terms": _PASSED
    + """, d AS (SELECT student, term, count(*) AS n FROM passed JOIN courses USING (course) GROUP BY ALL),
g AS (SELECT s.student, t, coalesce(n, 0) AS n FROM (SELECT DISTINCT student FROM d) s CROSS JOIN range(1, 11) r(t) LEFT JOIN d ON d.student = s.student AND d.term = t)
SELECT student, coalesce(min(t) FILTER (n < 2) - 1, 10)::INTEGER AS terms FROM g GROUP BY student""",
    "offer_parity": with_views("courses")
    + """SELECT programme || '/' || name AS course, CASE WHEN bool_or(term % 2 = 1) AND bool_or(term % 2 = 0) THEN 'both' WHEN bool_or(term % 2 = 1) THEN 'odd' ELSE 'even' END AS parity
FROM courses GROUP BY 1""",
    "curriculum_by_term": with_views("courses") + "SELECT programme, term, count(*) AS courses, sum(credits)::BIGINT AS credits, min(course) AS first FROM courses GROUP BY programme, term",
    "teachers_by_area": with_views("teaches", "courses")
    + """, a AS (SELECT area, teacher, count(*) AS n FROM teaches JOIN courses USING (course) GROUP BY ALL)
SELECT area, count(*) AS teachers, sum(n)::BIGINT AS courses, max(n) AS most FROM a GROUP BY area""",
    "course_facts": with_views("dag", "teaches", "courses")
    + """SELECT course, programme, term, coalesce((SELECT array_to_string(list_sort(list(DISTINCT teacher)), ',') FROM teaches t WHERE t.course = c.course), '') AS teachers,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT src)), ',') FROM dag WHERE dst = c.course), '') AS needs,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT dst)), ',') FROM dag WHERE src = c.course), '') AS opens FROM courses c""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "semester_plan")}
