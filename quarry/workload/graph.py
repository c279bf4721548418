"""Queries on the course graph and its closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import text
from quarry.lineage import shuffled
from quarry.operators import audit, closure, cycles, graph, orders, similarity, validation
from quarry.tables import table, with_views

STAR = (
    with_views("dag", "teaches", "courses")
    + """, nodes AS (
  SELECT 'COURSE:' || course AS node_id, 'course' AS kind, name FROM courses
  UNION ALL SELECT 'TEACHER:' || s_suppkey, 'teacher', s_name FROM supplier
  UNION ALL SELECT DISTINCT 'PROGRAMME:' || programme, 'programme', programme FROM courses
  UNION ALL SELECT DISTINCT 'AREA:' || area, 'area', area FROM courses
  UNION ALL SELECT 'UNIT:' || n_nationkey, 'unit', n_name FROM nation
  UNION ALL SELECT 'ROOT:' || r_regionkey, 'root', r_name FROM region),
edges AS (
  SELECT 'COURSE:' || src AS src, 'COURSE:' || dst AS dst, 'PREREQUISITE_OF' AS relation, conf FROM dag
  UNION ALL SELECT 'TEACHER:' || teacher, 'COURSE:' || course, 'TEACHES', 1.0 FROM teaches
  UNION ALL SELECT 'PROGRAMME:' || programme, 'COURSE:' || course, 'OFFERS', 1.0 FROM courses
  UNION ALL SELECT DISTINCT 'TEACHER:' || teacher, 'AREA:' || area, 'EXPERT_IN', 1.0 FROM teaches JOIN courses USING (course)
  UNION ALL SELECT 'ROOT:' || n_regionkey, 'UNIT:' || n_nationkey, 'CONTAINS', 1.0 FROM nation
  UNION ALL SELECT 'UNIT:' || s_nationkey, 'TEACHER:' || s_suppkey, 'CONTAINS', 1.0 FROM supplier)
"""
)
DAG = with_views("dag")
#: All reachable pairs with their shortest distance, level by level.
REACH = (
    with_views("dag", recursive=True)
    + """, walk AS (SELECT DISTINCT src, dst, 1 AS hops FROM dag UNION SELECT w.src, d.dst, hops + 1 FROM walk w JOIN dag d ON w.dst = d.src),
reach AS (SELECT src, dst, min(hops)::INTEGER AS hops FROM walk GROUP BY ALL)
"""
)
KEY = (
    "trim(regexp_replace(regexp_replace(' ' || translate(lower({0}), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy') || ' ', "
    "'[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' (de|da|do|das|dos|e)( (de|da|do|das|dos|e))* ', ' ', 'g'))"
)


def graph_nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.count_by_kind(tables.star_graph(spark, sf_dir)[0])


def graph_edges_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.count_by_relation(tables.star_graph(spark, sf_dir)[1])


def graph_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lint(*tables.star_graph(spark, sf_dir))


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.export(*tables.star_graph(spark, sf_dir), label=12)


def direct_prereqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(tables.prerequisites(spark, sf_dir), reverse=True, min_confidence=0.7)


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(tables.prerequisites(spark, sf_dir))


def teachers_of_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(tables.star_graph(spark, sf_dir)[1], "TEACHES", reverse=True).select("node", "neighbour")


def areas_of_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(tables.star_graph(spark, sf_dir)[1], "EXPERT_IN").select("node", "neighbour")


def critical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.critical(tables.prerequisites(spark, sf_dir), 3)


def co_prereqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_prerequisites(tables.prerequisites(spark, sf_dir))


def unlocked_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unlocked(tables.prerequisites(spark, sf_dir), tables.passed(spark, sf_dir))


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms: two words of every part name, supplier names in lower case, and the items' first words."""
    nodes, _ = tables.star_graph(spark, sf_dir)
    nodes = nodes.where("kind in ('teacher', 'unit', 'root', 'programme', 'area')")
    terms = table(spark, sf_dir, "supplier").selectExpr("lower(s_name) AS term").unionAll(table(spark, sf_dir, "nation").selectExpr("substring(n_name, 1, 4)"))
    terms = terms.unionAll(table(spark, sf_dir, "region").selectExpr("r_name")).unionAll(table(spark, sf_dir, "nation").selectExpr("''").limit(1)).distinct()
    keys = {"name": text.graph_key("name"), "code": F.lower("node_id")}
    return graph.resolve(terms, nodes, keys)


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest frequent word pairs of benchmark items that documents mention."""
    pairs = table(spark, sf_dir, "benchmark").select(F.split(text.graph_key("text"), " ").alias("w"))
    names = pairs.select(F.explode(F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> array_join(slice(w, i, 2), ' '))")).alias("name")).distinct()
    return graph.mentions(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text"), names, 3)


def relation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted relations, one per order line, taken into the graph; the edges that are new."""
    nodes, edges = tables.star_graph(spark, sf_dir)
    found = table(spark, sf_dir, "lineitem").selectExpr("concat('TEACHER:', l_suppkey) AS src", "concat('COURSE:', l_partkey) AS dst", "'TEACHES' AS relation", "round(1 - l_discount, 2) AS conf")
    _, after = graph.add_relations(nodes, edges, found)
    return after.where("relation = 'TEACHES' AND conf < 1").select("src", "dst", "conf")


def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closing path of each strongly connected component of the prerequisites with wrong edges."""
    return cycles.closing_paths(tables.entangled(spark, sf_dir))


def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the wrong edges keep from being planned, for every course of size 3 as target; courses of sizes divisible by 7 are completed."""
    part = table(spark, sf_dir, "part")
    targets = part.where("p_size = 3").selectExpr("p_partkey AS target")
    return cycles.plan_gaps(tables.entangled(spark, sf_dir), targets, part.where("p_size % 7 = 0").selectExpr("p_partkey AS course"))


def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.extraction_stats(tables.star_graph(spark, sf_dir)[1])


def relation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which relations survive a table of allowed kinds; the rest becomes the generic one."""
    allowed = spark.createDataFrame([("TEACHER", "COURSE", "TEACHES"), ("COURSE", "COURSE", "PREREQUISITE_OF"), ("PROGRAMME", "COURSE", "OFFERS")], "src_kind string, dst_kind string, relation string")
    return graph.valid_relations(tables.star_graph(spark, sf_dir)[1], allowed).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 4).alias("conf"))


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.ancestors(tables.prerequisites(spark, sf_dir))


def ancestors_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.ancestors(tables.prerequisites(spark, sf_dir), 0.7)


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.descendants(tables.prerequisites(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("descendants"), F.max("hops").alias("farthest"))


def bounded_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops: what the reference system shows as direct prerequisites."""
    return closure.bounded_chain(tables.prerequisites(spark, sf_dir), 2)


def bottleneck_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.bottleneck(tables.prerequisites(spark, sf_dir)).withColumn("high", F.lit(1.0))


def dag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").selectExpr("p_partkey AS node")
    return closure.depths(tables.prerequisites(spark, sf_dir).select("src", "dst").distinct(), nodes)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "part").where("p_size = 7").selectExpr("p_partkey AS target")
    return closure.plan_layers(tables.prerequisites(spark, sf_dir), targets, table(spark, sf_dir, "part").where("p_size % 5 = 0").selectExpr("p_partkey AS course"))


def plan_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


def path_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.path_confidence(tables.prerequisites(spark, sf_dir), _plan(spark, sf_dir))


def failure_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure.failure_impact(tables.prerequisites(spark, sf_dir))


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failing a course blocks, and when it is offered; courses of size 50 have no fixed term."""
    offers = tables.courses(spark, sf_dir).join(table(spark, sf_dir, "part").where("p_size < 50").selectExpr("p_partkey AS course"), "course", "left_semi").select("course", "term")
    return closure.failure_report(tables.prerequisites(spark, sf_dir), audit.offer_parity(offers))


def highlight_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of three intents on the courses of sizes up to 10, in turn, and of one that shows nothing."""
    intent = "element_at(array('prerequisite_chain', 'dependents', 'trajectory_planning', 'faqs'), int(p_partkey % 4) + 1)"
    asked = table(spark, sf_dir, "part").where("p_size <= 10").selectExpr("p_partkey AS id", f"{intent} AS intent", "p_partkey AS course")
    return closure.highlights(tables.prerequisites(spark, sf_dir), asked)


def _structure(spark: SparkSession, sf_dir: str, threshold: float = 0.08) -> DataFrame:
    return similarity.structural(similarity.signatures(tables.prerequisites(spark, sf_dir), tables.teaches(spark, sf_dir)), threshold)


def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir)


def find_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other courses; the threshold holds for the blend only."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS v")
    vectors = vectors.join(tables.courses(spark, sf_dir).selectExpr("course AS id"), "id", "left_semi")
    return similarity.find_similar(_structure(spark, sf_dir, 0.0), vectors, 5)


def predict_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = similarity.top_similar(_structure(spark, sf_dir), 5).select("course", "similar")
    return similarity.predict_missing(similar, tables.prerequisites(spark, sf_dir))


def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.name_jaccard(table(spark, sf_dir, "part").selectExpr("p_name AS name"), 0.3)


def recommended_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses are vectors, each compared with all others; the order is the term, else the depth (all have terms here)."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS v")
    reach = closure.ancestors(tables.prerequisites(spark, sf_dir), nodes=vectors.selectExpr("id AS node"))
    order = tables.courses(spark, sf_dir).selectExpr("course AS id", "term AS position")
    return similarity.recommended_before(vectors, reach, order, threshold=0.3)


def recommended_in_programmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recommended_before, with the terms of several programmes a course: earlier in one that both are in, unless no such programme has terms for both."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS v")
    # only courses that have a vector are closed and placed
    places = tables.places(spark, sf_dir).withColumnRenamed("course", "id").join(shuffled(vectors.select("id")), "id", "left_semi")
    order = places.groupBy("id").agg(F.collect_list(F.struct("programme", F.col("term").cast("double").alias("term"))).alias("places"))
    reach = closure.ancestors(tables.prerequisites(spark, sf_dir), nodes=vectors.selectExpr("id AS node"))
    return similarity.recommended_before(vectors, reach, order, threshold=0.3)


def base_of_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts are part types: every course requires and covers its own, more or less surely."""
    part = table(spark, sf_dir, "part")
    requires = part.selectExpr("p_partkey AS course", "p_type AS concept", "(50 + p_size) / 100.0D AS conf")
    covers = part.selectExpr("p_partkey AS course", "p_type AS concept", "(40 + p_size) / 100.0D AS conf")
    known = tables.courses(spark, sf_dir).select("course", "name", "term")
    # only concepts go along the edges, as numbers
    numbers = closure.numbered(covers.select("concept"))
    of = lambda rows: rows.join(shuffled(numbers), "concept").select(F.col("course").alias("node"), "item")
    covered = closure.inherited(tables.prerequisites(spark, sf_dir), of(covers), of(requires)).join(shuffled(numbers), "item").select("node", "concept")
    return orders.base_of_concepts(requires, covers, covered, tables.places(spark, sf_dir), known)


def base_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts are part types and brands: a course requires the type that its brand mate covers."""
    part = table(spark, sf_dir, "part")
    requires = part.where("p_size <= 3").selectExpr("p_partkey AS course", "p_type AS concept", "(50 + p_size) / 100.0D AS conf")
    covers = part.where("p_size >= 48").selectExpr("p_partkey AS course", "p_type AS concept", "(40 + p_size) / 100.0D AS conf")
    # ties to courses that neither require nor cover aren't asked for
    ends = requires.select(F.col("course").alias("node")).unionAll(covers.select("course")).distinct()
    return similarity.concept_base(requires, covers, closure.ancestors(tables.prerequisites(spark, sf_dir), nodes=ends))


def structured_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on every course: a code, a supplier of its second order lines as teacher, and two other courses as prerequisites at any distance."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    edges = tables.prerequisites(spark, sf_dir)
    names = part.selectExpr("p_partkey AS id", "p_name AS value")
    others = part.select(F.lit("prereq").alias("kind"), F.col("p_partkey").alias("course"), F.explode(F.expr("array(p_partkey div 4, p_partkey - 1)")).alias("id"))
    needed = others.join(shuffled(names), "id").select("kind", "course", "value")
    # of the names of all that a course needs, only those that decide a claim on it
    numbers = closure.numbered(names.select("value").where(text.text_key("value") != ""))
    own = names.join(shuffled(numbers), "value").select(F.col("id").alias("node"), "item")
    chain = closure.inherited(edges, own, validation.deciding(needed, numbers).withColumnRenamed("course", "node")).join(shuffled(numbers), "item").select(F.lit("prereq").alias("kind"), F.col("node").alias("course"), "value")
    taught = tables.teaches(spark, sf_dir).selectExpr("'teacher' AS kind", "course", "teacher AS s_suppkey")
    by_name = lambda rows: rows.join(shuffled(supplier), "s_suppkey").selectExpr("kind", "course", "s_name AS value")
    known = part.selectExpr("'code' AS kind", "p_partkey AS course", "concat('C', p_partkey) AS value").unionAll(chain).unionAll(by_name(taught))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").selectExpr("'teacher' AS kind", "l_partkey AS course", "l_suppkey AS s_suppkey").distinct()
    codes = part.selectExpr("'code' AS kind", "p_partkey AS course", "concat('no. ', p_partkey + if(p_partkey % 5 = 0, 1, 0)) AS value")
    return validation.check_structured(codes.unionAll(needed).unionAll(by_name(lines)), known)


_STRUCTURE_ALL = (
    with_views("dag", "teaches")
    + """, own AS (SELECT DISTINCT dst AS course, src AS item FROM dag),
fellow AS (SELECT DISTINCT a.src AS course, b.src AS item FROM dag a JOIN dag b USING (dst) WHERE a.src <> b.src),
rows_ AS (
  SELECT 'prereqs' AS part, course, item FROM own
  UNION ALL SELECT 'teachers', course, teacher FROM teaches
  UNION ALL SELECT DISTINCT 'dependents', src, dst FROM dag
  UNION ALL SELECT 'co_prereqs', course, item FROM fellow f WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.course = f.course AND o.item = f.item)
  UNION ALL SELECT DISTINCT 'prereqs_2', a.course, b.item FROM own a JOIN own b ON a.item = b.course
    WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.course = a.course AND o.item = b.item)),
w AS (SELECT * FROM (VALUES ('prereqs', 0.35::DOUBLE), ('teachers', 0.30), ('dependents', 0.20), ('co_prereqs', 0.10), ('prereqs_2', 0.05)) t(part, weight)),
n AS (SELECT part, course, count(*) AS n FROM rows_ GROUP BY ALL),
c AS (SELECT x.part, x.course AS a, y.course AS b, count(*) AS c FROM rows_ x JOIN rows_ y USING (part, item) WHERE x.course < y.course GROUP BY ALL),
p AS (SELECT DISTINCT a, b FROM c),
structure AS (
  SELECT p.a, p.b, round(sum(weight * coalesce(c.c, 0) / (coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(c.c, 0))) / sum(weight), 6) AS score
  FROM p CROSS JOIN w LEFT JOIN c ON c.a = p.a AND c.b = p.b AND c.part = w.part
  LEFT JOIN n na ON na.course = p.a AND na.part = w.part LEFT JOIN n nb ON nb.course = p.b AND nb.part = w.part
  WHERE coalesce(na.n, 0) + coalesce(nb.n, 0) > 0 GROUP BY p.a, p.b)
"""
)
_STRUCTURE = _STRUCTURE_ALL.replace("GROUP BY p.a, p.b)", "GROUP BY p.a, p.b HAVING score >= 0.08)")
_TOP = """, both_ AS (SELECT a AS course, b AS "similar", score FROM {0} UNION ALL SELECT b, a, score FROM {0}),
top AS (SELECT course, row_number() OVER (PARTITION BY course ORDER BY score DESC, "similar")::INTEGER AS rank, "similar", score FROM both_ QUALIFY rank <= 5)
"""
_PLAN = (
    with_views("dag", recursive=True)
    + """, walk AS (SELECT src, dst FROM dag UNION SELECT w.src, d.dst FROM walk w JOIN dag d ON w.dst = d.src),
done AS (SELECT p_partkey AS course FROM part WHERE p_size % 5 = 0),
targets AS (SELECT p_partkey AS target FROM part WHERE p_size = 7),
need AS (
  SELECT target, src AS course FROM walk JOIN targets ON dst = target WHERE src NOT IN (FROM done)
  UNION SELECT target, target FROM targets WHERE target NOT IN (FROM done)),
inner_ AS (SELECT x.target, src, dst FROM dag JOIN need x ON dst = x.course JOIN need y ON src = y.course AND x.target = y.target),
layer AS (SELECT target, course, 1 AS layer FROM need UNION SELECT i.target, i.dst, layer + 1 FROM layer l JOIN inner_ i ON i.target = l.target AND i.src = l.course),
plan AS (SELECT target, max(layer)::INTEGER AS layer, course FROM layer GROUP BY target, course)
"""
)

SQL = {
    "graph_nodes_by_kind": STAR + "SELECT kind, count(*) AS nodes FROM nodes GROUP BY kind",
    "graph_edges_by_relation": STAR + "SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY relation",
    "graph_lint": STAR
    + f"""SELECT 'duplicate_name' AS problem, kind || '|' || {KEY.format("name")} AS subject, count(*) AS detail FROM nodes GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'no_edges', node_id, 0 FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)
UNION ALL SELECT 'unknown_node', id, 0 FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT DISTINCT 'two_way', a.src || '|' || a.dst, 0 FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src AND a.relation = b.relation WHERE a.src <= a.dst""",
    "graph_export": STAR
    + """SELECT 'node' AS element, '{"id":"' || node_id || '","kind":"' || kind || '","label":"' ||
  CASE WHEN length(name) <= 12 THEN name ELSE regexp_replace(substr(name, 1, 12), ' [^ ]*$', '') || '…' END || '"}' AS payload FROM nodes
UNION ALL SELECT 'edge', '{"src":"' || src || '","dst":"' || dst || '","relation":"' || relation || '"}' FROM edges""",
    "direct_prereqs": DAG + "SELECT dst AS node, src AS neighbour, conf FROM dag WHERE conf >= 0.7",
    "dependents": DAG + "SELECT src AS node, dst AS neighbour, conf FROM dag",
    "teachers_of_course": STAR + "SELECT dst AS node, src AS neighbour FROM edges WHERE relation = 'TEACHES'",
    "areas_of_teacher": STAR + "SELECT src AS node, dst AS neighbour FROM edges WHERE relation = 'EXPERT_IN'",
    "critical_nodes": DAG + "SELECT src AS node, count(DISTINCT dst) AS dependents FROM dag GROUP BY src HAVING count(DISTINCT dst) >= 3",
    "co_prereqs": DAG + "SELECT a.src AS node, b.src AS other, count(DISTINCT a.dst) AS shared FROM dag a JOIN dag b ON a.dst = b.dst AND a.src <> b.src GROUP BY ALL",
    "unlocked_courses": with_views("dag", "transcript")
    + """, done AS (SELECT DISTINCT student, course FROM transcript WHERE grade >= 5),
have AS (SELECT student, dst, count(DISTINCT src) AS n FROM done JOIN dag ON course = src GROUP BY ALL)
SELECT student, h.dst AS course FROM have h WHERE n = (SELECT count(DISTINCT src) FROM dag d WHERE d.dst = h.dst)
AND NOT EXISTS (SELECT 1 FROM done WHERE done.student = h.student AND done.course = h.dst)""",
    "entity_lookup": STAR
    + f""", named AS (SELECT *, {KEY.format("name")} AS k FROM nodes WHERE kind <> 'course'),
terms AS (SELECT lower(s_name) AS term FROM supplier UNION SELECT substr(n_name, 1, 4) FROM nation UNION SELECT r_name FROM region UNION SELECT ''),
keyed AS (SELECT term, {KEY.format("term")} AS k FROM terms),
exact AS (SELECT term, keyed.k, coalesce((SELECT min(node_id) FROM named WHERE named.k = keyed.k AND named.k <> ''), (SELECT min(node_id) FROM named WHERE lower(node_id) = keyed.k)) AS node_id FROM keyed),
loose AS (SELECT term, (SELECT min(node_id) FROM named WHERE exact.k <> '' AND contains(named.k, exact.k)) AS node_id FROM exact WHERE node_id IS NULL)
SELECT term, node_id, 'key' AS how FROM exact WHERE node_id IS NOT NULL
UNION ALL SELECT term, node_id, CASE WHEN node_id IS NULL THEN 'none' ELSE 'part' END FROM loose""",
    "entity_mentions": f"""WITH w AS (SELECT string_split({KEY.format("text")}, ' ') AS w FROM benchmark),
names AS (SELECT DISTINCT array_to_string(w[i:i + 1], ' ') AS name FROM (SELECT w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w)),
keyed AS (SELECT {KEY.format("name")} AS k, min(name) AS name FROM names GROUP BY k HAVING k <> ''),
d AS (SELECT doc_id, string_split({KEY.format("text")}, ' ') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[i] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
  UNION SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))
SELECT doc_id AS id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(k) DESC, name)::INTEGER AS rank FROM g JOIN keyed USING (k) QUALIFY rank <= 3""",
    "relation_dedup": with_views("teaches")
    + """, f AS (SELECT l_suppkey AS t, l_partkey AS c, max(round(1 - l_discount, 2)) AS conf FROM lineitem GROUP BY ALL)
SELECT 'TEACHER:' || t AS src, 'COURSE:' || c AS dst, conf FROM f WHERE conf < 1 AND NOT EXISTS (SELECT 1 FROM teaches WHERE teacher = t AND course = c)""",
    "graph_cycles": with_views("dag", "entangled", recursive=True)
    + """, walk AS (SELECT src, dst FROM entangled UNION SELECT w.src, e.dst FROM walk w JOIN entangled e ON w.dst = e.src),
m AS (SELECT a.src AS node, min(a.dst) AS component FROM walk a JOIN walk b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
n AS (SELECT component, count(*) AS size FROM m GROUP BY component),
s AS (SELECT e.src AS node, min(e.dst) AS next FROM entangled e JOIN m x ON x.node = e.src JOIN m y ON y.node = e.dst AND x.component = y.component GROUP BY e.src),
f AS (SELECT node AS origin, next AS node FROM s UNION SELECT origin, next FROM f JOIN s USING (node)),
r AS (SELECT component, min(origin) AS start FROM f JOIN m ON m.node = origin WHERE origin = f.node GROUP BY component),
p AS (SELECT component, start, start AS node, 0 AS step FROM r UNION ALL SELECT component, start, next, step + 1 FROM p JOIN s USING (node) WHERE next <> start)
SELECT component, size, count(*) OVER (PARTITION BY component) AS length, step::BIGINT AS step, node FROM p JOIN n USING (component)""",
    "plan_gaps": with_views("dag", "entangled", recursive=True)
    + """, done AS (SELECT p_partkey AS course FROM part WHERE p_size % 7 = 0),
targets AS (SELECT p_partkey AS target FROM part WHERE p_size = 3),
up AS (SELECT target, target AS course FROM targets UNION SELECT target, src FROM up JOIN entangled ON dst = course),
need AS (SELECT * FROM up ANTI JOIN done USING (course)),
e AS (SELECT DISTINCT x.target, src, dst FROM need x JOIN entangled ON dst = x.course JOIN need y ON y.target = x.target AND y.course = src),
walk AS (SELECT target, src, dst FROM e UNION SELECT w.target, w.src, e.dst FROM walk w JOIN e ON e.target = w.target AND e.src = w.dst)
SELECT target, course, CASE WHEN (target, course, course) IN (SELECT target, src, dst FROM walk) THEN 'cycle' ELSE 'behind' END AS reason
FROM need WHERE EXISTS (SELECT 1 FROM walk a JOIN walk b ON a.target = b.target AND a.src = b.src AND b.src = b.dst
  WHERE a.target = need.target AND (a.dst = need.course))""",
    "extraction_stats": STAR
    + """SELECT 'relation' AS measure, relation AS item, count(*) AS n, round(avg(conf), 6) AS mean_confidence FROM edges GROUP BY relation
UNION ALL SELECT 'endpoint', split_part(node, ':', 1), count(*), round(avg(conf), 6) FROM (SELECT unnest([src, dst]) AS node, conf FROM edges) GROUP BY 2""",
    "relation_validate": STAR
    + """SELECT CASE WHEN relation IN ('TEACHES', 'PREREQUISITE_OF', 'OFFERS') THEN relation ELSE 'RELATED_TO' END AS relation, count(*) AS n,
  round(sum(greatest(0, least(conf, 1))), 4) AS conf FROM edges GROUP BY 1""",
    "ancestors": REACH + "SELECT dst AS node, src AS ancestor, hops FROM reach",
    "ancestors_confident": REACH.replace("FROM dag UNION SELECT", "FROM dag WHERE conf >= 0.7 UNION SELECT").replace("ON w.dst = d.src)", "ON w.dst = d.src AND d.conf >= 0.7)")
    + "SELECT dst AS node, src AS ancestor, hops FROM reach",
    "descendants": REACH + "SELECT src AS node, count(*) AS descendants, max(hops) AS farthest FROM reach GROUP BY src",
    "bounded_chain": DAG
    + """, two AS (SELECT src, dst, 1 AS hops FROM dag UNION ALL SELECT a.src, b.dst, 2 FROM dag a JOIN dag b ON a.dst = b.src)
SELECT dst AS node, src AS ancestor, min(hops)::INTEGER AS hops FROM two GROUP BY src, dst""",
    "bottleneck_bound": with_views("dag", recursive=True)
    + """, b AS (SELECT src, dst, conf AS bound FROM dag UNION SELECT b.src, d.dst, least(bound, conf) FROM b JOIN dag d ON b.dst = d.src)
SELECT src, dst, max(bound) AS bound, 1.0::DOUBLE AS high FROM b GROUP BY src, dst""",
    "dag_depth": with_views("dag", recursive=True)
    + """, d AS (SELECT p_partkey AS node, 0 AS depth FROM part UNION SELECT dst, depth + 1 FROM d JOIN dag ON src = node)
SELECT node, max(depth)::INTEGER AS depth FROM d GROUP BY node""",
    "plan_layers": _PLAN + "SELECT * FROM plan",
    "path_confidence": _PLAN + "SELECT target, course, min(conf) AS confidence FROM plan JOIN dag ON dst = course GROUP BY ALL HAVING min(conf) < 1",
    "structured_claims": with_views("dag", "teaches", recursive=True)
    + """, walk AS (SELECT src, dst FROM dag UNION SELECT w.src, d.dst FROM walk w JOIN dag d ON w.dst = d.src),
known AS (
  SELECT 'code' AS kind, p_partkey AS course, p_partkey::VARCHAR AS fact FROM part
  UNION SELECT 'teacher', course, lower(s_name) FROM teaches JOIN supplier ON s_suppkey = teacher
  UNION SELECT 'prereq', dst, lower(p_name) FROM walk JOIN part ON p_partkey = src),
claimed AS (
  SELECT 'code' AS kind, p_partkey AS course, 'no. ' || (p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) AS value FROM part
  UNION SELECT 'teacher', l_partkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 2
  UNION SELECT 'prereq', a.p_partkey, b.p_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 4 OR b.p_partkey = a.p_partkey - 1)
SELECT kind, course, value, CASE WHEN count(fact) = 0 THEN 'unknown'
  WHEN max(CASE WHEN kind = 'code' THEN replace(value, 'no. ', '') = fact ELSE contains(fact, lower(value)) OR contains(lower(value), fact) END) THEN 'ok' ELSE 'violation' END AS verdict
FROM claimed LEFT JOIN known USING (kind, course) GROUP BY kind, course, value""",
    "highlight_parts": REACH
    + """, q AS (SELECT p_partkey AS id, p_partkey % 4 AS i FROM part WHERE p_size <= 10 AND p_partkey % 4 < 3),
r AS (
  SELECT id, id AS node, 0 AS rank, '' AS rule FROM q
  UNION ALL SELECT id, src, CASE WHEN hops = 1 THEN 0 ELSE 1 END, CASE WHEN hops = 1 THEN '' WHEN i = 2 THEN 'minimal_path' ELSE 'prereq_transitivity' END FROM q JOIN reach ON dst = id WHERE i IN (0, 2)
  UNION ALL SELECT id, dst, 0, '' FROM q JOIN dag ON src = id WHERE i = 1
  UNION ALL SELECT id, b.src, 2, 'co_prerequisite' FROM q JOIN dag a ON a.src = id JOIN dag b ON b.dst = a.dst AND b.src <> id WHERE i = 0)
SELECT id, node, CASE WHEN min(rank) = 0 THEN 'base' ELSE 'inferred' END AS part, arg_min(rule, rank) AS rule FROM r GROUP BY id, node""",
    "failure_report": REACH
    + """SELECT src AS node, count(*) FILTER (hops = 1) AS direct, count(*) AS transitive, max(hops)::INTEGER AS depth, count(*) FILTER (hops = 1) >= 2 AS critical,
  any_value(CASE WHEN p_size < 50 THEN CASE WHEN (1 + p_size % 10) % 2 = 1 THEN 'odd' ELSE 'even' END END) AS parity FROM reach JOIN part ON p_partkey = src GROUP BY src""",
    "failure_impact": REACH
    + """SELECT src AS node, count(*) FILTER (hops = 1) AS direct, count(*) AS transitive, max(hops)::INTEGER AS depth, count(*) FILTER (hops = 1) >= 2 AS critical FROM reach GROUP BY src""",
    "structural_similarity": _STRUCTURE + "SELECT * FROM structure",
    "find_similar": _STRUCTURE_ALL
    + """, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings JOIN part ON p_partkey = vec_id),
near AS (SELECT x.id AS a, y.id AS b, coalesce(list_cosine_similarity(x.e, y.e), 0) AS near FROM v x JOIN v y ON x.id < y.id),
blended AS (SELECT a, b, round(0.6 * coalesce(score, 0) + 0.4 * coalesce(near, 0), 6) AS score FROM structure FULL JOIN near USING (a, b)),
kept AS (SELECT * FROM blended WHERE score >= 0.08)"""
    + _TOP.format("kept")
    + "SELECT * FROM top",
    "predict_missing": _STRUCTURE
    + _TOP.format("structure")
    + """, v AS (SELECT t.course, item AS prereq, count(*) AS votes FROM top t JOIN own ON own.course = t."similar" WHERE item <> t.course GROUP BY ALL),
s AS (SELECT course, prereq, round(votes / (SELECT count(*) FROM top WHERE top.course = v.course), 6) AS share FROM v)
SELECT course, prereq, share, row_number() OVER (PARTITION BY course ORDER BY share DESC, prereq)::INTEGER AS rank FROM s
WHERE share >= 0.4 AND NOT EXISTS (SELECT 1 FROM own WHERE own.course = s.course AND own.item = s.prereq) QUALIFY rank <= 3""",
    "name_jaccard": f"""WITH n AS (SELECT DISTINCT p_name AS name, list_distinct(list_filter(string_split({KEY.format("p_name")}, ' '), lambda w: length(w) > 2)) AS t FROM part)
SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 6) AS score
FROM n a JOIN n b ON a.name < b.name WHERE len(list_intersect(a.t, b.t)) > 0 AND score >= 0.3""",
    "recommended_before": REACH
    + """, c AS (SELECT p_partkey AS id, 1 + p_size % 10 AS term FROM part),
near AS (
  SELECT x.vec_id AS a, y.vec_id AS b, round(least(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 0.99), 4) AS score
  FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id JOIN c cx ON cx.id = x.vec_id JOIN c cy ON cy.id = y.vec_id WHERE cx.term < cy.term AND score >= 0.3)
SELECT b AS course, row_number() OVER (PARTITION BY b ORDER BY score DESC, a)::INTEGER AS rank, a AS before, score FROM near
WHERE NOT EXISTS (SELECT 1 FROM reach WHERE src = a AND dst = b) AND NOT EXISTS (SELECT 1 FROM reach WHERE src = b AND dst = a) QUALIFY rank <= 3""",
    "recommended_in_programmes": with_views("dag", "places", recursive=True)
    + """, reach AS (SELECT src, dst FROM dag UNION SELECT r.src, d.dst FROM reach r JOIN dag d ON r.dst = d.src),
near AS (
  SELECT x.vec_id AS a, y.vec_id AS b, round(least(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 0.99), 4) AS score
  FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE score >= 0.3 AND x.vec_id IN (SELECT p_partkey FROM part) AND y.vec_id IN (SELECT p_partkey FROM part)),
met AS (SELECT a, b, bool_or(p.term < q.term) AS earlier FROM near JOIN places p ON p.course = a JOIN places q ON q.course = b AND q.programme = p.programme WHERE p.term IS NOT NULL AND q.term IS NOT NULL GROUP BY a, b)
SELECT b AS course, row_number() OVER (PARTITION BY b ORDER BY score DESC, a)::INTEGER AS rank, a AS before, score FROM near LEFT JOIN met USING (a, b)
WHERE earlier IS DISTINCT FROM false AND NOT EXISTS (SELECT 1 FROM reach WHERE src = a AND dst = b) AND NOT EXISTS (SELECT 1 FROM reach WHERE src = b AND dst = a) QUALIFY rank <= 3""",
    "base_of_concepts": with_views("dag", "places", "courses", recursive=True)
    + """, reach AS (SELECT src, dst FROM dag UNION SELECT r.src, d.dst FROM reach r JOIN dag d ON r.dst = d.src),
need AS (SELECT p_partkey AS course, p_type AS concept, (50 + p_size) / 100.0::DOUBLE AS need FROM part r
  WHERE NOT EXISTS (SELECT 1 FROM reach JOIN part a ON a.p_partkey = src WHERE dst = r.p_partkey AND a.p_type = r.p_type)),
cand AS (SELECT n.course, concept, need, c.p_partkey AS base, (40 + c.p_size) / 100.0::DOUBLE AS give FROM need n JOIN part c ON c.p_type = concept AND c.p_partkey <> n.course),
met AS (SELECT c.course, base, bool_or(p.term < q.term) AS earlier FROM cand c JOIN places p ON p.course = base JOIN places q ON q.course = c.course AND q.programme = p.programme
  WHERE p.term IS NOT NULL AND q.term IS NOT NULL GROUP BY ALL),
best AS (SELECT c.*, name FROM cand c LEFT JOIN met m ON m.course = c.course AND m.base = c.base JOIN courses k ON k.course = c.base WHERE earlier IS DISTINCT FROM false
  QUALIFY row_number() OVER (PARTITION BY c.course, concept ORDER BY give DESC, k.term, name, c.base) = 1),
m AS (SELECT course, base, name, max(least(need, give)) AS confidence, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM best GROUP BY ALL)
SELECT course, row_number() OVER (PARTITION BY course ORDER BY confidence DESC, name, base)::INTEGER AS rank, base, confidence, concepts FROM m QUALIFY rank <= 6""",
    "base_recommended": REACH
    + """, f AS (
  SELECT r.p_partkey AS course, c.p_partkey AS base, r.p_type AS concept, least((50 + r.p_size) / 100.0::DOUBLE, (40 + c.p_size) / 100.0::DOUBLE) AS confidence
  FROM part r JOIN part c USING (p_type) WHERE r.p_size <= 3 AND c.p_size >= 48),
g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM reach WHERE src = base AND dst = course) AND NOT EXISTS (SELECT 1 FROM reach WHERE src = course AND dst = base)
  QUALIFY row_number() OVER (PARTITION BY course, concept ORDER BY confidence DESC, base) = 1),
h AS (SELECT course, base, max(confidence) AS confidence FROM g GROUP BY ALL)
SELECT course, base, confidence, row_number() OVER (PARTITION BY course ORDER BY confidence DESC, base)::INTEGER AS rank FROM h QUALIFY rank <= 6""",
}

QUERIES = {name: globals()[name] for name in SQL}
