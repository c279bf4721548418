"""Queries on dates, links, gates, follow-ups, subgraphs, crawls and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import dates, text, urls
from quarry.lineage import checkpoint, remove, shared_dir
from quarry.operators import closure, grounding, names, repair, retrieval, routing, validation
from quarry.sources import grids, markdown, web
from quarry.streaming import events, state
from quarry.tables import table, with_views
from quarry.workload import dialogue
from quarry.workload.graph import KEY, REACH
from quarry.workload.retrieval import _BM25

SUGGESTIONS = [("other", 1, "the"), ("other", 2, "What comes next?"), ("other", 3, "Who teaches it?"), ("other", 4, "Where is it?"), ("definition", 1, "Show an example"), ("plan", 1, "Show the plan")]


def semester_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parity = F.when(F.col("o_orderpriority") < "2", "odd").when(F.col("o_orderpriority") < "4", "even").otherwise("both")
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.semester(day).alias("semester"), dates.semester(day, 1).alias("following"), dates.next_offer(day, parity).alias("offer"), dates.display(day).alias("shown")
    )


def link_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page's URL with a broken host, against the pages' URLs."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id").alias("id"), F.expr("if(page_id % 2 = 0, regexp_replace(url, '://[^/]+', '://broken.example'), url)").alias("url"))
    return repair.repair_links(found, pages)


def answer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers on pages with links that were cut or changed, against contexts of two pages of which only one has the fragment."""
    page = table(spark, sf_dir, "pages").selectExpr("page_id", "concat('https://site.example/a/section-', page_id) AS url")
    context = F.expr("concat('see ', url, '#part', page_id, ' and (', url, '-other) or https://site.example/b')")
    said = F.expr("concat('At https://site.exam/section-', page_id, ', or <http://x.org/y#part', page_id, '>. Also https://site.example/b! https://site.example/zz')")
    return page.select("page_id", repair.links_in_text(said, context).alias("answer"))


def organs_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as organs that articles, one for each supplier, name: a nation alone, or with its region as a longer name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    organs = nation.selectExpr("n_name AS name", "n_name AS organ").unionAll(region.selectExpr("r_name", "r_name")).unionAll(named.selectExpr("concat('Council da ', n_name, ' ', r_name)", "concat(r_name, '/', n_name)"))
    said = table(spark, sf_dir, "supplier").join(named, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = said.selectExpr("'rules' AS path", "cast(s_suppkey AS int) AS number", "if(s_suppkey % 2 = 0, concat('The council, ', n_name, ' (', r_name, ').'), concat('As ', lower(n_name), ' says, ', r_name)) AS body")
    return markdown.organ_mentions(rows, organs)


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(repair.english("text")).alias("english"), F.count("*").alias("documents"))


def short_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    said = F.when(F.col("turn") % 3 == 0, F.lit("Sim, por favor!")).when(F.col("turn") % 3 == 1, F.lit("vai ser ótimo")).otherwise(words)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(repair.accepts(said)).alias("accepted"), F.count("*").alias("turns"))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answers = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), routing.first_match("text", dialogue.INTENTS, "other").alias("intent"), "text")
    return repair.suggestions(answers, spark.createDataFrame(SUGGESTIONS, "intent string, at int, suggestion string"))


def answer_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = repair.split_footer("text", ". ")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(before).alias("body"), F.length(after).alias("footer"))


def activity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("event_type"), F.lit(" "), F.floor("value").cast("string"), F.lit(" h, talk 2,5h; walk"))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(routing.activities(said)).alias("at", "a"))
    return rows.select("event_id", "at", F.col("a.item").alias("item"), F.col("a.hours").alias("hours"))


def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct edges between the courses of a term."""
    some = tables.courses(spark, sf_dir).where("term <= 5").select("course")
    edges = tables.prerequisites(spark, sf_dir)
    return edges.join(some.withColumnRenamed("course", "src"), "src", "left_semi").join(some.withColumnRenamed("course", "dst"), "dst", "left_semi").select("src", "dst", "conf")


def highlight_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inference adds to the direct edges, by course."""
    reach = closure.ancestors(tables.prerequisites(spark, sf_dir))
    return reach.where("hops > 1").groupBy("node").agg(F.count("*").alias("inferred"), F.min("ancestor").alias("first"), F.max("hops").alias("farthest"))


def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as far as three links from the first ten: page p links to 2p + 1 and to the pages it names."""
    links = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("src"), F.explode(F.expr("array(string(page_id * 2 + 1), string(page_id * 3 + 2))")).alias("dst"))
    return web.crawl_order(links, spark.range(10).selectExpr("cast(id AS string) AS url"), 3)


#: References of many kinds, added to each page's own.
REFERENCES = ("../up/{0}?x=1", "./a/../b/", "c/./d/.", "/r/../../s/{0}/", "//Other.example.org/p/../q", "?only=query", "../../../far/..", "mailto:a@example.org", "t/{0}.pdf", "u;v=1/../w")


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the links of every page lead to, and ten more references on it: canonical, without documents of other kinds."""
    added = F.concat(*(F.concat(F.lit(f'<a href="{before}'), (F.col("page_id").cast("string") if more else F.lit("")), F.lit(f'{after}">')) for r in REFERENCES for before, more, after in [r.partition("{0}")]))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", added).alias("html"))
    return pages.select("page_id", F.explode(urls.links("html", "url", skip_end=r"\.(?:pdf|zip)")).alias("target"))


def crawl_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 pages of a site whose pages link to two others each, by relative references, from ten seeds."""
    page = "https://site.example/d/{}"
    pages = table(spark, sf_dir, "pages").selectExpr(
        f"concat('{page.format('')}', page_id) AS url", """concat(html, '<a href="../d/', page_id * 2 + 1, '?x=1">', '<a href="', page_id * 3 + 2, '">', '<a href="/d/', page_id div 2, '/">') AS html"""
    )
    seeds = table(spark, sf_dir, "pages").where("page_id < 10").selectExpr(f"concat('{page.format('')}', page_id) AS url", "-page_id AS at")
    return web.crawl(pages, seeds, 150, 3, scopes=(("site.example", "/d/"),))


def nested_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pairs and triples of the first eight words of each benchmark item stand in documents, without those within longer ones."""
    w = table(spark, sf_dir, "benchmark").select(F.slice(F.split(text.graph_key("text"), " "), 1, 8).alias("w"))
    names_ = w.select(F.explode(F.expr("flatten(transform(array(2, 3), n -> transform(sequence(1, greatest(size(w) - n + 1, 1)), i -> array_join(slice(w, i, n), ' '))))")).alias("name")).distinct()
    found = grounding.spans(table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text"), names_.select("name", F.col("name").alias("target")))
    return grounding.outermost(found).select("id", "first", "last", "target")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question on every part: with its name, two words of it, a term that says nothing, a person's first or last name only, or nothing known, as term."""
    part = table(spark, sf_dir, "part")
    term = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN substring(p_name, 3, 9) WHEN 2 THEN concat('that one ', p_partkey) WHEN 3 THEN '' ELSE 'the teacher' END"
    said = "CASE p_partkey % 6 WHEN 4 THEN concat('and what gives supplier ', p_partkey % 30) WHEN 5 THEN 'and nobody at all' ELSE concat('tell me, of ', p_name, ' say, or ', substring_index(p_name, ' ', 2)) END"
    return part.selectExpr("p_partkey AS id", f"{said} AS text", f"{term} AS term")


def grounded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on parts, grounded among part names and prefixes of two words of them; what is left by a supplier's own number."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nodes = part.selectExpr("cast(p_partkey AS string) AS node_id", "p_name AS name")
    short = part.selectExpr("substring_index(p_name, ' ', 2) AS name", "concat('short ', substring_index(p_name, ' ', 2)) AS target").distinct()
    whole = nodes.selectExpr("name", "node_id AS target")
    aliases = supplier.selectExpr("concat('supplier ', s_suppkey % 50) AS name", "concat('S', s_suppkey) AS target")
    only = aliases.groupBy("name").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    keys = {"name": text.graph_key("name"), "code": F.lower("node_id")}
    return grounding.ground(_asked(spark, sf_dir), nodes, keys, whole.unionAll(short), only)


def track_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a track for each part type rests on: concepts are the longest four words of its first part's name that name parts; areas are part types and names of teachers' parts."""
    part = table(spark, sf_dir, "part")
    covers = part.select(F.explode(F.split("p_name", " ")).alias("concept"), F.col("p_partkey").alias("course")).distinct()
    wanted = part.groupBy(F.col("p_type").alias("id")).agg(F.min_by("p_name", "p_partkey").alias("name"))
    words = wanted.select("id", F.explode(F.array_distinct(F.split("name", " "))).alias("concept"))
    concepts = words.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("concept")), "concept"))).where("r <= 4").drop("r")
    base = part.selectExpr("p_partkey AS course", "explode(array(struct(p_partkey div 2 AS base, 1 AS rank), struct(p_partkey div 3 AS base, 2 AS rank), struct(p_partkey div 5 AS base, 3 AS rank))) AS b").select("course", "b.*").where("base > 0")
    experts = tables.teaches(spark, sf_dir).join(part.selectExpr("p_partkey AS course", "substring_index(p_name, ' ', 2) AS area"), "course").select("teacher", "area").distinct()
    return grounding.track_support(concepts, covers, base, experts)


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part type, with a table of its parts: brands span their rows, the head has two rows, and a part lists those it follows."""
    part = table(spark, sf_dir, "part").withColumn("n", F.count("*").over(Window.partitionBy("p_type", "p_brand"))).withColumn("i", F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_partkey")))
    brand = F.when(F.col("i") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">'), "p_brand", F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), brand, F.format_string("<td>%d</td><TD><b>%s</b> &amp; more<td>%d; %d , -</tr>", "p_partkey", "p_name", F.expr("p_partkey div 2"), F.expr("if(p_size = 1, 900000000 + p_partkey, p_partkey div 3)")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "p_partkey", row.alias("row")))), lambda s: s["row"]), "")
    head = '<table class="x"><tr><th rowspan=2>Brand<th colspan="2">Course</th><th rowspan="2">After</th></tr><tr><th>No.</th><th>Name</th></tr>'
    return part.groupBy(F.col("p_type").alias("page_id")).agg(F.concat(F.lit("<p>" + head), rows, F.lit("</table></p>")).alias("html"))


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published tables of every part type back as records."""
    fields = lambda name: F.col("fields")[name]
    found = grids.records(grids.grid(_published(spark, sf_dir)))
    return found.select("page_id", "row", fields("Brand").alias("brand"), fields("Course / No.").cast("long").alias("course"), fields("Course / Name").alias("name"), fields("After").alias("after"))


def published_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the published tables would add to the prerequisite edges: the unknown numbers that parts of size 1 list can't be resolved, the edges of even parts are there already."""
    pairs = grids.seeds(grids.records(grids.grid(_published(spark, sf_dir))), "course / no.", "AFTER")
    nodes = table(spark, sf_dir, "part").selectExpr("cast(p_partkey AS string) AS node_id")
    edges = tables.prerequisites(spark, sf_dir).where("dst % 2 = 0").selectExpr("cast(src AS string) AS src", "cast(dst AS string) AS dst", "'PREREQUISITE_OF' AS relation", "conf")
    return grids.seed_edges(pairs, nodes, {"code": F.col("node_id")}, edges, "PREREQUISITE_OF")[1]


def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.section_label("url").alias("label"))


def topic_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention a license, with a preview."""
    some = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return some.select("doc_id", F.substring("text", 1, 200).alias("preview"))


def fuzzy_name_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    terms = part.selectExpr("split(p_name, ' ')[0] AS term").unionAll(part.selectExpr("p_name")).unionAll(part.selectExpr("substring(p_name, 2, 5)")).distinct()
    return repair.fuzzy_names(terms, part.selectExpr("p_name AS name"))


def fuzzy_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    terms = part.selectExpr("concat(p_name, 's') AS term").unionAll(part.selectExpr("split(p_name, ' ')[0]")).unionAll(part.selectExpr("lower(p_brand)")).unionAll(part.selectExpr("concat(split(p_name, ' ')[1], ' course')"))
    return names.fuzzy_courses(terms, part.selectExpr("p_name AS name", "if(p_name < 'c', p_brand, null) AS acronym"))


def person_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as people, named in full or by their last word, and the suppliers' notes as texts."""
    people = table(spark, sf_dir, "nation").selectExpr("n_name AS person")
    notes = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS item", "concat('Offered by ', s_name, ' of ', lower(n_name)) AS text")
    return names.by_person(people, notes, 10)


def display_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('introducao de ', p_name, ' e mais') WHEN 2 THEN substring(p_name, 1, 3) ELSE initcap(p_name) END")
    return table(spark, sf_dir, "part").select("p_partkey", names.display_case(term).alias("shown"), names.blocked_programme(F.expr("if(p_partkey % 3 = 0, concat(p_brand, ' institute'), p_brand)")).alias("blocked"))


def list_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lists of their lines, against texts that lack some letters or their end."""
    before = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    after = F.expr("if(doc_id % 2 = 0, replace(text, 'on', ''), substring(text, 1, int(length(text) * 0.85)))")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", validation.list_items_kept(before, after).alias("kept"))


def lateral_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each item; items with a thin one get the documents of the next ids too."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS doc", "text")
    best = checkpoint(retrieval.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").selectExpr("item_id AS query", "text"), 1).select("query", "doc"))
    # the few rows go to the texts, not the texts to them; what was found is read again, not looked for again
    texts = lambda rows: checkpoint(docs.join(retrieval.few(rows, retrieval.MAX_BROADCAST_TERMS), "doc").select("query", "doc", "text"))
    context, more = texts(best), texts(best.select("query", F.explode(F.expr("array(doc + 1, doc + 2)")).alias("doc")))
    return repair.with_fallback(context, more, 2000).select("query", "doc", F.length("text").alias("size"))


def compose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    artefact = F.nullif(F.regexp_extract("text", "([A-Za-z]{10,})", 1), F.lit(""))
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("at"), "text", F.length("text").alias("confidence"), artefact.alias("artefact"))
    out = repair.compose(parts)
    return out.select("question", "parts", F.md5("answer").alias("digest"), "confidence", "artefact")


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in as a stream, each id once, and counted by hour from what the stream wrote."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    query = events.run(events.distinct_events(stream), f"{place}/out", f"{place}/checkpoint")
    query.awaitTermination()
    by = spark.read.schema(events.EVENTS).parquet(f"{place}/out").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = checkpoint(by.select(F.col("w.start").alias("hour"), "event_type", "n"))
    remove(spark, place)
    return out


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that expire while all events are taken in as a stream: 24 hours after their last event, two hours of delay; a purchase empties the items."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    turns = stream.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("number"), F.nullif("event_type", F.lit("view")).alias("entity"), F.get_json_object("props", "$.k").alias("item"), (F.col("event_type") == "purchase").alias("reset"))
    state.use_store(spark)
    events.run(state.sessions(turns), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    out = checkpoint(spark.read.schema(state.SESSIONS).parquet(f"{place}/out").withColumn("items", F.array_join("items", ",")))
    remove(spark, place)
    return out


_SEMESTER = "(({0}) // 2) || '/' || (({0}) % 2 + 1)"
_NUMBER = "(year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END)"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"
_TAIL = "(CASE WHEN length({0}) >= 6 THEN {0} END)".format("regexp_extract(regexp_replace(regexp_extract({0}, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '[^/]*$')")
_SAID = "CASE WHEN turn % 3 = 0 THEN 'Sim, por favor!' WHEN turn % 3 = 1 THEN 'vai ser ótimo' ELSE array_to_string(string_split(text, ' ')[1:3], ' ') END"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"

SQL = {
    "semester_of_order": f"""SELECT o_orderkey, {_SEMESTER.format(_NUMBER)} AS semester, {_SEMESTER.format(_NUMBER + " + 1")} AS "following",
  {_SEMESTER.format(_NUMBER + " + CASE WHEN o_orderpriority >= '4' OR (o_orderpriority < '2') = (month(o_orderdate) > 6) THEN 1 ELSE 2 END")} AS offer,
  day(o_orderdate) || ' de ' || {_MONTHS}[month(o_orderdate)] || ' de ' || year(o_orderdate) AS shown FROM orders""",
    "link_repair": f"""WITH f AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '://[^/]+', '://broken.example') ELSE url END AS url FROM pages),
u AS (SELECT {_TAIL.format("url")} AS tail, min(url) AS fixed FROM (SELECT DISTINCT url FROM pages) GROUP BY 1 HAVING count(*) = 1)
SELECT id, f.url, CASE WHEN f.url IN (SELECT url FROM pages) THEN f.url ELSE coalesce(u.fixed, f.url) END AS fixed FROM f LEFT JOIN u ON u.tail = {_TAIL.format("f.url")}""",
    "answer_links": """SELECT page_id, 'At https://site.example/a/section-' || page_id || '#part' || page_id || ', or <https://site.example/a/section-' || page_id || '#part' || page_id || '>. Also https://site.example/b! https://site.example/zz' AS answer FROM pages""",
    "organs_named": """WITH s AS (SELECT s_suppkey::INTEGER AS number, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT 'rules' AS path, number, unnest(CASE WHEN number % 2 = 0 THEN [r_name || '/' || n_name] ELSE [n_name, r_name] END) AS organ FROM s""",
    "language_gate": "SELECT lang, count(*) FILTER ("
    + " + ".join(f"contains(lower(text), '{w}')::INT" for w in repair.ENGLISH)
    + " >= 3) AS english, count(*) AS documents FROM documents GROUP BY lang",
    "short_acceptance": f"""WITH s AS (SELECT role, list_filter(string_split(regexp_replace(translate(lower({_SAID}), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[!?.,;:\\s]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM conversations)
SELECT role, count(*) FILTER (len(w) BETWEEN 1 AND 5 AND len(list_filter(w, lambda x: x NOT IN {_IN(repair.ACCEPTS)})) = 0 AND len(list_filter(w, lambda x: x IN {_IN(repair.STRONG)})) > 0) AS accepted,
  count(*) AS turns FROM s GROUP BY role""",
    "follow_ups": f"""WITH t AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {b}, '{c}')" for a, b, c in SUGGESTIONS)}) t(intent, "at", suggestion)),
a AS (SELECT conv_id * 1000 + turn AS id, {dialogue._case()} AS intent, text FROM conversations WHERE role = 'assistant')
SELECT id, row_number() OVER (PARTITION BY id ORDER BY "at")::INTEGER AS rank, suggestion FROM a JOIN t USING (intent) WHERE NOT contains(lower(text), lower(suggestion)) QUALIFY rank <= 3""",
    "answer_footer": """WITH p AS (SELECT doc_id, text, contains(text, '. ') AS has, length(list_last(string_split(text, '. '))) AS l FROM documents)
SELECT doc_id, (CASE WHEN has THEN length(text) - l - 2 ELSE length(text) END)::INTEGER AS body, (CASE WHEN has THEN l END)::INTEGER AS footer FROM p""",
    "activity_parse": """SELECT event_id, 0 AS "at", event_type AS item, floor(value)::DOUBLE AS hours FROM events UNION ALL SELECT event_id, 1, 'talk', 2.5 FROM events""",
    "subgraph_edges": with_views("dag", "courses")
    + "SELECT src, dst, conf FROM dag WHERE src IN (SELECT course FROM courses WHERE term <= 5) AND dst IN (SELECT course FROM courses WHERE term <= 5)",
    "highlight_diff": REACH + "SELECT dst AS node, count(*) AS inferred, min(src) AS first, max(hops)::INTEGER AS farthest FROM reach WHERE hops > 1 GROUP BY dst",
    "crawl_depth": """WITH RECURSIVE c AS (SELECT i AS page, 0 AS depth FROM range(10) t(i)
  UNION SELECT unnest([page_id * 2 + 1, page_id * 3 + 2]), depth + 1 FROM c JOIN pages ON page_id = page WHERE depth < 3)
SELECT page::VARCHAR AS url, min(depth)::INTEGER AS depth FROM c GROUP BY page""",
    "page_targets": """WITH RECURSIVE p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
  html || """
    + " || ".join("'<a href=\"" + r.replace("{0}", "' || page_id || '") + "\">'" for r in REFERENCES)
    + """ AS html FROM pages),
h AS (SELECT page_id, host, path, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']([^"''#][^"'']*)', 1)) AS href FROM p),
q AS (SELECT page_id, host, path, href, regexp_extract(href, '^[^?#]*') AS r FROM h WHERE NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:')),
m AS (SELECT DISTINCT page_id, href, CASE WHEN starts_with(r, '//') THEN lower(regexp_extract(r, '^//([^/]*)', 1)) ELSE host END AS host,
  CASE WHEN starts_with(r, '//') THEN regexp_replace(r, '^//[^/]*', '') WHEN starts_with(r, '/') THEN r WHEN r = '' THEN path ELSE regexp_extract(path, '^(.*/)?') || r END AS path FROM q),
d AS (SELECT page_id, host, CASE WHEN regexp_matches(path, '/\\.\\.?$') THEN path || '/' ELSE path END AS path, 0 AS step FROM m
  UNION SELECT page_id, host, CASE WHEN regexp_matches(path, '/\\./') THEN regexp_replace(path, '/\\./', '/') WHEN regexp_matches(path, '^/\\.\\./') THEN regexp_replace(path, '^/\\.\\./', '/')
    ELSE regexp_replace(path, '/[^/]+/\\.\\./', '/') END, step + 1 FROM d WHERE regexp_matches(path, '/\\.\\.?/'))
SELECT DISTINCT page_id, 'https://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS target FROM d
WHERE NOT regexp_matches(path, '/\\.\\.?/') AND NOT regexp_matches(path, '(?i)\\.(pdf|zip)$')""",
    "crawl_capped": """WITH f0 AS (SELECT page_id, 0 AS depth, row_number() OVER (ORDER BY page_id DESC) AS "at" FROM pages WHERE page_id < 10 QUALIFY "at" <= 150), """
    + ", ".join(
        f"""w{d} AS (SELECT link AS page_id, min(("at", i)) AS place FROM (SELECT "at", unnest([page_id * 2 + 1, page_id * 3 + 2, page_id // 2]) AS link, unnest([0, 1, 2]) AS i FROM f{d - 1} WHERE depth = {d - 1}) GROUP BY link),
f{d} AS (FROM f{d - 1} UNION ALL SELECT page_id, {d}, (SELECT count(*) FROM f{d - 1}) + row_number() OVER (ORDER BY place) AS "at" FROM w{d}
  WHERE page_id IN (SELECT page_id FROM pages) AND page_id NOT IN (SELECT page_id FROM f{d - 1}) QUALIFY "at" <= 150)"""
        for d in (1, 2, 3)
    )
    + """ SELECT 'https://site.example/d/' || page_id AS url, depth::INTEGER AS depth, "at" FROM f3""",
    "nested_mentions": f"""WITH b AS (SELECT string_split({KEY.format("text")}, ' ')[1:8] AS w FROM benchmark),
n AS (SELECT DISTINCT {KEY.format("k")} AS k, k AS target FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))) AS k FROM b
  UNION SELECT unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM b)),
d AS (SELECT doc_id AS id, string_split({KEY.format("text")}, ' ') AS w FROM documents),
g AS (SELECT id, i - 1 AS first, i - 1 + l - 1 AS last, array_to_string(w[i:i + l - 1], ' ') AS k FROM (SELECT id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (VALUES (1), (2), (3)) t(l))),
s AS (SELECT id, first, last, target FROM g JOIN n USING (k) WHERE k <> '')
SELECT id, first::INTEGER AS first, last::INTEGER AS last, target FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.id = s.id AND o.first <= s.first AND o.last >= s.last AND o.last - o.first > s.last - s.first)""",
    "grounded_questions": f"""WITH q AS (SELECT p_partkey AS id,
  CASE p_partkey % 6 WHEN 4 THEN 'and what gives supplier ' || p_partkey % 30 WHEN 5 THEN 'and nobody at all' ELSE 'tell me, of ' || p_name || ' say, or ' || array_to_string(string_split(p_name, ' ')[1:2], ' ') END AS text,
  CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 3, 9) WHEN 2 THEN 'that one ' || p_partkey WHEN 3 THEN '' ELSE 'the teacher' END AS term FROM part),
k AS (SELECT id, text, term, {KEY.format("term")} AS k FROM q),
n AS (SELECT p_partkey::VARCHAR AS node_id, {KEY.format("p_name")} AS nk, array_to_string(string_split({KEY.format("p_name")}, ' ')[1:2], ' ') AS sk, 'short ' || array_to_string(string_split(p_name, ' ')[1:2], ' ') AS short FROM part),
a AS (SELECT id, text, term, k.k, coalesce(min(x.node_id), min(y.node_id)) AS node_id FROM k LEFT JOIN n x ON x.nk = k.k AND k.k <> '' LEFT JOIN n y ON y.node_id = k.k AND k.k <> '' GROUP BY ALL),
b AS (SELECT id, text, term, min(n.node_id) AS node_id FROM a LEFT JOIN n ON a.k <> '' AND contains(nk, a.k) WHERE a.node_id IS NULL GROUP BY ALL),
s AS (SELECT b.id, min_by(z.target, (-length(z.nk), position(' ' || z.nk || ' ' IN ' ' || {KEY.format("b.text")} || ' '), z.target)) AS target FROM b
  JOIN (SELECT node_id AS target, nk FROM n UNION SELECT short, sk FROM n) z ON contains(' ' || {KEY.format("b.text")} || ' ', ' ' || z.nk || ' ') WHERE b.node_id IS NULL GROUP BY b.id),
e AS (SELECT 'supplier ' || s_suppkey % 50 AS name, min('S' || s_suppkey) AS target FROM supplier GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT b.id, b.term, s.target, (SELECT min(e.target) FROM e WHERE contains(' ' || {KEY.format("b.text")} || ' ', ' ' || e.name || ' ') HAVING count(DISTINCT e.target) = 1) AS alias
  FROM b LEFT JOIN s USING (id) WHERE b.node_id IS NULL)
SELECT id, term, node_id, 'key' AS how FROM a WHERE node_id IS NOT NULL
UNION ALL SELECT id, term, node_id, 'part' FROM b WHERE node_id IS NOT NULL
UNION ALL SELECT id, term, coalesce(target, alias), CASE WHEN target IS NOT NULL THEN 'mention' WHEN alias IS NOT NULL THEN 'alias' ELSE 'none' END FROM c""",
    "track_support": with_views("teaches")
    + """, cv AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS concept, p_partkey AS course FROM part),
w AS (SELECT p_type AS id, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1),
t AS (SELECT DISTINCT id, unnest(string_split(name, ' ')) AS concept FROM w),
k AS (SELECT id, concept FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(concept) DESC, concept) <= 4),
b AS (SELECT p_partkey AS course, unnest([p_partkey // 2, p_partkey // 3]) AS base FROM part),
o AS (SELECT DISTINCT id, course AS base FROM k JOIN cv USING (concept)),
e AS (SELECT DISTINCT teacher, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS area FROM teaches JOIN part ON p_partkey = course),
f AS (SELECT DISTINCT concept, area FROM (SELECT DISTINCT concept FROM k WHERE length(concept) > 3) JOIN (SELECT DISTINCT area FROM e) ON contains(area, concept) OR contains(concept, area))
SELECT id, 'base' AS kind, base::VARCHAR AS item, string_agg(DISTINCT concept, ',' ORDER BY concept) AS detail FROM k JOIN cv USING (concept) JOIN b USING (course) ANTI JOIN o USING (id, base) WHERE base > 0 GROUP BY id, base
UNION ALL SELECT id, 'specialist', teacher::VARCHAR, string_agg(DISTINCT area, ',' ORDER BY area) FROM k JOIN f USING (concept) JOIN e USING (area) GROUP BY id, teacher""",
    "table_records": """SELECT p_type AS page_id, (1 + row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey))::INTEGER AS row, p_brand AS brand, p_partkey AS course,
  p_name || ' & more' AS name, (p_partkey // 2) || '; ' || (CASE WHEN p_size = 1 THEN 900000000 + p_partkey ELSE p_partkey // 3 END) || ' , -' AS after FROM part""",
    "published_seeds": """WITH p AS (SELECT DISTINCT p_partkey AS dst, unnest([p_partkey // 2, CASE WHEN p_size = 1 THEN 900000000 + p_partkey ELSE p_partkey // 3 END]) AS src FROM part)
SELECT CASE WHEN src NOT IN (SELECT p_partkey FROM part) THEN 'unresolved' WHEN dst % 2 = 0 AND src > 0 THEN 'existing' ELSE 'new' END AS outcome, count(*) AS pairs FROM p GROUP BY 1""",
    "section_labels": """WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS p, regexp_extract(url, '^[a-z]+://([^/?#:.]+)', 1) AS h FROM pages)
SELECT page_id, coalesce(nullif(p[3], ''), h) AS label FROM p""",
    "topic_mentions": "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents WHERE contains(lower(text), 'license')",
    "fuzzy_name_score": f"""WITH n AS (SELECT DISTINCT p_name AS name, {KEY.format("p_name")} AS nk FROM part),
t AS (SELECT DISTINCT term, {KEY.format("term")} AS k FROM (SELECT split_part(p_name, ' ', 1) AS term FROM part UNION SELECT p_name FROM part UNION SELECT substr(p_name, 2, 5) FROM part)),
s AS (SELECT term, name, CASE WHEN k = nk THEN 100 WHEN list_has_all(string_split(nk, ' '), string_split(k, ' ')) THEN 80 WHEN contains(nk, k) THEN 50 END AS score FROM t, n WHERE k <> '')
SELECT term, name, score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, name) = 1""",
    "fuzzy_courses": r"""WITH n AS (SELECT DISTINCT p_name AS name, lower(CASE WHEN p_name < 'c' THEN p_brand END) AS acronym, trim(lower(p_name)) AS n FROM part),
t AS (SELECT DISTINCT term, trim(lower(term)) AS t FROM (SELECT p_name || 's' AS term FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT split_part(p_name, ' ', 2) || ' course' FROM part)),
x AS (SELECT *, regexp_replace(t, '(\w)s\b', '\1', 'g') AS ts, regexp_replace(n, '(\w)s\b', '\1', 'g') AS ns FROM t, n),
y AS (SELECT *, list_filter(string_split(ts, ' '), lambda w: length(w) > 2) AS tw, list_filter(string_split(ns, ' '), lambda w: length(w) > 2) AS nw FROM x),
z AS (SELECT *, len(list_filter(tw, lambda w: list_contains(nw, w))) AS e, len(list_filter(tw, lambda w: len(list_filter(nw, lambda v: contains(v, w) OR contains(w, v))) > 0)) AS h FROM y),
s AS (SELECT term, name, round(max(CASE WHEN t = acronym OR t = n OR ts = ns THEN 100 WHEN contains(n, t) OR contains(ns, ts) THEN 90 WHEN contains(t, n) OR contains(ts, ns) THEN 85
  WHEN len(tw) > 0 AND len(nw) > 0 THEN least((e * 15 + (h - e) * 5) / greatest(len(tw), len(nw))::DOUBLE * 10, 84) END), 6) AS score FROM z GROUP BY ALL)
SELECT term, row_number() OVER (PARTITION BY term ORDER BY score DESC, name)::INTEGER AS rank, name, score::DOUBLE AS score FROM s WHERE score >= 50 QUALIFY rank <= 2 OR (rank <= 3 AND score >= 80)""",
    "person_items": """WITH p AS (SELECT DISTINCT n_name AS person, lower(n_name) AS p, list_filter(string_split(lower(n_name), ' '), lambda w: length(w) > 3)[-1] AS last FROM nation),
t AS (SELECT s_suppkey AS item, lower('Offered by ' || s_name || ' of ' || n_name) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT person, row_number() OVER (PARTITION BY person ORDER BY item)::INTEGER AS rank, item FROM p JOIN t ON contains(t, p) OR (length(last) > 4 AND contains(t, last)) QUALIFY rank <= 10""",
    "display_terms": f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'introducao de ' || p_name || ' e mais' WHEN 2 THEN substr(p_name, 1, 3)
  ELSE array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS t, {KEY.format("CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' institute' ELSE p_brand END")} AS k FROM part)
SELECT p_partkey, CASE WHEN t <> lower(t) THEN t WHEN length(t) <= 4 AND regexp_matches(t, '^[a-z]+$') THEN upper(t)
  ELSE array_to_string(list_transform(string_split(t, ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('de', 'da', 'do', 'das', 'dos', 'e', 'em', 'para') THEN w ELSE upper(w[1]) || w[2:] END), ' ') END AS shown,
  length(k) <= 2 OR k = 'institute' OR starts_with(k, 'institute ') OR suffix(k, ' institute') AS blocked FROM t""",
    "list_preservation": """WITH a AS (SELECT doc_id, regexp_extract_all('- ' || replace(text, chr(10), chr(10) || '- '), '(?m)^[ \\t]*(?:[-•*]|\\d+[.)])[ \\t]+([^\\n]+)$', 1) AS items,
  lower(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'on', '') ELSE substr(text, 1, (floor(length(text) * 0.85))::BIGINT) END) AS low FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, len(items) AS n, low, unnest(list_transform(items, lambda i: regexp_extract_all(lower(i), '(\\p{L}{4,})', 1))) AS w FROM a),
k AS (SELECT doc_id, any_value(n) AS n, count(*) FILTER (len(list_filter(w, lambda x: contains(low, x))) >= 0.6 * len(w)) AS kept FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n < 3 OR kept >= 0.9 * n, true) AS kept FROM a LEFT JOIN k USING (doc_id)""",
    "lateral_lookup": f"""WITH {_BM25}, b AS (SELECT query, doc, text FROM bm25 JOIN documents ON doc_id = doc WHERE rank = 1),
m AS (SELECT query, doc_id AS doc, d.text FROM b JOIN documents d ON doc_id IN (b.doc + 1, b.doc + 2) WHERE length(b.text) < 2000)
SELECT query, doc, length(text)::INTEGER AS size FROM (FROM b UNION ALL FROM m)""",
    "compose_answers": """SELECT conv_id AS question, count(*) AS parts, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest, min(length(text))::INTEGER AS confidence,
  arg_min(nullif(regexp_extract(text, '([A-Za-z]{10,})', 1), ''), turn) FILTER (regexp_matches(text, '[A-Za-z]{10,}')) AS artefact FROM conversations GROUP BY conv_id""",
    "stream_sessions": """WITH o AS (SELECT user_id, ts, event_id, nullif(event_type, 'view') AS entity, json_extract_string(props, '$.k') AS item, (event_type = 'purchase')::INT AS reset,
  coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 24 HOURS, true)::INT AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o),
e AS (SELECT *, sum(reset) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM s),
m AS (SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS turns, max(epoch) AS last,
  arg_max(entity, (ts, event_id)) FILTER (entity IS NOT NULL) AS entity FROM e GROUP BY user_id, session HAVING max(ts) + INTERVAL 24 HOURS < (SELECT max(ts) - INTERVAL 2 HOURS FROM events)),
i AS (SELECT user_id, session, item, min((ts, event_id)) AS place FROM e JOIN m USING (user_id, session) WHERE epoch = last AND item IS NOT NULL GROUP BY ALL)
SELECT user_id::VARCHAR AS key, started, ended, turns, entity, coalesce((SELECT string_agg(item, ',' ORDER BY place) FROM i WHERE i.user_id = m.user_id AND i.session = m.session), '') AS items FROM m""",
    "stream_event_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in SQL}
