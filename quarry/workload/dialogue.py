"""Queries on conversations, events, claims and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import conversation, routing, validation
from quarry.tables import table

INTENTS = [
    ("prerequisites", ("before", "require", "requires", "need")), ("teacher", ("who", "teacher")), ("plan", ("plan", "how", "steps")),
    ("definition", ("what", "explain", "define")), ("thanks", ("thanks", "thank you")),
]
#: What a missed answer and a reference back look like in these tables, which are in English.
MISSES = ("i don't know", "no information", "not found", "could not find", "cannot answer")
BACK = tuple(rf"(?:^|[^a-z])(?:{w})(?:[^a-z]|$)" for w in ("it", "that", "this", "they", "them", "he", "she", "its", "their"))
SYNONYMS = [("teaching", "the"), ("teaching", "thing"), ("research", "re"), ("research", "tion"), ("culture", "and the"), ("culture", "er")]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation.history(_turns(spark, sf_dir))
    return out.select("conv_id", "turns", F.md5("history").alias("digest"))


def last_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of a turn is its first word of over eight letters."""
    entity = F.nullif(F.regexp_extract(F.lower("text"), "([a-z]{9,})", 1), F.lit(""))
    return conversation.carried(_turns(spark, sf_dir), entity).select("conv_id", "turn", "own_entity", "entity")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.pairs(_turns(spark, sf_dir)).select("conv_id", "turn", F.length("question").alias("asked"), F.length("answer").alias("answered"))


def intent_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", routing.first_match("text", INTENTS, "other").alias("intent"))


def route_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = routing.first_match("text", INTENTS, "other")
    agent = F.when(intent.isin("prerequisites", "teacher"), "graph").when(intent == "plan", "planner").otherwise("retrieval")
    return _turns(spark, sf_dir).where("role = 'user'").groupBy(agent.alias("agent")).agg(F.count("*").alias("turns"))


def miss_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("role").agg(F.count_if(conversation.missed("text", MISSES)).alias("missed"), F.count_if(conversation.ambiguous("text", BACK)).alias("ambiguous"), F.count_if(conversation.compound("text")).alias("compound"))


def axis_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = spark.createDataFrame(SYNONYMS, "axis string, synonym string")
    return routing.longest_synonym(table(spark, sf_dir, "benchmark").selectExpr("item_id AS id", "text"), synonyms)


def question_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", routing.last_content_words("text").alias("term"))


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.sessions(_events(spark, sf_dir).select("user_id", "ts"))


def lru_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.most_recent(conversation.sessions(_events(spark, sf_dir).select("user_id", "ts")), 100)


def accumulated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.accumulate(_events(spark, sf_dir), F.get_json_object("props", "$.k"), F.col("event_type") == "purchase")


def telemetry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("hour"), "event_type", "n")


def recent_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entries of an append-only log, newest first."""
    return _events(spark, sf_dir).where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "ts")


def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims are the license lines of documents; the known facts are two of them."""
    found = validation.claims(table(spark, sf_dir, "documents"), r"(?m)^((?:Licensed|Released) under [^\n]{3,60})$")
    facts = spark.createDataFrame([("released under the mit license.",), ("apache license",)], "fact string")
    return validation.check_claims(found, facts)


#: Answers of many kinds, of which each part gets one; {} is its name.
ANSWERS = [
    "O caminho é {}", "1. {} e depois", "texto sobre {} apenas", "tabela | {} |---", "disciplina importante:\n- {}", "nenhuma disciplina além de {}", "Precisa de {} antes",
    "A professora leciona {}", "- {}\n- outro item", "não encontrei nada sobre {}", "curto",
]


def verified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether symbolic answers of all kinds show what they must, each answer asked of one kind."""
    kinds = [*validation.SIGNS, "prereq", "other"]
    at = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(at(ANSWERS), F.lit("{}"), F.col("p_name")).alias("answer"), at(kinds).alias("kind"))
    return rows.select("id", validation.verified("answer", "kind").alias("v")).select("id", "v.ok", "v.why")


def debate_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).where("role = 'assistant'").selectExpr("conv_id AS question", "turn AS answer", "text")
    facts, bad = F.regexp_count("text", F.lit("the")), F.regexp_count("text", F.lit(r"\."))
    return validation.debate(turns, facts.cast("long"), bad.cast("long"), conversation.missed("text", MISSES))


def fact_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against a rewriting that changes some of their digits."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text", "translate(text, '7', '8') AS rewritten")
    return validation.preserved(docs.where("text rlike '[0-9]'"), "text", "rewritten")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "C").when(F.col("quality") == 1, "P").otherwise("I")
    second = F.when(F.col("n_chars") < 200, "I").when(F.col("toxic") == 1, "P").otherwise("C")
    return labels.select("lang", verdict.alias("verdict"), verdict.alias("r1"), second.alias("r2"))


def accuracy_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.accuracy(_rated(spark, sf_dir), ["lang"])


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.kappa(_rated(spark, sf_dir), ["lang"])


def latency_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.latency(_events(spark, sf_dir), "event_type", "value")


def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = routing.first_match("text", INTENTS, "other")
    turns = _turns(spark, sf_dir).select("role", got.alias("got"), F.lit("definition|other").alias("expected"))
    return validation.routing_accuracy(turns, "role")


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", validation.judge_score("text").alias("score"))


def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects cut out of surrounding text."""
    wrapped = F.concat(F.lit("Answer: "), F.col("props"), F.lit(" (end)"))
    return _events(spark, sf_dir).select("event_id", F.get_json_object(text.json_object(wrapped), "$.k").try_cast("int").alias("k"))


def _phrase(*phrases: str) -> str:
    return "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(" + "|".join(p.replace("'", "''") for p in phrases) + ")($|[^\\p{L}\\p{N}_])')"


def _case() -> str:
    return "CASE " + " ".join(f"WHEN {_phrase(*p)} THEN '{n}'" for n, p in INTENTS) + " ELSE 'other' END"


_FOLDED = "trim(regexp_replace(translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '\\s+', ' ', 'g'))"
_MISSED = f"regexp_matches({_FOLDED}, '" + "|".join(m.replace("'", "''") for m in MISSES) + "')"
_RATED = """r AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'C' WHEN quality = 1 THEN 'P' ELSE 'I' END AS r1,
  CASE WHEN n_chars < 200 THEN 'I' WHEN toxic = 1 THEN 'P' ELSE 'C' END AS r2 FROM labels JOIN documents USING (doc_id))"""
_SHORT = "CASE WHEN length({0}) <= 350 THEN {0} ELSE regexp_replace(substr({0}, 1, 350), ' [^ ]*$', '') || '…' END"
_SESSIONS = """s AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 24 HOURS, true) AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s),
sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 24 HOURS AS session_end, count(*) AS events FROM g GROUP BY user_id, g)"""
_NUMBERS = "(SELECT id, n, count(*) AS c FROM (SELECT doc_id AS id, unnest(regexp_extract_all({0}, '\\d+(?:[.,]\\d+)?')) AS n FROM documents) GROUP BY ALL)"

def _verdicts() -> str:
    met = lambda patterns: " AND ".join(f"regexp_matches(s, '{p}')" for p in patterns)
    rules = [f"WHEN kind = '{k}' AND {met(p)} THEN '1{w}'" for k, (signs, _) in validation.SIGNS.items() for p, w in signs]
    order = [x for k, (signs, lack) in validation.SIGNS.items() for x in (*(r for r in rules if f"kind = '{k}'" in r), f"WHEN kind = '{k}' THEN '0{lack}'")]
    return f"CASE WHEN length(s) < {validation.SHORTEST} THEN '0empty_response' {' '.join(order)} WHEN regexp_matches(s, '{validation.ERRORS}') THEN '0error_in_response' ELSE '1non_empty_response' END"


_PARTED = ", ".join("'" + a.replace("'", "''") + "'" for a in ANSWERS)
SQL = {
    "verified_answers": f"""WITH a AS (SELECT p_partkey AS id, strip_accents(lower(replace([{_PARTED}][p_partkey % {len(ANSWERS)} + 1], '{{}}', p_name))) AS s0,
  {[*validation.SIGNS, "prereq", "other"]}[p_partkey % {len(validation.SIGNS) + 2} + 1] AS k FROM part),
b AS (SELECT id, regexp_replace(s0, '^\\s+|\\s+$', '', 'g') AS s, CASE k WHEN 'prereq' THEN 'prerequisite_chain' ELSE k END AS kind FROM a)
SELECT id, v[1] = '1' AS ok, substr(v, 2) AS why FROM (SELECT id, {_verdicts()} AS v FROM b)""",
    "history_window": f"""WITH s AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS r FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || {_SHORT.format("t")}, chr(10) ORDER BY r DESC)) AS digest FROM s WHERE r <= 6 GROUP BY conv_id""",
    "last_entity": """WITH o AS (SELECT conv_id, turn, nullif(regexp_extract(lower(text), '([a-z]{9,})', 1), '') AS own_entity FROM conversations)
SELECT conv_id, turn, own_entity, last_value(own_entity IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entity FROM o""",
    "turn_pairs": """SELECT a.conv_id, a.turn, length(a.text)::INTEGER AS asked, length(b.text)::INTEGER AS answered FROM (
  SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) a JOIN conversations b ON a.conv_id = b.conv_id AND a.next = b.turn
WHERE a.role = 'user' AND b.role = 'assistant'""",
    "intent_quick": f"SELECT conv_id, turn, {_case()} AS intent FROM conversations",
    "route_phrase": f"""SELECT CASE WHEN i IN ('prerequisites', 'teacher') THEN 'graph' WHEN i = 'plan' THEN 'planner' ELSE 'retrieval' END AS agent, count(*) AS turns
FROM (SELECT {_case()} AS i FROM conversations WHERE role = 'user') GROUP BY 1""",
    "miss_detect": f"""SELECT role, count(*) FILTER ({_MISSED}) AS missed,
  count(*) FILTER (NOT regexp_matches({_FOLDED}, '^e (?:de|sobre) [a-z]') AND NOT regexp_matches(trim(text), '\\b[A-Z]{{2,}}\\b')
    AND NOT regexp_matches(trim(text), '(?:de|sobre|para) [A-Z][a-zà-ú]+(?: [A-Za-zÀ-ú]+)?(?:\\?|,| +quais?)')
    AND (len(regexp_split_to_array(trim(text), '\\s+')) < 4 OR regexp_matches({_FOLDED}, '{"|".join(BACK)}'))) AS ambiguous,
  count(*) FILTER (length(text) >= 25 AND (length(text) - length(replace(text, '?', '')) >= 2 OR {_phrase("and also", "as well as")})) AS compound FROM conversations GROUP BY role""",
    "axis_of_text": """WITH s AS (SELECT * FROM (VALUES ('teaching', 'the'), ('teaching', 'thing'), ('research', 're'), ('research', 'tion'), ('culture', 'and the'), ('culture', 'er')) t(axis, synonym))
SELECT item_id AS id, axis, synonym FROM benchmark JOIN s ON contains(lower(text), synonym) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(synonym) DESC, axis) = 1""",
    "question_term": """WITH w AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '\\s+', ' ', 'g')), ' '),
  lambda w: length(w) > 2 AND w NOT IN ('the', 'of', 'and', 'a', 'to', 'in')) AS w FROM benchmark)
SELECT item_id, array_to_string(w[greatest(len(w) - 2, 1):len(w)], ' ') AS term FROM w""",
    "session_ttl": f"WITH {_SESSIONS} SELECT * FROM sessions",
    "lru_sessions": f"WITH {_SESSIONS} SELECT user_id, max(session_end) AS last FROM sessions GROUP BY user_id ORDER BY last DESC, user_id LIMIT 100",
    "accumulated_items": """WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM events)
SELECT user_id, epoch, count(DISTINCT json_extract_string(props, '$.k')) AS items FROM e WHERE event_type <> 'purchase' GROUP BY ALL""",
    "telemetry_counts": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "recent_misses": "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "claim_check": """WITH c AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(c), '\\s+', ' ', 'g')) AS claim FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^((?:Licensed|Released) under [^\\n]{3,60})$', 1)) AS c FROM documents))
SELECT doc_id, claim, CASE WHEN claim IN ('released under the mit license.', 'apache license') THEN 'exact'
  WHEN contains(claim, 'apache license') OR contains('apache license', claim) OR contains(claim, 'released under the mit license.') OR contains('released under the mit license.', claim) THEN 'part'
  ELSE 'unsupported' END AS verdict FROM c""",
    "debate_winner": f"""WITH a AS (SELECT conv_id AS question, turn AS answer,
  2 * ((length(text) - length(replace(text, 'the', ''))) // 3) - 3 * (length(text) - length(replace(text, '.', ''))) - CASE WHEN {_MISSED} THEN 100 ELSE 0 END AS score
  FROM conversations WHERE role = 'assistant')
SELECT question, answer AS winner, score::BIGINT AS score FROM a QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, answer) = 1""",
    "fact_preservation": f"""WITH b AS {_NUMBERS.format("text")}, a AS {_NUMBERS.format("translate(text, '7', '8')")},
k AS (SELECT id, round(sum(least(b.c, coalesce(a.c, 0))) / sum(b.c), 6) AS kept FROM b LEFT JOIN a USING (id, n) GROUP BY id)
SELECT doc_id AS id, coalesce(kept, 1.0::DOUBLE) AS kept, coalesce(kept, 1.0) >= 0.9 AS ok FROM documents LEFT JOIN k ON id = doc_id WHERE regexp_matches(text, '[0-9]')""",
    "accuracy_weighted": f"""WITH {_RATED} SELECT lang, count(*) AS n, round(avg((r1 = 'C')::INT), 6) AS strict,
  round(avg((r1 = 'C')::INT) + 0.5 * avg((r1 = 'P')::INT), 6) AS weighted, round(avg((r1 = 'I')::INT), 6) AS error FROM r GROUP BY lang""",
    "cohen_kappa": f"""WITH {_RATED}, t AS (SELECT lang, count(*) AS n, avg((r1 = r2)::INT) AS po FROM r GROUP BY lang),
e AS (SELECT lang, sum(a * b) AS ab FROM (SELECT lang, r1 AS v, count(*) AS a FROM r GROUP BY ALL) JOIN (SELECT lang, r2 AS v, count(*) AS b FROM r GROUP BY ALL) USING (lang, v) GROUP BY lang),
k AS (SELECT lang, n, round(po, 6) AS agreement, round(CASE WHEN ab / (n * n) = 1 THEN 1 ELSE (po - ab / (n * n)) / (1 - ab / (n * n)) END, 6) AS kappa FROM t JOIN e USING (lang))
SELECT *, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""",
    "latency_p90": """SELECT event_type, count(*) AS n, min(value) AS least, round(median(value), 6) AS median, round(avg(value), 6) AS mean,
  list_sort(list(value))[greatest(1, count(*) * 9 // 10)] AS p90, max(value) AS most FROM events GROUP BY event_type""",
    "routing_accuracy": f"""WITH t AS (SELECT role, {_case()} IN ('definition', 'other') AS ok FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (ok) AS correct, round(avg(ok::INT), 6) AS rate FROM t GROUP BY role""",
    "judge_scores": """SELECT conv_id, turn, least(greatest(coalesce(try_cast(regexp_extract(text, '(-?\\d{1,9})', 1) AS INTEGER), 0), 0), 5) AS score FROM conversations""",
    "tolerant_json": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
}

QUERIES = {name: globals()[name] for name in SQL}
