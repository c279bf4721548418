"""Queries on questions in Portuguese, asked about every part by one of the templates below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import questions, routing
from quarry.tables import table
from quarry.workload.graph import KEY

#: A part asks the template of its number; {} is its name.
TEMPLATES = """
O que é bom fazer antes de {}?|Quais os pré-requisitos de {}?|O que preciso cursar antes de {}?|Quais disciplinas dependem de {}?|O que {} desbloqueia?
Quais disciplinas a professora {} leciona?|Quem leciona {}?|Professor responsável pela disciplina de {}?|A professora Maria leciona {}?|Artigos sobre {}
Perguntas frequentes sobre {}?|Quem trabalha com {}?|Quais as áreas de pesquisa do professor {}?|Qual o email da professora {}?|Disciplinas do terceiro termo de {}?
O que tem no termo 4 de {}?|Quais as eletivas de {}?|Já cursei cálculo e {}: como chego em redes?|Quero chegar em {}, já fiz cálculo.|Caminho mínimo para {}
Qual a matriz curricular de {}?|Grade curricular de {}?|Quem é o coordenador de {}?|Quais cursos disponíveis?|Me fale sobre {}
Quanto ainda falta para me formar em {}?|Posso me matricular em {}, física e redes?|Qual é o meu CR?|Se eu reprovar em {} o que acontece?|Quero trabalhar com {}
{} vai ter no próximo semestre?|Quais são as interdisciplinares de {}?|Estou cursando {}, física e álgebra este semestre|Se eu tirar 8,5 em {} de 4 créditos, e tirar 7 em física.|Oi, tudo bem?
Tenho 40h de monitoria em {}, valem como atividades complementares?|Esquece as minhas atividades|Onde fica a sala do professor {}?|normalmente {} é difícil
""".strip().replace("\n", "|").split("|")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(said, F.lit("{}"), F.col("p_name")).alias("q"))


def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", questions.intent_and_term("q").alias("x")).select("id", "x.intent", "x.term")


def question_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", questions.quick_intent("q").alias("intent"), questions.last_words("q").alias("term"))


def _intent(c: Column | str) -> Column:
    return F.coalesce(questions.quick_intent(c), questions.intent_and_term(c)["intent"])


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term that each question's intent yields, and whether the graph answers it by itself."""
    intent = _asked(spark, sf_dir).withColumn("intent", _intent("q"))
    return intent.select("id", "intent", questions.term_of("q", F.col("intent")).alias("term"), questions.direct(F.col("intent")).alias("direct"))


#: Messages on other matters, of which each customer and part sends one; {} is a name.
MESSAGES = """
Monte minha grade com {}, por favor|Quantas horas para me formar em {}?|Quais as novidades de {}?|Tem edital de {}?|Você tem ementa de {}?|O que é o curso de {}?
Como funciona {}?|Me fale mais sobre a {}.|Que materias devo cursar depois de {}|O que está acontecendo em {} hoje|requisitos para {} e plano de estudos|bom dia {}
""".strip().replace("\n", "|").split("|")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("p_partkey") % len(MESSAGES) + 1).cast("int"))
    name = F.expr("if(p_size % 2 = 0, p_brand, p_name)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(said, F.lit("{}"), name).alias("text"))


def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("id", F.explode(questions.kinds("text")).alias("kind"))


def question_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on what a programme (brand) is; those with a course's (part's) name aren't."""
    part = table(spark, sf_dir, "part")
    return questions.overviews(_messages(spark, sf_dir), part.selectExpr("p_name AS name"), part.selectExpr("p_brand AS name"))


def question_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades supposed in all courses, and means aimed at, of a question on every part; some say neither."""
    said = F.expr("""CASE p_partkey % 5 WHEN 0 THEN concat('Se eu passar com nota ', p_size, ',5 em todas?') WHEN 1 THEN concat('quanto preciso para o CR chegar a ', p_size % 10, ',2')
        WHEN 2 THEN concat('preciso subir para ', p_size % 10, '.7, e o cr geral ficar em ', p_size % 9) WHEN 3 THEN concat('tirar ', p_size, ' em cada') ELSE concat('chegar a ', p_size, ',5') END""")
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("q"))
    return asked.select("id", questions.uniform_grade("q").alias("grade"), questions.target_mean("q").alias("mean"))


def question_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities declared in one sentence on every part, with hours and institutions."""
    said = F.expr("concat('Fiz monitoria de ', p_size, 'h na Casa ', p_size, '; ', p_size % 4, ' horas de nada e também ', p_size, ',5 h pela Escola Técnica e 7hrs de ', p_name, '. fim')")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(routing.declared_activities(said)).alias("at", "a"))
    return rows.select("id", "at", "a.item", "a.hours", "a.institution")


#: Descriptions of activities, of which each part has one; {} is its name.
ACTIVITIES = [
    "Fiz IC em {}", "Monitoria de {} e palestra", "Curso de língua em {}", "Doação de sangue com {}", "participei do congresso: artigo em congresso sobre {}", "Estágio CLT em {}", "nada de {}",
    "Teatro e música de {}", "Unidade curricular optativa: {}", "Ensino Médio, feira de profissões", "IC, com {}",
]


def question_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted activity that each described one is."""
    said = F.element_at(F.array(*map(F.lit, ACTIVITIES)), (F.col("p_partkey") % len(ACTIVITIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(said, F.lit("{}"), F.col("p_name")).alias("q"))
    return rows.select("id", routing.accepted_activity("q").alias("a")).select("id", "a.axis", "a.activity")


def _route(c: Column | str) -> Column:
    return questions.route(c, questions.intent_and_term(c)["intent"])


def question_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", _route("q").alias("agent"))


def question_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", F.explode(questions.requests("q")).alias("request"))


def question_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), questions.listed("q", k).alias("items")) for k in questions.LISTS))
    return _asked(spark, sf_dir).select("id", F.inline(kinds)).select("id", "kind", F.posexplode("items").alias("at", "item"))


def question_supposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("id", F.posexplode(questions.supposed("q")).alias("at", "x")).select("id", "at", "x.grade", "x.course", "x.credits")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ASKED = f"""WITH a AS (SELECT p_partkey AS id, replace([{", ".join(map(_text, TEMPLATES))}][p_partkey % {len(TEMPLATES)} + 1], '{{}}', p_name) AS q0 FROM part),
q AS (SELECT id, q0, trim(regexp_replace(translate(lower(q0), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '\\s+', ' ', 'g')) AS q FROM a)
"""
_CLEAN = "regexp_replace(trim(regexp_replace(trim({0}), '[?.,!]+$', '')), ' (da|de|do|na|no|em)$', '')"


def _met(patterns: list[str]) -> str:
    return "regexp_matches(q, " + _text("|".join(f"(?:{p})" for p in patterns)) + ")" if patterns else "false"


def _term(name: str, pattern: str) -> str:
    one, two = (f"regexp_extract(q, {_text(pattern)}, {k})" for k in (1, 2))
    if questions._groups(pattern) < 2:
        return _CLEAN.format(one)
    two = _CLEAN.format(two)
    if name == "disciplinas_termo":
        starts = ("prim", "segu", "terc", "quar", "quin", "sext", "seti", "oita", "non", "deci")
        return f"(CASE {' '.join(f'WHEN starts_with({one}, {_text(s)}) THEN {_text(str(n))}' for n, s in enumerate(starts, 1))} ELSE trim({one}) END) || ':' || {two}"
    plain = f"{_CLEAN.format(one)} || ':' || {two}"
    return f"CASE WHEN starts_with(q, 'quero chegar em') THEN {two} || ':' || {_CLEAN.format(one)} ELSE {plain} END" if name == "trajectory_planning" else plain


_INTENT = "CASE " + " ".join(f"WHEN {_met([p])} THEN {_text(n)}" for n, patterns in questions.INTENTS for p in patterns) + " END"
_TERM = "CASE " + " ".join(f"WHEN {_met([p])} THEN {_term(n, p)}" for n, patterns in questions.INTENTS for p in patterns) + " END"
_PHRASE = " ".join("WHEN " + _met([rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})($|[^\p{{L}}\p{{N}}_])"]) + f" THEN {_text(agent)}" for agent, words in questions.PHRASES)
_ROUTE = " ".join(f"WHEN intent IN ({', '.join(map(_text, intents))}) THEN {_text(agent)}" for agent, intents in questions.ROUTES.items())
_REQUESTS = ", ".join(f"CASE WHEN {_met(some)} AND NOT {_met(none)} THEN {_text(n)} END" for n, (some, none) in questions.DETECTORS.items())


def _items(kind: str) -> str:
    body = f"regexp_extract(q, {_text(questions.LISTS[kind])}, 1)"
    if kind == "current":
        body = f"regexp_replace({body}, '\\b(?:e )?(?:se eu|quanto|qual|quais|o que|oq|como)\\b.*$', '')"
    return f"list_filter(list_transform(regexp_split_to_array({body}, ',| e |;'), lambda p: trim(p, ' .?!')), lambda p: length(p) >= {3 if kind == 'current' else 1})"


def _found(name: str, pattern: str) -> str:
    last = questions._groups(pattern)
    bare = ["regexp_replace(trim(regexp_extract(q, {}, {})), '[?.,!]+$', '')".format(_text(pattern), k) for k in range(1, last + 1)]
    one = _CLEAN.format(f"regexp_extract(q, {_text(pattern)}, {last})")
    if last == 2:
        one = " || ':' || ".join(reversed(bare) if name == "trajectory_planning" and pattern.startswith("quero chegar em") else bare)
    elif name == "trajectory_planning":
        no = _text(questions.NO_TARGET)
        one = f"CASE WHEN regexp_matches(q, {no}) THEN regexp_replace(trim(regexp_extract(q, {no}, 1)), '[?.,!]+$', '') || ':' ELSE {one} END"
    return f"CASE WHEN {_met([pattern])} AND length({one}) >= 2 THEN {one} END"


_TERMS = " ".join(f"WHEN {_text(n)} THEN coalesce({', '.join(_found(n, p) for p in patterns)})" for n, patterns in questions.TERMS.items())
_QUICK = " ".join(f"WHEN {_met(p)} THEN {_text(n)}" for n, p in questions.QUICK)
_LAST = f"list_filter(list_transform(string_split(q, ' '), lambda x: regexp_replace(x, '[?!.,;:]+$', '')), lambda x: length(x) > 2 AND x NOT IN ({', '.join(map(_text, questions.STOP_WORDS))}))"
_MESSAGES = f"""WITH a AS (SELECT p_partkey AS id, replace([{", ".join(map(_text, MESSAGES))}][p_partkey % {len(MESSAGES)} + 1], '{{}}', CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END) AS q0 FROM part),
q AS (SELECT id, trim(regexp_replace(translate(lower(q0), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '\\s+', ' ', 'g')) AS q FROM a)
"""
_ANY = lambda parts: "(" + " OR ".join(f"contains(q, {_text(p)})" for p in parts) + ")"
_OVERVIEW = ", ".join(f"nullif(regexp_replace(regexp_replace(trim(regexp_extract(q, {_text(p)}, 1)), '^[?.! ]+', ''), '[?.! ]+$', ''), '')" for p in questions.OVERVIEW)

SQL = {
    "question_axes": f"""WITH a AS (SELECT p_partkey AS id, ' ' || trim(regexp_replace(strip_accents(lower(replace([{", ".join(map(_text, ACTIVITIES))}][p_partkey % {len(ACTIVITIES)} + 1], '{{}}', p_name))), '\\s+', ' ', 'g')) || ' ' AS q FROM part),
k AS (SELECT * FROM (VALUES {", ".join(f"({n}, {axis}, {_text(activity)}, {_text(key)})" for n, (axis, activity, key) in enumerate((x, a, w) for x, a, words in routing.ACCEPTED for w in words))}) t(n, axis, activity, key)),
m AS (SELECT id, arg_min(axis, (-length(key), n)) AS axis, arg_min(activity, (-length(key), n)) AS activity FROM a JOIN k ON contains(q, key) GROUP BY id)
SELECT id, axis::INTEGER AS axis, activity FROM a LEFT JOIN m USING (id)""",
    "question_means": """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 3 THEN p_size END::DOUBLE AS grade,
  CASE p_partkey % 5 WHEN 1 THEN round(p_size % 10 + 0.2, 1) WHEN 2 THEN round(p_size % 10 + 0.7, 1) END::DOUBLE AS mean FROM part""",
    "question_activities": """WITH a AS (SELECT p_partkey AS id, 'Fiz monitoria de ' || p_size || 'h na Casa ' || p_size AS i1, p_size::DOUBLE AS h1, p_size % 4 || ' horas de nada' AS i2, (p_size % 4)::DOUBLE AS h2,
  p_size || ',5 h pela Escola Técnica' AS i3, p_size + 0.5::DOUBLE AS h3, '7hrs de ' || p_name || '. fim' AS i4 FROM part),
u AS (SELECT id, 0 AS k, i1 AS item, h1 AS hours, 'Casa' AS institution FROM a UNION ALL SELECT id, 1, i2, h2, NULL FROM a WHERE h2 > 0
  UNION ALL SELECT id, 2, i3, h3, 'Escola Técnica' FROM a UNION ALL SELECT id, 3, i4, 7.0, NULL FROM a)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS "at", item, hours::DOUBLE AS hours, institution FROM u WHERE hours > 0""",
    "question_terms": _ASKED
    + f"""SELECT id, intent, coalesce(CASE intent {_TERMS} END, array_to_string(w[greatest(len(w) - 2, 1):], ' ')) AS term, coalesce(intent IN ({", ".join(map(_text, questions.DIRECT))}), false) AS direct
FROM (SELECT *, coalesce(CASE {_QUICK} END, {_INTENT}) AS intent, {_LAST} AS w FROM q)""",
    "question_kinds": _MESSAGES
    + f"""SELECT id, kind FROM (SELECT id, unnest([CASE WHEN {_ANY(questions.PLAN)} AND NOT regexp_matches(q, {_text(r"(^|[^\p{L}\p{N}_])(" + "|".join(questions.NO_PLAN) + r")($|[^\p{L}\p{N}_])")}) THEN 'plan' END,
  CASE WHEN {_ANY(questions.NEWS)} THEN 'news' END, CASE WHEN {_ANY(questions.META)} AND length(q) < {questions.META_LENGTH} THEN 'meta' END]) AS kind FROM q) WHERE kind IS NOT NULL""",
    "question_overviews": _MESSAGES
    + f""", n AS (SELECT id, name, {KEY.format("name")} AS k FROM (SELECT id, coalesce({_OVERVIEW}) AS name FROM q) WHERE length(name) >= 2),
p AS (SELECT DISTINCT p_brand AS programme, {KEY.format("p_brand")} AS pk FROM part)
SELECT id, name, min(programme) AS programme FROM n JOIN p ON k <> '' AND contains(pk, k) WHERE k NOT IN (SELECT {KEY.format("p_name")} FROM part) GROUP BY id, name""",
    "question_intent": _ASKED + f"SELECT id, {_INTENT} AS intent, {_TERM} AS term FROM q",
    "question_quick": _ASKED
    + f"""SELECT id, CASE {" ".join(f"WHEN {_met(p)} THEN {_text(n)}" for n, p in questions.QUICK)} END AS intent, array_to_string(w[greatest(len(w) - 2, 1):], ' ') AS term
FROM (SELECT *, list_filter(list_transform(string_split(q, ' '), lambda x: regexp_replace(x, '[?!.,;:]+$', '')), lambda x: length(x) > 2 AND x NOT IN ({", ".join(map(_text, questions.STOP_WORDS))})) AS w FROM q)""",
    "question_route": _ASKED + f"SELECT id, CASE {_PHRASE} {_ROUTE} ELSE 'fallback' END AS agent FROM (SELECT *, {_INTENT} AS intent FROM q)",
    "question_requests": _ASKED + f"SELECT id, request FROM (SELECT id, unnest([{_REQUESTS}]) AS request FROM q) WHERE request IS NOT NULL",
    "question_lists": _ASKED
    + " UNION ALL ".join(f"SELECT id, '{k}' AS kind, (unnest(range(1, len(l) + 1)) - 1)::INTEGER AS \"at\", unnest(l) AS item FROM (SELECT id, {_items(k)} AS l FROM q)" for k in questions.LISTS),
    "question_supposed": _ASKED
    + """SELECT id, ("at" - 1)::INTEGER AS "at", replace(regexp_extract(p, 'tirar (\\d+[.,]?\\d*)', 1), ',', '.')::DOUBLE AS grade,
  regexp_extract(p, 'em (?:uma )?(.+?)(?: de \\d+ creditos?)?[.?,]?$', 1) AS course, try_cast(regexp_extract(p, 'de (\\d+) creditos?', 1) AS INTEGER) AS credits
FROM (SELECT id, unnest(range(1, len(l) + 1)) AS "at", unnest(l) AS p FROM (SELECT id, regexp_extract_all(q, '(tirar \\d+[.,]?\\d* em (?:uma )?.+?(?: de \\d+ creditos?)?(?:[.?,]|$))', 1) AS l FROM q))""",
}

QUERIES = {name: globals()[name] for name in SQL}
