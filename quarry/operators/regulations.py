"""Ranking of typed documents for questions on rules and curricula: additive weights, united with a semantic list, without repeated openings, reranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import checkpoint
from quarry.operators import retrieval

#: Words that weigh where question and document both hold them, as substrings.
WORDS = {
    "atividades complementares": 10, "atividade complementar": 10, "carga horaria": 8, "horas": 5, "312": 15, "ac ": 6, "ace ": 6, "eixo": 6, "eixos": 6, "curso": 3, "graduacao": 3, "cursos": 3,
    "bct": 4, "pos-graduacao": 4, "mestrado": 4, "doutorado": 4, "regimento": 4, "regulamento": 4, "regra": 3, "artigo": 3, "camara": 3, "congregacao": 3, "departamento": 2, "conselho": 2, "sae": 5,
    "biblioteca": 3, "extensao": 3, "nae": 4, "missao": 3, "objetivo": 2, "campus": 2, "matriz": 5, "semestre": 4, "termo": 4, "disciplina": 3, "coordenador": 5, "creditos": 3, "primeiro": 3,
    "segundo": 3, "eletiva": 8, "eletivas": 8, "grupo": 6, "grupos": 6,
}
#: What a document of a kind counts by itself; each long word of the question in a document of questions; a term by each of the forms it is named by; an acronym; electives and groups.
KINDS = {"question": 10, "objective": 3, "summary": 5}
LONG_WORD, TERM_FORM, ACRONYM, BOTH, EITHER = 5, 20, 15, 12, 6
ORDINALS = ("primeiro", "segundo", "terceiro", "quarto", "quinto", "sexto", "setimo", "oitavo", "nono", "decimo")
#: Documents by weights, semantic ones, characters by which openings are compared, documents in the end.
BY_WEIGHT, SEMANTIC, OPENING, MOST = 10, 8, 120, 8
_ELECTIVE, _GROUP = "eletiva", "grupo"


def forms(number: int) -> list[str]:
    """What a term is called."""
    word = ORDINALS[number - 1]
    return [word, f"{word} termo", str(number), f"{number}º", f"{number}o", f"termo {number}"]


def _held(said: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(said, F.lit(w)), F.lit(w)) for w in words)))


def by_weight(docs: DataFrame, queries: DataFrame, words: dict[str, float] | None = None, most: int = BY_WEIGHT) -> DataFrame:
    """(query, rank, doc, score): the `most` documents of each question with the highest sum of weights, above 0; ties to the smaller doc.

    docs: (doc, text, kind, acronym, number), kind as in sources.sections, number the term of a document of kind 'term'; queries: (query, text). Documents and questions meet on the words, long words
    (whole ones), acronyms and terms that both have; what documents count by themselves is added, and the best of those alone compete too. So no question is paired with a document for nothing.
    """
    weights = words or WORDS
    said = text.fold("text")
    own = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(w))) for k, w in KINDS.items()), F.lit(0.0))
    d = checkpoint(docs.select("doc", "kind", F.lower("acronym").alias("acronym"), F.col("number").cast("string").alias("number"), own.alias("own"), said.alias("said")))
    q = checkpoint(queries.select("query", said.alias("said")))
    key = lambda mark, c: F.concat(F.lit(f"{mark}:"), c)
    long_words = lambda c: F.array_distinct(F.filter(text.tokens(c), lambda w: F.length(w) > 3))
    rule = F.create_map(*(F.lit(x) for pair in ((w, float(n)) for w, n in weights.items()) for x in pair))
    named = F.array_compact(F.array(*(F.when(F.contains("said", F.lit(f)), F.struct(F.lit(str(n)).alias("number"))) for n in range(1, 11) for f in forms(n))))

    def rows(df: DataFrame, entity: str, *parts: tuple[Column, Column]) -> DataFrame:
        """(entity, key, w) of arrays of keys."""
        each = [df.select(entity, F.explode(keys).alias("key")).withColumn("w", w) for keys, w in parts]
        out = each[0]
        for e in each[1:]:
            out = out.unionAll(e)
        return out

    one = F.lit(1.0)
    elective = F.contains("said", F.lit(_ELECTIVE)), F.contains("said", F.lit(_GROUP))
    asked = rows(
        q, "query", (F.transform(_held(F.col("said"), list(weights)), lambda w: key("word", w)), one), (F.transform(long_words("said"), lambda w: key("long", w)), one),
        (F.transform(F.array_distinct(text.tokens("said")), lambda w: key("acronym", w)), one), (F.transform(named, lambda s: key("term", s["number"])), one),
        (F.array_compact(F.array(F.when(elective[0] | elective[1], F.lit("electives:")))), one),
    ).groupBy("query", "key").agg(F.sum("w").alias("times"))
    faq = (F.col("kind") == "question") & F.contains("said", F.lit("pergunta"))
    empty = F.array().cast("array<string>")
    held = rows(
        d, "doc", (F.transform(_held(F.col("said"), list(weights)), lambda w: key("word", w)), F.element_at(rule, F.substring_index("key", "word:", -1))),
        (F.transform(F.when(faq, long_words("said")).otherwise(empty), lambda w: key("long", w)), F.lit(float(LONG_WORD))),
        (F.array_compact(F.array(F.when(F.col("acronym") != "", key("acronym", F.col("acronym"))))), F.lit(float(ACRONYM))),
        (F.array_compact(F.array(F.when((F.col("kind") == "term") & F.col("number").isNotNull(), key("term", F.col("number"))))), F.lit(float(TERM_FORM))),
        (F.array_compact(F.array(F.when((F.col("kind").isin("term", "summary", "electives")) & (elective[0] | elective[1]), F.when(elective[0] & elective[1], F.lit("electives:both")).otherwise("electives:")))), F.lit(float(EITHER))),
    )
    held = held.withColumn("w", F.when(F.col("key") == "electives:both", F.lit(float(BOTH))).otherwise(F.col("w"))).withColumn("key", F.when(F.col("key") == "electives:both", F.lit("electives:")).otherwise(F.col("key")))
    met = held.join(asked, "key").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("times")).alias("score"))
    alone = d.where("own > 0").orderBy(F.desc("own"), "doc").limit(most).select("doc", "own")  # as many rows as are shown
    extra = q.select("query").crossJoin(F.broadcast(alone)).select("query", "doc", F.lit(0.0).alias("score"))
    both = met.unionAll(extra).groupBy("query", "doc").agg(F.sum("score").alias("score")).join(d.select("doc", "own"), "doc")
    return retrieval.best(both.select("query", "doc", (F.col("score") + F.col("own")).alias("score")).where("score > 0"), "query", "doc", most)


def united(weighted: DataFrame, semantic: DataFrame, docs: DataFrame, scorer: Column | None = None, opening: int = OPENING, most: int = MOST) -> DataFrame:
    """(query, rank, doc): the documents by weights, then the semantic ones, each opening once, then the `most` best by a pluggable scorer; without one in that order.

    weighted: (query, rank, doc); semantic: (query, rank, doc), of which the first SEMANTIC count; docs: (doc, text). The scorer may use query, doc, text and place.
    """
    both = weighted.select("query", "doc", F.col("rank").cast("long").alias("place")).unionAll(semantic.where(F.col("rank") <= SEMANTIC).select("query", "doc", F.col("rank").cast("long") + 1_000_000))
    shown = both.join(docs.select("doc", "text"), "doc").withColumn("head", F.substring(F.coalesce("text", F.lit("")), 1, opening))
    first = shown.withColumn("r", F.row_number().over(Window.partitionBy("query", "head").orderBy("place", "doc"))).where("r = 1").drop("r")
    order = ([] if scorer is None else [scorer.desc()]) + [F.col("place"), F.col("doc")]
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= most).select("query", "rank", "doc")
