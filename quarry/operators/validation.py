"""Claim checks, arbitration between answers, and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import shuffled
from quarry.operators.names import containing


def claims(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, claim): distinct normalised matches of a pattern's first group."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text_col, F.lit(pattern), 1)).alias("raw")).select("doc_id", text.text_key("raw").alias("claim")).where("claim <> ''").distinct()


def check_claims(found: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, claim, verdict): exact if known, part if a known fact (over 5 letters) holds it or it holds one, else unsupported.

    known: (fact). Distinct claims, not documents, meet the facts, by pieces of three characters that both have.
    """
    facts = known.select(text.text_key("fact").alias("fact")).where("fact <> ''").distinct()
    one = found.select("claim").distinct()
    exact = one.join(facts, one["claim"] == facts["fact"], "left_semi").withColumn("verdict", F.lit("exact"))
    rest = one.join(exact, "claim", "left_anti")
    long_facts = facts.where("length(fact) > 5")
    held = containing(rest, "claim", long_facts, "fact").select("claim").unionAll(containing(long_facts, "fact", rest, "claim").select("claim"))
    loose = held.distinct().withColumn("verdict", F.lit("part"))
    verdicts = exact.unionAll(loose)
    return found.join(verdicts, "claim", "left").select("doc_id", "claim", F.coalesce("verdict", F.lit("unsupported")).alias("verdict"))


def check_structured(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, course, value, verdict): distinct claims on courses as ok, violation, or unknown where nothing is known of that kind or nothing is claimed.

    claimed: (kind, course, value); known: (kind, course, value). Codes agree if their digits do; names of teachers and prerequisites if one holds the other.
    Claims meet only the facts of their own course and kind.
    """
    key = F.when(F.col("kind") == "code", F.regexp_replace("value", r"\D", "")).otherwise(text.text_key("value"))
    facts = known.select("kind", "course", key.alias("fact")).where("fact <> ''").distinct()
    said = claimed.distinct().withColumn("said", key)
    same = F.when(F.col("kind") == "code", F.col("said") == F.col("fact")).otherwise(F.col("fact").contains(F.col("said")) | F.col("said").contains(F.col("fact")))
    met = said.join(shuffled(facts), ["kind", "course"], "left").groupBy("kind", "course", "value").agg(F.max("said").alias("said"), F.count("fact").alias("facts"), F.max(same).alias("same"))
    verdict = F.when((F.col("facts") == 0) | F.coalesce(F.col("said") == "", F.lit(True)), "unknown").when(F.col("same"), "ok").otherwise("violation")
    return met.select("kind", "course", "value", verdict.alias("verdict"))


def deciding(claimed: DataFrame, names: DataFrame) -> DataFrame:
    """(course, item): the names that would bear out a claim, one holding the other; null for a claim that none would. With these and any other fact of a course check_structured gives what it gives with all of them.

    claimed: (course, value); names: (value, item). Distinct names meet, not claims.
    """
    key = text.text_key("value")
    claims_ = claimed.select("course", key.alias("said")).distinct()
    said, facts = claims_.select("said").where("said <> ''").distinct(), names.select("item", key.alias("fact")).where("fact <> ''")
    held = containing(said, "said", facts, "fact").select("said", "item").unionAll(containing(facts, "fact", said, "said").select("said", "item")).distinct()
    return claims_.join(shuffled(held), "said", "left").select("course", "item")


def debate(answers: DataFrame, facts: Column, violations: Column, miss: Column) -> DataFrame:
    """(question, winner, score): the answer of the highest 2 * facts - 3 * violations - 100 if it is a miss; ties to the first. answers: (question, answer)."""
    score = 2 * facts - 3 * violations - F.when(miss, 100).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "answer"))
    return answers.withColumn("score", score.cast("long")).withColumn("r", rank).where("r = 1").select("question", F.col("answer").alias("winner"), "score")


def preserved(pairs: DataFrame, before: str, after: str, least: float = 0.9) -> DataFrame:
    """Pairs with kept (share of numbers of `before`, as a multiset, that `after` still has) and ok. pairs: (id, ...)."""

    def numbers(c: str, name: str) -> DataFrame:
        return pairs.select("id", F.explode(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1)).alias("n")).groupBy("id", "n").agg(F.count("*").alias(name))

    both = numbers(before, "a").join(numbers(after, "b"), ["id", "n"], "left").groupBy("id").agg(F.sum("a").alias("all"), F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("same"))
    joined = pairs.select("id").join(both, "id", "left")
    kept = F.round(F.coalesce(F.col("same") / F.col("all"), F.lit(1.0)), 6)
    return joined.select("id", kept.alias("kept"), (kept >= least).alias("ok"))


def list_items_kept(before: Column | str, after: Column | str, least: float = 0.9, share: float = 0.6, few: int = 3) -> Column:
    """Whether the items of a list (bullets or numbers) are still there: at least `least` of them with `share` of their words of four letters or more somewhere in
    the text after; true for lists of fewer than `few` items.

    Words are runs of letters, so one stands in a text if one of the text's own runs holds it: only distinct words that equal none of these are looked for in them.
    """
    items = F.regexp_extract_all(text.col(before), F.lit(r"(?m)^[ \t]*(?:[-•*]|\d+[.)])[ \t]+([^\n]+)$"), 1)
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}{4,})"), 1)
    # what a function's variable holds is worked out once, not for each word
    let = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))

    def lost(words: Column, there: Column) -> Column:
        return let(F.array_join(there, " "), lambda all_: F.filter(F.array_except(F.flatten(words), there), lambda w: ~F.contains(all_, w)))

    def enough(words: Column, gone: Column) -> Column:
        kept = lambda own: F.size(F.filter(own, lambda w: ~F.array_contains(gone, w))) >= share * F.size(own)
        return (F.size(words) < few) | (F.size(F.filter(words, kept)) >= least * F.size(words))

    there = F.array_distinct(runs(F.coalesce(text.col(after), F.lit(""))))
    return let(F.transform(items, runs), lambda words: let(let(there, lambda t: lost(words, t)), lambda gone: enough(words, gone)))


def accuracy(rated: DataFrame, group: list[str]) -> DataFrame:
    """Strict and weighted accuracy and error rate by group. rated: verdict C (correct), P (partly) or I (wrong)."""
    c, p, i = (F.avg((F.col("verdict") == v).cast("double")) for v in "CPI")
    return rated.groupBy(*group).agg(F.count("*").alias("n"), F.round(c, 6).alias("strict"), F.round(c + 0.5 * p, 6).alias("weighted"), F.round(i, 6).alias("error"))


def kappa(rated: DataFrame, group: list[str]) -> DataFrame:
    """Cohen's kappa of two raters (r1, r2) by group, with its band; from the items' cells, not from margins."""
    cells = rated.where("r1 IS NOT NULL AND r2 IS NOT NULL").groupBy(*group, "r1", "r2").agg(F.count("*").alias("n"))
    total = cells.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("r1") == F.col("r2"), F.col("n")).otherwise(0)).alias("same"))
    one = cells.groupBy(*group, F.col("r1").alias("r")).agg(F.sum("n").alias("a"))
    two = cells.groupBy(*group, F.col("r2").alias("r")).agg(F.sum("n").alias("b"))
    chance = one.join(two, [*group, "r"]).groupBy(*group).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    k = F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6)
    band = F.when(F.col("kappa") < 0, "poor").when(F.col("kappa") <= 0.2, "slight").when(F.col("kappa") <= 0.4, "fair").when(F.col("kappa") <= 0.6, "moderate").when(F.col("kappa") <= 0.8, "substantial").otherwise("almost perfect")
    return total.join(chance, group, "left").withColumn("ab", F.coalesce("ab", F.lit(0))).select(*group, "n", F.round(po, 6).alias("agreement"), k.alias("kappa")).withColumn("band", band)


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, least, median, mean, p90, most): p90 is the value at place int(0.9 n) of the sorted ones, from 1."""
    ranked = samples.select(group, F.col(value).alias("v"), F.row_number().over(Window.partitionBy(group).orderBy(value)).alias("r"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    return ranked.groupBy(group).agg(
        F.max("n").alias("n"), F.min("v").alias("least"), F.round(F.median("v"), 6).alias("median"), F.round(F.avg("v"), 6).alias("mean"),
        F.max(F.when(F.col("r") == F.greatest(F.lit(1), F.floor(F.col("n") * 9 / 10)), F.col("v"))).alias("p90"), F.max("v").alias("most"),
    )


def routing_accuracy(routed: DataFrame, group: str) -> DataFrame:
    """(group, n, correct, rate): expected routes may hold alternatives, separated by pipes. routed: (expected, got)."""
    ok = F.array_contains(F.split("expected", r"\|"), F.col("got"))
    return routed.groupBy(group).agg(F.count("*").alias("n"), F.count_if(ok).alias("correct"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


def judge_score(c: Column | str) -> Column:
    """A judge's number from text: an integer clamped to 0..5; 0 if there is none."""
    return F.least(F.greatest(F.coalesce(F.regexp_extract(text.col(c), r"(-?\d{1,9})", 1).try_cast("int"), F.lit(0)), F.lit(0)), F.lit(5))


_ITEMS, _NUMBERED, _TABLE = r"[-*•]\s+\w", r"\d\.\s+\w", r"\|"
#: What shows that an answer of a kind is there, tried in order, over its lower case without accents: patterns of which all must be met, with the sign that they are; and what it lacks without any.
SIGNS: dict[str, tuple[list[tuple[list[str], str]], str]] = {
    "trajectory_planning": ([(["caminho|pre-requisito|prerequisito|sequencia|→|->|antes|ordem"], "trajectory_keywords_found"), ([r"\d\."], "ordered_list_found")], "no_trajectory_indicators"),
    "critical_disciplines": ([([_TABLE, "---"], "markdown_table_found"), (["critica|importante|dependente", _ITEMS], "critical_list_found")], "no_critical_table_or_list"),
    "co_prerequisite": ([([_ITEMS], "list_found"), ([_NUMBERED], "numbered_list_found"), (["nenhuma|nao ha"], "explicit_empty_result")], "no_list_found"),
    "prerequisite_chain": ([(["pre-requisito|prerequisito|dependente|necessario|precisa|antes|desbloqueia|disciplina"], "prereq_keywords_found"), ([f"{_ITEMS}|{_NUMBERED}"], "list_found")], "no_prereq_indicators"),
    "discipline_docentes": ([(["docente|professor|leciona|responsavel|ministra"], "docente_keywords_found")], "no_docente_keywords"),
    "listar": ([([f"{_ITEMS}|{_NUMBERED}"], "list_found"), ([_TABLE], "table_found")], "no_list_or_table"),
}
#: Other names of these kinds; signs of an error in answers of other kinds; the least characters of an answer.
SAME = {"prereq": "prerequisite_chain", "dependentes": "prerequisite_chain", "termo": "listar"}
ERRORS, SHORTEST = "nao encontr|error|falha|timeout", 10


def verified(answer: Column | str, kind: Column | str) -> Column:
    """struct(ok, why): whether a symbolic answer shows what one of its kind must; a null or short one is empty, one of another kind only mustn't tell of an error."""
    said, name = text.strip(text.fold(F.coalesce(text.col(answer), F.lit("")))), F.coalesce(text.col(kind), F.lit(""))
    for other, own in SAME.items():
        name = F.when(name == other, own).otherwise(name)

    def met(patterns: list[str]) -> Column:
        out = F.lit(True)
        for p in patterns:
            out = out & said.rlike(p)
        return out

    verdict = lambda ok, why: F.struct(F.lit(ok).alias("ok"), F.lit(why).alias("why"))
    by_kind = F.when(F.length(said) < SHORTEST, verdict(False, "empty_response"))
    for own, (signs, lack) in SIGNS.items():
        for patterns, why in signs:
            by_kind = by_kind.when((name == own) & met(patterns), verdict(True, why))
        by_kind = by_kind.when(name == own, verdict(False, lack))
    return by_kind.when(said.rlike(ERRORS), verdict(False, "error_in_response")).otherwise(verdict(True, "non_empty_response"))
