"""Small repairs and gates around answers: links, suggestions, acceptance, language, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.names import containing

#: Words that tell an English text.
ENGLISH = ("the", "and", "are", "is", "all", "every", "explicitly", "evidence", "therefore", "supported", "grounded")
#: Words of short acceptances, and those of which one must be there.
ACCEPTS = tuple("""sim s quero pode podes claro por favor pfv ok okay manda bora isso aceito beleza blz uhum aham detalha detalhe detalhar vai vamos ser gentileza otimo perfeito top
traz traga mostra""".split())
STRONG = tuple("sim s quero pode podes claro ok okay manda bora aceito beleza blz uhum aham detalha detalhe detalhar traz traga mostra pfv".split())


def tail(url: Column | str) -> Column:
    """The last path segment, if it has six characters or more."""
    last = F.substring_index(F.regexp_replace(F.coalesce(F.parse_url(text.col(url), F.lit("PATH")), F.lit("")), "/+$", ""), "/", -1)
    return F.when(F.length(last) >= 6, last)


def repair_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """(id, url, fixed): unknown URLs become the only known one with the same tail; others stay. found: (id, url); known: (url)."""
    all_known = known.select("url").distinct()
    unique = all_known.select(tail("url").alias("tail"), F.col("url").alias("fixed")).where("tail IS NOT NULL").groupBy("tail").agg(F.min("fixed").alias("fixed"), F.count("*").alias("n")).where("n = 1").drop("n")
    fine = all_known.select("url", F.lit(True).alias("fine"))
    joined = found.join(fine, "url", "left").withColumn("tail", tail("url")).join(unique, "tail", "left")
    return joined.select("id", "url", F.when(F.col("fine"), F.col("url")).otherwise(F.coalesce("fixed", "url")).alias("fixed"))


#: What a URL in a text is, and marks after it that don't belong to it.
URL, AFTER = r"https?://[^\s<>)\]\"']+", r"[.,;:!?]+$"


def links_in_text(answer: Column | str, context: Column | str) -> Column:
    """The answer with each URL that its context lacks replaced by the context's only one with the same fragment, else by its only one whose last path segment, of six characters or more, is the same.

    Marks after a URL stay; others, and answers without a context, stay as they are.
    """
    said, known = text.col(answer), F.array_distinct(F.regexp_extract_all(F.coalesce(text.col(context), F.lit("")), F.lit(URL), 0))
    fragment = lambda u: F.when(F.contains(u, F.lit("#")), F.regexp_extract(u, r"^[^#]*#(.*)$", 1))
    last = lambda u: F.substring_index(F.regexp_replace(F.substring_index(u, "#", 1), "/+$", ""), "/", -1)
    only = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))

    def fixed(whole: Column) -> Column:
        url = F.regexp_replace(whole, AFTER, "")
        by_fragment = only(F.filter(known, lambda k: fragment(k) == fragment(url)))
        by_tail = F.when(F.length(last(url)) >= 6, only(F.filter(known, lambda k: last(k) == last(url))))
        return F.when(F.array_contains(known, url), whole).otherwise(F.coalesce(F.concat(F.coalesce(by_fragment, by_tail), F.regexp_extract(whole, AFTER, 0)), whole))

    between, urls = F.split(said, URL), F.transform(F.regexp_extract_all(said, F.lit(URL), 0), fixed)
    return F.array_join(F.zip_with(between, urls, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def english(c: Column | str, least: int = 3) -> Column:
    """Whether at least `least` of the English words stand in the text, as substrings."""
    low = F.lower(text.col(c))
    hits = F.lit(0)
    for w in ENGLISH:
        hits = hits + low.contains(w).cast("int")
    return hits >= least


def accepts(c: Column | str, words: tuple[str, ...] = ACCEPTS, strong: tuple[str, ...] = STRONG, most: int = 5) -> Column:
    """At most five words, all from the vocabulary of acceptances, one of them a strong one."""
    said = F.filter(F.split(F.regexp_replace(text.fold(c), r"[!?.,;:\s]+", " "), " "), lambda w: w != "")
    return (F.size(said) > 0) & (F.size(said) <= most) & F.forall(said, lambda w: w.isin(*words)) & F.exists(said, lambda w: w.isin(*strong))


def suggestions(answers: DataFrame, templates: DataFrame, most: int = 3) -> DataFrame:
    """(id, rank, suggestion): follow-ups of an answer's intent whose text is not in it already. answers: (id, intent, text); templates: (intent, at, suggestion), fixed and small."""
    fresh = answers.join(F.broadcast(templates), "intent").where(~F.contains(F.lower("text"), F.lower("suggestion")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "rank", "suggestion")


def split_footer(c: Column | str, marker: str) -> tuple[Column, Column]:
    """The text before and after the last marker; without one the whole text and null."""
    whole = text.col(c)
    has = F.contains(whole, F.lit(marker))
    after = F.substring_index(whole, marker, -1)
    return F.when(has, F.substring(whole, F.lit(1), F.length(whole) - F.length(after) - len(marker))).otherwise(whole), F.when(has, after)


def with_fallback(context: DataFrame, more: DataFrame, least: int = 200) -> DataFrame:
    """Rows of context, and of more for the queries whose context has fewer than `least` characters. Both: (query, doc, text)."""
    size = context.groupBy("query").agg(F.sum(F.length("text")).alias("size"))
    thin = more.join(size, "query", "left").where(F.coalesce("size", F.lit(0)) < least).drop("size")
    return context.unionByName(thin.join(context.select("query", "doc"), ["query", "doc"], "left_anti"))


def compose(parts: DataFrame) -> DataFrame:
    """(question, parts, answer, confidence, artefact): the parts' answers joined in order, the least confidence, the first artefact. parts: (question, at, text, confidence, artefact)."""
    order = F.array_sort(F.collect_list(F.struct("at", "text")))
    return parts.groupBy("question").agg(
        F.count("*").alias("parts"), F.array_join(F.transform(order, lambda s: s["text"]), "\n").alias("answer"), F.min("confidence").alias("confidence"),
        F.min_by("artefact", F.when(F.col("artefact").isNotNull(), F.col("at"))).alias("artefact"),
    )


def fuzzy_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name, score): the best name of each term: 100 if equal, 80 if it holds all the term's words, 50 if it contains the term; ties by name.

    terms: (term); names: (name), distinct names of a dimension. Equal names and shared words are found by equi-joins.
    """
    asked = terms.select("term", text.graph_key("term").alias("k")).where("k <> ''").distinct()
    known = names.select("name", text.graph_key("name").alias("nk")).distinct()
    words = lambda c: F.array_distinct(F.split(c, " "))
    shared = asked.select("term", "k", F.size(words("k")).alias("n"), F.explode(words("k")).alias("w")).join(known.select("name", "nk", F.explode(words("nk")).alias("w")), "w")
    subset = shared.groupBy("term", "k", "n", "name", "nk").agg(F.count("*").alias("c")).where("c = n").select("term", "name", F.when(F.col("k") == F.col("nk"), 100).otherwise(80).alias("score"))
    part = containing(asked, "k", known, "nk").select("term", "name", F.lit(50).alias("score"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "name"))
    return subset.unionAll(part).withColumn("r", rank).where("r = 1").select("term", "name", "score")
