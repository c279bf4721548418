"""Quality rules with adaptive thresholds, all in DataFrame operations.

Five integer measures of a text are compared with fences that adapt to its language and source, in place
of fixed cutoffs. The fences come from mergeable quantile sketches: for each group and measure, the
counts of its values, rounded down to their leading BITS bits. So a sketch is exact up to 2**BITS - 1 and has a relative error of 2**(1 - BITS) beyond, over the
whole range, and at most 2**(BITS - 1) cells for each doubling of the values, whatever the corpus size. Sketches merge by adding counts. Quartiles
of a language are drawn towards those of all documents, and those of a source towards its language's, with the weight of PRIOR documents:
(n * own + PRIOR * parent's) / (n + PRIOR), so small groups need no switch. With the quartiles q1 and q3, a document is rejected if a measure lies
outside [q1 - r, q3 + r], r = max(FENCE * (q3 - q1), that measure's least reach). The least reach is there for measures that most texts
have no trace of (0 in both quartiles): a text with one repeated line isn't an outlier.

Measures, per thousand but for the last: symbols to characters of words, repeated lines to lines with a word, words in
repeated three-word windows to words, letters A to Z to characters of words (shouting), and mean word length in hundredths.

Words are runs of characters other than ASCII white space, from whole texts. Defined results: a null text has no words; null
languages and sources are groups of their own. Documents with fewer than 50 words, or with more than half of their words in repeated windows, fail
the base rules and are left out of the sketches; if none is left, there are no fences and nothing else fails. Repeated rows count each and get equal verdicts; a value
at a fence is inside; an empty table stays empty; texts of any length are measured whole, in arrays of their words. Columns of the names added are replaced, all others pass, whatever their name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PRIOR, FENCE = 50, 3
BITS = 11
#: measure: (SQL, least reach, whether low values are rejected too)
MEASURES = {
    "symbol_rate": ("n_symbols * 1000 div greatest(word_chars, 1)", 20, False),
    "dup_line_rate": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 300, False),
    "repeat_rate": ("n_repeat_words * 1000 div greatest(n_words, 1)", 300, False),
    "upper_rate": ("n_upper * 1000 div greatest(word_chars, 1)", 100, False),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 150, True),
}
ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "kept")
WHITE = " \t\n\u000b\f\r"


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and base_failed."""
    docs = docs.drop(*ADDED)
    t, w, keys, lines = common.free_names(docs, "t_", "words_", "keys_", "lines_")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.withColumn(t, text).withColumn(w, F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    hashed = words.withColumn("n_words", F.size(w).cast("long")).withColumn(
        keys, F.expr(f"if(n_words < 3, array(), transform(sequence(0, n_words - 3), i -> xxhash64(get({w}, int(i)), get({w}, int(i) + 1), get({w}, int(i) + 2))))")
    )
    # positions are sorted by window only in texts in which one is repeated
    pairs = f"sort_array(transform({keys}, (k, i) -> struct(k, i)))"
    twice = "sort_array(transform(filter(x, (p, j) -> p.k = get(x, j - 1).k OR p.k = get(x, j + 1).k), p -> p.i))"
    covered = f"aggregate(transform(array({pairs}), x -> {twice}), 0L, (n, at) -> n + aggregate(transform(at, (p, j) -> least(3, coalesce(get(at, j + 1) - p, 3))), 0L, (a, x) -> a + x))"
    cut = hashed.withColumn(lines, F.expr(rf"filter(split({t}, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    return cut.select(
        *docs.columns,
        "n_words",
        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(array_distinct({keys})) = size({keys}), 0L, {covered})").alias("n_repeat_words"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def cell(value: str) -> str:
    """SQL: the value rounded down to its leading BITS bits."""
    low = f"greatest(length(bin({value})) - {BITS}, 0)"
    return f"shiftleft(shiftright({value}, {low}), {low})"


def fences(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang_, source_, <measure>_low, <measure>_high) for every group that occurs, from sketches."""
    values = F.array(*(F.struct(F.lit(m).alias("measure"), F.expr(cell(sql)).alias("cell")) for m, (sql, _, _) in MEASURES.items()))
    base = measured.select(F.col(lang_col).alias("lang_"), F.col(source_col).alias("source_"), "base_failed", F.inline(values))
    sketch = common.checkpoint(base.groupBy("lang_", "source_", "measure", "cell").agg(F.count_if(~F.col("base_failed")).alias("n")))
    by = {"source": ["lang_", "source_"], "lang": ["lang_"], "all": []}
    groups = sketch.select("lang_", "source_").distinct()
    found = groups
    for level, keys in by.items():
        merged = sketch.where("n > 0").groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
        of = Window.partitionBy(*keys, "measure")
        ranked = merged.withColumns({"upto": F.sum("n").over(of.orderBy("cell")), "total": F.sum("n").over(of)})
        quartiles = ranked.groupBy(*keys, "measure").agg(
            F.max("total").alias("total"), *(F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("cell"))).alias(f"q{q}") for q in (1, 3))
        )
        wide = quartiles.groupBy(*keys).agg(
            F.max("total").alias(f"{level}_total"),
            *(F.max(F.when(F.col("measure") == m, F.struct("q1", "q3"))).alias(f"{level}_{m}") for m in MEASURES),
        )
        wide = wide.withColumnsRenamed({k: f"{k}{level}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}{level}"))
        found = found.join(F.broadcast(wide) if not keys else wide, on, "left")
    out = []
    for m, (_, reach, low) in MEASURES.items():
        q = {}
        for x in ("q1", "q3"):
            q[x] = f"cast(all_{m}.{x} AS double)"
            for level in ("lang", "source"):
                q[x] = f"coalesce(({level}_total * {level}_{m}.{x} + {PRIOR} * {q[x]}) / ({level}_total + {PRIOR}), {q[x]})"
        r = f"greatest({FENCE} * ({q['q3']} - {q['q1']}), {reach}D)"
        out += [F.expr(f"{q['q1']} - {r}" if low else "-1D").alias(f"{m}_low"), F.expr(f"{q['q3']} + {r}").alias(f"{m}_high")]
    return found.select("lang_", "source_", *out)


def apply_rules(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents (without their texts, if keep_text is false) with their measures, base_failed and kept.

    Measures are checkpointed, as fences and verdicts both need them; without texts that takes little room.
    """
    measured = measure(docs, text_col)
    measured = common.checkpoint(measured if keep_text else measured.drop(text_col))
    limits = fences(measured, lang_col, source_col)
    names = dict(zip(limits.columns, common.free_names(measured, *limits.columns), strict=True))
    limits = common.checkpoint(limits.toDF(*names.values()))
    same = measured[lang_col].eqNullSafe(limits[names["lang_"]]) & measured[source_col].eqNullSafe(limits[names["source_"]])
    joined = common.join_lookup(measured, limits, same, F.xxhash64(*(measured[c] for c in ("n_words", "word_chars", "n_lines", "n_upper"))))
    inside = F.lit(True)
    for m, (sql, _, _) in MEASURES.items():
        inside = inside & F.coalesce(F.expr(sql).between(F.col(names[f"{m}_low"]), F.col(names[f"{m}_high"])), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop(*names.values())
