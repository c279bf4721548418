"""DuckDB SQL for the operators' queries, written independently of the Spark code."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS window_text FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY window_text) AS least FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM m WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n_kept
  FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b, x.n + y.n - common AS united, common
  FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common * 10 >= 8 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.doc_id)
SELECT d.doc_id,
  (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS class_id,
  least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE a = d.doc_id AND common = united), d.doc_id)) AS copy_of,
  (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links,
  coalesce((SELECT n FROM n WHERE n.doc_id = d.doc_id), 0) AS n_shingles
FROM d
"""

OP2 = """
WITH m AS (SELECT source, sum(length(text)) AS mass FROM documents GROUP BY source HAVING sum(length(text)) > 0),
r AS (SELECT source, (power(mass, 0.7) / sum(power(mass, 0.7)) OVER ()) * (sum(mass) OVER () / mass) AS rate FROM m),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate))::BIGINT + 25)) AS k FROM r),
c AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, any_value(rate) AS rate, count(*) AS n FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND cdf <= u GROUP BY doc_id)
SELECT d.*, n::INTEGER AS n_copies, round(rate, 6) AS rate, copy::INTEGER AS copy,
  md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS shuffle_key
FROM documents d JOIN (SELECT doc_id, rate, n, unnest(range(1, n + 1)) AS copy FROM n) USING (doc_id)
"""

OP3 = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

_RATES = {
    "symbol_rate": ("n_symbols * 1000 // greatest(word_chars, 1)", 20, False),
    "dup_line_rate": ("n_dup_lines * 1000 // greatest(n_lines, 1)", 300, False),
    "repeat_rate": ("n_repeat_words * 1000 // greatest(n_words, 1)", 300, False),
    "upper_rate": ("n_upper * 1000 // greatest(word_chars, 1)", 100, False),
    "word_length": ("word_chars * 100 // greatest(n_words, 1)", 150, True),
}


def _fence(measure: str, slack: int, low: bool) -> str:
    q1, q3 = (f"s_{q}_{measure}" for q in ("q1", "q3"))
    reach = f"greatest(3 * ({q3} - {q1}), {slack}::DOUBLE)"
    return f"coalesce({measure} <= {q3} + {reach}" + (f" AND {measure} >= {q1} - {reach}, true)" if low else ", true)")


def _shrunk(level: str, parent: str, n: str) -> str:
    """Quartiles of a level, drawn towards those of its parent with the weight of 50 documents."""
    own = lambda m, q: f"{level}.{q}_{m}"
    above = lambda m, q: f"a.{q}_{m}::DOUBLE" if parent == "a" else f"{parent}_{q}_{m}"
    return ", ".join(f"coalesce(({n} * {own(m, q)} + 50 * {above(m, q)}) / ({n} + 50), {above(m, q)}) AS {level}_{q}_{m}" for m in _RATES for q in ("q1", "q3"))


def _quartiles(measures) -> str:
    # the smallest value that a quarter, or three quarters, of the rows don't exceed
    return ", ".join(f"quantile_disc({m}_cell, {q}) AS {n}_{m}" for m in measures for n, q in (("q1", 0.25), ("q3", 0.75)))


OP7 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
cov AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    (n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {", ".join(f"{sql} AS {m}, ({m} >> greatest(length(bin({m})) - 11, 0)) << greatest(length(bin({m})) - 11, 0) AS {m}_cell" for m, (sql, _, _) in _RATES.items())} FROM m),
s AS (SELECT lang, source, count(*) AS ns, {_quartiles(_RATES)} FROM b WHERE NOT base_failed GROUP BY ALL),
l AS (SELECT lang, count(*) AS nl, {_quartiles(_RATES)} FROM b WHERE NOT base_failed GROUP BY ALL),
a AS (SELECT {_quartiles(_RATES)} FROM b WHERE NOT base_failed),
groups AS (SELECT DISTINCT lang, source FROM b),
gl AS (SELECT g.*, {_shrunk("l", "a", "nl")} FROM groups g LEFT JOIN l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a),
gs AS (SELECT gl.lang, gl.source, {_shrunk("s", "l", "ns")} FROM gl LEFT JOIN s ON gl.lang IS NOT DISTINCT FROM s.lang AND gl.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_fence(m, slack, low) for m, (_, slack, low) in _RATES.items())} AS kept
FROM b JOIN gs ON b.lang IS NOT DISTINCT FROM gs.lang AND b.source IS NOT DISTINCT FROM gs.source
"""

_P = "1 + (1000000000::HUGEINT * ({count} + 5)) // ({n} + 5 * v)"

OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(DISTINCT doc) AS docs, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS n_lang
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) USING (lang)
    LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL) USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(count="coalesce(c.n, 0)", n="g.n")} AS p, {_P.format(count="k.n", n="g.n_lang")} AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM f QUALIFY part = 'pair' OR rank <= 50
"""

OP12 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
p AS (SELECT doc_id, t, unnest(range(1, octet_length(t) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, t[i:i] AS b, CASE WHEN i <= octet_length(t) - 199 THEN t[i:i + 199] END AS w FROM p),
r AS (SELECT doc_id, i, b, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS repeats FROM s),
c AS (SELECT doc_id, i, b, coalesce(max(CASE WHEN repeats THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 200, false) AS gone FROM r),
e AS (SELECT doc_id, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(hex(b), '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM e GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES = {
    "op2_source_mixing": OP2, "op3_topk_search": OP3, "op5_substring_dedup": OP5, "op7_quality_rules": OP7, "op9_jaccard_join": OP9,
    "op11_divergence_audit": OP11, "op12_suffix_dedup": OP12,
}
