"""Operators that SQL can express, against that SQL on whole tables, and on small cases with defined results."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, queries, quality_rules, source_mixing, substring_dedup, topk_search, wordhash

SMALL = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SMALL}/{f}'")
    got = queries.queries()[name](spark, SMALL)
    expected = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_dedup(rows, width):
    """Per row: the words that stay, straight from the definition."""
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, float("inf")), float("inf") if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (float("inf") if doc_id is None else doc_id):
                gone |= set(range(i, i + width))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def digest_rows(out):
    return [tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()]


def test_substring_dedup_by_brute_force(spark):
    draw = random.Random(2)
    passages = [[draw.choice("abcdefg") for _ in range(draw.randint(4, 30))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(draw.randint(0, 5)):
            w += draw.choice(passages) if draw.random() < 0.5 else [draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 12))]
        rows.append((draw.choice([None, i, i, i, i // 2]), draw.choice([" ", "\n", "\t "]).join(w) if draw.random() < 0.95 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(digest_rows(substring_dedup.remove_repeats(docs, width=5)), key=key) == sorted(brute_dedup(rows, 5), key=key)


@pytest.mark.parametrize("bound", [0, 7, 200_000])
def test_substring_dedup_remembers_repeats(monkeypatch, bound):
    """Whatever a task remembers, the repeats are those of the definition; with room enough a common passage is shuffled rarely."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    ids = rng.sample(range(1000), 120)
    rows = [(i, " ".join([*(rng.choice("abcdefgh") for _ in range(rng.randrange(9))), *passage])) for i in ids]
    monkeypatch.setattr(substring_dedup, "Frequent", lambda cls=substring_dedup.Frequent: cls(bound))
    batches = [
        pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part]), pa.array([i for i, _ in part])], ["id_", "text_", "sum_"])
        for part in (rows[at : at + 6] for at in range(0, len(rows), 6))
    ]
    hashed = [r for b in substring_dedup._hash_windows(5, 1, "id_", "text_")(iter(batches)) for r in b.to_pylist()]
    lost = substring_dedup._find_repeats(1)(pa.Table.from_pylist(hashed))
    found = {r["id_"]: substring_dedup.common.unpack(r["starts"]) for r in substring_dedup._gather(lost).to_pylist()}
    removed = [(i, sum(b - a for a, b in substring_dedup.intervals(found.get(i, np.empty(0, np.int64)), 5))) for i in ids]
    assert removed == [(i, n) for i, _, n, _ in brute_dedup(rows, 5)]
    shuffled = sum(len(r["hashes"]) // 8 for r in hashed if r["hashes"])
    assert bound < 200_000 or shuffled < 8 * 15 + sum(len(t.split()) - 4 for _, t in rows) - 8 * len(rows)


def test_substring_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "few words", "x"), (5, long, "x"), (5, long, "x"), (6, "start " + long + " end", "x"), (None, long, "x")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string"))
    got = sorted(((r["doc_id"] or 99, r["n_words"], r["n_removed"], r["removed"]) for r in out.collect()), key=lambda r: r[:3])
    assert [r[:3] for r in got] == [(1, 0, 0), (2, 0, 0), (3, 2, 0), (5, 60_000, 0), (5, 60_000, 0), (6, 60_002, 60_000), (99, 60_000, 60_000)]
    assert [tuple(s) for s in got[5][3]] == [(1, 60_001)]
    empty = substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []


def test_intervals_merge():
    assert substring_dedup.intervals(np.array([3, 4, 5, 9, 30, 30]), 5) == [(3, 14), (30, 35)]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = {i: [j for j in sets if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in sets}
    return sorted((i, root[i], min([i, *(j for j in links[i] if sets[j] == sets[i])]), len(links[i]), len(sets[i])) for i in sets)


def near_copies(draw, n, edits):
    base = [f"b{draw.randint(0, 9999)}" for _ in range(120)]
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"e{draw.randint(0, 9999)}"
        yield " ".join(w)


def test_similarity_groups_by_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    texts = [t for _ in range(6) for t in near_copies(draw, 12, 3)] + [" ".join(f"x{draw.randint(0, 99)}" for _ in range(40)) for _ in range(60)]
    texts += ["", " ", "one two", "one two", "one two three"] + [" ".join(["same"] * 300)] * 3
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_groups(rows)
    assert sorted(map(tuple, jaccard_join.similarity_groups(docs).collect())) == expected
    # blocks of a cluster are compared in pairs
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    assert sorted(map(tuple, jaccard_join.similarity_groups(docs).collect())) == expected


def test_similarity_edges(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, None, "x"), (4, "", None), (None, "a b c d e f", "x"), (7, "z " * 50_000, "x")]
    got = {r["doc_id"]: r for r in jaccard_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string, sig string")).collect()}
    assert len(got) == 6
    assert [got[i]["class_id"] for i in (1, 2, 3, 4, None, 7)] == [1, 1, 3, 4, None, 7]
    assert [got[i]["n_links"] for i in (1, 2, 3, 4, None, 7)] == [1, 1, 0, 0, 0, 0]
    assert jaccard_join.similarity_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_keeps_similar_pairs():
    for n, least in jaccard_join.least_matches(0.8, 1e-9).items():
        from math import comb

        below = sum(comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(least))
        assert below < 1e-9 <= below + comb(n + 1, least) * 0.8**least * 0.2 ** (n + 1 - least)


def test_intersections_agree():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 300, 200).astype(np.uint64)) for _ in range(30)]
    left, right = np.triu_indices(30, 1)
    assert (jaccard_join.intersections(sets, left, right) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)]).all()
    assert (jaccard_join.intersections(sets, left[:3], right[:3]) == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left[:3], right[:3], strict=True)]).all()


def test_window_hashes_do_not_depend_on_their_place():
    known, powers = wordhash.WordHashes(), wordhash.Powers()
    a, b = b"a b c d e f g".split(), b"x y c d e f g z".split()
    h, text, position = wordhash.window_hashes(wordhash.word_hashes(a + b, known), np.array([len(a), len(a) + len(b)]), 5, powers)
    at = {(int(t), int(p)): int(v) for t, p, v in zip(text, position, h, strict=True)}
    assert at[0, 2] == at[1, 2] and len(set(at.values())) == len(at) - 1


def test_top_k_by_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    odd = [(1000, None), (1001, []), (1002, [None] * 8), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1100, [0.5, 0.5]), (None, [0.1] * 8), (5, rows[5][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    q = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows}
    expected = []
    for i in (0, 100, 200, 300):
        best = sorted((-int(q[i] @ v), j) for j, v in q.items() if j != i)[:10]
        expected += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == expected
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_mixing(spark):
    rows = [(i, "t" * (i % 7), "abc"[i % 3]) for i in range(3000)] + [(9000, None, "a"), (9001, "tt", None), (9002, "", "none"), (None, "ttt", "a"), (5, "t" * 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("x")).withColumn("cdf", F.lit("x"))
    out = source_mixing.mix(docs, {"a": 3.0, "b": 1.0, "c": 0.0, None: 0.1}).collect()
    assert {r["source"] for r in out} <= {"a", "b", None}
    mass = {s: sum(len(r["text"] or "") for r in out if r["source"] == s) for s in "ab"}
    assert 2.7 < mass["a"] / mass["b"] < 3.3
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    again = source_mixing.mix(docs.repartition(7), {"a": 3.0, "b": 1.0, "c": 0.0, None: 0.1}).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    rates = [r["n_copies"] for r in out if r["source"] == "a" and r["copy"] == 1]
    assert max(rates) >= 4  # means above 1 are drawn, not rounded
    assert source_mixing.mix(docs.limit(0)).collect() == []


def test_rules_edges(spark):
    prose = lambda i: " ".join(f"word{(i * 7 + k) % 97}x{k}" for k in range(80))
    rows = [(i, prose(i), "en", "s") for i in range(80)]
    odd = [(100, None, "en", "s"), (101, "", None, None), (102, "* " * 90 + prose(1), "en", "s"), (103, prose(3), None, "t"), (104, "again and " * 100, "en", "s"), (105, prose(1).upper(), "en", "s"), (None, prose(2), "en", "s")]
    out = quality_rules.apply_rules(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x"))).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[i] for i in range(80)) and kept[103] and kept[None]
    assert not any(kept[i] for i in (100, 101, 102, 104, 105))
    assert {r["doc_id"]: r["n_repeat_words"] for r in out}[104] == 200
    assert quality_rules.apply_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_top_k_against_its_sql_on_repeated_ids(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in draw.normal(0, 0.3, 4)]) for i in [*range(0, 400, 20), 100, 100, 7, 7, 7]]
    rows += [(100, rows[5][1]), (1, rows[5][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op3_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.oracle_sql()['op3_topk_search']})").fetchall())
    assert sum(r["query_id"] == 100 for r in got) == 40  # four rows ask with this id


def test_top_k_scores_are_exact_integers(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**40, 1.0]), (2, [2.0**40, 0.0]), (3, [2.0**40, 3.0]), (4, [-(2.0**50), 7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") == 0, k=2, scale=1).collect()]
    assert got == [(0, 1, 3, 2**60 + 3), (0, 2, 1, 2**60 + 1)]
    draw = random.Random(8)
    for size in (2**20, 2**30, 2**31):
        v = np.array([[float(draw.randint(-size, size)) for _ in range(3)] for _ in range(300)])
        for a, which, scores in topk_search.nra(v, v[:5], np.arange(300), np.arange(5), 4):
            true = sorted((-sum(int(x) * int(y) for x, y in zip(v[a], v[i], strict=True)), i) for i in range(300) if i != a)[:4]
            assert [(-int(s), int(i)) for i, s in zip(which, scores, strict=True)] == true


def test_windows_differ_by_either_hash():
    """Two windows that the first hash can't tell apart meet in different buckets, unless the second can't either."""
    flat = wordhash.word_hashes(b"a b c d e f g h".split(), wordhash.WordHashes())
    at = np.arange(5)
    one, two = (wordhash.hashes_at(f, at, 4, wordhash.Powers(b)) for f, b in ((flat, wordhash.BASE), (wordhash.mixed(flat), wordhash.SECOND_BASE)))
    assert len(set(one.tolist()) | set(two.tolist())) == 10
    again = wordhash.hashes_at(wordhash.mixed(flat[2:]), np.arange(3), 4, wordhash.Powers(wordhash.SECOND_BASE))
    assert (again == two[2:]).all()


def test_internal_names_do_not_clash(spark):
    prose = lambda i: " ".join(f"word{(i * 7 + k) % 97}x{k}" for k in range(80))
    odd = ["u_", "block_", "source_", "rate_", "steps_", "t_", "words_", "keys_", "lines_", "lang_", "lost_id_", "lost_sum_", "id_", "sum_", "upper_rate_low", "text_", "row", "n", "sig", "salt_"]
    docs = spark.createDataFrame([(i, prose(i % 30), "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    more = docs.select("*", *(F.lit(f"mine {c}").alias(c) for c in odd))
    for run in (source_mixing.mix, quality_rules.apply_rules, substring_dedup.remove_repeats):
        plain_, full = run(docs), run(more)
        assert full.columns == [*more.columns, *plain_.columns[len(docs.columns) :]]
        assert sorted(map(tuple, full.select(plain_.columns).collect()), key=repr) == sorted(map(tuple, plain_.collect()), key=repr)
        assert all(full.where(F.col(c) != f"mine {c}").isEmpty() for c in odd)
    assert sorted(jaccard_join.similarity_groups(more).collect()) == sorted(jaccard_join.similarity_groups(docs).collect())


def poisson_inverse(mean, u):
    from math import exp, lgamma, log

    n, total = 0, exp(-mean)
    while total <= u:
        n += 1
        total += exp(n * log(mean) - mean - lgamma(n + 1))
    return n


def test_mixing_survives_large_rates(spark):
    docs = spark.createDataFrame([(1, "t", "tiny"), *((i, "word " * 2000, "rest") for i in range(2, 90))], "doc_id long, text string, source string")
    out = source_mixing.mix(docs, {"tiny": 0.05, "rest": 1.0})
    tiny = out.where("source = 'tiny'").agg(F.count("*"), F.max("copy"), F.max("n_copies"), F.max("rate"), F.countDistinct("copy")).first()
    assert tiny[0] == tiny[1] == tiny[2] == tiny[4] and abs(tiny[0] - tiny[3]) < 6 * tiny[3] ** 0.5 and tiny[3] > 40_000
    us = [k / 1009 + 0.0003 for k in range(0, 1009, 16)]
    for mean in (0.01, 1.0, 7.5, 399.0, 401.0, 690.0):  # exp(-mean) is a number
        first = 0 if mean < source_mixing.LARGE else int(mean - source_mixing.REACH * mean**0.5)
        log_first = -mean if not first else first * math.log(mean) - mean - math.lgamma(first + 1)
        steps = math.ceil(mean - first + source_mixing.REACH * mean**0.5) + 24
        frame = spark.createDataFrame([(u, mean, first, log_first, steps) for u in us], "u double, rate_ double, first_ long, log_first_ double, steps_ int")
        assert [r[0] for r in frame.select(F.expr(source_mixing.inverse("u"))).collect()] == [poisson_inverse(mean, u) for u in us]


def test_larger_lookups_are_salted(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 7 + 1), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    lookup = source_mixing.common.checkpoint(spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "s string, v long"))
    rows = []
    for most in (10, 2):
        joined = source_mixing.common.join_lookup(docs, lookup, docs["source"].eqNullSafe(lookup["s"]), F.xxhash64("doc_id"), max_rows=most)
        rows.append(sorted(map(tuple, joined.collect()), key=repr))
    assert rows[0] == rows[1] and len(rows[0]) == 300
    joined = source_mixing.common.join_lookup(docs, lookup, docs["source"].eqNullSafe(lookup["s"]), F.xxhash64("doc_id"), max_bytes=5)
    assert sorted(map(tuple, joined.collect()), key=repr) == rows[0]


def test_fences_see_the_whole_range(spark):
    """Mean word lengths far over 20 characters are still told apart, and small groups lean on their parents."""
    rows = [(i, " ".join("x" * (40 + (i + k) % 5) for k in range(60)), "zz", "s") for i in range(200)] + [(900, " ".join("x" * (90 + k % 5) for k in range(60)), "zz", "s")]
    rows = [(i, " ".join(f"{w}{k:02d}" for k, w in enumerate(t.split())), lang, s) for i, t, lang, s in rows]
    rows += [(901, rows[3][1], "zz", "rare"), (902, rows[-1][1], "zz", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs).collect()}
    assert all(kept[i] for i in range(200)) and kept[901] and not kept[900] and not kept[902]
    value = spark.range(1).select(*(F.expr(quality_rules.cell(f"{v}L")) for v in (0, 1, 2047, 2048, 2049, 5_000_001))).first()
    assert list(value) == [0, 1, 2047, 2048, 2048, 5_000_001 >> 12 << 12]


def sketches(texts):
    known, powers = wordhash.WordHashes(), wordhash.Powers()
    return [jaccard_join.minhash(x) for x in jaccard_join.shingle_sets([t.encode().split() for t in texts], 5, known, powers)]


def bucket_rows(sig):
    """Rows (key, i, j, node, bytes), sorted, of all buckets of several members."""
    at = {}
    for node, s in enumerate(sig):
        for band in range(jaccard_join.HASHES // jaccard_join.band_rows(jaccard_join.THRESHOLD)):
            at.setdefault((band, *s[4 * band : 4 * band + 4].tolist()), []).append(node)
    rows = [(k, 0, 0, node, jaccard_join.one_byte(sig[node]).tobytes()) for k, nodes in enumerate(at.values()) if len(nodes) > 1 for node in nodes]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 50], strict=True)], ["key", "i", "j", "node", "bytes"]) for i in range(0, len(rows), 50)]
    return batches, sum(len(n) * (len(n) - 1) // 2 for n in at.values())


def test_templated_pages_do_not_become_a_cluster(monkeypatch):
    """Pages of pairwise similarity 0.4 are mates in many buckets; only mates are compared, and no link is left."""
    draw = random.Random(6)
    template = [f"t{i}" for i in range(120)]
    pages = [" ".join(template + [f"p{draw.randint(0, 10**9)}" for _ in range(87)]) for _ in range(150)]
    batches, candidates = bucket_rows(sketches(pages))
    compared = []
    real = jaccard_join._surviving
    monkeypatch.setattr(jaccard_join, "_surviving", lambda sig, a, b, least: (compared.append(max(len(a), len(b))), real(sig, a, b, least))[1])
    links = [tuple(r.values()) for b in jaccard_join._links(0.8, 1e-9)(iter(batches)) for r in b.to_pylist()]
    assert candidates > 3000 and sum(compared) <= candidates
    assert len(links) < 5


@pytest.mark.parametrize("together", [0, 3, 1000])
def test_links_connect_what_pruning_leaves(monkeypatch, together):
    monkeypatch.setattr(jaccard_join, "TOGETHER", together)
    draw = random.Random(9)
    sig = sketches([t for _ in range(9) for t in near_copies(draw, 14, 30)])
    batches, _ = bucket_rows(sig)
    low = np.stack([jaccard_join.one_byte(s) for s in sig])
    least = jaccard_join.least_matches(0.8, 1e-9)
    edges = set()
    for a in range(len(sig)):
        for b in range(a):
            share = any((sig[a][4 * k : 4 * k + 4] == sig[b][4 * k : 4 * k + 4]).all() for k in range(jaccard_join.HASHES // jaccard_join.band_rows(jaccard_join.THRESHOLD)))
            if share and all((low[a][:n] == low[b][:n]).sum() >= m for n, m in least.items()):
                edges.add((b, a))

    def parts(pairs):
        root = list(range(len(sig)))
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    links = [tuple(r.values()) for b in jaccard_join._links(0.8, 1e-9)(iter(batches)) for r in b.to_pylist()]
    assert parts(links) == parts(edges) and len(set(parts(edges))) < len(sig)


def test_buckets_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET", 5)
    draw = random.Random(7)
    texts = [t for _ in range(3) for t in near_copies(draw, 25, 4)]
    rows = list(enumerate(texts))
    assert sorted(map(tuple, jaccard_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())) == brute_groups(rows)


def test_texts_that_share_an_id(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(5, a), (5, b), (5, b), (9, b), (3, a), (8, None), (8, "x")]
    got = sorted(map(tuple, jaccard_join.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()))
    assert got == [(3, 3, 1), (5, 3, 1), (5, 5, 1), (8, 8, 0), (8, 8, 0), (9, 5, 1)]


def test_components_of_stars_and_chains(spark):
    from quarry.llm.components import components

    links = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 160)] + [(160, 39)] + [(200, 201), (201, 202)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {**dict.fromkeys([*range(40), *range(100, 161)], 0), **dict.fromkeys([200, 201, 202], 200)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bands_follow_the_threshold():
    assert [jaccard_join.band_rows(t) for t in (0.95, 0.8, 0.5, 0.3, 0.11)] == [4, 4, 2, 1, 1]
    for t in (0.11, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95):
        rows = jaccard_join.band_rows(t)
        assert (1 - t**rows) ** (jaccard_join.HASHES // rows) <= 1e-6
    with pytest.raises(ValueError, match="below"):
        jaccard_join.band_rows(0.05)


def test_low_thresholds_find_their_pairs(spark):
    """Pairs of similarity 0.33 to 0.45, which bands for 0.8 would mostly miss."""
    draw = random.Random(12)
    rows = []
    for i in range(60):
        base = [f"w{i}x{k}" for k in range(60)]
        at = draw.randint(25, 30)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:at], *(f"v{i}x{k}" for k in range(60 - at)), *base[at:]][:80]))]
    sets = {k: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for k, t in rows}
    alike = {i for i in range(60) if 0.3 <= len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in jaccard_join.similarity_groups(docs, threshold=0.3).collect()}
    assert len(alike) > 30 and {i for i in range(60) if got[2 * i + 1] == 2 * i} == alike


def test_wide_vectors_make_smaller_blocks(spark, monkeypatch):
    """Blocks are bounded in components too, and give the same."""
    draw = np.random.default_rng(11)
    rows = [(i, draw.normal(size=40).round(2).tolist()) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = lambda: sorted(map(tuple, topk_search.top_k(vectors, F.col("vec_id") % 10 == 0, 3).collect()))
    whole = ask()
    monkeypatch.setattr(topk_search, "CELLS", 40 * 7)
    assert ask() == whole and len(whole) == 27
