"""Source divergence audit against a plain recount, and its defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from quarry.llm import divergence_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(lower(text or ""))
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in sources if x != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(draw, n):
    words = [a + b for a in "abcdeäßж" for b in ("", "x", "Xy", "z", "é")]
    out = []
    for _ in range(n):
        lang = draw.choice(["en", "en", "en", "de", None, "fr"])
        source = draw.choice(["hot"] * 6 + ["a", "b", "Z", None, "é"]) if lang != "fr" else "only"
        text = "".join(draw.choice(words) + draw.choice([" ", ", ", "1", "\n", "_", "\x7f"]) for _ in range(draw.choice([0, 1, 5, 40])))
        out.append((lang, source, None if draw.random() < 0.05 else text))
    return out


def audited(spark, rows, **options):
    docs = spark.createDataFrame([(i % 3, *r, "own") for i, r in enumerate(rows)], "doc_id int, lang string, source string, text string, rank string").repartition(5)
    out = divergence_audit.audit(docs, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def test_by_brute_force(spark):
    rows = rows_of(random.Random(5), 300)
    rows += rows[:7]
    assert audited(spark, rows, least=30, top=6) == brute(rows, 30, 6)


def test_defined_cases(spark):
    assert audited(spark, []) == []
    few = [("en", "a", "one two"), ("en", "b", None), ("en", "b", ""), (None, None, "x"), ("de", "solo", "ein")]
    # no term is kept: pairs of value 0, nothing for a language of one source
    assert audited(spark, few) == brute(few, 30, 50) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audited(spark, few, least=1) == brute(few, 1, 50)


def test_small_blocks(monkeypatch):
    """Blocks, pieces of long texts, batches that cut a term's rows, and stripes of sources give the same."""
    monkeypatch.setattr(divergence_audit, "PIECE", 16)
    for text in (b"", b"a", b"Ab1cd " * 30, b"x" * 100, b"  " + b"yz" * 40 + b" w" * 9, "é".encode() * 40 + b" q", b" " * 50):
        assert [w for words in divergence_audit.terms(text) for w in words] == [w.encode() for w in TERM.findall(lower(text.decode()))]
    block = divergence_audit.Block()
    rows = rows_of(random.Random(6), 60)
    for i, (lang, source, text) in enumerate(rows):
        block.add((lang or "", source or ""), i, (text or "").encode())
    got = Counter()
    for batch in block.partial_runs():
        for r in batch.to_pylist():
            got[r["lang"], r["source"], r["term"]] += 1000 * r["n_docs"] + r["n"]
    want = Counter()
    for lang, source, text in rows:
        found = TERM.findall(lower(text or ""))
        want[lang or "", source or "", ""] += 1000
        want.update({(lang or "", source or "", t): 1000 + n for t, n in Counter(found).items()})
    assert got == want


def test_scan_over_batches():
    rows = sorted((lang, term, source, doc) for lang in ("", "en") for term in ("", "a", "b", "c") for source in "xyz" for doc in range(4) if (term, source) != ("b", "y"))
    import pyarrow as pa

    table = pa.table({"lang": [r[0] for r in rows], "term": [r[1] for r in rows], "source": [r[2] for r in rows], "doc": [r[3] for r in rows], "n_docs": [1] * len(rows), "n": [2] * len(rows)})
    for size in (1, 3, 5, 1000):
        out = [r for b in divergence_audit._scan(10)(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert [(r["lang"], r["term"]) for r in out] == [(lang, t) for lang in ("", "en") for t in ("", "a", "c")]
        assert all(r["sources"] == ["x", "y", "z"] and r["counts"] == [8, 8, 8] for r in out)


def test_shares_are_exact():
    big = np.array([[10**17, 3]])
    totals = np.array([10**18 + 7, 11])
    assert divergence_audit.shares(big, totals, 5, 10**9).tolist() == [[1 + 10**9 * (10**17 + 5) // (10**18 + 7), 1 + 10**9 * 8 // 11]]
