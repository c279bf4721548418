from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import language_id, quality_classifier, queries
from quarry.llm.common import table

SMALL = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    out = queries.op8_language_id(spark, SMALL)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, ("the quick brown fox jumps over " * 3, "der schnelle braune fuchs springt weit ")[i % 2] * 2, "en" if i % 2 == 0 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (None, "fox " * 60_000, "x"), (5, "fuchs", None), (5, "fuchs", None)], "doc_id long, text string, score string")
    got = [(r["lang_pred"], r["score"]) for r in language_id.predict(odd, network).collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == "en" and got[4] == got[5] and got[4][0] in ("de", "en")
    assert language_id.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), network).collect() == []


def test_no_language_is_lost_to_a_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "EPOCHS", 0)  # the sample is what counts here
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('wort ', id) AS text", "concat('l', id % 30) AS lang")
    assert language_id.fit(docs).languages == sorted(f"l{i}" for i in range(30))


def test_windows_cover_every_byte():
    for n in (1, 5, 127, 128, 129, 252, 253, 254, 1000):
        text = bytes((i * 37) % 251 + 1 for i in range(n))
        found = language_id.windows_of(text)
        stride = language_id.WINDOW - max(language_id.WIDTHS) + 1
        for i in range(n - 3):
            assert any(0 <= i - k * stride <= language_id.WINDOW - 4 and w[i - k * stride : i - k * stride + 4].tobytes() == text[i : i + 4] for k, w in enumerate(found))


def test_gradient_lowers_the_loss():
    draw = np.random.default_rng(0)
    x = draw.integers(97, 123, (300, language_id.WINDOW)).astype(np.uint8)
    y = draw.integers(0, 2, 300)
    x[y == 1, 10:14] = np.frombuffer(b"zqzq", np.uint8)
    network = language_id.Network.new(["a", "b"], 1)
    for seed in range(12):
        network.train(x, y, seed)
    assert (network.probabilities(x).argmax(axis=1) == y).mean() > 0.95


def test_quality_against_labels(spark):
    out = queries.op1_quality_classifier(spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").join(table(spark, SMALL, "documents").select("doc_id", "text"), "doc_id").collect()
    clean = [r for r in out if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r for r in out if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) / len(clean) >= 0.99
    assert sum(r["kept"] for r in junk) / len(junk) <= 0.1
    toxic = [r for r in out if r["toxic"] == 1 and any(w in r["text"].lower() for w in ("idiot", "scum", "moron", "trash"))]
    assert toxic and sum(r["kept"] for r in toxic) / len(toxic) <= 0.1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "w " * 60_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x")).withColumn("good", F.lit("x")).withColumn("number", F.lit("x"))
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, no_labels)
    got = quality_classifier.classify(docs, model).collect()
    assert len(got) == 4 and {r["score"] for r in got} == {0.5}
    odd = spark.createDataFrame([(1, 1, None), (1, None, 1), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert not quality_classifier.fit(docs, odd).trained
    assert quality_classifier.classify(docs.limit(0), model).collect() == []


def test_views_teach_each_other():
    """One view is blind on the labelled rows' words of half of the pool; the other view's labels teach it."""
    draw = np.random.default_rng(0)
    n = 2000
    good = draw.integers(0, 2, n).astype(float)
    known = np.arange(n) < 500
    text = [np.array([10 + int(g), 20 + int(draw.integers(5))]) if k or draw.random() < 0.5 else np.array([30 + int(g)]) for g, k in zip(good, known, strict=True)]
    meta = [np.array([40 + int(g if draw.random() < 0.99 else 1 - g)]) for g in good]
    model = quality_classifier.co_train(text, meta, np.where(known, good, 0), known)
    late = [i for i in range(n) if text[i][0] >= 30]
    p = quality_classifier.sigmoid(model.text.logits([text[i] for i in late], model.text.table()))
    assert ((p > 0.5) == (good[late] > 0.5)).mean() > 0.9


def naive_probabilities(network, text):
    """Straight from the definition: every window, every filter at every place."""
    data = text.encode().lower()
    total = np.zeros(len(network.languages))
    windows = language_id.windows_of(data)
    for w in windows:
        hidden = []
        for table, bias in zip(network.tables, network.biases, strict=True):
            for f in range(language_id.FILTERS):
                best = max(sum(float(table[j][w[i + j]][f]) for j in range(len(table))) for i in range(language_id.WINDOW - len(table) + 1))
                hidden.append(max(0.0, best + float(bias[f])))
        z = np.array(hidden) @ network.out.astype(float) + network.out_bias
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return total / len(windows)


def test_language_by_naive_convolution(spark, monkeypatch):
    monkeypatch.setattr(language_id, "FILTERS", 3)
    network = language_id.Network.new(["a", "b", "c"], 4)
    texts = ["short", "ein etwas längerer Text mit Umlauten: äöüß " * 9, "x", "the quick brown fox " * 20]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), network).collect()
    for r in got:
        p = naive_probabilities(network, r["text"])
        assert abs(p.max() - r["score"]) < 1e-5 and network.languages[int(p.argmax())] == r["lang_pred"]


def test_gradient_by_differences(monkeypatch):
    monkeypatch.setattr(language_id, "FILTERS", 2)
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    monkeypatch.setattr(language_id, "RATE", 1e-3)
    draw = np.random.default_rng(2)
    x, y = draw.integers(97, 103, (20, language_id.WINDOW)).astype(np.uint8), draw.integers(0, 2, 20)
    loss = lambda net: -np.log(net.probabilities(x)[np.arange(20), y]).mean()
    net = language_id.Network.new(["a", "b"], 3)
    net.tables, net.biases = [t.astype(float) for t in net.tables], [b.astype(float) for b in net.biases]
    net.out, net.out_bias = net.out.astype(float), net.out_bias.astype(float)
    slopes = []
    for values in (net.tables[1], net.out, net.biases[0]):
        place = np.unravel_index(np.argmax([abs(v) for v in values.ravel()]), values.shape) if values is not net.tables[1] else (0, int(x[0, 0]), 0)
        values[place] += 1e-5
        up = loss(net)
        values[place] -= 2e-5
        slopes.append((values, place, (up - loss(net)) / 2e-5))
        values[place] += 1e-5
    before = [float(v[p]) for v, p, _ in slopes]
    net.train(x, y, 1)  # one step of Adam moves each value by RATE against its slope's sign
    for (values, place, slope), old in zip(slopes, before, strict=True):
        assert abs(slope) < 1e-7 or np.sign(old - values[place]) == np.sign(slope)


def test_the_sample_of_a_language_is_the_first_by_hash(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 50)
    monkeypatch.setattr(language_id, "EPOCHS", 0)
    seen = []
    monkeypatch.setattr(language_id, "_sample", lambda seed: lambda batches: (seen.append(0) or b.select([2, 1]).rename_columns(["lang", "window"]).cast(pa.schema([("lang", pa.string()), ("window", pa.binary())])) for b in batches))
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, id, null) AS doc_id", "concat('wort ', id % 3000, repeat('.', 200)) AS text", "if(id % 10 = 0, 'rare', 'often') AS lang")
    monkeypatch.setattr(language_id.np, "frombuffer", lambda data, kind: np.zeros(data.count(b"wort") * language_id.WINDOW, np.uint8))
    monkeypatch.setattr(language_id.Network, "train", lambda self, x, y, seed: seen.append(np.bincount(y).tolist()))
    language_id.fit(docs)
    assert seen[-1] == [50, 50]


def test_fit_by_brute_force(spark):
    """The same as co-training in memory with all rows at hand."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = quality_classifier.fit(docs, labels)
    verdict = {r["doc_id"]: float(r["quality"] == 1 and r["toxic"] == 0) for r in labels.collect()}
    hashed = sorted(docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)), "doc_id", "text", "source", "lang", "n_chars").collect())
    cache = quality_classifier.WordFeatures()
    text = [quality_classifier.text_features((r["text"] or "").encode(), cache) for r in hashed]
    meta = [quality_classifier.meta_features(r["source"], r["lang"], r["n_chars"]) for r in hashed]
    known = np.array([r["doc_id"] in verdict for r in hashed])
    plain = quality_classifier.co_train(text, meta, np.array([verdict.get(r["doc_id"], 0.0) for r in hashed]), known)
    assert 20 < known.sum() < len(hashed) and model.prior == plain.prior
    for a, b in ((model.text, plain.text), (model.meta, plain.meta)):
        assert a.features.tolist() == b.features.tolist() and np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias) and np.isclose(a.scale, b.scale)
    alone = quality_classifier.fit(docs, labels, rounds=0)
    assert not np.array_equal(alone.text.features, model.text.features) or not np.allclose(alone.text.weights, model.text.weights)  # the pool taught something


def test_numbers_are_no_letters(spark):
    network = language_id.Network.new(["de", "en"], 1)
    docs = spark.createDataFrame([(1, "²"), (2, "½ 12"), (3, "Ⅻ ٣ _"), (4, "²é"), (5, "ªº"), (6, "日")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, network).collect()}
    assert {k for k, v in got.items() if v == "und"} == {1, 2, 3}


def test_training_does_not_depend_on_the_order_of_rows(spark):
    """Windows that share their first bytes are in one order too, however tasks were dealt."""
    rows = [(i, f"the same start of many texts {chr(97 + i % 26)} {i * 7919 % 1000}", "en" if i % 2 else "de") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_id.fit(d) for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(7)))
    assert np.array_equal(one.out, two.out) and all(np.array_equal(a, b) for a, b in zip(one.tables, two.tables, strict=True))


def test_clashing_names_of_the_classifier(spark):
    rows = [(i, "good words here " * 5 if i % 2 else "bad $$$ !!! " * 9, "en", "a", i, "x", 1.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int, fed_n_chars_ string, fed_text_ double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs, quality_classifier.fit(docs, labels))
    assert out.columns == [*docs.columns, "text_score", "meta_score", "score", "kept"]
    assert {r.fed_n_chars_ for r in out.collect()} == {"x"} and all(r.kept == (r.doc_id % 2 == 1) for r in out.collect())


def test_fit_is_bounded_in_features(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(200)), "en", "a", 9) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(docs, labels, rounds=0).trained
    # ten rows at least are asked for a fit, and so many have more features than this
    assert not quality_classifier.fit(docs, labels, rounds=0, fitted=2000).trained
