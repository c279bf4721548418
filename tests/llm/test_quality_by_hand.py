"""The quality classifier against a plain one: dense matrices, words as they are, everything in one place."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality_classifier


def features(text):
    words, body = (text or "").encode().split(), (text or "").encode()
    cores = [w.strip(b".,;:!?*$&%#|<>\"'()[]{}=-_").decode().lower() for w in words]
    lines = [x for x in body.split(b"\n") if x.strip()]
    size = max(1, len(body))
    shapes = {
        # an empty text lacks all other characters
        "symbols": (1 - sum(c not in b"#*$%&|<>!" for c in body) / size, (0.002, 0.01, 0.03, 0.06, 0.1)), "capitals": (1 - sum(not 65 <= c <= 90 for c in body) / size, (0.03, 0.06, 0.1, 0.2, 0.4)),
        "pairs": (len(set(zip(cores, cores[1:]))) / max(1, len(words) - 1), (0.1, 0.3, 0.5, 0.7, 0.8, 0.9)), "lines": (len(set(lines)) / max(1, len(lines)), (0.1, 0.3, 0.5, 0.7, 0.9)),
        "size": (len(words), (1, 5, 10, 20, 40, 80, 160, 640, 2560)),
    }
    return set(cores) | {("shape", name, sum(value >= e for e in edges)) for name, (value, edges) in shapes.items()}


def metadata(source, lang, n_chars):
    return {("s", source), ("l", lang), ("n", None if n_chars is None else max(0, n_chars).bit_length()), ("sl", source, lang)}


def logistic(z):
    return 1 / (1 + np.exp(-z))


class Plain:
    """A logistic regression on the words that tell the classes apart, and all else."""

    def __init__(self, selective):
        self.selective, self.names, self.w, self.b, self.scale, self.shift = selective, [], np.zeros(0), 0.0, 1.0, 0.0

    def fit(self, rows, good):
        n, g = len(rows), good.sum()
        names = sorted(set().union(*rows), key=repr)
        if self.selective:
            names = [x for x in names if isinstance(x, tuple) or self.ratio([x in r for r in rows], good) >= 25]
        x = np.array([[float(name in r) for name in names] for r in rows]).reshape(n, len(names))
        w, b = np.zeros(len(names)), math.log((g + 1) / (n - g + 1))
        m, s = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for step in range(1, 251):
            error = logistic(x @ w + b) - good
            gradient = np.append(x.T @ error + w, error.sum()) / n
            m, s = 0.9 * m + 0.1 * gradient, 0.99 * s + 0.01 * gradient**2
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        self.names, self.w, self.b = names, w, b

    @staticmethod
    def ratio(has, good):
        """The likelihood ratio statistic of a two by two table."""
        total, n = 0.0, len(good)
        for a in (True, False):
            for c in (1.0, 0.0):
                seen = sum(h == a and y == c for h, y in zip(has, good))
                expected = sum(h == a for h in has) * sum(y == c for y in good) / n
                total += 2 * seen * math.log(seen / expected) if seen else 0.0
        return total

    def raw(self, row):
        return sum(w for name, w in zip(self.names, self.w) if name in row) + self.b

    def calibrate(self, rows, good):
        z, g = np.array([self.raw(r) for r in rows]), good.sum()
        target = np.where(good > 0, (g + 1) / (g + 2), 1 / (len(good) - g + 2))
        a, c = 1.0, 0.0
        for _ in range(50):
            p = logistic(a * z + c)
            v, e = np.maximum(p * (1 - p), 1e-9), p - target
            h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
            d = np.linalg.solve(h, [(e * z).sum() + 1e-3 * (a - 1), e.sum()])
            a, c = a - d[0], c - d[1]
            if abs(d).max() < 1e-8:
                break
        self.scale, self.shift = max(a, 0.0), c

    def logit(self, row):
        return min(30.0, max(-30.0, self.scale * self.raw(row) + self.shift))


def plain_scores(docs, verdict, numbers):
    """{doc: (text, meta, score)} by co-training. docs: {id: (text, lang, source, n_chars)}."""
    rows = {d: (features(t), metadata(s, lang, n)) for d, (t, lang, s, n) in docs.items()}
    order = sorted(docs, key=numbers.get)
    known = [d for d in order if d in verdict]
    good = np.array([verdict[d] for d in known])
    share = (good.sum() + 1) / (len(good) + 2)
    held, fitted = [i for i in range(len(known)) if i % 5 == 0], [i for i in range(len(known)) if i % 5]
    most = int(0.1 * len(fitted)) + 1
    wanted = {0.0: int(most * (1 - share)) + 1, 1.0: int(most * share) + 1}
    views, taught, told = [Plain(True), Plain(False)], [{}, {}], [set(), set()]
    for turn in range(4):
        for k, view in enumerate(views):
            extra = sorted(taught[k], key=numbers.get)
            view.fit([rows[known[i]][k] for i in fitted] + [rows[d][k] for d in extra], np.append(good[fitted], [taught[k][d] for d in extra]))
            view.calibrate([rows[known[i]][k] for i in held], good[held])
        if turn == 3:
            break
        chosen = []
        for k, view in enumerate(views):
            p = {d: float(logistic(view.logit(rows[d][k]))) for d in docs if d not in verdict and d not in told[k]}
            chosen += [(k, 0.0, d) for d in sorted((d for d in p if p[d] <= 1 - 0.9), key=lambda d: (p[d], numbers[d]))[: wanted[0.0]]]
            chosen += [(k, 1.0, d) for d in sorted((d for d in p if p[d] >= 0.9), key=lambda d: (-p[d], numbers[d]))[: wanted[1.0]]]
        for k, label, d in chosen:
            taught[1 - k][d] = label
            told[k].add(d)
    assert any(taught), "nothing was exchanged"
    prior, out = math.log(share / (1 - share)), {}
    for d in docs:
        t, m = (view.logit(rows[d][k]) for k, view in enumerate(views))
        out[d] = tuple(float(logistic(z)) for z in (t, m, t + m - prior))
    return out


def test_scores_by_hand(spark):
    draw = random.Random(21)
    docs, verdict = {}, {}
    for i in range(150):
        fine = draw.random() < 0.6
        pool = ["calm", "river", "stone", "The", "open", "field", "walks"] if fine else ["BUY!!!", "$$$", "cheap", "click", "now", "the", "win"]
        noise = ["alpha", "beta", "gamma", "Delta,", "(eps)"]
        text = draw.choice([" ", "\n"]).join(draw.choice(pool if draw.random() < 0.6 else noise) for _ in range(draw.randint(3, 60)))
        docs[i] = (text if draw.random() < 0.97 else None, draw.choice(["en", "de", None]), draw.choice(["good.org", "both.net"] if fine else ["spam.biz", "both.net"]), draw.choice([None, len(text)]))
        if i % 2:
            verdict[i] = float(fine if draw.random() < 0.95 else not fine)
    frame = spark.createDataFrame([(i, *d) for i, d in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in verdict.items()], "doc_id long, quality int, toxic int")
    numbers = {r.doc_id: r.n for r in frame.select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("n")).collect()}
    want = plain_scores(docs, verdict, numbers)
    got = quality_classifier.classify(frame, quality_classifier.fit(frame, labels)).collect()
    for r in got:
        assert np.allclose((r.text_score, r.meta_score, r.score), want[r.doc_id], atol=1e-6), r.doc_id
        assert r.kept == (r.score >= 0.5)
    assert len({r.kept for r in got}) == 2
