"""References resolved as RFC 3986 has them, canonical forms, and a capped crawl against a queue."""

from __future__ import annotations

import random
from collections import deque
from urllib.parse import urljoin, urlsplit

from quarry.functions import urls
from quarry.sources import web

#: The examples of RFC 3986, section 5.4.
BASE = "http://a/b/c/d;p?q"
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def resolved(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, reference string, base string")
    return [r.u for r in df.select("i", urls.resolve("reference", "base").alias("u")).orderBy("i").collect()]


def test_examples_of_the_standard(spark):
    assert dict(zip(EXAMPLES, resolved(spark, [(r, BASE) for r in EXAMPLES]), strict=True)) == EXAMPLES


def test_random_references(spark):
    draw = random.Random(1)
    piece = lambda: draw.choice(["a", "b.html", "..", ".", "x y", "é", "c;d"])
    pairs = []
    for _ in range(400):
        base = draw.choice(["https://h.org", "http://h.org:8080/", "https://u@h.org/" + "/".join(piece() for _ in range(draw.randint(0, 4)))]) + draw.choice(["", "?k=v", "/"])
        reference = draw.choice(["", "/", "../", "../../"]) + "/".join(piece() for _ in range(draw.randint(1, 5))) + draw.choice(["", "?q=1/../2", "#f", "/"])
        pairs.append((reference, base))
    for (reference, base), got in zip(pairs, resolved(spark, pairs), strict=True):
        want = urljoin(base, reference)
        if not any(x in urlsplit(base).path + "/" for x in ("/../", "/./", "//")):  # of these the library leaves some as they are
            assert got == want, (reference, base)
    assert resolved(spark, [(None, BASE), ("g", None)]) == [None, None]


def test_canonical(spark):
    scope = {"scopes": (("x.org", "/s/"), ("y.org", "/")), "skip_path": "^/s/private/", "skip_end": r"\.(?:pdf|png)"}
    cases = {
        "http://X.org/s/a/": "https://x.org/s/a", "https://x.org/s": "https://x.org/s", "https://x.org/sa": None, "https://y.org": "https://y.org/", "https://y.org/a?b#c": "https://y.org/a",
        "https://x.org/s/private/a": None, "https://x.org/s/a.PDF": None, "https://z.org/": None, "mailto:a@y.org": None, "//y.org/a": None, "https://y.org:443/a//": "https://y.org/a", "javascript:void(0)": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.c for r in df.select("u", urls.canonical("u", **scope).alias("c")).collect()} == cases
    html = """<a href="../a">1</a><A HREF='b?x=1'>2</A><a href="#top">3</a><a href="../a/">4</a><a href="https://else.org/">5</a>"""
    row = spark.createDataFrame([(html, "https://y.org/p/q/r")], "html string, url string").select(urls.links("html", "url", scopes=(("y.org", "/"),)).alias("l")).first()
    assert row.l == ["https://y.org/p/a", "https://y.org/p/q/b"]


def queue(pages, seeds, most, depth):
    """The crawl as a plain queue."""
    todo, seen, out = deque((s, 0) for s in seeds), set(), []
    while todo and len(out) < most:
        url, d = todo.popleft()
        if url in seen:
            continue
        seen.add(url)
        if url not in pages:
            continue
        out.append((url, d, len(out) + 1))
        if d < depth:
            todo += [(link, d + 1) for link in pages[url] if link not in seen]
    return out


def test_crawl_equals_queue(spark):
    draw = random.Random(4)
    name = lambda i: f"https://s.org/d/{i}"
    pages = {name(i): [name(draw.randrange(90)) for _ in range(draw.randint(0, 5))] for i in range(70)}
    html = [(u, " ".join(f'<a href="{draw.choice([x, x.removeprefix("https://s.org/d/"), x.replace("https://s.org", "") + "/"])}">' for x in links)) for u, links in pages.items()]
    seeds = [name(3), name(80), name(5), name(3)]
    got = lambda most, depth: sorted(map(tuple, web.crawl(spark.createDataFrame(html, "url string, html string"), spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, at int"), most, depth).collect()), key=lambda r: r[2])
    for most, depth in ((400, 3), (10, 3), (1, 3), (25, 9), (400, 0)):
        assert got(most, depth) == queue(pages, seeds, most, depth)
    none = spark.createDataFrame([], "url string, html string")
    assert web.crawl(none, spark.createDataFrame([("https://s.org/", 0)], "url string, at int")).collect() == []
