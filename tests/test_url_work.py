"""Links of pages: each step of an address is worked out at one place of the plan, and odd rows stay as they were."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.functions import urls

SCOPE = {"scopes": (("h.org", "/"), ("y.org", "/p/")), "skip_path": "^/x/", "skip_end": r"\.(?:pdf|zip)"}


def test_steps_stand_once_in_the_plan(spark):
    pages = spark.createDataFrame([("", "")], "html string, url string")
    plan = pages.select(urls.links("html", "url", **SCOPE).alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    # the parts of a reference, of the page's own address and of what comes of them, each by its own patterns, and few more
    assert len(re.findall(r"regexp_|RLIKE", plan)) <= 40
    assert plan.count("split(") == 1


def test_odd_pages(spark):
    html = '<a href="a"> <a HREF = \'a\'> <a href="../b/.">\n<a href=" c/../d ?q#f"> <a href=""> <a href="#top"> <a href="//Y.org:443/p/q//"> <a href="t.PDF"> <a href="x\n/../e"> <a href="1:2"> <a href="mailto:a@h.org"> <a href="?k">'
    rows = [(1, html, "https://u@H.org:80/r/s"), (1, html, "https://u@H.org:80/r/s"), (2, html, None), (3, None, "https://h.org/"), (4, "", "https://h.org/"), (5, html, ""), (6, html, "//h.org/r/s"), (None, '<a href="a">', "http://h.org")]
    df = spark.createDataFrame(rows, "id int, html string, url string")
    got = [(r.id, r.l) for r in df.select("id", urls.links("html", "url", **SCOPE).alias("l")).collect()]
    both = ["https://h.org/r/a", "https://h.org/b", "https://h.org/r/d ", "https://y.org/p/q", "https://h.org/r/e", "https://h.org/r/1:2", "https://h.org/r/s"]
    assert got == [(1, both), (1, both), (2, []), (3, None), (4, []), (5, []), (6, []), (None, ["https://h.org/a"])]
    out = df.select("id", F.explode(urls.links("html", "url", **SCOPE)).alias("target"))
    assert out.where("id = 1").count() == 2 * len(both)


def test_parts_of_odd_addresses(spark):
    names = ["scheme", "authority", "path", "query", "fragment"]
    cases = {
        None: (None, None, None, None, None), "": (None, None, "", None, None), " A+b.c-1:x ": ("a+b.c-1", None, "x", None, None), "1a:x": (None, None, "1a:x", None, None), "a:b:c": ("a", None, "b:c", None, None),
        "//": (None, "", "", None, None), "h:////p": ("h", "", "//p", None, None), "x//y": (None, None, "x//y", None, None), "?": (None, None, "", "", None), "#": (None, None, "", None, ""), "a#b?c#d": (None, None, "a", None, "b?c#d"),
        "//h?a?b#": (None, "h", "", "a?b", ""), "s://a\nb/c\nd?e\nf#g\nh\n": ("s", "a\nb", "/c\nd", "e\nf", "g\nh\n"), "?a:b": (None, None, "", "a:b", None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string")
    p = urls.parts("u")
    got = [tuple(r)[1:] for r in df.select("i", *(p[n].alias(n) for n in names)).orderBy("i").collect()]
    assert got == list(cases.values())


def test_dots(spark):
    cases = {None: None, "": "", ".": "", "..": "", "/": "/", "/..": "/", "a/.": "a/", "a/../..": "", "/a/./b//../c": "/a/b/c", "a/...": "a/...", ".a/b..": ".a/b..", "/a/..\n": "/a/..\n", "//a/..": "//"}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string")
    assert [r.p for r in df.select("i", urls.without_dots("u").alias("p")).orderBy("i").collect()] == list(cases.values())
