"""Web pages, feeds and tables as rows; crawl order by joins. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text, urls
from quarry.lineage import Rounds, checkpoint


def sections(pages: DataFrame, tag: str = "h[23]", least: int = 80, size: int = 6000, most: int = 60) -> DataFrame:
    """(page_id, section, part, title, body): parts between headings, of at least `least` characters, cut to `size`, the first `most` of a page."""
    rows = pages.select("page_id", F.posexplode(F.split("html", rf"(?i)(?=<{tag}[ >])")).alias("section", "piece"))
    title = text.html_to_text(F.regexp_extract("piece", rf"(?is)^<{tag}[^>]*>(.*?)</{tag}>", 1))
    body = text.html_to_text(F.regexp_replace("piece", rf"(?is)^<{tag}[^>]*>.*?</{tag}>", " "))
    long = rows.select("page_id", "section", title.alias("title"), body.alias("whole")).where(F.length("whole") >= least)
    cut = long.select("page_id", "section", "title", "whole", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / size).cast("int"))).alias("part"))
    kept = cut.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("section", "part"))).where(F.col("r") <= most)
    return kept.selectExpr("page_id", "section", "part", "title", f"substring(whole, part * {size} + 1, {size}) AS body")


def in_scope(url: Column | str, hosts: tuple[str, ...], skip: str = r"\.(pdf|jpe?g|png|zip|docx?|xlsx?)$") -> Column:
    return F.lower(F.parse_url(text.col(url), F.lit("HOST"))).isin(*hosts) & ~F.lower(F.coalesce(F.parse_url(text.col(url), F.lit("PATH")), F.lit(""))).rlike(skip)


def crawl_order(links: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(url, depth): pages within `depth` links of the seeds, breadth first. links: (src, dst); seeds: (url)."""
    found = frontier = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        new = frontier.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        frontier = checkpoint(new.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        found = found.unionAll(frontier)
    return found


def crawl(pages: DataFrame, seeds: DataFrame, most: int = 400, depth: int = 3, **scope) -> DataFrame:
    """(url, depth, at): the first `most` pages of a breadth-first crawl, in the order in which a queue would fetch them.

    pages: (url, html), what can be fetched, by canonical URL; seeds: (url, at), by their order. A page is asked for once, at its first place: of pages of one depth in the order of the pages that link
    to them, then of the links there. What isn't among the pages counts for nothing. Links are read of fetched pages only, and each round holds no more pages than are still to be fetched.
    """
    rounds = Rounds(pages.sparkSession)
    known = pages.where("url IS NOT NULL").dropDuplicates(["url"])
    start = seeds.select(urls.canonical("url", **scope).alias("url"), F.lit(0).cast("long").alias("by"), F.col("at").cast("long").alias("place"))
    found, n, wanted = None, 0, start.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("by", "place")).alias("place"))
    for d in range(depth + 1):
        if found is not None:
            wanted = wanted.join(found.select("url"), "url", "left_anti")
        fetched = wanted.join(known.select("url"), "url", "left_semi").orderBy("place", "url").limit(most - n)
        # at most as many rows as may still be fetched
        numbered = fetched.select("url", F.lit(d).alias("depth"), (F.row_number().over(Window.orderBy("place", "url")) + n).cast("long").alias("at"))
        new = rounds.keep(f"depth{d}", numbered)
        found = new if found is None else found.unionAll(new)
        count = new.count()
        n += count
        if not count or n >= most or d == depth:
            break
        out = known.join(new, "url").select("at", F.posexplode(urls.links("html", "url", **scope)).alias("i", "url"))
        wanted = rounds.keep(f"wanted{d}", out.groupBy("url").agg(F.min(F.struct(F.col("at").alias("by"), F.col("i").cast("long").alias("place"))).alias("place")))
    out = checkpoint(found)
    rounds.done()
    return out


def section_label(url: Column | str) -> Column:
    """The second part of a path, else the first part of the host."""
    second = F.get(F.split(F.parse_url(text.col(url), F.lit("PATH")), "/"), F.lit(2))
    return F.coalesce(F.nullif(second, F.lit("")), F.substring_index(F.parse_url(text.col(url), F.lit("HOST")), ".", 1))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed, title, link, published, summary) of RSS items, newest first. feeds: (feed, xml)."""
    rows = feeds.select("feed", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)).alias("item"))

    def element(name: str) -> Column:
        return text.html_to_text(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))

    date = F.try_to_timestamp(F.regexp_extract(element("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return rows.select("feed", element("title").alias("title"), element("link").alias("link"), date.alias("published"), element("description").alias("summary")).orderBy(F.desc_nulls_last("published"), "link")


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, at, row, markdown): rows of HTML tables as arrays of cells, and as Markdown."""
    tables_ = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("at", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), text.html_to_text)
    return tables_.select("page_id", "at", cells.alias("row")).withColumn("markdown", F.concat(F.lit("| "), F.array_join("row", " | "), F.lit(" |")))


def seed_map(seeds: DataFrame, key: str, value: str) -> DataFrame:
    """A map<string, array<string>> column as (key, value) rows, values trimmed, blanks dropped."""
    return seeds.select(F.explode("entries").alias(key, "v")).select(key, F.explode("v").alias(value)).select(key, F.trim(value).alias(value)).where(F.col(value) != "")
