"""HTML tables as grids: cells placed by their row and column spans, then records by header, Markdown, and published rows as seeds of a graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import graph

TABLE = re.compile(r"(?is)<table\b[^>]*>(.*?)</table>")
#: A table's rows and cells; their end tags may be left out.
ROW = re.compile(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|\Z)")
CELL = re.compile(r"(?is)<(t[dh])\b([^>]*)>(.*?)(?=</t[dh]>|<t[dh]\b|\Z)")
#: The most columns and rows that a cell may span, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _span(attributes: str, name: str, most: int) -> int:
    found = re.search(rf"(?i)\b{name}\s*=\s*[\"']?\s*(\d+)", attributes)
    return min(int(found.group(1)), most) if found else 1


def place(rows: list[list[tuple[int, int, str, bool]]]) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(row, column, content, head, own) of each place of a table from its rows of (columns, rows, content, head): a cell goes to the first free column, and its content to all places it
    spans, of which `own` is the first. Spans end with the table; a span of 0 rows goes on to its end, one of 0 columns counts as 1."""
    held: dict[int, tuple[int, str, bool]] = {}  # by column: rows still covered from above
    for r, cells in enumerate(rows):
        column, now = 0, {c: h for c, h in held.items() if h[0] > 0}
        held = {c: (left - 1, content, head) for c, (left, content, head) in now.items()}
        for columns, down, content, head in cells:
            while column in now:
                column += 1
            for k in range(max(columns, 1)):
                if column in now:  # a wide cell ends before one from above
                    break
                yield r, column, content, head, k == 0
                held[column] = ((down or MOST_ROWS) - 1, content, head)
                column += 1
        for c, (_, content, head) in now.items():
            yield r, c, content, head, False


def cells_of(html: str | None) -> Iterator[tuple[int, int, int, str, bool, bool]]:
    for at, table in enumerate(TABLE.findall(html or "")):
        rows = [[(_span(a, "colspan", MOST_COLUMNS), _span(a, "rowspan", MOST_ROWS), body, tag.lower() == "th") for tag, a, body in CELL.findall(row)] for row in ROW.findall(table)]
        for cell in place(rows):
            yield at, *cell


@F.udtf(returnType="at int, row int, col int, cell string, head boolean, own boolean")
class GridCells:
    def eval(self, html: str):
        yield from cells_of(html)


def grid(pages: DataFrame) -> DataFrame:
    """(page_id, at, row, col, text, head, own): each place of each table (at) of a page, with the text of the cell that covers it; own is false where that began above or to the left.

    pages: (page_id, html). Places that no cell covers have no row. A table within a table ends the outer one.
    """
    cut = pages.select("page_id", F.col("html").alias("html_")).lateralJoin(GridCells(F.col("html_").outer()))
    return cut.select("page_id", "at", "row", "col", text.html_to_text("cell").alias("text"), "head", "own")


def records(cells: DataFrame) -> DataFrame:
    """(page_id, at, row, fields): the rows below a table's head as maps from header to text. The head is the leading rows of heading cells only, or else the first row.

    Headers of several rows are joined by a slash, repeated parts once; columns without one are left out, of equal ones the first counts.
    """
    key = ["page_id", "at"]
    of_row = cells.groupBy(*key, "row").agg(F.bool_and("head").alias("head"))
    body = of_row.where("NOT head").groupBy(*key).agg(F.min("row").alias("body"))
    tops = of_row.select(*key).distinct().join(body, key, "left").select(*key, F.greatest(F.coalesce("body", F.lit(2**31 - 1)), F.lit(1)).alias("body"))
    marked = cells.join(tops, key)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"])
    heads = marked.where("row < body").groupBy(*key, "col").agg(F.array_join(F.filter(F.array_distinct(parts), lambda t: t != ""), " / ").alias("header")).where("header <> ''")
    first = heads.groupBy(*key, "header").agg(F.min("col").alias("col"))
    entries = marked.where("row >= body").join(first, [*key, "col"]).groupBy(*key, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "text")))).alias("fields"))
    return entries.select(*key, "row", "fields")


def markdown(cells: DataFrame) -> DataFrame:
    """(page_id, at, row, line): rows as Markdown, spanned content once, bars within cells escaped."""
    shown = F.when(F.col("own"), F.replace("text", F.lit("|"), F.lit("\\|"))).otherwise("")
    return cells.withColumn("shown", shown).groupBy("page_id", "at", "row").agg(
        F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "shown"))), lambda s: s["shown"]), " | "), F.lit(" |")).alias("line")
    )


def seeds(rows: DataFrame, key: str, value: str, separator: str = "[,;]") -> DataFrame:
    """(key, value): published records as pairs, a pair for each part of the value's field; blanks and dashes dropped. Headers are compared by their keys."""
    def named(name: str) -> Column:
        return F.get(F.map_values(F.map_filter("fields", lambda k, _: text.graph_key(k) == text.graph_key(F.lit(name)))), F.lit(0))

    pairs = rows.select(F.trim(named(key)).alias("key"), F.explode(F.split(named(value), separator)).alias("value")).select("key", F.trim("value").alias("value"))
    return pairs.where("key <> '' AND value NOT IN ('', '-', '–')").distinct()


def seed_edges(pairs: DataFrame, nodes: DataFrame, keys: dict[str, Column], edges: DataFrame, relation: str, conf: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, relation, conf) that the pairs (key, value) add, from values to keys, and (outcome, pairs): how many are new, were there already, or have an unresolved end.

    Ends are resolved by key (graph.lookup_table). An edge of these ends and this relation that the graph has already stays as it is, whatever its confidence.
    """
    table = graph.lookup_table(nodes, keys)
    ends = pairs.select("key", "value", text.graph_key("key").alias("k"), text.graph_key("value").alias("v"))
    found = ends.join(table.toDF("k", "dst"), "k", "left").join(table.toDF("v", "src"), "v", "left")
    known = edges.where(F.col("relation") == relation).select("src", "dst", F.lit(True).alias("there")).distinct()
    marked = found.join(known, ["src", "dst"], "left").withColumn("outcome", F.when(F.col("src").isNull() | F.col("dst").isNull(), "unresolved").when(F.col("there"), "existing").otherwise("new"))
    new = marked.where("outcome = 'new'").select("src", "dst", F.lit(relation).alias("relation"), F.lit(conf).alias("conf")).distinct()
    return new, marked.groupBy("outcome").agg(F.count("*").alias("pairs"))
