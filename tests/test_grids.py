"""Cells by spans: random tilings written as HTML and read back, golden tables, records and seeds."""

from __future__ import annotations

import random

from quarry.sources import grids


def tiling(draw, height, width):
    """A grid filled with numbered rectangles, and the cells of each row as HTML has them."""
    filled, rows, n = [[None] * width for _ in range(height)], [], 0
    for r in range(height):
        cells = []
        for c in range(width):
            if filled[r][c] is None:
                wide = 1
                while c + wide < width and filled[r][c + wide] is None and draw.random() < 0.4:
                    wide += 1
                tall = draw.randint(1, height - r) if draw.random() < 0.4 else 1
                for i in range(r, r + tall):
                    for j in range(c, c + wide):
                        filled[i][j] = n
                cells.append((wide, tall, n))
                n += 1
        rows.append(cells)
    return filled, rows


def test_tilings(spark):
    draw = random.Random(6)
    pages, want = [], []
    for page in range(40):
        filled, rows = tiling(draw, draw.randint(1, 7), draw.randint(1, 6))
        tag = lambda: draw.choice(["td", "TD", "th"])
        html = "".join("<tr>" + "".join(f"<{tag()} colspan={w} rowspan='{t}'>c{n}" + draw.choice(["</td>", ""]) for w, t, n in cells) + draw.choice(["</tr>", ""]) for cells in rows)
        pages.append((page, f"text<table>{html}</table>more"))
        want += [(page, r, c, f"c{n}") for r, line in enumerate(filled) for c, n in enumerate(line)]
    got = grids.grid(spark.createDataFrame(pages, "page_id int, html string"))
    assert sorted((r.page_id, r.row, r.col, r.text) for r in got.collect()) == sorted(want)
    assert got.where("own").count() == sum(len({n for _, _, _, n in [w for w in want if w[0] == p]}) for p in range(40))


def test_records_and_markdown(spark):
    html = """<table><tr><th rowspan=2>Term<th colspan=2>Course<th></th></tr><tr><th>Code<th>Name<th>x</tr>
    <tr><td rowspan="0">1</td><td>a|b</td><td><i>Al</i>pha</td></tr><tr><td>c</td><td></td><td>-</td><td>over</td></tr></table>
    <table><tr><td>k</td><td>v</td></tr><tr><td colspan=2>both</td></tr></table><table></table>"""
    cells = grids.grid(spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page_id int, html string"))
    rows = {(r.at, r.row): r.fields for r in grids.records(cells).collect()}
    assert rows == {(0, 2): {"Term": "1", "Course / Code": "a|b", "Course / Name": "Al pha"}, (0, 3): {"Term": "1", "Course / Code": "c", "Course / Name": "", "x": "-"}, (1, 1): {"k": "both", "v": "both"}}
    lines = {(r.at, r.row): r.line for r in grids.markdown(cells).collect()}
    assert lines[0, 0] == "| Term | Course |  |  |" and lines[0, 2] == "| 1 | a\\|b | Al pha |" and lines[1, 1] == "| both |  |"


def test_seeds(spark):
    rows = spark.createDataFrame([({"Código": "10", "Pré-requisitos": "1; 2,-"},), ({"Código": "", "Pré-requisitos": "1"},), ({"Código": "11", "Pré-requisitos": "9"},), ({"other": "x"},)], "fields map<string, string>")
    pairs = grids.seeds(rows, "codigo", "Pre Requisitos")
    assert sorted(map(tuple, pairs.collect())) == [("10", "1"), ("10", "2"), ("11", "9")]
    nodes = spark.createDataFrame([("1",), ("2",), ("10",), ("11",)], "node_id string")
    edges = spark.createDataFrame([("1", "10", "P", 0.5), ("2", "10", "Q", 1.0)], "src string, dst string, relation string, conf double")
    new, counts = grids.seed_edges(pairs, nodes, {"code": nodes["node_id"]}, edges, "P", 0.9)
    assert [tuple(r) for r in new.collect()] == [("2", "10", "P", 0.9)]
    assert {r.outcome: r.pairs for r in counts.collect()} == {"existing": 1, "new": 1, "unresolved": 1}
