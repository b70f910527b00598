"""Cells of both sides compared inside their row, and plain markup that is only cut."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from pagegauge.functions import grids as G, markup, patterns as P
from pagegauge.operators import cells as C

CELL = "array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>>"


def some_cells(r):
    return [(r.choice([None, 0, 1, 2]), r.choice([None, 0, 1]), 1, r.choice([1, 2]), r.choice(["a", "b", None]), r.random() < 0.3)
            for _ in range(r.randint(0, 7))]


def test_cells_paired_in_the_row_equal_the_join(spark):
    r = random.Random(3)
    tables = spark.createDataFrame(
        [(k, some_cells(r), some_cells(r)) for k in range(120)] + [(120, None, some_cells(r)), (121, None, None)],
        f"id int, gt_cells {CELL}, pred_cells {CELL}").cache()
    joined = C.join_cells(*[C.explode_cells(tables, ["id"], f"{s}_cells") for s in ("gt", "pred")], ["id"])
    flat = ["id", "row", "col", *[f"{s}.{f}" for s in ("gt", "pred") for f in C.CELL_FIELDS]]
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(C.pair_cells(tables, ["id"]).select(*flat)) == rows(joined.select(*flat))
    scores = C.paired_cell_scores(tables).drop("gt_cells", "pred_cells").where("cell_accuracy IS NOT NULL")
    assert rows(scores) == rows(C.cell_scores(joined, ["id"]))

    items = ["row", "col", "text"]
    from pagegauge.operators.multiset import multiset_counts
    counted = multiset_counts(*[C.explode_cells(tables, ["id"], f"{s}_cells") for s in ("gt", "pred")], ["id"], items)
    inside = tables.where("coalesce(size(gt_cells), 0) + coalesce(size(pred_cells), 0) > 0").select(
        "id", G.cell_overlap(F.col("gt_cells"), F.col("pred_cells")).cast("long").alias("overlap"))
    assert rows(inside) == rows(counted.select("id", "overlap"))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range|single)", plan, re.I))


@pytest.mark.parametrize("name, most", [
    ("cell_accuracy", 0), ("cell_diff", 0), ("cell_multiset", 0), ("table_page_scores", 0), ("cell_issue_counts", 1)])
def test_cells_are_not_shuffled(spark, name, most):
    assert exchanges(contract.queries()[name](spark, "/root/testdata/sf0.001")) <= most


def test_plain_markup_reads_as_any_other(spark):
    plain = ["", "<table><tr><th>a b</th><td></td></tr><tr><td>ü.</td></tr></table>",
             "<table><tr><td>1</td></tr></table>\n\n<table><tr><td>x</td><td>y z</td></tr></table>"]
    other = ["<table><tr><td> a</td></tr></table>", "<table><tr><td>a  b</td></tr></table>", "<table><tr><td>a&amp;</td></tr></table>",
             "<table><tr><td>*a*</td></tr></table>", "<table><tr><td>×</td></tr></table>", "<table><tr><td>х</td></tr></table>",
             "<table><tr><td colspan=2>a</td></tr></table>", "<table><tr></tr></table>", "<table><tr><td>a</tr></table>", None]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(plain + other)], "id int, html string").repartition(1)
    html = F.col("html")
    told = [r[0] for r in df.orderBy("id").select(html.rlike(P.PLAIN_TABLES)).collect()]
    assert told == [True] * len(plain) + [False] * (len(other) - 1) + [None]
    # A comment in front changes nothing but the path that is taken.
    marked = F.concat(F.lit("<!-- c -->"), html)
    for one, two in df.select(G.html_grids(html), G.html_grids(marked)).where("html IS NOT NULL").collect():
        assert one == two
    for columns in ("ordinal", "colspan", "occupied"):
        for one, two in df.select(G.html_cells(html, columns), G.html_cells(marked, columns)).collect():
            assert one == (two or [])


def slow_distance(a, b):
    """Top-down distance without trimming, bounds or special cases."""
    line = [0]
    for other in b[2]:
        line.append(line[-1] + other[1])
    for child in a[2]:
        fresh = [line[0] + child[1]]
        for k, other in enumerate(b[2]):
            fresh.append(min(line[k + 1] + child[1], fresh[k] + other[1], line[k] + slow_distance(child, other)))
        line = fresh
    return (a[0] != b[0]) + line[-1]


def test_markup_distance_equals_the_plain_recursion():
    r = random.Random(5)

    def table():
        rows = ["".join(f"<{t}>{r.choice(['a', 'b', 'c', '', '<b>x</b>', 'a&amp;b'])}</{t}>" for t in r.choices(["td", "th"], k=r.randint(0, 4)))
                for _ in range(r.randint(0, 5))]
        return "<table>" + "".join(f"<tr>{row}</tr>" for row in rows) + "</table>"

    assert isinstance(markup.read_table("<table><tr><td>a</td></tr></table>"), tuple)
    for _ in range(2000):
        a, b = table(), table()
        want = slow_distance(*[markup.freeze(markup.first_table(t)) for t in (a, b)])
        assert markup.tree_distance(markup.read_table(a), markup.read_table(b)) == want
        assert markup.tree_size(markup.read_table(a)) == markup.tree_size(markup.first_table(a))


def test_cells_of_markup_are_counted_without_pairing_them(spark, monkeypatch):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>c</td><td>d</td></tr></table>"
    pages = spark.createDataFrame([(1, html, html.replace("d<", "x<")), (2, html, "<table><tr><td>a</td></tr></table>")], "id int, g string, p string")
    tables = pages.select("id", G.html_cells(F.col("g"), "ordinal").alias("gt_cells"), G.html_cells(F.col("p"), "ordinal").alias("pred_cells"))
    monkeypatch.setattr(G, "paired_cells", lambda *_: F.raise_error(F.lit("paired")).cast(
        f"array<struct<row:int,col:int,gt:{CELL[6:-1]},pred:{CELL[6:-1]}>>"))
    found = C.paired_cell_scores(tables).orderBy("id").select("cell_accuracy", "structure_precision", "structure_recall").collect()
    assert [tuple(r) for r in found] == [(0.75, 1.0, 1.0), (0.25, 1.0, 0.25)]
