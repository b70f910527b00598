"""Tables as nested array columns: parsing, cell lists and per-table metrics.

A grid is ``array<array<string>>`` with equally long rows.  All metrics here
stay inside the row that holds the two grids, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions import arrow, patterns as P, text as X
from pagegauge.functions.exprs import collapse, let, lines, list_where, prf, ratio, strip
from pagegauge.functions.metrics import edit_similarity

NO_GRIDS = "array<array<array<string>>>"
GRID = "array<array<string>>"


def rectangle(rows: Column) -> Column:
    """Pad short rows with empty cells."""
    def pad(all_rows: Column) -> Column:
        return let(F.array_max(F.transform(all_rows, F.size)), lambda w: F.transform(
            all_rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))))
    return let(rows, pad)


def _well_formed(html: Column) -> Column:
    """Every row and cell closed, no table inside a table, only common entities."""
    def count(pattern: str) -> Column:
        return F.regexp_count(html, F.lit(pattern))
    return (
        (count(r"(?i)<tr\b") == count(r"(?i)</tr>"))
        & (count(r"(?i)<t[dh]\b") == count(r"(?i)</t[dh]>"))
        & (count(r"(?i)<table\b") == count(r"(?i)</table>"))
        & ~html.rlike(r"(?is)<table\b[^>]*>(?:(?!</table>).)*<table\b")
        & ~(F.contains(html, F.lit("&")) & html.rlike(P.RARE_ENTITY))
    )


def _native_tables(html: Column) -> Column:
    tables = F.regexp_extract_all(html, F.lit(P.HTML_TABLE), F.lit(0))
    def rows(table: Column) -> Column:
        found = F.regexp_extract_all(table, F.lit(P.TABLE_ROW), F.lit(1))
        return F.filter(F.transform(found, lambda r: F.regexp_extract_all(
            r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))), lambda r: F.size(r) > 0)
    return F.transform(tables, rows)


def _normal_grids(tables: Column) -> Column:
    filled = F.filter(tables, lambda t: F.size(t) > 0)
    return F.transform(filled, lambda t: rectangle(
        F.transform(t, lambda r: F.transform(r, X.normalize_cell_basic))))


def _plain_rows(table: Column) -> Column:
    """Rows of plain markup (``PLAIN_TABLES``), which end where their end tag says."""
    parts = F.split(table, "</tr>", -1)
    return let(parts, lambda p: F.slice(p, 1, F.size(p) - 1))


def _plain_grids(html: Column) -> Column:
    """Grids of plain markup: its cells need no normalizer."""
    tables = F.filter(F.split(html, "</table>", -1), lambda t: F.contains(t, F.lit("<tr>")))
    return F.transform(tables, lambda t: rectangle(F.transform(
        _plain_rows(t), lambda r: F.regexp_extract_all(r, F.lit(P.PLAIN_CELL), F.lit(1)))))


def read_html(html: Column) -> Column:
    """``grids`` of all HTML tables and ``error``; only broken markup visits the Arrow parser.

    Markup that cannot be read has an error and NULL grids.  Plain markup, told by one pattern, is only cut.
    """
    html = F.coalesce(html, F.lit(""))
    plain = html.rlike(P.PLAIN_TABLES)

    def native(t: Column) -> Column:
        # Decoded once by parsing; the normalizer decodes again as for any cell.
        return _normal_grids(F.transform(_native_tables(t), lambda t: F.transform(
            t, lambda r: F.transform(r, lambda c: X.unescape_basic(F.regexp_replace(c, P.ANY_TAG, " "))))))

    def cleaned(t: Column) -> Column:
        return X.unify_spaces(F.regexp_replace(t, r"(?s)<!--.*?-->", ""))

    # NULL unless the markup is broken; the parser then finds grids or an error.
    parsed = arrow.parse_tables(let(F.when(~plain, cleaned(html)), lambda t: F.when(~_well_formed(t), t)))
    return let(parsed, lambda found: F.struct(
        F.when(found["grids"].isNotNull() | found["error"].isNotNull(), _normal_grids(found["grids"]))
        .when(plain, _plain_grids(html)).otherwise(let(cleaned(html), native)).alias("grids"),
        found["error"].alias("error")))


def html_grids(html: Column) -> Column:
    """Grids of all HTML tables, NULL where the markup cannot be read."""
    return read_html(html)["grids"]


def _pipe_row(line: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    # An escaped pipe stays in its cell; other escapes lose their backslash.
    safe = F.regexp_replace(body, r"\\\|", "\x01")
    cells = F.split(F.regexp_replace(safe, r"(?s)\\(.)", "$1"), r"\|", -1)
    return F.transform(cells, lambda c: X.normalize_cell_basic(F.translate(c, "\x01", "|")))


def pipe_grids(markdown: Column) -> Column:
    """Grids of all pipe tables: a header line, a rule line, then pipe lines.

    A rule is a pipe line too, so each table lies inside one unbroken run of pipe lines: from the line before the
    run's first rule to its end.  Runs are slices, so the work follows the number of lines.
    """
    def is_row(line: Column) -> Column:
        return F.contains(line, F.lit("|")) & (F.translate(strip(line), "|", "") != "") & (
            strip(F.regexp_replace(strip(line), r"^\|+|\|+$", "")) != "")

    def is_rule(line: Column) -> Column:
        parts = F.split(strip(F.regexp_replace(strip(line), r"^\|+|\|+$", "")), r"\|", -1)
        return F.contains(line, F.lit("|")) & F.forall(parts, lambda p: strip(p).rlike(P.CELL_RULE))

    def table(run: Column) -> Column:
        # A rule on the first line of a run has no header before it.
        rules = F.transform(F.slice(run, 2, F.size(run)), lambda x: x["rule"])
        return let(F.array_position(rules, True).cast("int"), lambda head: F.when(head > 0, F.transform(
            F.concat(F.slice(run, F.greatest(head, F.lit(1)), 1), F.slice(run, head + 2, F.size(run))),
            lambda x: _pipe_row(x["line"]))))

    def runs(facts: Column) -> Column:
        gaps = F.filter(F.transform(facts, lambda x, k: F.when(~x["row"], k + 1)), lambda k: k.isNotNull())
        return let(gaps, lambda at: F.zip_with(
            F.concat(F.array(F.lit(0)), at), F.concat(at, F.array(F.size(facts) + 1)),
            lambda before, behind: F.slice(facts, before + 1, behind - before - 1)))

    def scan(all_lines: Column) -> Column:
        facts = F.transform(all_lines, lambda x: F.struct(x.alias("line"), is_row(x).alias("row"), is_rule(x).alias("rule")))
        return F.filter(F.transform(let(facts, runs), table), lambda t: t.isNotNull())

    found = F.when(F.contains(markdown, F.lit("|")), let(lines(X.unify_spaces(markdown)), scan))
    return F.coalesce(F.transform(found, rectangle), F.array().cast(NO_GRIDS))


def read_page(markdown: Column) -> Column:
    """``grids`` of the pipe and HTML tables of a Markdown page and ``error``."""
    return let(read_html(markdown), lambda found: F.struct(
        F.concat(pipe_grids(markdown), found["grids"]).alias("grids"), found["error"].alias("error")))


def page_grids(markdown: Column) -> Column:
    return read_page(markdown)["grids"]


def canonical_html(grid: Column) -> Column:
    """Grid as HTML: first row header cells, the rest body cells, text escaped."""
    def escaped(t: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            t = F.replace(t, F.lit(char), F.lit(entity))
        return t

    def row_html(row: Column, k: Column) -> Column:
        tag = F.when(k == 0, "th").otherwise("td")
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(row, lambda c: F.concat(
            F.lit("<"), tag, F.lit(">"), escaped(c), F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))

    return F.concat(F.lit("<table>"), F.array_join(F.transform(grid, row_html), ""), F.lit("</table>"))


def tree_size(grid: Column) -> Column:
    return 1 + F.size(grid) + F.size(F.flatten(grid))


def width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))


# --- metrics on two grids --------------------------------------------------------

def teds(ref: Column, pred: Column) -> Column:
    differs = ref != pred
    found = arrow.grid_similarity(list_where(differs, ref, GRID), list_where(differs, pred, GRID))
    return F.when(differs, found).otherwise(1.0)


def cell_exact_f1(ref: Column, pred: Column) -> Column:
    """F1 of the multiset of (row, column, text); positions are unique inside a grid."""
    same = F.aggregate(
        F.zip_with(ref, pred, lambda a, b: F.coalesce(F.size(F.filter(
            F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit)), F.lit(0))),
        F.lit(0), lambda acc, n: acc + F.greatest(n, F.lit(0)))
    return prf(same, F.size(F.flatten(ref)), F.size(F.flatten(pred)))["f1"]


def cell_similarity(ref: Column, pred: Column) -> Column:
    """Mean text similarity over the rectangle that covers both grids."""
    rows = F.greatest(F.size(ref), F.size(pred))
    widest = F.greatest(width(ref), width(pred))
    empty = F.array().cast("array<string>")

    def line(a: Column, b: Column, cols: Column) -> Column:
        scored = F.zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda x, y: edit_similarity(
            F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
        # Columns beyond both rows are empty on both sides and count as equal.
        return F.aggregate(scored, (cols - F.size(scored)).cast("double"), lambda acc, v: acc + v)

    total = let(widest, lambda cols: F.aggregate(
        F.zip_with(ref, pred, lambda a, b: line(a, b, cols)), F.lit(0.0), lambda acc, v: acc + v))
    return F.when((rows == 0) & (widest == 0), 1.0).otherwise(ratio(total, rows * widest))


def count_similarity(a: Column, b: Column) -> Column:
    return 1.0 - F.abs(a - b) / F.greatest(a, b, F.lit(1))


def row_count_similarity(ref: Column, pred: Column) -> Column:
    return count_similarity(F.size(ref), F.size(pred))


def col_count_similarity(ref: Column, pred: Column) -> Column:
    return count_similarity(width(ref), width(pred))


def table_count_prf(n_ref: Column, n_pred: Column) -> Column:
    return prf(F.least(n_ref, n_pred), n_ref, n_pred)


def page_metrics(ref: Column, pred: Column, matches: Column) -> dict[str, Column]:
    """The table bundle of a page (or document) from its grids and their matching."""
    n_ref, n_pred = F.size(ref), F.size(pred)
    counts = table_count_prf(n_ref, n_pred)
    none = F.when((n_ref == 0) & (n_pred == 0), 1.0).otherwise(0.0)

    def total(score) -> Column:
        return F.aggregate(F.transform(matches, score), F.lit(0.0), lambda acc, v: acc + v)

    def mean(score) -> Column:
        return F.when(F.size(matches) == 0, none).otherwise(total(score) / F.size(matches))

    def on_grids(metric):
        return lambda m: metric(F.get(ref, m["gt_index"]), F.get(pred, m["pred_index"]))

    doc = F.when((n_ref == 0) & (n_pred == 0), 1.0).when((n_ref == 0) | (n_pred == 0), 0.0).otherwise(
        total(lambda m: m["teds"]) / F.greatest(n_ref, n_pred, F.lit(1)))
    return {
        "ref_table_count": n_ref,
        "pred_table_count": n_pred,
        "table_count_precision": counts["precision"],
        "table_count_recall": counts["recall"],
        "table_count_f1": counts["f1"],
        "table_teds_doc": doc,
        "table_teds_matched_mean": mean(lambda m: m["teds"]),
        "table_cell_exact_f1_mean": mean(on_grids(cell_exact_f1)),
        "table_cell_text_similarity_mean": mean(on_grids(cell_similarity)),
        "table_row_count_similarity_mean": mean(on_grids(row_count_similarity)),
        "table_col_count_similarity_mean": mean(on_grids(col_count_similarity)),
    }


def match_grids(ref: Column, pred: Column) -> Column:
    """One-to-one table matching; equal single tables never leave the JVM."""
    trivial = (F.size(ref) == 0) | (F.size(pred) == 0)
    twin = (F.size(ref) == 1) & (ref == pred)
    kind = "array<struct<gt_index:int,pred_index:int,teds:double>>"
    one = F.array(F.struct(F.lit(0).alias("gt_index"), F.lit(0).alias("pred_index"), F.lit(1.0).alias("teds")))
    hard = ~trivial & ~twin
    return (
        F.when(trivial, F.array().cast(kind))
        .when(twin, one.cast(kind))
        .otherwise(arrow.table_matches(list_where(hard, ref, NO_GRIDS), list_where(hard, pred, NO_GRIDS)))
    )


# --- cell lists with spans -------------------------------------------------------------

CELLS = "array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,is_header:boolean>>"


def _raw_cells(row_html: Column) -> Column:
    found = F.regexp_extract_all(row_html, F.lit(P.TABLE_CELL), F.lit(0))

    def span(attrs: Column, pattern: str) -> Column:
        value = F.regexp_extract(attrs, pattern, 1)
        return F.when(value == "", 1).otherwise(value.try_cast("int"))

    def cell(html: Column) -> Column:
        attrs = F.regexp_extract(html, P.TABLE_CELL, 2)
        return F.struct(
            span(attrs, P.ROWSPAN).alias("rowspan"), span(attrs, P.COLSPAN).alias("colspan"),
            collapse(F.regexp_replace(F.regexp_extract(html, P.TABLE_CELL, 3), P.ANY_TAG, " ")).alias("text"),
            (F.lower(F.regexp_extract(html, P.TABLE_CELL, 1)) == "th").alias("is_header"))

    return F.transform(found, cell)


def html_cells(html: Column, columns: str = "occupied") -> Column:
    """Cells of one HTML table.

    ``columns`` picks the numbering: ``ordinal`` counts cells, ``colspan``
    advances by the spans of the row, ``occupied`` also skips places taken by
    spans from rows above.  Plain markup has no spans: all three are the same.
    """
    return F.when(html.rlike(P.PLAIN_TABLES), _plain_cells(html)).otherwise(_marked_cells(html, columns))


def _plain_cells(html: Column) -> Column:
    def numbered(row_html: Column, row: Column) -> Column:
        found = F.regexp_extract_all(row_html, F.lit(P.PLAIN_CELL), F.lit(0))
        return F.transform(found, lambda c, k: F.struct(
            row.alias("row"), k.alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"),
            F.substring(c, 5, F.lit(2**31 - 1)).alias("text"), c.startswith("<th>").alias("is_header")))

    return F.flatten(F.transform(_plain_rows(html), numbered))


def _marked_cells(html: Column, columns: str) -> Column:
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), P.TABLE_WRAPPERS, "")
    rows = F.regexp_extract_all(clean, F.lit(P.TABLE_ROW), F.lit(1))
    if columns == "occupied":
        return _occupied_cells(F.transform(rows, _raw_cells))

    def number(cells: Column, row: Column) -> Column:
        def place(k: Column) -> Column:
            if columns == "ordinal":
                return k
            return F.aggregate(F.slice(cells, 1, k), F.lit(0), lambda acc, c: acc + c["colspan"])
        return F.transform(cells, lambda c, k: F.struct(
            row.alias("row"), place(k).alias("col"), c["rowspan"].alias("rowspan"),
            c["colspan"].alias("colspan"), c["text"].alias("text"), c["is_header"].alias("is_header")))

    return F.flatten(F.transform(rows, lambda r, k: number(_raw_cells(r), k))).cast(CELLS)


def _occupied_cells(rows: Column) -> Column:
    """Fold over the rows, carrying only the spans that reach below the row before."""
    cell_type = CELLS.removeprefix("array<").removesuffix(">")
    line = f"struct<at:int,cells:{CELLS}>"
    state = f"struct<spans:array<struct<col:int,end:int,until:int>>,rows:array<{CELLS}>>"

    def free(spans: Column, start: Column) -> Column:
        # The free place is at the start or right behind a span from above.
        options = F.concat(F.array(start), F.transform(spans, lambda p: p["end"]))
        return F.array_min(F.filter(options, lambda x: (x >= start) & ~F.exists(
            spans, lambda p: (p["col"] <= x) & (x < p["end"]))))

    def placed(spans: Column, row: Column) -> Column:
        def place(acc: Column, c: Column) -> Column:
            return let(free(spans, acc["at"]), lambda col: F.struct(
                (col + c["colspan"]).alias("at"),
                F.concat(acc["cells"], F.array(F.struct(
                    row["row"].alias("row"), col.alias("col"), c["rowspan"].alias("rowspan"),
                    c["colspan"].alias("colspan"), c["text"].alias("text"),
                    c["is_header"].alias("is_header")).cast(cell_type))).alias("cells"))).cast(line)

        none = F.struct(F.lit(0).alias("at"), F.array().cast(CELLS).alias("cells")).cast(line)
        return F.aggregate(row["cells"], none, place, lambda acc: acc["cells"])

    def step(acc: Column, row: Column) -> Column:
        def below(cells: Column) -> Column:
            reach = F.transform(F.filter(cells, lambda c: (c["rowspan"] > 1) & (c["col"] + c["colspan"]).isNotNull()), lambda c: F.struct(
                c["col"].alias("col"), (c["col"] + c["colspan"]).alias("end"), (c["row"] + c["rowspan"]).alias("until")))
            open_spans = F.filter(acc["spans"], lambda p: p["until"] > row["row"] + 1)
            return F.struct(F.concat(open_spans, reach).alias("spans"),
                            F.concat(acc["rows"], F.array(cells)).alias("rows")).cast(state)
        return let(placed(acc["spans"], row), below)

    numbered = F.transform(rows, lambda cells, r: F.struct(r.alias("row"), cells.alias("cells")))
    start = F.struct(F.array().alias("spans"), F.array().alias("rows")).cast(state)
    return F.flatten(F.aggregate(numbered, start, step, lambda acc: acc["rows"]))


def paired_cells(gt: Column, pred: Column) -> Column:
    """Both sides of every (row, col) position of two cell lists, in order; of cells at one position the last listed.

    Sorted together, cells of one position are neighbours, so the work follows the number of cells and stays in the row.
    """
    def listed(cells: Column, side: int) -> Column:
        return F.coalesce(F.transform(cells, lambda c, k: F.struct(
            c["row"].alias("row"), c["col"].alias("col"), F.lit(side).alias("side"), k.alias("k"), c.alias("cell"))),
            F.array())

    def together(a: Column, b: Column) -> Column:
        return a["row"].eqNullSafe(b["row"]) & a["col"].eqNullSafe(b["col"])

    def last_listed(cells: Column) -> Column:
        """Cells that no later one of the same side and position follows."""
        return F.filter(cells, lambda c, k: let(F.get(cells, k + 1), lambda n: n.isNull() | (
            n["side"] != c["side"]) | ~together(n, c)))

    def joined(cells: Column) -> Column:
        def pair(c: Column, k: Column) -> Column:
            other = F.get(cells, k + 1)
            follows = (c["side"] == 1) & (k > 0) & together(F.get(cells, k - 1), c)
            mate = F.when((c["side"] == 0) & other.isNotNull() & together(other, c), other["cell"])
            return F.when(~follows, F.struct(
                c["row"].alias("row"), c["col"].alias("col"), F.when(c["side"] == 0, c["cell"]).alias("gt"),
                F.when(c["side"] == 0, mate).otherwise(c["cell"]).alias("pred")))
        return F.filter(F.transform(cells, pair), lambda p: p.isNotNull())

    both = F.sort_array(F.concat(listed(gt, 0), listed(pred, 1)))
    return let(let(both, last_listed), joined)


def cell_counts(gt: Column, pred: Column) -> Column:
    """Positions of either side (``gt``, ``pred``), of both (``both``) and those of equal text (``same``), as ``paired_cells`` has them.

    Cell lists without gaps or repeats in their positions, as markup gives them, are compared as sets of numbers and texts.
    """
    def places(cells: Column) -> Column:
        return F.coalesce(F.transform(cells, lambda c: c["row"].cast("long") * 2**32 + c["col"]), F.array().cast("array<bigint>"))

    def texts(cells: Column, at: Column) -> Column:
        keyed = F.zip_with(at, cells, lambda k, c: F.concat(k.cast("string"), F.lit("="), c["text"]))
        return F.coalesce(F.filter(keyed, lambda t: t.isNotNull()), F.array().cast("array<string>"))

    def simple(at: Column) -> Column:
        return (F.size(F.array_distinct(at)) == F.size(at)) & ~F.exists(at, lambda k: k.isNull())

    def count(n_gt: Column, n_pred: Column, both: Column, same: Column) -> Column:
        return F.struct(n_gt.alias("gt"), n_pred.alias("pred"), both.alias("both"), same.alias("same"))

    def as_sets(at: Column) -> Column:
        return count(F.size(at["g"]), F.size(at["p"]), F.size(F.array_intersect(at["g"], at["p"])),
                     F.size(F.array_intersect(texts(gt, at["g"]), texts(pred, at["p"]))))

    def as_pairs(pairs: Column) -> Column:
        def number(keep) -> Column:
            return F.size(F.filter(pairs, keep))
        return count(number(lambda p: p["gt"].isNotNull()), number(lambda p: p["pred"].isNotNull()),
                     number(lambda p: p["gt"].isNotNull() & p["pred"].isNotNull()), number(lambda p: p["gt"]["text"] == p["pred"]["text"]))

    return let(F.struct(places(gt).alias("g"), places(pred).alias("p")), lambda at: F.when(
        simple(at["g"]) & simple(at["p"]), as_sets(at)).otherwise(let(paired_cells(gt, pred), as_pairs)))


def cell_overlap(gt: Column, pred: Column) -> Column:
    """Size of the multiset intersection of two cell lists by row, column and text.

    Sorted together, a cell of the prediction uses up one of the equal ground-truth cells just before it.
    """
    def listed(cells: Column, side: int) -> Column:
        return F.coalesce(F.transform(cells, lambda c: F.struct(
            F.struct(c["row"], c["col"], c["text"]).alias("at"), F.lit(side).alias("side"))), F.array())

    def count(cells: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            left = F.when(acc["at"].eqNullSafe(c["at"]), acc["left"]).otherwise(0)
            hit = (c["side"] == 1) & (left > 0)
            return F.struct(
                c["at"].alias("at"), F.when(c["side"] == 0, left + 1).when(hit, left - 1).otherwise(left).alias("left"),
                F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n")).cast(state)
        return F.aggregate(cells, F.struct(F.lit(None).alias("at"), F.lit(0).alias("left"), F.lit(0).alias("n")).cast(state),
                           step, lambda acc: acc["n"])

    state = "struct<at:struct<row:int,col:int,text:string>,left:int,n:int>"
    return let(F.sort_array(F.concat(listed(gt, 0), listed(pred, 1))), count)
