"""Golden values for metrics, normalizers and page evaluations."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import grids as G, keys as K, metrics as M, text as X
from pagegauge.functions.exprs import settle
from pagegauge.operators import cells as C, layout, scoring

GT = "<table><tr><th>Tên</th><th>Tuổi</th></tr><tr><td>Nguyễn A</td><td>30</td></tr></table>"


def value(spark, make, *texts):
    names = [f"c{k}" for k in range(len(texts))]
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("v")).first().v


def scan(spark, ref, hyp):
    df = spark.createDataFrame([(ref, hyp)], "ref string, hyp string")
    return scoring.score_scan(df).first()


@pytest.mark.parametrize("text, expected", [
    ("hello  \n  world", "hello world"), ("a\nb\nc", "a b c"), ("a   b", "a b"), ("  hello  ", "hello"),
    ("", ""), (None, ""), ("é", "é"),
    ("# Title\n\n- a **bold** item\n> quote", "Title a bold item quote"),
    ("| A | B |\n|---|---|\n| 1. X | 7. Y |", "A B 1. X 7. Y"),
    ("![alt](u.png) caption text\nkept", "kept"),
    ("AT&amp;T 1, 5 and 3 . 5 %", "AT&T 1,5 and 3. 5%"),
    ("see <https://a.b/c_d_e> : x", "see https://a.b/c_d_e x"),
    ("a b​c – d×e", "a bc - dxe"),
    ("2.214.394 and 0, 5; time 10: 30", "2.214.394 and 0,5; time 10: 30"),
    ("tick ( ** ) \\*kept\\*", "tick ( ** ) kept"),
])
def test_normalize_text(spark, text, expected):
    assert value(spark, X.normalize_text, text) == expected


def test_many_urls_survive(spark):
    urls = [f"https://h.t/{k}_x" for k in range(15)]
    assert value(spark, X.normalize_text, " ".join(urls)) == " ".join(urls)


def test_other_normalizers(spark):
    assert value(spark, X.normalize_folded, "Hello, World!") == "hello world"
    assert value(spark, X.normalize_cell, "<b>2 × 3</b> **x** \\| &lt;") == "2 X 3 x | <"
    assert value(spark, X.normalize_cell_markdown, "<i>a</i> <strong>b</strong> __c__ _d_") == "*a* **b** **c** *d*"
    assert value(spark, X.normalize_latex, " \\left( x + y \\right) ") == "(x+y)"
    assert value(spark, X.normalize_space, " a　b&nbsp;c ") == "a b c"


@pytest.mark.parametrize("ref, hyp, counts, cer", [
    ("hello", "hello", (0, 0, 0, 5), 0.0),
    ("Hợp đồng lao động", "Hợp đông lao đông", (2, 0, 0, 17), 2 / 17),
    ("", "abc", (0, 0, 0, 0), 0.0), ("abc", "axc", (1, 0, 0, 3), 1 / 3),
    ("abc", "xyz", (3, 0, 0, 3), 1.0), ("ab", "abc", (0, 0, 1, 2), 0.5), ("abc", "ab", (0, 1, 0, 3), 1 / 3),
])
def test_cer_detail(spark, ref, hyp, counts, cer):
    row = scan(spark, ref, hyp)
    assert tuple(row.cer_detail) == counts and row.cer == pytest.approx(cer, abs=1e-6)


def test_alignment_rows(spark):
    df = scoring.align_chars(spark.createDataFrame([("k", "abc", "axcd")], "id string, ref string, hyp string"))
    rows = [(r.gt, r.pred, r.type) for r in scoring.alignments(df, ["id"]).orderBy("step_no").collect()]
    assert rows == [("b", "x", "substitution"), ("-", "d", "insertion")]


@pytest.mark.parametrize("ref, hyp, wer, nwer", [
    ("hello world", "hello world", 0.0, 0.0), ("Hello, World!", "hello world", 1.0, 0.0),
    ("hello world", "hello", 0.5, 0.5), ("", "something", 0.0, 0.0),
    ("Hợp đồng lao động số 001", "Hợp đồng lao đông số 001", 1 / 6, 1 / 6),
])
def test_word_errors(spark, ref, hyp, wer, nwer):
    row = scan(spark, ref, hyp)
    assert (row.wer_ws, row.nwer) == (pytest.approx(wer), pytest.approx(nwer))


def test_char_precision_recall(spark):
    row = scan(spark, "abc", "abcd")
    assert (row.char_precision, row.char_recall) == (0.75, 1.0)


def test_text_metrics_variants(spark):
    df = spark.createDataFrame([("", "abc"), ("a b", "a b"), ("a, b", "a b"), ("", "")], "ref string, hyp string")
    rows = scoring.text_metrics(df).collect()
    assert [r.cer for r in rows] == [3.0, 0.0, 0.25, 0.0]
    assert [r.wer for r in rows] == [1.0, 0.0, pytest.approx(1 / 3), 0.0]
    assert [r.char_f1 for r in rows] == [0.0, 1.0, pytest.approx(6 / 7), 1.0]
    assert all(0 <= r.normalized_edit_similarity <= 1 for r in rows)


def test_punctuation_and_capitals(spark):
    df = spark.createDataFrame(
        [("Hello, world. How are you?",) * 2, ("Hello World",) * 2, ("Hello, World.", "hello world"),
         ("", ""), ("", "Yes!")], "ref string, hyp string")
    same, caps, lost, empty, extra = scoring.score_punctuation(df).collect()
    assert same.punct_miou == 1.0 and same.per_punct == {",": 1.0, ".": 1.0, "?": 1.0}
    assert caps.cap_miou == 1.0 and (lost.punct_miou, lost.cap_miou, lost.pcs) == (0.0, 0.0, 0.0)
    assert tuple(lost.cap_detail) == (0, 0, 2)
    assert empty.pcs == 1.0 and extra.per_punct == {"!": 0.0} and tuple(extra.cap_detail) == (0, 1, 0)


def table_records(spark, gt, pred):
    return C.score_table_pairs(spark.createDataFrame([(gt, pred)], "gt_html string, pred_html string")).first()


def diff(spark, gt, pred):
    df = spark.createDataFrame([(1, gt, pred)], "id int, gt string, pred string")
    side = {s: C.explode_cells(df.select("id", G.html_cells(F.col(s), "ordinal").alias("cells")), ["id"])
            for s in ("gt", "pred")}
    joined = C.join_cells(side["gt"], side["pred"], ["id"])
    return C.cell_diff(joined, ["id"]).orderBy("row", "col").collect()


def test_teds_goldens(spark):
    plain = GT.replace("th>", "td>")
    assert table_records(spark, GT, GT).teds == 1.0 and diff(spark, GT, GT) == []
    assert table_records(spark, GT, plain).teds == 1.0
    assert [d.issue for d in diff(spark, GT, plain)] == ["header_mismatch"] * 2
    assert table_records(spark, GT, GT.replace("30", "31")).teds == pytest.approx(1 - 0.5 / 7, abs=1e-6)
    assert table_records(spark, GT, "").teds == 0.0 and table_records(spark, "", "").teds == 1.0
    detail = table_records(spark, GT, plain).teds_detail
    assert tuple(detail) == (2, 7, 7)


def test_cells_with_spans(spark):
    html = ('<table><thead><tr><th colspan="2">a</th><th>b</th></tr></thead>'
            "<tr><td rowspan='2'>c</td><td>d</td></tr><tr><td>e</td><td>f</td></tr></table>")
    got = {m: [(c.row, c.col) for c in value(spark, lambda h, m=m: G.html_cells(h, m), html)]
           for m in ("ordinal", "colspan", "occupied")}
    assert got["ordinal"] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert got["colspan"] == [(0, 0), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert got["occupied"] == [(0, 0), (0, 2), (1, 0), (1, 1), (2, 1), (2, 2)]
    assert value(spark, G.html_cells, "") == []


def test_broken_and_entity_markup(spark):
    assert value(spark, G.html_grids, "<table><tr><th>A<th>B<tr><td>1<td>&eacute;</table>") == [
        [["A", "B"], ["1", "é"]]]
    assert value(spark, G.html_grids, "<table><tr><td>x &amp; <b>y</b></td></tr></table>") == [[["x & y"]]]


def test_pipe_tables(spark):
    md = "t\n| A | B |\n|---|:---:|\n| 1 \\| 2 | 3 |\n| 4 |\n\ny | z\n--- | ---\nq | r\nend"
    assert value(spark, G.pipe_grids, md) == [[["A", "B"], ["1 | 2", "3"], ["4", ""]], [["y", "z"], ["q", "r"]]]


def test_pipe_lines_without_a_header_or_rule_are_no_table(spark):
    assert value(spark, G.pipe_grids, "|---|---|\n| a | b |\n\n| c | d |\n| e | f |") == []
    assert value(spark, G.pipe_grids, "|---|\n|---|\n| a |") == [[["---"], ["a"]]]
    assert value(spark, G.pipe_grids, "| p |\n| A |\n|---|\n| 1 |\n|---|\n| 2 |") == [[["A"], ["1"], ["---"], ["2"]]]


def test_large_tables_are_parsed_in_time(spark):
    """Five thousand rows; work that grew with the square of the rows took minutes."""
    start = time.perf_counter()
    pipes = "| A | B |\n|---|---|\n" + "\n".join(f"| {k} | x{k} |" for k in range(5000))
    assert value(spark, G.pipe_grids, pipes) == [[["A", "B"], *([str(k), f"x{k}"] for k in range(5000))]]
    rows = "".join(f"<tr>{'<td rowspan=2>s</td>' if k % 2 == 0 else ''}<td colspan='2'>{k}</td><td>y</td></tr>" for k in range(5000))
    cells = value(spark, G.html_cells, f"<table>{rows}</table>")
    assert [(c.row, c.col) for c in cells if c.text != "s"] == [(k, col) for k in range(5000) for col in (1, 3)]
    assert [len(t) for t in value(spark, G.html_grids, f"<table>{rows}</table>")] == [5000]
    assert time.perf_counter() - start < 60


def test_spans_that_cross(spark):
    html = ("<table><tr><td rowspan='3'>a</td><td>b</td><td rowspan='2' colspan='2'>c</td></tr><tr><td>d</td><td>e</td></tr>"
            "<tr><td>f</td><td>g</td><td rowspan='99999999999'>h</td></tr><tr><td>i</td></tr></table>")
    got = [(c.text, c.row, c.col) for c in value(spark, G.html_cells, html)]
    assert got == [("a", 0, 0), ("b", 0, 1), ("c", 0, 2), ("d", 1, 1), ("e", 1, 4), ("f", 2, 1), ("g", 2, 2), ("h", 2, 3), ("i", 3, 0)]


def test_best_formulas_equal_all_pairs(spark):
    rng = random.Random(5)
    def some(n):
        return ["".join(rng.choice("xyé+=12\U0001d465") for _ in range(rng.randrange(1, 15))) for _ in range(n)]
    ref, pred = some(60), some(80)
    def plain(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, above = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(above[j] + 1, line[-1] + 1, above[j - 1] + (x != y)))
        return line[-1]
    want = sum(max(1 - plain(a, b) / max(len(a), len(b)) for b in pred) for a in ref) / len(ref)
    df = spark.createDataFrame([(ref, pred), (some(2000), some(2000))], "r array<string>, p array<string>")
    start = time.perf_counter()
    got = [r[0] for r in df.select(M.best_formula_similarity(F.col("r"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(want, abs=1e-12) and 0 < got[1] < 1 and time.perf_counter() - start < 60


def test_unreadable_markup_is_an_error_of_its_row(spark):
    deep = "<table><tr><td>" + "<b>" * 3000 + "x</td></tr></table>"
    df = spark.createDataFrame([(1, GT, GT), (2, GT, deep), (3, "<table><tr><td>1<![if x]><td>2</table>", GT)],
                               "id int, gt_html string, pred_html string")
    good, bad, odd = C.score_table_pairs(df).orderBy("id").collect()
    assert (good.teds, good.error) == (1.0, None) and odd.error is None and odd.teds < 1.0
    assert bad.teds is None and bad.teds_detail is None and bad.error.startswith("RecursionError: ")
    assert value(spark, G.html_grids, "<table><tr><td>1<![if x]><td>2</table>") == [[["1", "2"]]]
    assert value(spark, G.html_grids, "<table><tr><td>" + "<b>" * 3000 + "x<td>y</table>") == [[["x", "y"]]]


def test_table_matching_is_one_to_one(spark):
    def grids(*tables):
        return [[list(r) for r in t] for t in tables]
    a, b = [("h",), ("x",)], [("h",), ("long text",), ("more",)]
    df = spark.createDataFrame(
        [(grids(a, b), grids(b, a)), (grids(a), grids()), (grids(), grids()), (grids(a, b), grids(b))],
        "gt_grids array<array<array<string>>>, pred_grids array<array<array<string>>>")
    swapped, lost, none, partial = scoring.score_tables(df).collect()
    assert [(m.gt_index, m.pred_index) for m in swapped.table_matches] == [(0, 1), (1, 0)]
    assert swapped.table_teds_doc == 1.0 and lost.table_teds_doc == 0.0 and none.table_teds_doc == 1.0
    assert partial.table_teds_doc == 0.5 and partial.table_teds_matched_mean == 1.0
    assert partial.table_count_recall == 0.5 and partial.table_count_precision == 1.0


def test_mixed_pages_leave_absent_metrics_null(spark):
    t = "array<struct<table_id:int,html:string>>"
    df = spark.createDataFrame(
        [("a", "a", [], []), ("", "", [(1, GT)], [(1, GT)]), ("", "x", [], [])],
        f"gt_text string, pred_text string, gt_tables {t}, pred_tables {t}")
    text, table, extra = scoring.score_pages(df).collect()
    assert text.cer == 0.0 and text.table_teds_doc is None
    assert table.cer is None and table.table_teds_doc == 1.0 and table.table_cell_exact_f1_mean == 1.0
    assert extra.cer == 1.0


def test_markdown_bundle(spark):
    md = "# T\n\n- one\n\nsome text. More text.\n$x+1$\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    df = spark.createDataFrame([(md, md), (md, "")], "gt_text string, pred_text string")
    same, gone = scoring.score_markdown(df).collect()
    for name in ("ast_struct_f1", "ast_struct_text_f1", "reading_order_lcs", "table_teds_doc", "formula_exact_f1"):
        assert same[name] == 1.0 and gone[name] == 0.0, name
    assert same.cer == 0.0 and same.ref_formula_count == 1


def test_formula_similarity(spark):
    df = settle(spark.createDataFrame([("$ab$ $$c d$$", "$ax$"), ("", ""), ("$a$", "")], "r string, p string"),
                rf=M.formulas(F.col("r")), pf=M.formulas(F.col("p")))
    got = [r.v for r in df.select(M.best_formula_similarity(F.col("rf"), F.col("pf")).alias("v")).collect()]
    assert got[1:] == [1.0, 0.0] and 0 < got[0] < 1


def blocks(spark, *boxes):
    rows = [(1, k, k, *map(float, b), f"t{k}") for k, b in enumerate(boxes)]
    return spark.createDataFrame(
        rows, "page int, block_id int, pos int, x1 double, y1 double, x2 double, y2 double, text string")


A, B, MERGED = (0.1, 0.1, 0.9, 0.3), (0.1, 0.4, 0.9, 0.6), (0.1, 0.1, 0.9, 0.6)


@pytest.mark.parametrize("pred, statuses, mean", [
    ([A, B], ["matched", "matched"], 1.0), ([], ["missed", "missed"], 0.0),
    ([MERGED], ["over_merged", "over_merged"], 0.4), ([(0.1, 0.1, 0.4, 0.3), B], ["split", "matched"], None),
])
def test_layout(spark, pred, statuses, mean):
    gt, hyp = blocks(spark, A, B), blocks(spark, *pred)
    matches = layout.best_matches(gt, hyp, ["page"]).orderBy("gt_pos")
    assert [r.match_status for r in matches.collect()] == statuses
    if mean is not None:
        assert layout.page_mean_iou(matches, ["page"]).first().mean_iou == pytest.approx(mean)


def test_extra_block(spark):
    gt, pred = blocks(spark, A), blocks(spark, A, (0.0, 0.8, 0.1, 0.9))
    rows = layout.layout_report(gt, pred, ["page"]).collect()
    assert sorted(r.match_status for r in rows) == ["extra", "matched"]


@pytest.mark.parametrize("scale", [1, 2000])
def test_crowded_page_equals_brute_force(spark, scale):
    import random
    rnd = random.Random(5)
    def many(n):
        for _ in range(n):
            x, y = rnd.random() * 1.2 - 0.1, rnd.random()
            yield tuple(v * scale for v in (x, y, x + rnd.random() * 0.3, y + rnd.random() * 0.2))
    gt, pred = list(many(300)), list(many(300))
    got = {r.gt_pos: (r.pred_pos, r.iou) for r in layout.best_matches(
        blocks(spark, *gt), blocks(spark, *pred), ["page"]).collect()}
    def area(b):
        return max(0, b[2] - b[0]) * max(0, b[3] - b[1])
    for k, g in enumerate(gt):
        best = (None, 0.0)
        for j, p in enumerate(pred):
            common = area((max(g[0], p[0]), max(g[1], p[1]), min(g[2], p[2]), min(g[3], p[3])))
            iou = common / (area(g) + area(p) - common)
            if iou > best[1] + 1e-12:
                best = (j, iou)
        assert got[k][0] == best[0] and got[k][1] == pytest.approx(best[1], abs=1e-6)


@pytest.mark.parametrize("name, expected", [
    ("Hợp đồng (1).PDF", "hop_dong_1.pdf"), ("Straße.v2.txt", "strasse_v2_txt"), ("...", "doc"), ("a.b.docx", "a_b.docx"),
])
def test_slug(spark, name, expected):
    assert value(spark, K.slug, name) == expected


def test_doc_key(spark):
    assert tuple(value(spark, K.doc_key, "textlayer_vi_001")) == ("text_layer", "vi")
    assert value(spark, K.doc_key, "scan_en") is None and value(spark, K.doc_key, "_en_1") is None


def test_tables_of_a_document(spark):
    from pagegauge.operators import cells as C
    def tables(rows):
        return spark.createDataFrame(rows, "doc string, page_num int, html string")
    gt = tables([("d", 1, "<a> <b>"), ("d", 2, "<a><b>"), ("d", 3, "x"), ("e", 1, "y"), ("f", 1, "u"), ("f", 2, "v")])
    pred = tables([("d", 7, "<a><b>"), ("d", 8, "z"), ("f", 1, "w")])
    summary = {r.doc: r for r in C.doc_table_summary(gt, pred, ["doc"], most=2).collect()}
    assert {k: (r.n_gt, r.n_pred, r.n_same, r.copies_f1, r.comparable) for k, r in summary.items()} == {
        "d": (3, 2, 1, 0.4, True), "e": (1, 0, 0, 0.0, True), "f": (2, 1, 0, 0.0, True)}
    left = {r.doc: ([t.page_num for t in r.gt_left], [t.html for t in r.pred_left])
            for r in C.left_over_tables(gt, pred, ["doc"], most=1).collect()}
    assert left == {"e": ([1], [])}
    left = {r.doc: ([t.page_num for t in r.gt_left], [t.html for t in r.pred_left])
            for r in C.left_over_tables(gt, pred, ["doc"]).collect()}
    assert left == {"d": ([2, 3], ["z"]), "e": ([1], []), "f": ([1, 2], ["w"])}


def test_best_by_key_sorts_no_texts(spark):
    from pagegauge.operators import cells as C, layout
    cells = spark.createDataFrame([("t", 0, 0, 1, "a"), ("t", 0, 0, 2, "b"), ("t", None, 1, 3, "n")],
                                  "id string, row int, col int, ordinal int, text string")
    joined = C.join_cells(cells, cells.where("ordinal = 1 OR row IS NULL"), ["id"])
    assert {(r.row, r.col): (r.gt.text, r.pred.text) for r in joined.collect()} == {(0, 0): ("b", "a"), (None, 1): ("n", "n")}
    blocks = spark.createDataFrame([("p", "x", 0, 0.0, 0.0, 1.0, 1.0, "t")],
                                   "page string, block_id string, pos int, x1 double, y1 double, x2 double, y2 double, text string")
    for df in (joined, layout.best_matches(blocks, blocks, ["page"])):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
