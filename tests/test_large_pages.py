"""Pairing and in-row comparisons that keep the work in proportion to the pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegauge.catalog import fixtures as fx
from pagegauge.operators import layout, multiset, pairs
from pagegauge.plans.benchmark import score_text_layer_pages
from pagegauge.sources.documents import blocks_of

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_page_content_meets_in_one_join(spark):
    text = plan(fx.page_pairs(spark, DATA))
    # The text is cut into pages once for either side; keys need no cutting.
    assert text.count("regexp_extract_all") == 2
    assert "regexp_extract_all" not in plan(fx.pred_pages(spark, DATA).drop("pred_text"))


def test_skipped_pages_of_any_number(spark):
    gt = spark.range(300).selectExpr("'u' uc_type", "'l' lang", "id % 2 doc_id", "cast(id - 70 as int) page_num", "'t' gt_text")
    pred = gt.selectExpr("explode(array('a', 'b')) model", "uc_type", "lang", "doc_id", "page_num", "'p' pred_text").where(
        "doc_id = 0 and ((model = 'a' and page_num % 7 <> 0) or (model = 'b' and page_num in (0, 64, 500)))")
    pred = pred.unionByName(pred.limit(1))
    extra = pred.where("model = 'a' and page_num = 2").withColumn("page_num", F.lit(9999))
    got = {(r.model, r.page_num) for r in pairs.skipped_pages(gt, pred.unionByName(extra), pred).collect()}
    numbers = range(-70, 230, 2)
    want = {("a", n) for n in numbers if n % 7 == 0} | {("b", n) for n in numbers if n not in (0, 64)}
    assert got == want
    both = pairs.pair_pages(gt, pred.unionByName(extra)).where("not matched")
    assert {(r.model, r.page_num, r.pred_text) for r in both.collect()} == {(m, n, None) for m, n in want}


def test_equal_texts_are_split_once(spark):
    rows = spark.createDataFrame([("m", "a b a", "a b a"), ("m", "a c", "c d d"), ("n", None, "x"), ("n", "x", "")],
                                 "model string, ref string, hyp string")
    split = lambda text: F.filter(F.split(text, " "), lambda w: w != "")
    got = {r.model: (r.overlap, r.n_ref, r.n_pred) for r in multiset.paired_multiset_prf(
        rows, ["model"], "ref", "hyp", split).collect()}
    # Counts meet per model, not per row: a 3/2, b 1/1, c 1/1, d 0/2.
    assert got == {"m": (4, 5, 6), "n": (1, 1, 1)}


@pytest.mark.parametrize("row_pairs", [layout.ROW_PAIRS, 0])
def test_mean_iou_in_the_row_is_that_of_the_join(spark, monkeypatch, row_pairs):
    monkeypatch.setattr(layout, "ROW_PAIRS", row_pairs)
    rng = np.random.default_rng(3)

    def blocks(n, gap=False):
        out = []
        for k in range(n):
            x, y, w, h = rng.random(4) * [1, 1, 0.3, 0.3]
            box = [float(x), float(y), float(x + w), float(y + h)]
            if gap and k % 3 == 0:
                box[int(rng.integers(4))] = None
            out.append((k, box, "t"))
        return out

    kind = "array<struct<block_id:int,bbox:array<double>,text:string>>"
    pages = spark.createDataFrame(
        [(0, blocks(30), blocks(25)), (1, blocks(90), blocks(70)), (2, [], blocks(2)), (3, blocks(3), []),
         (4, blocks(12, True), blocks(12, True)), (5, None, None)],
        f"k int, gt_blocks {kind}, pred_blocks {kind}")
    got = {r.k: r.mean_iou for r in layout.with_mean_iou(pages, "gt_blocks", "pred_blocks").collect()}
    joined = layout.page_mean_iou(layout.best_matches(
        blocks_of(pages.withColumnRenamed("gt_blocks", "blocks"), ["k"]),
        blocks_of(pages.withColumnRenamed("pred_blocks", "blocks"), ["k"]), ["k"]), ["k"])
    want = {**dict.fromkeys(range(6), 0.0), **{r.k: r.mean_iou for r in joined.collect()}}
    assert got == pytest.approx(want, abs=2e-6)
    assert any(got.values())


def test_text_layer_pages_shuffle_nothing(spark):
    kind = "array<struct<block_id:int,bbox:array<double>,text:string>>"
    rows = spark.createDataFrame([("m", "text_layer", "en", "d", 1, "ab", "ac", [(0, [0.0, 0.0, 1.0, 1.0], "x")],
                                   [(0, [0.0, 0.0, 1.0, 0.5], "x")])],
                                 f"model string, uc_type string, lang string, doc_id string, page_num int, ref string, hyp string, gt_blocks {kind}, pred_blocks {kind}")
    scored = score_text_layer_pages(rows)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    row = scored.first()
    assert (row.cer, row.mean_iou) == (0.5, 0.5)


@pytest.mark.parametrize("keep", [True, False])
def test_alignments_in_a_band_are_those_of_the_whole_matrix(keep):
    from pagegauge.functions import kernels
    rng = np.random.default_rng(5)
    left, right = [], []
    for n in range(900):
        a = "".join(rng.choice(list("abcdé "), int(rng.integers(60, 520))))
        b = list(a)
        for _ in range(int(rng.integers(0, 45))):
            at = int(rng.integers(0, len(b)))
            kind = int(rng.integers(0, 3))
            b[at:at + (kind != 1)] = [] if kind == 0 else [str(rng.choice(list("abcdé x")))]
        if n % 9 == 0:
            shift = int(rng.integers(1, 40))
            b = b[shift:] + list(a[:shift])
        left.append(a)
        right.append("".join(b))
    for a, b, got in zip(left, right, kernels.edit_scripts(left, right, keep)):
        assert got.tolist() == kernels.edit_script(a, b, keep).tolist()
    groups = [(len(b), k, a, b, []) for k, (a, b) in enumerate(zip(left, right)) if len(a) > 448 and abs(len(a) - len(b)) < 20]
    found = [None] * len(left)
    assert len(kernels._band_scripts(groups, 9, keep, found)) < len(groups)
