"""Layout matching over blocks derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge.catalog import fixtures as fx
from pagegauge.catalog.registry import query
from pagegauge.functions import geometry
from pagegauge.operators import layout
from pagegauge.operators.rollup import issue_counts
from pagegauge.plans.benchmark import score_text_layer_pages

KEY = ["page_id"]


def _matches(spark, sf):
    return layout.best_matches(fx.gt_blocks(spark, sf), fx.pred_blocks(spark, sf), KEY)


@query("layout_best", ("block_best",), """
  SELECT page_id, gt_pos, coalesce(pred_pos, -1) AS pred_pos, round(iou, 6) AS iou FROM block_best""")
def layout_best(spark, sf):
    return _matches(spark, sf).select(
        "page_id", "gt_pos", F.coalesce("pred_pos", F.lit(-1)).alias("pred_pos"), "iou")


@query("layout_status", ("block_status",), """
  SELECT page_id, gt_pos, match_status,
         CASE match_status WHEN 'over_merged' THEN 'pred_bbox_covers_multiple_gt_blocks'
              WHEN 'split' THEN 'gt_block_split_into_multiple_pred_blocks'
              WHEN 'missed' THEN 'no_pred_block_found_for_gt' END AS issue FROM block_status""")
def layout_status(spark, sf):
    return _matches(spark, sf).select("page_id", "gt_pos", "match_status", "issue")


@query("layout_extra", ("pred_blocks", "block_best"), """
  SELECT page_id, pos AS pred_pos FROM pred_blocks p WHERE NOT EXISTS (
    SELECT 1 FROM block_best b WHERE b.page_id = p.page_id AND b.pred_pos = p.pos)""")
def layout_extra(spark, sf):
    pred = fx.pred_blocks(spark, sf)
    return layout.extra_blocks(pred, _matches(spark, sf), KEY).select("page_id", "pred_pos")


@query("layout_mean_iou", ("block_best",), """
  SELECT page_id, round(sum(round(iou, 6)), 6) AS total_iou, round(avg(round(iou, 6)), 9) AS mean_iou, count(*) AS n_blocks
  FROM block_best GROUP BY page_id""")
def layout_mean_iou(spark, sf):
    """Mean IoU per page, to nine digits: at six the mean of two blocks often ends on a rounding tie."""
    means = layout.page_mean_iou(_matches(spark, sf), KEY, digits=None)
    total = F.round(F.col("mean_iou") * F.col("n_blocks"), 6)
    return means.select("page_id", total.alias("total_iou"), F.round("mean_iou", 9).alias("mean_iou"), "n_blocks")


@query("text_layer_pages", ("distances",), """
  SELECT model, uc_type, lang, doc_id, page_num, CASE WHEN n_gt = 0 THEN 0.0 ELSE round(d / n_gt, 6) END AS cer,
         n_gt::INT AS total_chars_gt, round(mean_iou, 9) AS mean_iou
  FROM distances JOIN (
    SELECT model, doc_id, page_num, avg(CASE WHEN least(length(g[k]), coalesce(length(p[k]), 0)) = 0 THEN 0.0
             ELSE round(least(length(g[k]), length(p[k])) / greatest(length(g[k]), length(p[k])), 6) END) AS mean_iou
    FROM (SELECT *, unnest(range(1, len(g) + 1)) AS k FROM (
      SELECT model, doc_id, page_num, string_split(gt_text, chr(10)) AS g, string_split(pred_text, chr(10)) AS p
      FROM page_pairs WHERE uc_type = 'text_layer')) GROUP BY ALL) USING (model, doc_id, page_num)""")
def text_layer_pages(spark, sf):
    """Text-layer pages whose blocks are their lines, each as wide as it has characters."""
    def lines(text):
        return F.transform(F.split(text, "\n", -1), lambda line, k: F.struct(
            k.alias("block_id"), F.array(F.lit(0.0), k / 8.0, F.length(line) / 128.0, (k + 1) / 8.0).alias("bbox"),
            line.alias("text")))

    pairs = fx.page_pairs(spark, sf)
    blocks = pairs.withColumns({"gt_blocks": lines(F.col("gt_text")), "pred_blocks": lines(F.col("pred_text"))})
    scored = score_text_layer_pages(fx.ref_hyp(blocks), digits=9)
    return scored.withColumn("total_chars_gt", F.col("cer_detail.total_chars_gt")).drop("cer_detail")


@query("layout_issue_counts", ("block_status", "pred_blocks"), """
  SELECT match_status, count(*) AS n FROM block_status GROUP BY 1
  UNION ALL SELECT 'extra', count(*) FROM pred_blocks p WHERE NOT EXISTS (
    SELECT 1 FROM block_status b WHERE b.page_id = p.page_id AND b.pred_pos = p.pos)""")
def layout_issue_counts(spark, sf):
    report = layout.layout_report(fx.gt_blocks(spark, sf), fx.pred_blocks(spark, sf), KEY)
    return issue_counts(report, [], "match_status")


@query("box_normalize", ("block_rows",), """
  SELECT pos, page_id, round(x1 * 612.0 / w, 6) AS x1, round(y1 * 792.0 / h, 6) AS y1,
         round(x2 * 612.0 / w, 6) AS x2, round(y2 * 792.0 / h, 6) AS y2
  FROM (SELECT *, CAST(CASE page_id % 3 WHEN 0 THEN 612 WHEN 1 THEN 1 ELSE 700 END AS DOUBLE) AS w,
               CAST(CASE page_id % 2 WHEN 0 THEN 792 ELSE 1000 END AS DOUBLE) AS h FROM block_rows)""")
def box_normalize(spark, sf):
    rows = fx._block_rows(spark, sf)
    width = F.when(F.col("page_id") % 3 == 0, 612.0).when(F.col("page_id") % 3 == 1, 0.0).otherwise(700.0)
    height = F.when(F.col("page_id") % 2 == 0, 792.0).otherwise(1000.0)
    page = F.array(F.lit(0.0), F.lit(0.0), width, height)
    bbox = F.array(F.col("x1") * 612.0, F.col("y1") * 792.0, F.col("x2") * 612.0, F.col("y2") * 792.0)
    boxed = rows.select("pos", "page_id", geometry.normalize_box(bbox, page).alias("b"))
    return boxed.select("pos", "page_id", *[
        F.col("b")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("box_rotate", ("block_rows",), """
  SELECT pos, page_id,
    round(CASE o WHEN 6 THEN 1 - y2 WHEN 8 THEN y1 WHEN 3 THEN 1 - x2 ELSE x1 END, 6) AS x1,
    round(CASE o WHEN 6 THEN x1 WHEN 8 THEN 1 - x2 WHEN 3 THEN 1 - y2 ELSE y1 END, 6) AS y1,
    round(CASE o WHEN 6 THEN 1 - y1 WHEN 8 THEN y2 WHEN 3 THEN 1 - x1 ELSE x2 END, 6) AS x2,
    round(CASE o WHEN 6 THEN x2 WHEN 8 THEN 1 - x1 WHEN 3 THEN 1 - y1 ELSE y2 END, 6) AS y2
  FROM (SELECT *, page_id % 9 AS o FROM block_rows)""")
def box_rotate(spark, sf):
    rows = fx._block_rows(spark, sf)
    turned = geometry.rotate_box(F.array("x1", "y1", "x2", "y2"), F.col("page_id") % 9)
    boxed = rows.select("pos", "page_id", turned.alias("b"))
    return boxed.select("pos", "page_id", *[
        F.round(F.col("b")[k], 6).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
