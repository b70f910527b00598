"""Layout matching: best predicted block for every ground-truth block of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.functions import arrow, geometry, patterns as P
from pagegauge.functions.exprs import list_where, settle

BOX = ("x1", "y1", "x2", "y2")
PER_TILE = 64  # blocks of both sides that a tile holds on average


def _side(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    text = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    return df.select(
        *keys, F.col("block_id").alias(f"{prefix}_id"), F.col("pos").alias(f"{prefix}_pos"),
        *[F.col(c).cast("double").alias(f"{prefix}_{c}") for c in BOX], text.alias(f"{prefix}_text"))


def _box(prefix: str):
    return tuple(F.col(f"{prefix}_{c}") for c in BOX)


def _grids(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Extent of each page and the number of tiles per side, from the number of its blocks."""
    boxes = gt.select(*keys, *BOX).unionAll(pred.select(*keys, *BOX))
    return boxes.groupBy(*keys).agg(
        F.min("x1").alias("_x0"), F.min("y1").alias("_y0"),
        (F.max("x2") - F.min("x1")).alias("_w"), (F.max("y2") - F.min("y1")).alias("_h"),
        F.ceil(F.sqrt(F.count("*") / PER_TILE)).cast("int").alias("_tiles"))


def _index(value, low: str, size: str):
    """Tile of a coordinate, the first one where there is no coordinate or no extent."""
    part = F.floor((value - F.col(low)) / F.col(size) * F.col("_tiles")).cast("int")
    found = F.when(F.col(size) > 0, F.least(F.greatest(part, F.lit(0)), F.col("_tiles") - 1))
    return F.coalesce(found, F.lit(0))


def _tiled(df: DataFrame, prefix: str, grids: DataFrame, keys: list[str]) -> DataFrame:
    """Each block once per tile it touches: one for most, as most pages are one tile."""
    def tiles(axis: str, low: str, size: str):
        first = _index(F.col(f"{prefix}_{axis}1"), low, size)
        return F.sequence(first, F.greatest(first, _index(F.col(f"{prefix}_{axis}2"), low, size)))
    return df.join(grids, keys).withColumn("_tx", F.explode(tiles("x", "_x0", "_w"))).withColumn(
        "_ty", F.explode(tiles("y", "_y0", "_h")))


def _candidates(gt: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Ground truth left-joined to the predictions that overlap it, each pair in one tile only."""
    on = [*keys, "_tx", "_ty"]
    p = pred.select(*[F.col(c).alias(f"_p{c}") for c in on], *[c for c in pred.columns if c.startswith("pred_")])
    condition = (
        (F.least("gt_x2", "pred_x2") > F.greatest("gt_x1", "pred_x1"))
        & (F.least("gt_y2", "pred_y2") > F.greatest("gt_y1", "pred_y1"))
        # The tile of the corner where the overlap begins.
        & (_index(F.greatest("gt_x1", "pred_x1"), "_x0", "_w") == F.col("_tx"))
        & (_index(F.greatest("gt_y1", "pred_y1"), "_y0", "_h") == F.col("_ty")))
    for c in on:
        condition = (F.col(c) == F.col(f"_p{c}")) & condition
    return gt.join(p, condition, "left").drop(*[f"_p{c}" for c in on])


def best_matches(
    gt_blocks: DataFrame, pred_blocks: DataFrame, keys: list[str], threshold: float = P.IOU_THRESHOLD,
) -> DataFrame:
    """One row per ground-truth block with its best predicted block, if any.

    Input blocks carry ``block_id``, ``pos`` (order on the page, unique), the
    four box columns and optionally ``text``.  Highest IoU above zero wins,
    earlier prediction first on ties; a prediction may serve several blocks.
    Blocks join per page and tile; a page has one tile for every 64 blocks,
    scaled to its own extent, so neither a busy page nor all its pairs land in
    one task.
    """
    gt, pred = _side(gt_blocks, keys, "gt"), _side(pred_blocks, keys, "pred")
    grids = _grids(gt_blocks, pred_blocks, keys)
    joined = _candidates(_tiled(gt, "gt", grids, keys), _tiled(pred, "pred", grids, keys), keys)

    iou = geometry.iou(_box("gt"), _box("pred"))
    meets = F.col("pred_pos").isNotNull() & (iou > 0)
    partner = [f"pred_{c}" for c in ("id", "pos", *BOX, "text")]
    # A group limit on two numbers; nothing is aggregated over texts.
    order = Window.partitionBy(*keys, "gt_pos").orderBy(F.desc_nulls_last("iou"), "pred_pos")
    best = joined.withColumn("iou", F.when(meets, iou)).withColumn("_rank", F.row_number().over(order)).where(
        "_rank = 1").withColumns({c: F.when(F.col("iou").isNotNull(), F.col(c)) for c in partner})
    overlap = F.coalesce("iou", F.lit(0.0))
    status = geometry.match_status(
        F.col("iou").isNotNull(), overlap, geometry.area(*_box("gt")), geometry.area(*_box("pred")), threshold)
    return best.select(
        *keys, "gt_pos", "gt_id", *[f"gt_{c}" for c in BOX], "gt_text",
        *partner,
        F.round(overlap, 6).alias("iou"), status.alias("match_status"),
    ).withColumn("issue", geometry.issue(F.col("match_status")))


def extra_blocks(pred_blocks: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted blocks that are nobody's best match."""
    chosen = matches.where(F.col("pred_pos").isNotNull()).select(*keys, "pred_pos")
    rest = _side(pred_blocks, keys, "pred").join(chosen, [*keys, "pred_pos"], "left_anti")
    return rest.withColumns({
        "iou": F.lit(0.0), "match_status": F.lit("extra"),
        "issue": F.lit("pred_block_has_no_matching_gt")})


def layout_report(
    gt_blocks: DataFrame, pred_blocks: DataFrame, keys: list[str],
    threshold: float = P.IOU_THRESHOLD,
) -> DataFrame:
    """Matches and extra blocks in one table."""
    matches = best_matches(gt_blocks, pred_blocks, keys, threshold)
    return matches.unionByName(extra_blocks(pred_blocks, matches, keys), allowMissingColumns=True)


def page_mean_iou(matches: DataFrame, keys: list[str], digits: int | None = 6) -> DataFrame:
    """Mean IoU over ground-truth blocks; extra blocks do not count."""
    mean = F.avg("iou") if digits is None else F.round(F.avg("iou"), digits)
    return matches.where(F.col("match_status") != "extra").groupBy(*keys).agg(
        mean.alias("mean_iou"), F.count("*").alias("n_blocks"))


#: Pairs of blocks of a page up to which expressions compare them all; more go to the Arrow kernel.
ROW_PAIRS = 1024


def with_mean_iou(pages: DataFrame, gt: str, pred: str, digits: int | None = 6) -> DataFrame:
    """Add ``mean_iou``, that of ``page_mean_iou(best_matches(...))``, where both sides of a page lie in one row.

    Which block is the best one does not matter to the mean, so blocks never leave their row.  A page without
    ground-truth blocks scores 0.
    """
    def boxes(name: str) -> Column:
        found = F.transform(F.col(name), lambda b: b["bbox"].cast("array<double>"))
        return F.coalesce(found, F.array().cast("array<array<double>>"))

    def corners(box: Column) -> tuple[Column, ...]:
        return tuple(F.get(box, F.lit(k)) for k in range(4))

    def meets(a: Column, b: Column) -> Column:
        x, y = corners(a), corners(b)
        return F.when(
            (F.least(x[2], y[2]) > F.greatest(x[0], y[0])) & (F.least(x[3], y[3]) > F.greatest(x[1], y[1])),
            geometry.iou(x, y)).otherwise(0.0)

    rows = settle(pages, _gt=boxes(gt), _pred=boxes(pred))
    many = F.size("_gt") * F.size("_pred") > ROW_PAIRS
    few = F.when(~many, F.transform("_gt", lambda a: F.aggregate(
        F.col("_pred"), F.lit(0.0), lambda best, b: F.greatest(best, meets(a, b)))))
    none = "array<array<double>>"
    rows = settle(rows, _few=few, _many=arrow.best_ious(
        list_where(many, F.col("_gt"), none), list_where(many, F.col("_pred"), none)))
    total = F.aggregate(F.coalesce("_few", "_many"), F.lit(0.0), lambda acc, v: acc + F.round(v, 6))
    mean = F.when(F.size("_gt") > 0, total / F.size("_gt")).otherwise(0.0)
    return rows.withColumn("mean_iou", mean if digits is None else F.round(mean, digits)).drop("_gt", "_pred", "_few", "_many")
