"""Bounding-box expressions; a box is four double columns or an array of four."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions import patterns as P


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    inside = (
        F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
        * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1])))
    union = area(*a) + area(*b) - inside
    return F.when(union > 0, inside / union).otherwise(0.0)


def match_status(
    found: Column, overlap: Column, gt_area: Column, pred_area: Column,
    threshold: float = P.IOU_THRESHOLD,
) -> Column:
    return (
        F.when(~found, "missed")
        .when(overlap >= threshold, "matched")
        .when((gt_area > 0) & (pred_area > P.AREA_RATIO * gt_area), "over_merged")
        .when((pred_area > 0) & (gt_area > P.AREA_RATIO * pred_area), "split")
        .otherwise("low_iou")
    )


def issue(status: Column) -> Column:
    return (
        F.when(status == "over_merged", "pred_bbox_covers_multiple_gt_blocks")
        .when(status == "split", "gt_block_split_into_multiple_pred_blocks")
        .when(status == "missed", "no_pred_block_found_for_gt")
        .when(status == "extra", "pred_block_has_no_matching_gt")
    )


def normalize_box(bbox: Column, page_bbox: Column, digits: int = 6) -> Column:
    """Absolute box over the page's width and height; a zero side counts as 1."""
    def side(k: int) -> Column:
        value = F.get(page_bbox, F.lit(k))
        return F.when(value.isNull() | (value == 0), 1.0).otherwise(value)

    def part(k: int) -> Column:
        return F.round(F.coalesce(F.get(bbox, F.lit(k)), F.lit(0.0)) / side(2 + k % 2), digits)

    return F.array(*[part(k) for k in range(4)])


def rotate_box(bbox: Column, orientation: Column) -> Column:
    """Box in display orientation for image orientation 3, 6 or 8; others unchanged."""
    x1, y1, x2, y2 = (F.get(bbox, F.lit(k)) for k in range(4))
    return (
        F.when(orientation == 6, F.array(1 - y2, x1, 1 - y1, x2))
        .when(orientation == 8, F.array(y1, 1 - x2, y2, 1 - x1))
        .when(orientation == 3, F.array(1 - x2, 1 - y2, 1 - x1, 1 - y1))
        .otherwise(bbox)
    )
