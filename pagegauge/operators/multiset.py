"""Multiset precision, recall and F1 over exploded items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.exprs import prf, settle


def multiset_counts(
    ref: DataFrame, pred: DataFrame, keys: list[str], items: list[str]
) -> DataFrame:
    """Overlap and sizes per key.

    Both sides are counted in one pass; the first grouping is by key and item,
    so a key with very many items is spread over tasks.
    """
    cols = [*keys, *items]
    both = ref.select(*cols, F.lit(1).alias("_r"), F.lit(0).alias("_p")).unionByName(
        pred.select(*cols, F.lit(0).alias("_r"), F.lit(1).alias("_p")))
    return _overlaps(both, keys, items)


def _overlaps(marked: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    per_item = marked.groupBy(*keys, *items).agg(F.sum("_r").alias("_r"), F.sum("_p").alias("_p"))
    return per_item.groupBy(*keys).agg(
        F.sum(F.least("_r", "_p")).alias("overlap"),
        F.sum("_r").alias("n_ref"), F.sum("_p").alias("n_pred"))


def _scored(counts: DataFrame, keys: list[str]) -> DataFrame:
    scores = prf(F.col("overlap"), F.col("n_ref"), F.col("n_pred"))
    return counts.withColumn("_s", scores).select(*keys, "overlap", "n_ref", "n_pred", "_s.*")


def multiset_prf(
    ref: DataFrame, pred: DataFrame, keys: list[str], items: list[str]
) -> DataFrame:
    return _scored(multiset_counts(ref, pred, keys, items), keys)


def paired_multiset_prf(
    pairs: DataFrame, keys: list[str], ref: str, pred: str, split: Callable[[Column], Column]
) -> DataFrame:
    """The same over two texts of a row that ``split`` takes apart.

    One pass over the pairs serves both sides, and equal sides are split and counted once.
    """
    def side(name: str, in_ref: int, in_pred: int) -> Column:
        return F.struct(F.col(name).alias("_text"), F.lit(in_ref).alias("_r"), F.lit(in_pred).alias("_p"))

    sides = F.when(F.col(ref) == F.col(pred), F.array(side(ref, 1, 1))).otherwise(
        F.array(side(ref, 1, 0), side(pred, 0, 1)))
    marked = pairs.select(*keys, F.inline(sides))
    # A step of its own: exploded where it is computed, a list is computed twice, the first time to see if it is empty.
    items = settle(marked, _items=split(F.col("_text")))
    return _scored(_overlaps(items.select(*keys, "_r", "_p", F.explode("_items").alias("_item")), keys, ["_item"]), keys)
