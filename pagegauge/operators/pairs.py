"""Pairing ground truth with predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC = ["uc_type", "lang", "doc_id"]
PAGE = [*DOC, "page_num"]


def _one_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key; each task keeps one row per key before the shuffle (group limit)."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("_rank = 1").select(*keys, *[c for c in df.columns if c not in keys])


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _one_per_key(df, keys, order.desc_nulls_last())


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _one_per_key(df, keys, order.asc_nulls_last())


#: Pages of a document that meet the document's list of models together.
MODEL_SLICE = 1000


def expected_pages(page_keys: DataFrame, pred_docs: DataFrame) -> DataFrame:
    """(model, page key) of every page of every document that a model predicted.

    Each document's models become one list, which is handed to slices of its page numbers; pages meet the slice, so a
    document with most of all pages is spread like any other.
    """
    lists = pred_docs.select("model", *DOC).distinct().groupBy(*DOC).agg(F.collect_list("model").alias("_models"))
    sliced = page_keys.select(*PAGE).withColumn("_slice", F.floor(F.col("page_num") / MODEL_SLICE))
    handed = sliced.select(*DOC, "_slice").distinct().join(lists, DOC)
    return sliced.join(handed, [*DOC, "_slice"]).select(F.explode("_models").alias("model"), *PAGE)


#: Page numbers that share one mask, a bit for each.
SLICE_PAGES = 64


def _page_masks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row for every 64 page numbers of a key that has some of them, with a bit for each that is there."""
    return pages.select(
        *keys, F.floor(F.col("page_num") / SLICE_PAGES).alias("_slice"),
        F.expr(f"shiftleft(1L, cast(pmod(page_num, {SLICE_PAGES}) as int))").alias("_bit")
    ).groupBy(*keys, "_slice").agg(F.bit_or("_bit").alias("_mask"))


def skipped_pages(gt_pages: DataFrame, pred_pages: DataFrame, pred_docs: DataFrame) -> DataFrame:
    """(model, page key) of every page that a model skipped in a document it predicted.

    Page numbers meet as masks of 64, so no row per page and model crosses the network, and a document with most of
    all pages is spread over its slices.
    """
    there = _page_masks(gt_pages, DOC).join(pred_docs.select("model", *DOC).distinct(), DOC)
    answered = _page_masks(pred_pages, ["model", *DOC]).withColumnRenamed("_mask", "_answered")
    left = there.join(answered, ["model", *DOC, "_slice"], "left").withColumn(
        "_left", F.col("_mask").bitwiseAND(F.bitwise_not(F.coalesce("_answered", F.lit(0).cast("long"))))).where("_left <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(SLICE_PAGES - 1)), lambda k: F.call_function(
        "shiftright", F.col("_left"), k).bitwiseAND(F.lit(1)) == 1)
    page = (F.col("_slice") * SLICE_PAGES + F.col("_k")).cast(gt_pages.schema["page_num"].dataType)
    return left.select("model", *DOC, "_slice", F.explode(bits).alias("_k")).select("model", *DOC, page.alias("page_num"))


def pair_pages(
    gt_pages: DataFrame, pred_pages: DataFrame, pred_docs: DataFrame | None = None
) -> DataFrame:
    """Every ground-truth page of every document a model predicted.

    A page the model skipped is paired with NULLs (``matched`` false); predicted
    pages without ground truth are dropped.  Skipped pages are found with keys
    only and join the predictions as rows without content, so page content
    crosses the network once per side, meets in one join, and whatever is
    computed on the pairs is planned once.  What was computed on the ground
    truth before (normalizing, parsing) runs once per page, not per model.
    """
    if pred_docs is None:
        pred_docs = pred_pages.select("model", *DOC).distinct()
    skipped = skipped_pages(gt_pages, pred_pages, pred_docs)
    answers = pred_pages.withColumn("matched", F.lit(True)).unionByName(
        skipped.withColumn("matched", F.lit(False)), allowMissingColumns=True)
    return gt_pages.join(answers, PAGE)


def merge_tables(text_pages: DataFrame, table_pages: DataFrame, keys: list[str]) -> DataFrame:
    """Tables from the table prediction, only where the text page has none."""
    found = table_pages.select(*keys, F.col("tables").alias("_tables"))
    own = F.coalesce(F.size("tables"), F.lit(0)) > 0
    merged = F.when(own, F.col("tables")).otherwise(F.coalesce(F.col("_tables"), F.col("tables")))
    return text_pages.join(found, keys, "left").withColumn("tables", merged).drop("_tables")


def resolve_sources(docs: DataFrame, stored: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Where each document's prediction comes from: stored pages, else pipeline output, else none."""
    keys = ["model", *DOC]
    a = stored.select(*keys).distinct().withColumn("_stored", F.lit(True))
    b = pipeline.select(*keys).distinct().withColumn("_pipeline", F.lit(True))
    source = F.when(F.col("_stored"), "stored_pages").when(F.col("_pipeline"), "pipeline")
    joined = docs.join(a, keys, "left").join(b, keys, "left").withColumn("pred_source", source)
    return joined.withColumn(
        "status", F.when(F.col("pred_source").isNull(), "skip").otherwise("ok")
    ).withColumn(
        "reason", F.when(F.col("pred_source").isNull(), "no_pred_source")
    ).drop("_stored", "_pipeline")


def not_done(todo: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work that has no result yet; everything when forced."""
    return todo if force else todo.join(done.select(*keys), keys, "left_anti")


def carry_over(scores: DataFrame, previous: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keep an expensive column from earlier results."""
    kept = previous.select(*keys, column).where(F.col(column).isNotNull())
    return scores.drop(column).join(kept, keys, "left")
