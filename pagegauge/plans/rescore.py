"""Score stored predictions again with the current formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import patterns as P, text as X
from pagegauge.functions.exprs import settle
from pagegauge.operators import coverage, rollup, scoring
from pagegauge.operators.pairs import DOC, PAGE, carry_over, pair_pages, resolve_sources
from pagegauge.plans.upload import gt_scoring_pages

KEYS = ["model", *PAGE]


def stored_predictions(stored: DataFrame) -> DataFrame:
    """Raw Markdown pages (source A) through the batch content filter."""
    filtered = settle(stored, _kept=X.filter_content(F.col("raw"), live=False))
    return filtered.select(
        *KEYS, X.normalize_text(F.col("_kept")).alias("pred_text"),
        X.html_tables(F.col("raw")).alias("pred_tables"))


def pipeline_predictions(text_pages: DataFrame, table_pages: DataFrame) -> DataFrame:
    """Split pipeline output (source B): filtered prose plus the cell text of its tables."""
    tables = table_pages.select(*KEYS, F.filter("tables", lambda t: F.coalesce(t["html"], F.lit("")) != "").alias("_t"))
    joined = text_pages.join(tables, KEYS, "left")
    filtered = settle(joined, _kept=X.filter_content(F.col("full_text"), live=False))
    prose = settle(filtered, _prose=X.normalize_text(F.col("_kept")))
    cell_texts = F.coalesce(
        F.transform("_t", lambda t: X.html_table_text(t["html"])), F.array().cast("array<string>"))
    parts = F.filter(F.concat(F.array("_prose"), cell_texts), lambda x: x != "")
    kept = F.transform("_t", lambda t, k: F.struct(
        F.coalesce(t["table_id"], k + 1).alias("table_id"), t["html"].alias("html")))
    return prose.select(
        *KEYS, F.array_join(parts, "\n").alias("pred_text"),
        F.coalesce(kept, F.array().cast("array<struct<table_id:int,html:string>>")).alias("pred_tables"))


def rescore(
    docs: DataFrame, gt_docs: DataFrame, stored: DataFrame, pipeline: DataFrame,
    previous: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page scores, status per document).

    ``docs`` lists the documents to score; stored pages win over pipeline
    output, documents with neither are skipped with a reason, and evidence of
    earlier results is kept.
    """
    statuses = resolve_sources(docs, stored, pipeline)
    chosen = statuses.where(F.col("status") == "ok").select("model", *DOC, "pred_source")

    def pages(df: DataFrame, source: str) -> DataFrame:
        return df.join(chosen.where(F.col("pred_source") == source).drop("pred_source"), ["model", *DOC], "left_semi")

    pred = pages(stored, "stored_pages").unionByName(pages(pipeline, "pipeline"))
    scored = scoring.score_pages(pair_pages(gt_scoring_pages(gt_docs), pred))
    if previous is not None:
        scored = carry_over(scored, previous, KEYS, "evidence")
    return scored, statuses


def summarize(scored: DataFrame) -> DataFrame:
    return rollup.doc_summary(scored, P.BATCH_METRICS)


tally = coverage.status_tally
