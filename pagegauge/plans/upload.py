"""Score Markdown page files against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import keys as K, patterns as P, text as X
from pagegauge.functions.exprs import settle
from pagegauge.operators import evidence, rollup, scoring
from pagegauge.operators.pairs import DOC, pair_pages
from pagegauge.sources import documents, markdown

KEYS = ["model", *DOC, "page_num"]


def uploaded_pages(files: DataFrame, model: str) -> DataFrame:
    """Numbered pages with filtered text and inline tables; see ``quarantined`` for ids that name no use case."""
    pages = markdown.number_uploaded_pages(files).withColumn("_k", K.doc_key(F.col("doc_id")))
    keyed = pages.where(F.col("_k").isNotNull()).select(
        F.lit(model).alias("model"), "_k.uc_type", "_k.lang", "doc_id", "page_num", "raw")
    tables = X.html_tables(F.col("raw"))
    filtered = settle(keyed, _kept=X.filter_content(F.col("raw")))
    return filtered.select(
        *KEYS, F.col("raw").alias("pred_raw"), X.normalize_text(F.col("_kept")).alias("pred_text"),
        tables.alias("pred_tables"))


def quarantined(files: DataFrame) -> DataFrame:
    """Uploaded pages that cannot be scored, with the reason."""
    pages = markdown.number_uploaded_pages(files)
    return pages.where(K.doc_key(F.col("doc_id")).isNull()).select(
        "doc_id", "page_num", F.lit("document id names no use case").alias("error"))


def gt_scoring_pages(gt_docs: DataFrame) -> DataFrame:
    """Ground-truth pages whose text also holds their table cells."""
    pages = documents.pages_of(gt_docs)
    return pages.select(
        *DOC, "page_num", X.scoring_text(F.col("full_text"), F.col("tables")).alias("gt_text"),
        F.col("full_text").alias("gt_prose"),
        F.transform("tables", lambda t: F.struct(t["table_id"], t["html"])).alias("gt_tables"))


def score_upload(gt_docs: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """One row per ground-truth page of the uploaded documents."""
    pairs = pair_pages(gt_scoring_pages(gt_docs), uploaded_pages(files, model))
    return scoring.score_pages(pairs)


def with_evidence(scored: DataFrame) -> DataFrame:
    """Diff evidence on the prose, independent of the scoring text."""
    prose = scoring.normalize_pairs(scored, "gt_prose", "pred_text").withColumns({
        "n_gt_tables": F.coalesce(F.size("gt_tables"), F.lit(0)),
        "n_pred_tables": F.coalesce(F.size("pred_tables"), F.lit(0)),
        "has_table": evidence.has_table(F.coalesce("pred_raw", F.lit(""))),
        "figure_mentions": evidence.mentions_figure(F.coalesce("pred_raw", F.lit("")))})
    return evidence.evidence(evidence.diff_pages(prose)).drop("chunks", "ref", "hyp")


def summarize(scored: DataFrame) -> DataFrame:
    return rollup.doc_summary(scored, P.UPLOAD_METRICS)
