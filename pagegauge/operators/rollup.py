"""Roll-ups: pages to documents, use cases, models and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import patterns as P


def means(metrics, digits: int | None = 6, prefix: str = "avg_") -> list[Column]:
    """NULL-ignoring means under ``avg_*`` names."""
    out = []
    for metric in metrics:
        value = F.avg(metric)
        out.append((value if digits is None else F.round(value, digits)).alias(f"{prefix}{metric}"))
    return out


def uc_summary(
    page_scores: DataFrame, metrics, keys=("model", "uc_type", "lang"), digits: int | None = 6
) -> DataFrame:
    """Mean of each metric over the pages of a use case."""
    return page_scores.groupBy(*keys).agg(*means(metrics, digits), F.count("*").alias("n_pages"))


def overall_macro(uc_scores: DataFrame, metrics) -> DataFrame:
    """Mean of use-case means; a metric absent from a use case is ignored."""
    return uc_scores.groupBy("model").agg(
        *[F.round(F.avg(f"avg_{m}"), 6).alias(f"avg_{m}") for m in metrics])


def overall_micro(page_scores: DataFrame, metrics) -> DataFrame:
    """Mean over all pages of a model."""
    return page_scores.groupBy("model").agg(*means(metrics), F.count("*").alias("n_pages"))


def doc_summary(
    page_scores: DataFrame, metrics=P.UPLOAD_METRICS, keys=("model", "uc_type", "lang", "doc_id"),
    missing_as_zero: bool = False,
) -> DataFrame:
    """Document means with page and matched-page counts."""
    known = [m for m in metrics if m in page_scores.columns]
    values = page_scores
    if missing_as_zero:
        values = page_scores.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in known})
    return values.groupBy(*keys).agg(
        *means(known), F.count("*").alias("n_pages"), F.count_if("matched").alias("n_matched_pages"))


def document_evaluation(page_scores: DataFrame, metrics, keys=("model", "uc_type", "doc_id")) -> DataFrame:
    """Summary of one document's evaluation: means over its pages, where a missing value counts as 0."""
    return page_scores.groupBy(*keys).agg(
        *[F.round(F.avg(F.coalesce(m, F.lit(0.0))), 6).alias(f"avg_{m}") for m in metrics],
        F.count("*").alias("n_pages"))


def resolve_table_scores(doc_scores: DataFrame) -> DataFrame:
    """Document TEDS and cell F1: table summary, else text summary, else mean of its pages."""
    return doc_scores.withColumns({
        "teds": F.coalesce("table_avg_teds", "text_teds", "page_teds"),
        "cell_f1": F.coalesce("table_avg_cell_f1", "text_cell_f1", "page_cell_f1"),
    })


def model_stats(doc_scores: DataFrame, metrics, keys=("model",), digits: int = 4) -> DataFrame:
    """Mean of document means, with document count; ``upload`` wins as source."""
    aggs = [*means(metrics, digits), F.count("*").alias("docs")]
    if "source" in doc_scores.columns:
        uploaded = F.bool_or(F.col("source") == "upload")
        aggs.append(F.when(uploaded, "upload").otherwise(F.max("source")).alias("source"))
    return doc_scores.groupBy(*keys).agg(*aggs)


def buckets(doc_scores: DataFrame, metrics, digits: int = 4) -> DataFrame:
    """Model x use case x language."""
    return model_stats(doc_scores, metrics, ("model", "uc_type", "lang"), digits)


def model_rollup(doc_scores: DataFrame, metrics) -> DataFrame:
    """Model, model x use case and model x use case x language in one pass."""
    return doc_scores.rollup("model", "uc_type", "lang").agg(
        F.grouping_id().cast("int").alias("level"), *means(metrics, 4),
        F.count("*").alias("docs")).where(F.col("level") < 7)


def dashboard(doc_scores: DataFrame, metrics) -> DataFrame:
    """Model totals and model x use case means."""
    model, uc = F.col("model"), F.col("uc_type")
    return doc_scores.groupingSets([[model], [model, uc]], model, uc).agg(
        *means(metrics, 4), F.count("*").alias("docs"))


def only_models(scores: DataFrame, models=None, pattern: str | None = None) -> DataFrame:
    """Rows of the named models, or of those whose name holds ``pattern`` in any case; all rows without either."""
    if models:
        scores = scores.where(F.col("model").isin(*models))
    return scores.where(F.contains(F.lower("model"), F.lit(pattern.lower()))) if pattern else scores


def compare_models(doc_scores: DataFrame, metrics, uc_type=None, lang=None, models=None) -> DataFrame:
    """Scores of models side by side.

    Without a use case or language these are the model's own means over its documents; for a slice, the unweighted
    mean of the slice's bucket means, and documents add up.
    """
    rows = only_models(doc_scores, models)
    chosen = {c: v for c, v in (("uc_type", uc_type), ("lang", lang)) if v and v != "all"}
    if not chosen:
        return model_stats(rows, metrics).select("model", *[f"avg_{m}" for m in metrics], "docs")
    for column, value in chosen.items():
        rows = rows.where(F.col(column) == value)
    return buckets(rows, metrics).groupBy("model").agg(
        *[F.round(F.avg(f"avg_{m}"), 4).alias(f"avg_{m}") for m in metrics],
        F.sum("docs").alias("docs"))


def issue_counts(details: DataFrame, keys, issue: str) -> DataFrame:
    """How often each kind of error occurs."""
    return details.groupBy(*keys, issue).agg(F.count("*").alias("n"))


def corpus_rates(page_scores: DataFrame, keys, distance: str, size: str) -> DataFrame:
    """Total distance over total length."""
    return page_scores.groupBy(*keys).agg(
        (F.sum(distance) / F.greatest(F.sum(size), F.lit(1))).alias("rate"))
