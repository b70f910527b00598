"""Leaderboards, recommendations, worst pages and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.functions import patterns as P
from pagegauge.functions.metrics import percent


def leaderboard(stats: DataFrame, total_docs: Column | int) -> DataFrame:
    """Models by character F1, then TEDS; the input has one row per model."""
    total = total_docs if isinstance(total_docs, Column) else F.lit(total_docs)
    order = Window.orderBy(
        F.coalesce("avg_char_f1", F.lit(0.0)).desc(), F.coalesce("avg_teds", F.lit(0.0)).desc(), "model")
    ranked = stats.withColumn("rank", F.row_number().over(order))
    return ranked.withColumns({
        "is_best": F.col("rank") == 1,
        "total_docs": total,
        "is_complete": (total > 0) & (F.col("docs") >= total),
    })


def recommend(bucket_scores: DataFrame, metric: str | None = None) -> DataFrame:
    """Models ranked inside each use case and language.

    Without a metric, tables rank by TEDS and everything else by character F1.
    CER ranks ascending; buckets without the metric drop out.
    """
    if metric is None:
        value = F.when(F.col("uc_type") == "table", F.col("avg_teds")).otherwise(F.col("avg_char_f1"))
    else:
        value = F.col(f"avg_{metric}")
    shown = percent(value)
    order = shown.asc() if metric == "cer" else shown.desc()
    by_bucket = Window.partitionBy("uc_type", "lang").orderBy(order, "model")
    scored = bucket_scores.where(value.isNotNull()).withColumn("value", shown)
    ranked = scored.withColumn("rank", F.row_number().over(by_bucket))
    return ranked.withColumn("is_best", F.col("rank") == 1)


def _worst_first(metric: str) -> Column:
    return F.col(metric).desc() if metric in P.HIGHEST_IS_WORST else F.col(metric).asc()


def worst_pages(
    page_scores: DataFrame, metric: str, k: int = 5, model: str | None = None, doc_id=None
) -> DataFrame:
    """The k worst pages by one metric (a bounded sort, never a full one)."""
    if metric not in P.UPLOAD_METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(P.UPLOAD_METRICS)}")
    rows = page_scores.where(F.col(metric).isNotNull())
    if model is not None:
        rows = rows.where(F.col("model") == model)
    if doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    return rows.select("model", "doc_id", "page_num", F.col(metric).alias("value")).orderBy(
        F.col("value").desc() if metric in P.HIGHEST_IS_WORST else F.col("value").asc(),
        "model", "doc_id", "page_num").limit(k)


def worst_pages_per_model(page_scores: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """The k worst pages of every model; each task keeps k rows per model before the shuffle."""
    order = Window.partitionBy("model").orderBy(_worst_first(metric), "doc_id", "page_num")
    rows = page_scores.where(F.col(metric).isNotNull())
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("model", "rank", "doc_id", "page_num", F.col(metric).alias("value"))


def outlier_pages(page_scores: DataFrame, metric: str, z: float = 1.0) -> DataFrame:
    """Pages where a model falls below the other models on the same page by ``z`` deviations."""
    keys = ["doc_id", "page_num"]
    norms = page_scores.groupBy(*keys).agg(
        F.avg(metric).alias("page_mean"), F.stddev_pop(metric).alias("page_sd"))
    joined = page_scores.join(norms, keys)
    return joined.where(
        (F.col("page_sd") > 0) & (F.col(metric) < F.col("page_mean") - z * F.col("page_sd")))


def recent(log: DataFrame, ts: str, n: int = 50, *ties: str) -> DataFrame:
    """Newest n entries."""
    return log.orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in ties]).limit(n)


def compare_doc(doc_scores: DataFrame, models: list[str], metric: str) -> DataFrame:
    """All models' scores side by side, one column per model."""
    return doc_scores.groupBy("doc_id").pivot("model", models).agg(F.first(metric))
