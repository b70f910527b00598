"""Ground-truth versions written by reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.operators.coverage import current_versions

STATUSES = ("in_progress", "done")


def stamp(docs: DataFrame, reviewer: str, status: str, at: Column | None = None) -> DataFrame:
    """Review stamp of a saved document; a document must have pages."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    return docs.where(F.col("pages").isNotNull()).withColumns({
        "reviewer": F.lit(reviewer), "status": F.lit(status),
        "updated_at": F.current_timestamp() if at is None else at, "deleted": F.lit(False)})


def tombstone(docs: DataFrame, at: Column | None = None) -> DataFrame:
    """Delete: the document returns to draft."""
    return docs.withColumns({
        "updated_at": F.current_timestamp() if at is None else at, "deleted": F.lit(True)})


def append_versions(versions: DataFrame, path: str) -> None:
    versions.write.mode("append").partitionBy("uc_type", "lang").parquet(path)


def read_current(spark, path: str) -> DataFrame:
    return current_versions(spark.read.parquet(path))
