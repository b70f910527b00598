"""What is done, what is missing, and the state of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators.pairs import last_per_key

DOC = ["uc_type", "lang", "doc_id"]


def missing_docs(models: DataFrame, gt_docs: DataFrame, evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents a model has not been scored on, one row each.

    The model names are one scalar; what each document has been scored with is
    gathered first (at most one entry per model), and only what is missing unfolds.
    """
    names = models.select("model").distinct().agg(F.collect_set("model"))
    seen = evaluated.groupBy(key).agg(F.collect_set("model").alias("_seen"))
    docs = gt_docs.select(key).distinct().join(seen, key, "left")
    lacking = F.array_except(names.scalar(), F.coalesce("_seen", F.array().cast("array<string>")))
    return docs.select(F.explode(lacking).alias("model"), key)


def progress(stats: DataFrame, gt_docs: DataFrame, evaluated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents done and missing per model."""
    docs = gt_docs.select(key).distinct()
    total = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("total_docs"))
    known = evaluated.select("model", key).distinct().join(docs, key, "left_semi")
    done = known.groupBy("model").agg(F.count("*").alias("_known"))
    joined = stats.join(done, "model", "left").withColumn("total_docs", total.scalar())
    missing = F.col("total_docs") - F.coalesce("_known", F.lit(0))
    return joined.withColumns({
        "missing": missing, "complete": F.col("docs") >= F.col("total_docs")}).drop("_known")


def asset_status(assets: DataFrame, sides: dict[str, DataFrame], keys=tuple(DOC)) -> DataFrame:
    """One flag per side telling whether an asset has it."""
    keys = list(keys)
    out = assets
    for name, side in sides.items():
        out = out.join(side.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def review_overview(drafts: DataFrame, gt: DataFrame, keys=tuple(DOC)) -> DataFrame:
    """Total, reviewed and pending drafts: overall, per use case and per language."""
    flagged = asset_status(drafts, {"reviewed": gt}, keys)
    return flagged.rollup("uc_type", "lang").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("total"),
        F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("pending"))


def status_tally(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def known_models(*frames: DataFrame) -> DataFrame:
    """Distinct model names over any number of sources."""
    names = frames[0].select("model")
    for frame in frames[1:]:
        names = names.unionByName(frame.select("model"))
    return names.where(F.col("model").isNotNull()).distinct()


def current_versions(versions: DataFrame, keys=tuple(DOC)) -> DataFrame:
    """Latest version per document; deleted documents disappear."""
    keys = list(keys)
    latest = last_per_key(versions, keys, F.struct(F.col("updated_at"), F.col("deleted").cast("int")))
    return latest.where(~F.col("deleted"))
