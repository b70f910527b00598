"""Score predicted pages as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.operators import scoring
from pagegauge.operators.pairs import PAGE, last_per_key, not_done
from pagegauge.sources import results

KEYS = ["model", *PAGE]
PAGES = (
    "model string, uc_type string, lang string, doc_id string, page_num int, "
    "pred_text string, pred_tables array<struct<table_id:int,html:string>>, received_at timestamp")


def score_batch(
    pages: DataFrame, gt_pages: DataFrame, scores_path: str, version: str, force: bool = False,
    batch: tuple[str, int] | None = None,
) -> None:
    """Score the pages of one micro-batch that have no score of this formula version yet, and append their scores.

    ``batch`` names the stream and numbers its batch, so that a replayed one changes nothing even if forced.  Only pages that arrive are scored: one that never does is not scored as empty, unlike in the batch job.
    """
    fresh = last_per_key(pages, KEYS, F.col("received_at"))
    # Stored scores and ground truth are read for the partitions of the batch only.
    touched = pages.select(*results.PARTITIONS).distinct()
    old = None if force else results.read_scores(pages.sparkSession, scores_path)
    if old is not None:
        old = old.join(touched, results.PARTITIONS, "left_semi")
        fresh = not_done(fresh, old.where(F.col("formula_version") == version), KEYS)
    gt_pages = gt_pages.join(touched.select("uc_type", "lang").distinct(), ["uc_type", "lang"], "left_semi")
    pairs = gt_pages.join(fresh, PAGE).withColumn("matched", F.lit(True))
    scored = scoring.score_pages(pairs).drop("gt_text", "pred_text", "gt_tables", "pred_tables")
    versioned = scored.withColumn("formula_version", F.lit(version))
    results.save_scores(versioned, scores_path, KEYS, batch)


def start_scoring(
    spark: SparkSession, inbox: str, gt_pages: DataFrame, scores_path: str, checkpoint: str,
    version: str = "1", force: bool = False,
):
    """File-source stream over Parquet page drops; its checkpoint folder is the name of the stream."""
    stream = spark.readStream.schema(PAGES).parquet(inbox)
    return (
        stream.writeStream
        .foreachBatch(lambda batch, n: score_batch(batch, gt_pages, scores_path, version, force, (checkpoint, n)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
