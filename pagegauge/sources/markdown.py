"""Predictions delivered as one Markdown file per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions import patterns as P
from pagegauge.operators.pairs import first_per_key


def read_markdown_files(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md").text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
                F.col("value").alias("raw")))


def number_uploaded_pages(files: DataFrame) -> DataFrame:
    """Page numbers from ``<doc>_<n>.md`` names, rebased so that a document starts at 1.

    Of several files with one number the first by name stays.  The smallest
    number per document comes from a combining aggregation, so a document with
    very many files does not meet in one task.
    """
    index = F.regexp_extract("file_name", P.PAGE_FILE, 2)
    named = files.withColumns({
        "doc_id": F.regexp_extract("file_name", P.PAGE_FILE, 1), "file_index": index.try_cast("int"),
    }).where(F.col("file_index").isNotNull())
    pages = first_per_key(named, ["doc_id", "file_index"], F.col("file_name"))
    first = named.groupBy("doc_id").agg(F.min("file_index").alias("_first"))
    return pages.join(first, "doc_id").withColumn(
        "page_num", F.col("file_index") - F.col("_first") + 1).drop("_first")


def stored_pages(files: DataFrame) -> DataFrame:
    """Pages stored as ``<model>/<uc>/<lang>/<doc>/<doc>_p<n>.md``."""
    parts = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/[^/]+_p(\d+)\.md$"
    names = ("model", "uc_type", "lang", "doc_id")
    return files.withColumns({
        **{n: F.regexp_extract("path", parts, k + 1) for k, n in enumerate(names)},
        "page_num": F.regexp_extract("file_name", P.STORED_PAGE_FILE, 1).try_cast("int"),
    }).where((F.col("doc_id") != "") & F.col("page_num").isNotNull())
