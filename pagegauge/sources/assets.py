"""Source files waiting for transcription."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions import patterns as P

LAYOUT = r"([^/]+)/([^/]+)/([^/]+)(\.[^./]+)$"


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """``<uc>/<lang>/<doc>.<ext>`` files; contents are never loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return list_assets(files.select("path", "length"))


def list_assets(files: DataFrame) -> DataFrame:
    """Known source formats, one row per document (first file by name)."""
    ext = F.lower(F.regexp_extract("path", LAYOUT, 4))
    keyed = files.withColumns({
        "uc_type": F.regexp_extract("path", LAYOUT, 1), "lang": F.regexp_extract("path", LAYOUT, 2),
        "doc_id": F.regexp_extract("path", LAYOUT, 3), "ext": ext,
    }).where(F.col("ext").isin(*P.ASSET_EXTENSIONS))
    return keyed.groupBy("uc_type", "lang", "doc_id").agg(
        F.min_by("ext", "path").alias("ext"), F.min("path").alias("path"))
