"""Numbering rows inside groups of any size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local master that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Use every core on inputs with fewer splits than cores; leave large scans as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def number_within(
    df: DataFrame, groups: list[str], order: list[Column], name: str = "seq"
) -> DataFrame:
    """1, 2, 3, ... inside each group, in order.

    A window over the group would put a large group into one task.  Rows are
    range-partitioned by group and order instead, numbered inside each slice,
    and shifted by the sizes of the slices before it.
    """
    keys = [F.col(g) for g in groups]
    sliced = durable(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = sliced.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_slice", *groups).orderBy(*order)
    numbered = sliced.withColumn("_k", F.row_number().over(inside))
    return numbered.join(offsets, [*groups, "_slice"]).withColumn(
        name, F.col("_offset") + F.col("_k")).drop("_slice", "_offset", "_k")


def name_documents(assets: DataFrame) -> DataFrame:
    """``<uc>_<lang>_<seq>`` names in file-name order inside each use case and language."""
    numbered = number_within(assets, ["uc_type", "lang"], [F.col("file_name")])
    ext = F.lower(F.regexp_extract("file_name", r"^.+(\.[^.]+)$", 1))
    stem = F.concat_ws(
        "_", F.replace("uc_type", F.lit("_"), F.lit("")), F.col("lang"),
        F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0"))
        .otherwise(F.col("seq").cast("string")))
    return numbered.withColumn("new_name", F.concat(stem, ext)).withColumn(
        "changed", F.col("new_name") != F.col("file_name"))


def suffix_collisions(slugs: DataFrame, folder: str = "folder", slug: str = "slug", order: str = "src") -> DataFrame:
    """``_2``, ``_3``, ... before the extension of repeated names in a folder, skipping names that are taken.

    The first row of a name keeps it.  The others take the smallest suffixes whose name is nobody's: numbers count
    only free suffixes, found by listing the occupied ones of each stem.
    """
    numbered = number_within(slugs, [folder, slug], [F.col(order)], "copy")
    parts = r"(?s)^(.+?)(\.[^.]+)?$"
    stem, ext = F.regexp_extract(slug, parts, 1), F.regexp_extract(slug, parts, 2)
    # Names of the form <stem>_<n><ext>: the suffixes of another name that are occupied.
    suffixed = slugs.select(folder, F.col(slug).alias("_full")).distinct().select(
        folder, F.regexp_extract("_full", r"(?s)^(.+?)_([1-9][0-9]{0,17})(\.[^.]+)?$", 1).alias("_stem"),
        F.regexp_extract("_full", r"(?s)^(.+?)_([1-9][0-9]{0,17})(\.[^.]+)?$", 3).alias("_ext"),
        F.regexp_extract("_full", r"(?s)^(.+?)_([1-9][0-9]{0,17})(\.[^.]+)?$", 2).try_cast("long").alias("_n"))
    occupied = suffixed.where("_n >= 2").groupBy(folder, F.concat("_stem", "_ext").alias(slug)).agg(
        F.sort_array(F.collect_set("_n")).alias("_taken"))
    # The copy-th free suffix from 2 on: each occupied one at or below it moves it up by one.
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("copy").cast("long"),
                       lambda at, n: F.when(n <= at, at + 1).otherwise(at))
    renamed = F.concat(stem, F.lit("_"), free.cast("string"), ext)
    return numbered.join(occupied, [folder, slug], "left").withColumn(
        "target", F.when(F.col("copy") == 1, F.col(slug)).otherwise(renamed)).drop("copy", "_taken")
