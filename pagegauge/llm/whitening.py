"""Whitening of embeddings with MLlib's distributed block matrices.

Components become x = floor(256 * c).  The fit list holds each distinct vector
once.  Rows get gapless indexes (prefix sums over the partitions of a written
table), their centred vectors are dealt as an ``IndexedRowMatrix`` and cut into
blocks.  The scatter of the fit list is the product of its transposed
``BlockMatrix`` with itself; only that matrix, dimensions squared, comes to the
driver, where ``eigh`` gives the components.  The whitening matrix (eigenvectors
over the square roots of their eigenvalues) goes back as a ``BlockMatrix`` that
multiplies the blocks of all rows.  The same transposed product over the
projected fit list measures how far its covariance is from the identity.

The product is split along the rows (``SPLIT_BLOCKS`` blocks a task), so no task
sees more than a few blocks however long the table is.  All of it runs in the
JVM; no Python sees a row.

Sums are exact (decimals), and so is ``deviation``: 64-bit arithmetic where the
largest component proves that it suffices, decimals otherwise, and null where
the number itself does not fit 64 bits.

Defined results: rows with a null vector or a null or not finite component take
no part, nor do empty vectors and vectors of another length than most (of two
equally frequent lengths the greater counts), for which no covariance exists;
null ids stay; repeated rows stay separate and count once in the fit list;
components without variance (below rounding error of the largest) are left out,
so equal vectors give no rows, as does an empty table; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.store import settled

#: Entries of a block (8 bytes each), and columns of one at most.
BLOCK_ENTRIES, BLOCK_COLUMNS = 1 << 20, 1024
#: Blocks of rows that a task multiplies and adds up.
SPLIT_BLOCKS = 4


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): integer components of the rows that have them all."""
    def bad(v: Column) -> Column:
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_e")).where(
        "_e is not null and size(_e) > 0").where(~F.exists("_e", bad)).select(
        "vec_id", F.transform("_e", lambda v: F.floor(256 * v)).alias("x"))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """The rows with a gapless ``index`` from 0: counts of the partitions before, plus the place in the own one."""
    own = F.monotonically_increasing_id()
    # The upper bits number the partition, the lower 33 the row in it.
    placed = settled(rows.withColumn("_part", F.shiftright(own, 33)).withColumn(
        "_place", own.bitwiseAND(F.lit((1 << 33) - 1))), name)
    # One row per partition, so the window and the broadcast hold as many rows as the table has partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(
        "index", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def blocks(rows: DataFrame, columns: int) -> BlockMatrix:
    """A block matrix of rows (index, centred)."""
    table = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    wide = min(columns, BLOCK_COLUMNS)
    return IndexedRowMatrix(table).toBlockMatrix(max(1, BLOCK_ENTRIES // wide), wide)


def _java(matrix: BlockMatrix):
    return matrix._java_matrix_wrapper


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The product of the transposed matrix with itself, added up in splits along the rows."""
    height = -(-matrix.numRows() // matrix.rowsPerBlock)
    splits = max(1, -(-height // SPLIT_BLOCKS))
    # The Python method takes no number of splits; without them all blocks would meet in one task.
    product = _java(matrix.transpose()).call("multiply", _java(matrix)._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _literal(matrix: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])


def whitened(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(
        F.desc("c"), F.desc("d")).limit(1).collect()
    empty = spark.range(0).select(
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("vec_id", vectors.schema["vec_id"].dataType), ("component", "int"), ("n", "long"), ("deviation", "long"),
            ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    if not lengths:
        return empty
    d = lengths[0]["d"]
    rows = rows.where(F.size("x") == d)
    fit = indexed(rows.select("x").distinct(), "whitening-fit")
    totals = fit.select(F.posexplode("x")).groupBy("pos").agg(
        F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.min("col").alias("low"), F.max("col").alias("high"),
        F.count("*").alias("n")).orderBy("pos").collect()
    n, sums = totals[0]["n"], [int(t["s"]) for t in totals]
    most = max(max(abs(t["low"]), abs(t["high"])) for t in totals)

    means = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with("x", means, lambda x, m: x.cast("double") - m)
    fit_blocks = blocks(fit.withColumn("centred", centred), d)
    variance = scatter(fit_blocks) / n
    values, axes = np.linalg.eigh((variance + variance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > values[0] * d * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    if not kept:
        return empty
    matrix = axes[:, :kept] / np.sqrt(values[:kept])
    explained = values[:kept] / values.sum()
    local = spark.range(d).select(F.col("id").alias("index"), F.element_at(
        _literal(matrix), (F.col("id") + 1).cast("int")).alias("centred"))
    whitening = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(
        local.select("index", array_to_vector("centred").alias("vector")), "vector")).toBlockMatrix(
        fit_blocks.colsPerBlock, kept)
    error = float(np.abs(scatter(fit_blocks.multiply(whitening)) / n - np.eye(kept)).max())

    every = indexed(rows, "whitening-rows")
    # |n * x - S| <= 2 * n * most for each component.
    if d * (2 * n * most) ** 2 < 1 << 63:
        away = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: n * x - s)
        deviation = F.aggregate(away, F.lit(0).cast("long"), lambda total, a: total + a * a)
    else:
        wide = "decimal(38,0)"
        away = F.zip_with("x", F.array(*[F.lit(str(s)).cast(wide) for s in sums]), lambda x, s: F.try_subtract(
            F.try_multiply(x.cast(wide), F.lit(n)).cast(wide), s).cast(wide))
        deviation = F.aggregate(away, F.lit(0).cast(wide), lambda total, a: F.try_add(
            total, F.try_multiply(a, a).cast(wide)).cast(wide)).try_cast("long")
    product = blocks(every.withColumn("centred", centred), d).multiply(whitening).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model).select(
        "index", vector_to_array("vector").alias("_y"))
    return every.withColumn("deviation", deviation).select("vec_id", "index", "deviation").join(
        projected, "index").select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("_y")).select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("col").alias("whitened"),
        F.element_at(F.array(*[F.lit(float(v)) for v in explained]), F.col("pos") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))
