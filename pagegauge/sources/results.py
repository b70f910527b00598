"""Score tables: an append-only log, CSV exports and stored evaluation JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegauge.sources import score_log
from pagegauge.sources.score_log import PARTITIONS

DOC_KEYS = [*PARTITIONS, "doc_id"]
EVAL_LAYOUT = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)_eval\.json$"
EVAL = (
    "doc_id string, model string, source string, scored_at string, reeval_at string, "
    "text struct<summary:struct<avg_cer:double,avg_wer:double,avg_char_f1:double,avg_word_f1:double,"
    "avg_normalized_edit_similarity:double,table_teds_doc:double,table_cell_exact_f1_mean:double,"
    "n_pages:int,n_matched_pages:int>,pages:array<struct<page_num:int,cer:double,wer:double,"
    "char_f1:double,word_f1:double,normalized_edit_similarity:double,table_teds_doc:double,"
    "table_cell_exact_f1_mean:double>>>, "
    "table struct<summary:struct<avg_teds:double,avg_cell_exact_f1:double,n_pages:int>>, "
    "_corrupt_record string")


def read_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """Current scores; None only where nothing has been stored yet."""
    return score_log.read(spark, path)


def save_scores(
    scores: DataFrame, path: str, keys: list[str] = DOC_KEYS, batch: tuple[str, int] | None = None,
) -> None:
    """Replace the scores with the same key (document by default); others stay.

    Only the given rows are written (``score_log``), and saving the same scores twice changes nothing.
    """
    score_log.append(scores, path, keys, batch)


def read_evaluations(spark: SparkSession, root: str) -> DataFrame:
    """Stored ``<model>/<uc>/<lang>/<doc>_eval.json`` files; unreadable ones are skipped."""
    from pagegauge.sources.documents import read_json
    raw = read_json(spark, root, EVAL, "*_eval.json")
    keys = {n: F.regexp_extract("_path", EVAL_LAYOUT, k + 1) for k, n in enumerate(DOC_KEYS)}
    return raw.where(F.col("_corrupt_record").isNull()).withColumns(keys).where(
        F.col("model") != "").drop("_corrupt_record", "_path")


def evaluation_scores(evals: DataFrame) -> DataFrame:
    """Document scores of stored evaluations with the table-score fallbacks laid out."""
    def page_mean(field: str):
        values = F.filter(F.transform("text.pages", lambda p: p[field]), lambda v: v.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(values) > 0, total / F.size(values))
    return evals.select(
        *DOC_KEYS, F.coalesce("source", F.lit("pipeline")).alias("source"),
        F.col("text.summary.avg_cer").alias("cer"), F.col("text.summary.avg_char_f1").alias("char_f1"),
        F.col("text.summary.avg_word_f1").alias("word_f1"),
        F.col("table.summary.avg_teds").alias("table_avg_teds"),
        F.col("text.summary.table_teds_doc").alias("text_teds"),
        page_mean("table_teds_doc").alias("page_teds"),
        F.col("table.summary.avg_cell_exact_f1").alias("table_avg_cell_f1"),
        F.col("text.summary.table_cell_exact_f1_mean").alias("text_cell_f1"),
        page_mean("table_cell_exact_f1_mean").alias("page_cell_f1"))


def flatten(df: DataFrame) -> DataFrame:
    """Structs one level deep as ``a.b`` columns, arrays and maps as JSON text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType):
            out += [
                _plain(column[inner.name], inner.dataType).alias(f"{field.name}.{inner.name}")
                for inner in field.dataType.fields]
        else:
            out.append(_plain(column, field.dataType).alias(field.name))
    return df.select(*out)


def _plain(column, kind):
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(column) if nested else column


def write_page_csv(page_scores: list[DataFrame], path: str) -> None:
    """Page rows of all use cases under the union of their columns."""
    merged = flatten(page_scores[0])
    for more in page_scores[1:]:
        merged = merged.unionByName(flatten(more), allowMissingColumns=True)
    merged.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_page_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Page rows written by ``write_page_csv``; the schema lists the columns in their written order."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """A use-case summary has a handful of rows per model, hence one file."""
    flatten(summary).repartition(1).write.mode("overwrite").option("header", True).csv(path)


def save_raw_pages(pages: DataFrame, path: str) -> None:
    """Untruncated predicted pages, so that everything can be scored again; a page saved anew replaces the old one."""
    save_scores(pages, path, [*DOC_KEYS, "page_num"])


def model_registry(spark: SparkSession, path: str) -> DataFrame:
    """Known model names; only partition values are read."""
    return score_log.partitions(spark, path).select("model").distinct().orderBy("model")
