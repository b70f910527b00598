"""Registered queries against their SQL on the smallest driver tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = (
    "pair_coverage", "token_errors", "char_f1", "norm_tables_flat", "structure_prf", "formula_best", "page_rebase",
    "cell_exact_f1", "cell_accuracy", "layout_extra", "cer_by_model", "model_rollup", "leaderboard", "recommendation",
    "missing_docs", "review_overview", "document_names", "text_table_merge", "review_activity",
    "word_detail", "doc_evaluation", "response_pages", "table_id_join", "compare_models_all", "tree_block_kinds",
    "tree_scan_prediction", "tree_text_layer", "tree_tables", "layout_status", "slug_collisions", "cell_diff",
    "incremental_scores", "worst_pages_per_model", "doc_table_summary", "layout_best", "char_alignment",
    "text_layer_pages", "layout_mean_iou", "table_page_scores", "mixed_pages", "table_cells", "inline_tables", "csv_round_trip", "doc_summary", "cell_issue_counts", "asset_status",
)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def test_every_query_with_sql_is_registered():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 90


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, str(DATA))
    cursor = sql.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


def test_entry_runs(spark):
    assert [r["rank"] for r in contract.entry(spark).orderBy("rank").collect()] == [1, 2, 3]
