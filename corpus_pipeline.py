"""From raw documents to packed training sequences, in stages written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import decontaminate, minhash, packing, quality, secrets
from pagegauge.llm.store import fresh, scratch, table
from pagegauge.llm.tokens import WORD_LEVEL


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score below 0.3 go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    name = fresh(docs, "_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.3).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest id of each group stays."""
    return minhash.deduplicated(docs)


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item, edited or not, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every secret value but widely copied examples becomes a mark; all documents stay."""
    scanned = secrets.scan(docs, repository="doc_id", owner="source")
    return secrets.masked(docs, scanned).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; the ids of each piece are part of its row."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_LEVEL))


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_one_of_each_group),
    ("decontamination", remove_test_items),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: No SQL expresses the network of the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
