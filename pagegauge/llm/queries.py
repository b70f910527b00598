"""Registered queries of the operators and their SQL, where SQL can say the same."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import (
    bpe, chat, decontaminate, hardneg, langid, minhash, multiindex, packing, pii, quality, secrets, tokenfiles, whitening,
)
from pagegauge.llm.store import scratch, table
from pagegauge.llm.tokens import BYTE_LEVEL, WORD_LEVEL

QUERIES = {}
SQL: dict[str, str] = {}
#: A user passes a key of their own; results of the query must be the same everywhere.
SURROGATE_KEY = b"surrogates of the registered query"
_SQL_FOLDER = Path(__file__).resolve().parent / "sql"


def query(fn):
    QUERIES[fn.__name__] = fn
    file = _SQL_FOLDER / f"{fn.__name__}.sql"
    if file.exists():
        SQL[fn.__name__] = file.read_text()
    return fn


@query
def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(WORD_LEVEL), with_ids=False).drop("ids")


@query
def op4_chat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    said = F.array(*[F.struct(
        F.lit(-1).alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), F.lit(probe).alias("text"))
        for k, role in enumerate(("user", "assistant"))])
    more = spark.range(1).select(F.inline(said))
    return chat.read_back(chat.formatted(chat.ranked(chat.linear(turns.union(more)))))


@query
def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.report(secrets.scan(docs, repository="doc_id", owner="source"))


@query
def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = quality.held_out("doc_id", 4)
    found = [(r.lang, bytes(r.sample), bytes(r.held_back)) for r in langid.samples(docs.where(fold != 2)).collect()]
    return langid.predict(docs.select("doc_id", "text"), found).select(
        "doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = quality.held_out("doc_id", 5)
    labels = table(spark, sf_dir, "labels").where(fold != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    return quality.score(docs, model).select(
        "doc_id", (fold == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "token-files")
    manifest = tokenfiles.write_token_files(
        docs, folder, public_tokenizers.path(BYTE_LEVEL), end_id=2, vocabulary_size=50257)
    return tokenfiles.read_token_files(manifest, folder).drop("ids")


@query
def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymized(docs, key=SURROGATE_KEY)


@query
def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


@query
def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(WORD_LEVEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
