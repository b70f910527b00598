"""Roll-ups, rankings, coverage and reviews."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagegauge.catalog import fixtures as fx
from pagegauge.catalog.registry import cte, query, rounded
from pagegauge.catalog.text_queries import _cer_pages
from pagegauge.functions import keys as K, metrics as M
from pagegauge.operators import coverage, ordering, pairs, ranking, rollup
from pagegauge.sources import results

PAGE_METRICS = ("cer", "wer", "char_f1", "word_f1", "table_teds_doc")
DOC_METRICS = ("cer", "char_f1", "word_f1", "teds", "cell_f1")

cte("doc_cer", ("cer_pages",), """
  SELECT model, uc_type, lang, doc_id, round(avg(cer), 6) AS avg_cer,
         round(avg(normalized_edit_similarity), 6) AS avg_nes, count(*) AS n_pages,
         count_if(matched) AS n_matched_pages FROM cer_pages GROUP BY ALL""")


# --- end to end from the texts ----------------------------------------------------------

@query("cer_by_model", ("doc_cer",), """
  SELECT model, round(avg(avg_cer), 6) AS avg_cer, count(*) AS docs, sum(n_pages) AS n_pages,
         sum(n_matched_pages) AS n_matched_pages, row_number() OVER (ORDER BY round(avg(avg_cer), 6), model) AS rank
  FROM doc_cer GROUP BY model""")
def cer_by_model(spark, sf):
    """Pages to documents to models, ranked by mean character error rate."""
    docs = rollup.doc_summary(_cer_pages(spark, sf), ("cer",))
    models = docs.groupBy("model").agg(
        F.round(F.avg("avg_cer"), 6).alias("avg_cer"), F.count("*").alias("docs"),
        F.sum("n_pages").alias("n_pages"), F.sum("n_matched_pages").alias("n_matched_pages"))
    from pyspark.sql import Window
    return models.withColumn("rank", F.row_number().over(Window.orderBy("avg_cer", "model")))


@query("doc_summary", ("doc_cer",), "SELECT * FROM doc_cer")
def doc_summary(spark, sf):
    scores = rollup.doc_summary(_cer_pages(spark, sf), ("cer", "normalized_edit_similarity"))
    return scores.withColumnRenamed("avg_normalized_edit_similarity", "avg_nes")


@query("uc_rollup", ("cer_pages",), """
  SELECT model, uc_type, lang, round(avg(cer), 6) AS avg_cer, count(*) AS n_pages FROM cer_pages GROUP BY ALL""")
def uc_rollup(spark, sf):
    return rollup.uc_summary(_cer_pages(spark, sf), ("cer",))


@query("corpus_rate", ("distances",), """
  SELECT model, lang, round(sum(d) / greatest(sum(n_gt), 1), 6) AS rate FROM distances GROUP BY ALL""")
def corpus_rate(spark, sf):
    rates = rollup.corpus_rates(_cer_pages(spark, sf), ("model", "lang"), "d", "n_gt")
    return rates.withColumn("rate", F.round("rate", 6))


# --- on the score log ----------------------------------------------------------------------

@query("overall_macro", ("score_log",), f"""
  SELECT model, {rounded('avg(cer)', 6)} AS avg_cer, {rounded('avg(wer)', 6)} AS avg_wer, {rounded('avg(t)', 6)} AS avg_table_teds_doc
  FROM (SELECT model, uc_type, lang, avg(cer) AS cer, avg(wer) AS wer, avg(table_teds_doc) AS t
        FROM score_log GROUP BY ALL) GROUP BY model""")
def overall_macro(spark, sf):
    metrics = ("cer", "wer", "table_teds_doc")
    means = rollup.uc_summary(fx.score_log(spark, sf), metrics, digits=None)
    return rollup.overall_macro(means, metrics)


@query("overall_micro", ("score_log",), """
  SELECT model, round(avg(cer), 6) AS avg_cer, round(avg(wer), 6) AS avg_wer, round(avg(char_f1), 6) AS avg_char_f1,
         round(avg(word_f1), 6) AS avg_word_f1, round(avg(table_teds_doc), 6) AS avg_table_teds_doc, count(*) AS n_pages
  FROM score_log GROUP BY model""")
def overall_micro(spark, sf):
    return rollup.overall_micro(fx.score_log(spark, sf), PAGE_METRICS)


@query("uc_dispatch", ("score_log",), """
  SELECT model, uc_type, lang, round(avg(CASE WHEN uc_type <> 'table' THEN cer END), 6) AS avg_cer,
         round(avg(CASE WHEN uc_type = 'scan' THEN wer END), 6) AS avg_wer,
         round(avg(CASE WHEN uc_type = 'table' THEN table_teds_doc END), 6) AS avg_teds, count(*) AS n_pages
  FROM score_log GROUP BY ALL""")
def uc_dispatch(spark, sf):
    """Each use case is scored by its own metrics; the branches meet under one schema."""
    log, key = fx.score_log(spark, sf), ("model", "uc_type", "lang")
    branches = [
        rollup.uc_summary(log.where(F.col("uc_type") == "scan"), ("cer", "wer"), key),
        rollup.uc_summary(log.where(F.col("uc_type") == "table"), ("table_teds_doc",), key)
        .withColumnRenamed("avg_table_teds_doc", "avg_teds"),
        rollup.uc_summary(log.where(F.col("uc_type") == "text_layer"), ("cer",), key)]
    merged = branches[0]
    for branch in branches[1:]:
        merged = merged.unionByName(branch, allowMissingColumns=True)
    return merged


@query("doc_summary_zero_filled", ("score_log",), """
  SELECT model, doc_id, round(avg(coalesce(cer, 0)), 6) AS avg_cer,
         round(avg(coalesce(table_teds_doc, 0)), 6) AS avg_table_teds_doc, count(*) AS n_pages,
         count_if(matched) AS n_matched_pages FROM score_log GROUP BY model, uc_type, lang, doc_id""")
def doc_summary_zero_filled(spark, sf):
    return rollup.doc_summary(
        fx.score_log(spark, sf), ("cer", "table_teds_doc"), missing_as_zero=True).drop("uc_type", "lang")


@query("doc_log", ("doc_log",), "SELECT * EXCLUDE (source) FROM doc_log")
def doc_log(spark, sf):
    return fx.doc_log(spark, sf)


@query("csv_round_trip", ("doc_log",), """
  SELECT model, uc_type, lang, doc_id, avg_cer, avg_char_f1, avg_table_teds_doc, n_pages, n_matched_pages FROM doc_log""")
def csv_round_trip(spark, sf):
    """Page scores exported as CSV, those of tables with columns of their own, then read and rolled up again."""
    log = fx.score_log(spark, sf).select(
        "model", "uc_type", "lang", "doc_id", "page_num", "matched", "cer", "char_f1", "table_teds_doc")
    kinds = [log.where("uc_type <> 'table'").drop("table_teds_doc"), log.where("uc_type = 'table'")]
    path = f"{ordering.shared_folder(spark)}/page-csv-{uuid.uuid4().hex}"
    results.write_page_csv(kinds, path)
    pages = results.read_page_csv(
        spark, path, "model string, uc_type string, lang string, doc_id long, page_num long, matched boolean, "
        "cer double, char_f1 double, table_teds_doc double")
    return rollup.doc_summary(pages, ("cer", "char_f1", "table_teds_doc"))


@query("model_stats", ("doc_log",), """
  SELECT model, round(avg(avg_cer), 4) AS avg_cer, round(avg(avg_char_f1), 4) AS avg_char_f1,
         round(avg(avg_word_f1), 4) AS avg_word_f1, round(avg(avg_table_teds_doc), 4) AS avg_teds,
         round(avg(avg_table_cell_exact_f1_mean), 4) AS avg_cell_f1, count(*) AS docs FROM doc_log GROUP BY model""")
def model_stats(spark, sf):
    return rollup.model_stats(fx.doc_log_scores(spark, sf), DOC_METRICS)


@query("score_source", ("score_log",), """
  SELECT model, CASE WHEN bool_or(source = 'upload') THEN 'upload' ELSE max(source) END AS source, count(*) AS docs,
         round(avg(cer), 4) AS avg_cer FROM (
    SELECT model, doc_id, max(source) AS source, avg(cer) AS cer FROM score_log GROUP BY ALL) GROUP BY model""")
def score_source(spark, sf):
    docs = fx.score_log(spark, sf).groupBy("model", "doc_id").agg(
        F.max("source").alias("source"), F.avg("cer").alias("cer"))
    return rollup.model_stats(docs, ("cer",))


@query("model_buckets", ("bucket_log",), "SELECT * FROM bucket_log")
def model_buckets(spark, sf):
    return rollup.buckets(fx.doc_log_scores(spark, sf), DOC_METRICS)


@query("model_rollup", ("doc_log",), """
  SELECT model, uc_type, lang, CAST(grouping(model) * 4 + grouping(uc_type) * 2 + grouping(lang) AS INT) AS level,
         round(avg(avg_cer), 4) AS avg_cer, round(avg(avg_char_f1), 4) AS avg_char_f1, count(*) AS docs
  FROM doc_log GROUP BY GROUPING SETS ((model), (model, uc_type), (model, uc_type, lang))""")
def model_rollup(spark, sf):
    return rollup.model_rollup(fx.doc_log_scores(spark, sf), ("cer", "char_f1"))


@query("dashboard", ("doc_log",), """
  SELECT model, uc_type, round(avg(avg_cer), 4) AS avg_cer, round(avg(avg_char_f1), 4) AS avg_char_f1,
         round(avg(avg_word_f1), 4) AS avg_word_f1, round(avg(avg_table_teds_doc), 4) AS avg_teds,
         round(avg(avg_table_cell_exact_f1_mean), 4) AS avg_cell_f1, count(*) AS docs
  FROM doc_log GROUP BY GROUPING SETS ((model), (model, uc_type))""")
def dashboard(spark, sf):
    return rollup.dashboard(fx.doc_log_scores(spark, sf), DOC_METRICS)


@query("compare_models", ("bucket_log",), f"""
  SELECT model, {rounded('avg(avg_cer)', 4)} AS avg_cer, {rounded('avg(avg_char_f1)', 4)} AS avg_char_f1,
         {rounded('avg(avg_teds)', 4)} AS avg_teds, sum(docs) AS docs FROM bucket_log WHERE lang = 'en' GROUP BY model""")
def compare_models(spark, sf):
    return rollup.compare_models(fx.doc_log_scores(spark, sf), ("cer", "char_f1", "teds"), lang="en")


@query("doc_evaluation", ("score_log",), """
  SELECT model, uc_type, doc_id, round(avg(coalesce(cer, 0)), 6) AS avg_cer, round(avg(coalesce(char_f1, 0)), 6) AS avg_char_f1,
         count(*) AS n_pages FROM score_log GROUP BY ALL""")
def doc_evaluation(spark, sf):
    return rollup.document_evaluation(fx.score_log(spark, sf), ("cer", "char_f1"))


@query("compare_models_all", ("doc_log",), """
  SELECT model, round(avg(avg_cer), 4) AS avg_cer, round(avg(avg_char_f1), 4) AS avg_char_f1,
         round(avg(avg_table_teds_doc), 4) AS avg_teds, count(*) AS docs FROM doc_log GROUP BY model""")
def compare_models_all(spark, sf):
    return rollup.compare_models(fx.doc_log_scores(spark, sf), ("cer", "char_f1", "teds"), "all", "all")


@query("table_score_fallback", ("score_log",), """
  SELECT model, doc_id, round(coalesce(CASE WHEN doc_id % 5 = 0 THEN t END, CASE WHEN doc_id % 3 = 0 THEN t - 0.1 END, p), 6) AS teds
  FROM (SELECT model, doc_id, max(table_teds_doc) AS t, avg(table_teds_doc) AS p FROM score_log GROUP BY ALL)""")
def table_score_fallback(spark, sf):
    docs = fx.score_log(spark, sf).groupBy("model", "doc_id").agg(
        F.max("table_teds_doc").alias("t"), F.avg("table_teds_doc").alias("page_teds"))
    none = F.lit(None).cast("double")
    laid = docs.withColumns({
        "table_avg_teds": F.when(F.col("doc_id") % 5 == 0, F.col("t")),
        "text_teds": F.when(F.col("doc_id") % 3 == 0, F.col("t") - 0.1),
        "table_avg_cell_f1": none, "text_cell_f1": none, "page_cell_f1": none})
    return rollup.resolve_table_scores(laid).select("model", "doc_id", F.round("teds", 6).alias("teds"))


@query("leaderboard", ("doc_log",), """
  SELECT model, avg_char_f1, avg_teds, docs, total_docs, row_number() OVER (
           ORDER BY coalesce(avg_char_f1, 0) DESC, coalesce(avg_teds, 0) DESC, model) AS rank,
         docs >= total_docs AS is_complete
  FROM (SELECT model, round(avg(avg_char_f1), 4) AS avg_char_f1, round(avg(avg_table_teds_doc), 4) AS avg_teds, count(*) AS docs
        FROM doc_log GROUP BY model), (SELECT count(DISTINCT doc_id) AS total_docs FROM doc_log)""")
def leaderboard(spark, sf):
    docs = fx.doc_log_scores(spark, sf)
    total = docs.agg(F.countDistinct("doc_id")).scalar()
    ranked = ranking.leaderboard(rollup.model_stats(docs, ("char_f1", "teds")), total)
    return ranked.drop("is_best")


@query("recommendation", ("bucket_log",), f"""
  SELECT uc_type, lang, model, {rounded('v * 100', 1)} AS value, row_number() OVER (
           PARTITION BY uc_type, lang ORDER BY {rounded('v * 100', 1)} DESC, model) AS rank, docs
  FROM (SELECT *, CASE WHEN uc_type = 'table' THEN avg_teds ELSE avg_char_f1 END AS v FROM bucket_log) WHERE v IS NOT NULL""")
def recommendation(spark, sf):
    buckets = rollup.buckets(fx.doc_log_scores(spark, sf), DOC_METRICS)
    return ranking.recommend(buckets).select("uc_type", "lang", "model", "value", "rank", "docs")


@query("recommendation_cer", ("bucket_log",), f"""
  SELECT uc_type, lang, model, {rounded('avg_cer * 100', 1)} AS value, row_number() OVER (
           PARTITION BY uc_type, lang ORDER BY {rounded('avg_cer * 100', 1)}, model) AS rank FROM bucket_log""")
def recommendation_cer(spark, sf):
    buckets = rollup.buckets(fx.doc_log_scores(spark, sf), DOC_METRICS)
    return ranking.recommend(buckets, "cer").select("uc_type", "lang", "model", "value", "rank")


@query("worst_pages", ("score_log",), """
  SELECT model, doc_id, page_num, round(cer, 6) AS value FROM score_log WHERE model = 'm1'
  ORDER BY cer DESC, model, doc_id, page_num LIMIT 5""")
def worst_pages(spark, sf):
    worst = ranking.worst_pages(fx.score_log(spark, sf), "cer", 5, model="m1")
    return worst.withColumn("value", F.round("value", 6))


@query("worst_pages_per_model", ("score_log",), """
  SELECT model, rank, doc_id, page_num, round(value, 6) AS value FROM (
    SELECT model, doc_id, page_num, char_f1 AS value, row_number() OVER (PARTITION BY model ORDER BY char_f1, doc_id, page_num) AS rank
    FROM score_log) WHERE rank <= 5""")
def worst_pages_per_model(spark, sf):
    worst = ranking.worst_pages_per_model(fx.score_log(spark, sf), "char_f1")
    return worst.select("model", "rank", "doc_id", "page_num", F.round("value", 6).alias("value"))


@query("outlier_pages", ("cer_pages",), """
  SELECT model, doc_id, page_num FROM (
    SELECT *, avg(normalized_edit_similarity) OVER w AS m, stddev_pop(normalized_edit_similarity) OVER w AS s
    FROM cer_pages WINDOW w AS (PARTITION BY doc_id, page_num))
  WHERE s > 1e-9 AND normalized_edit_similarity < m - 1.2 * s""")
def outlier_pages(spark, sf):
    flagged = ranking.outlier_pages(_cer_pages(spark, sf), "normalized_edit_similarity", 1.2)
    return flagged.where(F.col("page_sd") > 1e-9).select("model", "doc_id", "page_num")


@query("doc_comparison", ("doc_log",), """
  SELECT doc_id, max(CASE WHEN model = 'm0' THEN avg_cer END) AS m0, max(CASE WHEN model = 'm1' THEN avg_cer END) AS m1,
         max(CASE WHEN model = 'm2' THEN avg_cer END) AS m2, max(CASE WHEN model = 'm3' THEN avg_cer END) AS m3,
         max(CASE WHEN model = 'm4' THEN avg_cer END) AS m4 FROM doc_log GROUP BY doc_id""")
def doc_comparison(spark, sf):
    return ranking.compare_doc(fx.doc_log(spark, sf), ["m0", "m1", "m2", "m3", "m4"], "avg_cer")


@query("missing_docs", ("score_log",), """
  SELECT m.model, d.o_orderkey AS doc_id FROM (SELECT DISTINCT model FROM score_log) m, orders d
  WHERE NOT EXISTS (SELECT 1 FROM score_log s WHERE s.model = m.model AND s.doc_id = d.o_orderkey)""")
def missing_docs(spark, sf):
    log = fx.score_log(spark, sf)
    docs = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return coverage.missing_docs(log, docs, log.select("model", "doc_id").distinct())


@query("progress", ("doc_log",), """
  SELECT model, count(*) AS docs, total_docs, total_docs - count(*) AS missing, count(*) >= total_docs AS complete
  FROM doc_log, (SELECT count(*) AS total_docs FROM orders) GROUP BY model, total_docs""")
def progress(spark, sf):
    scored = fx.doc_log(spark, sf)
    docs = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    stats = scored.groupBy("model").agg(F.count("*").alias("docs"))
    return coverage.progress(stats, docs, scored)


@query("known_models", ("pred_pages", "score_log"), """
  SELECT DISTINCT model FROM pred_pages UNION SELECT model FROM score_log""")
def known_models(spark, sf):
    return coverage.known_models(fx.pred_pages(spark, sf), fx.score_log(spark, sf))


@query("review_overview", (), """
  SELECT uc_type, lang, CAST(grouping(uc_type) * 2 + grouping(lang) AS INT) AS level, count(*) AS total,
         count_if(reviewed) AS reviewed, count_if(NOT reviewed) AS pending
  FROM (SELECT CASE d.doc_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'table' ELSE 'text_layer' END AS uc_type, d.lang,
               l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l USING (doc_id))
  GROUP BY ROLLUP (uc_type, lang)""")
def review_overview(spark, sf):
    drafts = fx.gt_pages(spark, sf).where(F.col("page_num") == 1).select("uc_type", "lang", "doc_id")
    return coverage.review_overview(drafts, fx.table(spark, sf, "labels"), ("doc_id",))


@query("asset_status", ("pred_pages",), """
  SELECT doc_id, doc_id IN (SELECT doc_id FROM pred_pages WHERE model = 'm_swap') AS has_swap,
         doc_id IN (SELECT doc_id FROM pred_pages WHERE model = 'm_drop') AS has_drop,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS gt_done FROM documents""")
def asset_status(spark, sf):
    pred = fx.pred_pages(spark, sf)
    sides = {
        "has_swap": pred.where(F.col("model") == "m_swap"), "has_drop": pred.where(F.col("model") == "m_drop"),
        "gt_done": fx.table(spark, sf, "labels").where(F.col("quality") == 1)}
    return coverage.asset_status(fx.table(spark, sf, "documents").select("doc_id"), sides, ("doc_id",))


@query("review_versions", (), """
  SELECT user_id AS doc_id, event_type AS status, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn = 1 AND event_type <> 'error'""")
def review_versions(spark, sf):
    versions = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), "event_id",
        F.struct("ts", "event_id").alias("updated_at"), (F.col("event_type") == "error").alias("deleted"))
    return coverage.current_versions(versions, ("doc_id",)).select("doc_id", "status", "event_id")


@query("recent_log", (), """
  SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_log(spark, sf):
    log = fx.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return ranking.recent(log, "ts", 50, "event_id").drop("ts")


@query("source_fallback", ("score_log",), """
  SELECT model, doc_id, CASE WHEN doc_id % 4 <> 0 AND stored THEN 'stored_pages' WHEN doc_id % 7 <> 0 THEN 'pipeline' END AS pred_source,
         CASE WHEN (doc_id % 4 <> 0 AND stored) OR doc_id % 7 <> 0 THEN 'ok' ELSE 'skip' END AS status
  FROM (SELECT model, doc_id, bool_or(matched) AS stored FROM score_log GROUP BY ALL)""")
def source_fallback(spark, sf):
    log = fx.score_log(spark, sf)
    docs = log.select("model", "uc_type", "lang", "doc_id").distinct()
    resolved = pairs.resolve_sources(
        docs, log.where((F.col("doc_id") % 4 != 0) & F.col("matched")), log.where(F.col("doc_id") % 7 != 0))
    return resolved.select("model", "doc_id", "pred_source", "status")


@query("status_tally", ("score_log",), """
  SELECT CASE WHEN doc_id % 28 = 0 THEN 'skip' ELSE 'ok' END AS status, count(*) AS n FROM (
    SELECT DISTINCT model, doc_id FROM score_log) GROUP BY 1""")
def status_tally(spark, sf):
    docs = fx.score_log(spark, sf).select("model", "uc_type", "lang", "doc_id").distinct()
    resolved = pairs.resolve_sources(
        docs, docs.where(F.col("doc_id") % 4 != 0), docs.where(F.col("doc_id") % 7 != 0))
    return coverage.status_tally(resolved)


@query("quality_band", ("score_log",), """
  SELECT model, CASE WHEN cer < 0.05 THEN 'good' WHEN cer <= 0.15 THEN 'fair' ELSE 'poor' END AS cer_band,
         CASE WHEN table_teds_doc IS NULL THEN 'none' WHEN table_teds_doc > 0.85 THEN 'good'
              WHEN table_teds_doc > 0.60 THEN 'fair' ELSE 'poor' END AS teds_band, count(*) AS n
  FROM score_log GROUP BY ALL""")
def quality_band(spark, sf):
    banded = fx.score_log(spark, sf).select(
        "model", M.upload_band(F.col("cer")).alias("cer_band"),
        M.card_band(F.col("table_teds_doc")).alias("teds_band"))
    return banded.groupBy("model", "cer_band", "teds_band").agg(F.count("*").alias("n"))


@query("doc_key", ("gt_pages",), """
  SELECT DISTINCT name, CASE WHEN p1 = '' OR p2 = '' OR n < 3 THEN NULL WHEN p1 = 'textlayer' THEN 'text_layer' ELSE p1 END AS uc_type,
         CASE WHEN p1 = '' OR p2 = '' OR n < 3 THEN NULL ELSE p2 END AS lang
  FROM (SELECT name, string_split(name, '_')[1] AS p1, string_split(name, '_')[2] AS p2, len(string_split(name, '_')) AS n
        FROM (SELECT CASE WHEN doc_id % 10 = 9 THEN lang || doc_id ELSE replace(uc_type, '_', '') || '_' || lang || '_' || doc_id END AS name
              FROM gt_pages))""")
def doc_key(spark, sf):
    pages = fx.gt_pages(spark, sf).where(F.col("page_num") == 1)
    good = F.concat_ws("_", F.replace("uc_type", F.lit("_"), F.lit("")), F.col("lang"), F.col("doc_id").cast("string"))
    name = F.when(F.col("doc_id") % 10 == 9, F.concat("lang", F.col("doc_id").cast("string"))).otherwise(good)
    keyed = pages.select(name.alias("name"), K.doc_key(name).alias("k"))
    return keyed.select("name", "k.uc_type", "k.lang")


@query("use_case_names", ("score_log",), """
  SELECT uc, uc_name, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'vi' THEN 'Tiếng Việt' WHEN 'ja' THEN '日本語' ELSE '한국어' END AS label,
         count(*) AS n
  FROM score_log LEFT JOIN (VALUES
    ('UC01', 'scan', 'vi', 'scan_vi'), ('UC02', 'scan', 'en', 'scan_en'), ('UC03', 'scan', 'ja', 'scan_ja'),
    ('UC04', 'table', 'vi', 'table_vi'), ('UC05', 'table', 'en', 'table_en'), ('UC06', 'table', 'ja', 'table_ja'),
    ('UC07', 'text_layer', 'vi', 'text_layer_vi'), ('UC08', 'text_layer', 'en', 'text_layer_en'),
    ('UC09', 'text_layer', 'ja', 'text_layer_ja')) u(uc, uc_type, lang, uc_name) USING (uc_type, lang) GROUP BY ALL""")
def use_case_names(spark, sf):
    named = K.with_use_case(fx.score_log(spark, sf).select("uc_type", "lang"))
    return named.groupBy("uc", "uc_name", "lang", K.lang_label(F.col("lang")).alias("label")).agg(
        F.count("*").alias("n"))


@query("model_filter", ("score_log",), """
  SELECT model, count(*) AS n FROM score_log WHERE lower(model) LIKE '%m2%' GROUP BY model""")
def model_filter(spark, sf):
    log = rollup.only_models(fx.score_log(spark, sf), pattern="m2")
    return log.groupBy("model").agg(F.count("*").alias("n"))
