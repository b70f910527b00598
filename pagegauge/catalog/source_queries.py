"""Naming, OCR responses, incremental scoring and review activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge.catalog import fixtures as fx
from pagegauge.catalog.registry import cte, query
from pagegauge.functions import keys as K, text as X
from pagegauge.operators import ordering, pairs
from pagegauge.sources import responses

cte("assets", (), r"""
  SELECT page_id, lang, uc_type, tail || '-' || page_id || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '.v2.docx' END AS file_name
  FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) AS lang,
               CASE page_id % 2 WHEN 0 THEN 'scan' ELSE 'text_layer' END AS uc_type,
               regexp_extract(url, '^https?://([^/]+)/', 1) AS tail FROM pages)""")
cte("slugs", ("assets",), r"""
  SELECT lang AS folder, file_name AS src, coalesce(nullif(trim(regexp_replace(regexp_replace(
           CASE WHEN known THEN left(low, length(low) - length(ext)) ELSE low END, '[^a-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'doc')
         || CASE WHEN known THEN ext ELSE '' END AS slug
  FROM (SELECT *, ext IN ('.pdf', '.docx', '.png') AS known FROM (
    SELECT *, lower(file_name) AS low, regexp_extract(lower(file_name), '^.+(\.[^.]+)$', 1) AS ext FROM assets))""")


def _assets(spark, sf):
    pages = fx.texts(spark, sf, "pages").select("page_id", "url")
    ext = F.element_at(F.array(F.lit(".PDF"), F.lit(".png"), F.lit(".v2.docx")), (F.col("page_id") % 3 + 1).cast("int"))
    return pages.select(
        "page_id", F.regexp_extract("url", "^https?://[^/]+/([^/]+)/", 1).alias("lang"),
        F.when(F.col("page_id") % 2 == 0, "scan").otherwise("text_layer").alias("uc_type"),
        F.concat(F.regexp_extract("url", "^https?://([^/]+)/", 1), F.lit("-"),
                 F.col("page_id").cast("string"), ext).alias("file_name"))


@query("slug_names", ("slugs",), "SELECT folder, src, slug FROM slugs")
def slug_names(spark, sf):
    return _assets(spark, sf).select(
        F.col("lang").alias("folder"), F.col("file_name").alias("src"), K.slug(F.col("file_name")).alias("slug"))


@query("document_names", ("assets",), r"""
  SELECT page_id, replace(uc_type, '_', '') || '_' || lang || '_' || CASE WHEN seq < 1000 THEN lpad(seq::VARCHAR, 3, '0') ELSE seq::VARCHAR END
         || lower(regexp_extract(file_name, '^.+(\.[^.]+)$', 1)) AS new_name
  FROM (SELECT *, row_number() OVER (PARTITION BY uc_type, lang ORDER BY file_name) AS seq FROM assets)""")
def document_names(spark, sf):
    return ordering.name_documents(_assets(spark, sf)).select("page_id", "new_name")


@query("slug_collisions", ("assets",), r"""
  SELECT lang AS folder, file_name AS src, CASE WHEN k = 1 THEN slug ELSE replace(slug, '.pdf', '_' || k || '.pdf') END AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, slug ORDER BY file_name) AS k FROM (
    SELECT lang, file_name, left(regexp_replace(file_name, '[^a-z]', '', 'g'), 4) || '.pdf' AS slug FROM assets))""")
def slug_collisions(spark, sf):
    slugs = _assets(spark, sf).select(
        F.col("lang").alias("folder"), F.col("file_name").alias("src"),
        F.concat(F.substring(F.regexp_replace("file_name", "[^a-z]", ""), 1, 4), F.lit(".pdf")).alias("slug"))
    return ordering.suffix_collisions(slugs).select("folder", "src", "target")


# --- OCR responses ---------------------------------------------------------------------------

def _trees(spark, sf):
    """Web pages as block trees: one page each, the whole body cut where paragraphs end."""
    pages = fx.texts(spark, sf, "pages").select("page_id", "html")
    paras = F.split("html", "</p>", -1)
    kinds = F.array(*map(F.lit, ("Text", "Picture", "Table", "Caption", "PageFooter")))
    block = F.transform(paras, lambda p, k: F.struct(
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("block_type"),
        F.array(F.lit(0.0), k * 10.0, F.lit(100.0), k * 10.0 + 8.0).alias("bbox"), p.alias("html"),
        F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("array<struct<spans:array<struct<text:string>>>>").alias("lines")))
    page = F.struct(
        F.lit("Page").alias("block_type"), F.array(*map(F.lit, (0.0, 0.0, 200.0, 400.0))).alias("bbox"),
        block.alias("children"))
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), F.array(page).alias("children"))


cte("tree_texts", (), r"""
  SELECT page_id, k, ['Text', 'Picture', 'Table', 'Caption', 'PageFooter'][(k - 1) % 5 + 1] AS kind,
         trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(ps[k],
           '(?i)<img\b[^>]*>', '', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
           '&nbsp;', ' '), '&#39;', chr(39)), '&quot;', '"'), '\s+', ' ', 'g')) AS t
  FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (
    SELECT page_id, string_split(html, '</p>') AS ps FROM pages))""")


@query("tree_block_kinds", ("tree_texts",), """
  SELECT kind AS block_type, count(*) AS n, round(max(((k - 1) * 10.0 + 8.0) / 400.0), 6) AS max_y2
  FROM tree_texts WHERE kind <> 'Picture' AND t <> '' GROUP BY 1""")
def tree_block_kinds(spark, sf):
    blocks = responses.tree_blocks(_trees(spark, sf))
    return blocks.groupBy("block_type").agg(
        F.count("*").alias("n"), F.round(F.max(F.col("bbox")[3]), 6).alias("max_y2"))


@query("tree_scan_prediction", ("tree_texts",), """
  SELECT page_id::VARCHAR AS doc_id, 1 AS page_num, string_agg(t, chr(10) ORDER BY k) AS full_text
  FROM tree_texts WHERE kind NOT IN ('Picture', 'Table') AND t <> '' GROUP BY page_id""")
def tree_scan_prediction(spark, sf):
    return responses.scan_prediction(responses.text_blocks(responses.tree_blocks(_trees(spark, sf))))


@query("tree_text_layer", ("tree_texts",), """
  SELECT page_id::VARCHAR AS doc_id, 1 AS page_num, count(*)::INT AS n_blocks, string_agg(t, chr(10) ORDER BY k) AS full_text
  FROM tree_texts WHERE kind <> 'Picture' AND t <> '' GROUP BY page_id""")
def tree_text_layer(spark, sf):
    pages = responses.text_layer_prediction(responses.tree_blocks(_trees(spark, sf)))
    return pages.select("doc_id", "page_num", F.size("blocks").alias("n_blocks"), "full_text")


@query("tree_tables", ("tree_texts",), """
  SELECT page_id::VARCHAR AS doc_id, 1 AS page_num, count(*)::INT AS n_tables
  FROM tree_texts WHERE kind = 'Table' AND t <> '' GROUP BY page_id""")
def tree_tables(spark, sf):
    pages = responses.table_prediction(responses.tree_blocks(_trees(spark, sf)))
    return pages.select("doc_id", "page_num", F.size("tables").alias("n_tables"))


@query("tree_readable", (), r"""
  SELECT page_id::VARCHAR AS doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY k) FILTER (t <> ''), '') AS markdown
  FROM (SELECT page_id, k, CASE WHEN k % 5 = 3 THEN trim(h, ' ' || chr(10)) ELSE
          trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '(?i)<br\s*/?>', chr(10), 'g'),
            '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '\n{3,}', chr(10) || chr(10), 'g'),
            ' ' || chr(10)) END AS t
        FROM (SELECT page_id, k, ps[k] AS h FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (
          SELECT page_id, string_split(html, '</p>') AS ps FROM pages))) WHERE h <> '' AND k % 5 <> 2)
  GROUP BY page_id""")
def tree_readable(spark, sf):
    return responses.readable_document(_trees(spark, sf))


@query("response_page_text", (), r"""
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(body, '(?i)<img\b[^>]*/?>', '', 'g'),
           '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS full_text
  FROM (SELECT page_id, trim(url) || chr(10) || trim(html) || chr(10) || 'page ' || page_id AS body FROM pages)""")
def response_page_text(spark, sf):
    pages = fx.texts(spark, sf, "pages")
    return pages.select("page_id", X.response_page_text(
        F.col("url"), F.col("html"), F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("full_text"))


@query("response_pages", (), r"""
  SELECT page_id::VARCHAR AS doc_id, 1 AS page_num,
         trim(regexp_replace(regexp_replace(regexp_replace(body, '(?i)<img\b[^>]*/?>', '', 'g'),
           '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS full_text,
         (1 - page_id % 2)::INT AS n_tables, CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR END AS first_cell,
         CASE WHEN page_id % 2 = 0 THEN 2 END AS second_span
  FROM (SELECT page_id, trim(url) || chr(10) || trim(html) || chr(10) || 'page ' || page_id AS body FROM pages)""")
def response_pages(spark, sf):
    """Web pages as page responses: every second one has a table of its own and one that is none."""
    pages = fx.texts(spark, sf, "pages")
    key = F.col("page_id").cast("string")
    own = F.concat(F.lit(" <TABLE><tr><th>"), key, F.lit("</th><td colspan='2'>x</td></tr></TABLE>"))
    tables = F.array(*[F.struct(key.alias("id"), c.alias("content")) for c in (F.lit("no table"), own)])
    block = "array<struct<type:string,content:string,top_left_x:double,top_left_y:double,bottom_right_x:double,bottom_right_y:double>>"
    page = F.struct(
        F.lit(0).alias("index"), F.col("html").alias("markdown"), F.col("url").alias("header"),
        F.concat(F.lit("page "), key).alias("footer"), F.when(F.col("page_id") % 2 == 0, tables).alias("tables"),
        F.struct(F.lit(1.0).alias("width"), F.lit(1.0).alias("height")).alias("dimensions"),
        F.lit(None).cast(block).alias("blocks"))
    found = responses.response_text_layer(responses.response_pages(
        pages.select(key.alias("doc_id"), F.array(page).alias("pages"))))
    cells = F.get("tables", F.lit(0))["cells"]
    return found.select(
        "doc_id", "page_num", F.get("blocks", F.lit(0))["text"].alias("full_text"), F.size("tables").alias("n_tables"),
        F.get(cells, F.lit(0))["text"].alias("first_cell"), F.get(cells, F.lit(1))["colspan"].alias("second_span"))


# --- merging split predictions and evidence carry-over ------------------------------------------

@query("text_table_merge", ("score_log",), """
  SELECT model, doc_id, page_num, CASE WHEN page_num % 2 = 0 THEN 'own' WHEN page_num % 3 = 0 THEN 'found' END AS source
  FROM (SELECT DISTINCT model, doc_id, page_num FROM score_log)""")
def text_table_merge(spark, sf):
    log = fx.score_log(spark, sf).select("model", "doc_id", "page_num").distinct()
    keys = ["model", "doc_id", "page_num"]
    empty = F.array().cast("array<string>")
    text = log.withColumn("tables", F.when(F.col("page_num") % 2 == 0, F.array(F.lit("own"))).otherwise(empty))
    tables = log.where(F.col("page_num") % 3 == 0).withColumn("tables", F.array(F.lit("found")))
    return pairs.merge_tables(text, tables, keys).select(*keys, F.get("tables", F.lit(0)).alias("source"))


@query("evidence_carry_over", ("score_log",), """
  SELECT model, doc_id, page_num, CASE WHEN page_num % 3 = 0 THEN 'seen ' || page_num END AS evidence
  FROM (SELECT DISTINCT model, doc_id, page_num FROM score_log)""")
def evidence_carry_over(spark, sf):
    keys = ["model", "doc_id", "page_num"]
    log = fx.score_log(spark, sf).select(*keys).distinct()
    old = log.withColumn("evidence", F.when(F.col("page_num") % 3 == 0, F.concat(
        F.lit("seen "), F.col("page_num").cast("string"))))
    return pairs.carry_over(log, old, keys, "evidence")


# --- streams ----------------------------------------------------------------------------------------

@query("review_activity", (), """
  SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(DISTINCT user_id) AS users
  FROM events GROUP BY ALL""")
def review_activity(spark, sf):
    """Hourly activity; the batch form of the streaming job, with re-deliveries removed."""
    from pagegauge.streaming.review import hourly_activity
    events = fx.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    delivered = events.unionByName(events.where(F.col("event_id") % 10 == 0))
    return hourly_activity(delivered.dropDuplicates(["event_id"]))
