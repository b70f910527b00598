"""Ground truth and predictions derived from the driver tables.

Each fixture exists twice, as a DataFrame and as SQL text, and both read the
whole table.  Document texts are cut into consecutive pages that together
hold the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.catalog.registry import cte
from pagegauge.functions.exprs import settle
from pagegauge.operators.evidence import has_table, mentions_figure
from pagegauge.operators.ordering import spread
from pagegauge.operators.pairs import pair_pages
from pagegauge.operators.scoring import normalize_side

PAGE_CHARS = 500
TOKEN_PAGE_CHARS = 250

# The accented letters of the texts, each given an ASCII code of
# its own in the SQL because SQL edit distance counts bytes.
LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
_ASCII = "||".join(f"chr({k})" for k in [*range(1, 9), 11, 12, *range(14, 25)])


def one_byte(column: str) -> str:
    return f"translate({column}, '{LETTERS}', {_ASCII})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are about to be parsed: spread over all cores."""
    return spread(table(spark, sf_dir, name))


# --- pages of documents -----------------------------------------------------------

def paged(docs: DataFrame, chars: int = PAGE_CHARS) -> DataFrame:
    # One pass over the text; cutting page k by its place would walk over all pages before it.  Page numbers come from
    # the length alone, so that what reads keys only cuts nothing, and pages are not cut a second time to see if there are any.
    pages = F.when(F.col("text") != "", F.regexp_extract_all(
        "text", F.lit(f"(?s).{{1,{chars}}}+"), F.lit(0))).otherwise(F.array("text"))
    n_pages = F.greatest(F.lit(1), F.ceil(F.length("text") / chars)).cast("int")
    uc = F.element_at(F.array(F.lit("scan"), F.lit("table"), F.lit("text_layer")),
                      (F.col("doc_id") % 3 + 1).cast("int"))
    cut = docs.select(uc.alias("uc_type"), "lang", "doc_id", pages.alias("_pages"), n_pages.alias("_n"))
    listed = cut.select("uc_type", "lang", "doc_id", "_pages", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("page_num"))
    return listed.select("uc_type", "lang", "doc_id", "page_num", F.element_at("_pages", F.col("page_num")).alias("gt_text"))


def gt_pages(spark: SparkSession, sf_dir: str, chars: int = PAGE_CHARS) -> DataFrame:
    return paged(texts(spark, sf_dir, "documents").select("doc_id", "lang", "text"), chars)


MODELS = ("m_exact", "m_swap", "m_drop")


def _model_text(model: Column, text: Column) -> Column:
    return F.when(model == "m_exact", text).when(
        model == "m_swap", F.replace(text, F.lit("th"), F.lit("tn"))).otherwise(F.lower(F.replace(text, F.lit("."), F.lit(""))))


def pred_pages(spark: SparkSession, sf_dir: str, chars: int = PAGE_CHARS) -> DataFrame:
    """Three models with missing pages, missing documents and extra pages.

    Texts are made after the models are listed, so that what reads keys only makes none.
    """
    pages = gt_pages(spark, sf_dir, chars)
    models = F.explode(F.array(*map(F.lit, MODELS))).alias("model")
    kept = pages.where((F.col("doc_id") + F.col("page_num")) % 17 != 0).select(
        models, "uc_type", "lang", "doc_id", "page_num", "gt_text")
    kept = kept.select("model", "uc_type", "lang", "doc_id", "page_num", _model_text(F.col("model"), F.col("gt_text")).alias("pred_text"))
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 19 == 0)
    extra = paged(docs.select("doc_id", "lang", "text"), chars).groupBy(
        "uc_type", "lang", "doc_id").agg((F.max("page_num") + 1).alias("page_num"))
    extra = extra.select(models, "uc_type", "lang", "doc_id", "page_num", F.lit("extra").alias("pred_text"))
    return kept.unionByName(extra).where(~((F.col("model") == "m_drop") & (F.col("doc_id") % 23 == 0)))


def page_pairs(spark: SparkSession, sf_dir: str, chars: int = PAGE_CHARS) -> DataFrame:
    pairs = pair_pages(gt_pages(spark, sf_dir, chars), pred_pages(spark, sf_dir, chars))
    return pairs.withColumn("pred_text", F.coalesce("pred_text", F.lit("")))


def normalized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page pairs after the full normalizer, which runs once per page of either side."""
    gt = normalize_side(gt_pages(spark, sf_dir), "gt_text", "ref")
    pred = pred_pages(spark, sf_dir).withColumns({
        "has_table": has_table(F.col("pred_text")), "figure_mentions": mentions_figure(F.col("pred_text"))})
    pairs = pair_pages(gt, normalize_side(pred, "pred_text", "hyp"))
    return pairs.withColumns({
        "hyp": F.coalesce("hyp", F.lit("")), "has_table": F.coalesce("has_table", F.lit(False)),
        "figure_mentions": F.coalesce("figure_mentions", F.lit(False))})


def ref_hyp(pairs: DataFrame) -> DataFrame:
    """Score the texts as they are, without the normalizer."""
    return pairs.withColumnsRenamed({"gt_text": "ref", "pred_text": "hyp"})


def _page_ctes(suffix: str, chars: int) -> None:
    cte(f"gt_pages{suffix}", (), f"""
      SELECT CASE doc_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'table' ELSE 'text_layer' END AS uc_type,
             lang, doc_id, page_num, substring(text, 1 + {chars} * (page_num - 1), {chars}) AS gt_text
      FROM (SELECT *, unnest(range(1, 1 + greatest(1, CAST(ceil(length(text) / {chars}.0) AS INT)))) AS page_num
            FROM documents)""")
    cte(f"pred_pages{suffix}", (f"gt_pages{suffix}",), f"""
      SELECT * FROM (
        SELECT 'm_exact' AS model, uc_type, lang, doc_id, page_num, gt_text AS pred_text FROM gt_pages{suffix}
        UNION ALL
        SELECT 'm_swap', uc_type, lang, doc_id, page_num, replace(gt_text, 'th', 'tn') FROM gt_pages{suffix}
        UNION ALL
        SELECT 'm_drop', uc_type, lang, doc_id, page_num, lower(replace(gt_text, '.', '')) FROM gt_pages{suffix}
      ) WHERE (doc_id + page_num) % 17 <> 0 AND NOT (model = 'm_drop' AND doc_id % 23 = 0)
      UNION ALL
      SELECT m.model, uc_type, lang, doc_id, max(page_num) + 1, 'extra'
      FROM gt_pages{suffix}, (VALUES ('m_exact'), ('m_swap'), ('m_drop')) m(model)
      WHERE doc_id % 19 = 0 AND NOT (m.model = 'm_drop' AND doc_id % 23 = 0)
      GROUP BY ALL""")
    cte(f"page_pairs{suffix}", (f"gt_pages{suffix}", f"pred_pages{suffix}"), f"""
      SELECT d.model, g.uc_type, g.lang, g.doc_id, g.page_num, g.gt_text,
             coalesce(p.pred_text, '') AS pred_text, p.doc_id IS NOT NULL AS matched
      FROM gt_pages{suffix} g
      JOIN (SELECT DISTINCT model, doc_id FROM pred_pages{suffix}) d USING (doc_id)
      LEFT JOIN pred_pages{suffix} p
        ON p.model = d.model AND p.doc_id = g.doc_id AND p.page_num = g.page_num""")


_page_ctes("", PAGE_CHARS)
_page_ctes("_short", TOKEN_PAGE_CHARS)

cte("distances", ("page_pairs",), f"""
  SELECT *, length(gt_text) AS n_gt, length(pred_text) AS n_pred,
         CASE WHEN gt_text = pred_text THEN 0
              ELSE levenshtein({one_byte('gt_text')}, {one_byte('pred_text')}) END AS d
  FROM page_pairs""")
cte("cer_pages", ("distances",), """
  SELECT model, uc_type, lang, doc_id, page_num, matched, d / greatest(n_gt, 1) AS cer,
         greatest(0.0, 1.0 - d / greatest(n_gt, n_pred, 1)) AS normalized_edit_similarity
  FROM distances""")


# --- a page score log derived from line items -------------------------------------

UC = ("scan", "table", "text_layer")
LANGS = ("en", "vi", "ja", "ko")


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored page per line item."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax")
    uc = F.element_at(F.array(*map(F.lit, UC)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    lang = F.element_at(F.array(*map(F.lit, LANGS)), (F.floor(F.col("l_orderkey") / 3) % 4 + 1).cast("int"))
    cer = (F.col("l_discount") + F.col("l_suppkey") % 7 * 0.01) * 0.987654321
    rows = li.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string")).alias("model"),
        uc.alias("uc_type"), lang.alias("lang"), F.col("l_orderkey").alias("doc_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("page_num"),
        cer.alias("cer"), (cer * 1.7 + F.col("l_tax") * 0.3).alias("wer"),
        (1 - cer * 0.6).alias("char_f1"), (1 - cer * 0.9).alias("word_f1"),
        (1 - cer * 0.8).alias("normalized_edit_similarity"),
        F.when(uc == "table", 1 - F.col("l_tax") * 1.23456789).alias("table_teds_doc"),
        F.when(uc == "table", 1 - F.col("l_tax") * 1.3456789).alias("table_cell_exact_f1_mean"),
        F.when(F.col("l_suppkey") % 5 == 4, "upload").otherwise("pipeline").alias("source"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 13 != 0).alias("matched"))
    return rows


cte("score_log", (), """
  SELECT *, cer * 1.7 + l_tax * 0.3 AS wer, 1 - cer * 0.6 AS char_f1, 1 - cer * 0.9 AS word_f1,
         1 - cer * 0.8 AS normalized_edit_similarity,
         CASE WHEN uc_type = 'table' THEN 1 - l_tax * 1.23456789 END AS table_teds_doc,
         CASE WHEN uc_type = 'table' THEN 1 - l_tax * 1.3456789 END AS table_cell_exact_f1_mean
  FROM (SELECT 'm' || (l_suppkey % 5) AS model,
               CASE l_orderkey % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'table' ELSE 'text_layer' END AS uc_type,
               CASE (l_orderkey // 3) % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'vi' WHEN 2 THEN 'ja' ELSE 'ko' END AS lang,
               l_orderkey AS doc_id, l_partkey * 10 + l_linenumber AS page_num,
               (l_discount + CAST(l_suppkey % 7 AS DOUBLE) * CAST(0.01 AS DOUBLE)) * CAST(0.987654321 AS DOUBLE) AS cer, l_tax,
               CASE WHEN l_suppkey % 5 = 4 THEN 'upload' ELSE 'pipeline' END AS source,
               (l_partkey + l_linenumber) % 13 <> 0 AS matched
        FROM lineitem)""")
DOC_LOG_METRICS = ("cer", "char_f1", "word_f1", "table_teds_doc", "table_cell_exact_f1_mean")
cte("doc_log", ("score_log",), """
  SELECT model, uc_type, lang, doc_id, max(source) AS source, round(avg(cer), 6) AS avg_cer,
         round(avg(char_f1), 6) AS avg_char_f1, round(avg(word_f1), 6) AS avg_word_f1,
         round(avg(table_teds_doc), 6) AS avg_table_teds_doc,
         round(avg(table_cell_exact_f1_mean), 6) AS avg_table_cell_exact_f1_mean,
         count(*) AS n_pages, count_if(matched) AS n_matched_pages
  FROM score_log GROUP BY model, uc_type, lang, doc_id""")
cte("bucket_log", ("doc_log",), """
  SELECT model, uc_type, lang, round(avg(avg_cer), 4) AS avg_cer, round(avg(avg_char_f1), 4) AS avg_char_f1,
         round(avg(avg_word_f1), 4) AS avg_word_f1, round(avg(avg_table_teds_doc), 4) AS avg_teds,
         round(avg(avg_table_cell_exact_f1_mean), 4) AS avg_cell_f1, count(*) AS docs
  FROM doc_log GROUP BY model, uc_type, lang""")


def doc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagegauge.operators.rollup import doc_summary
    log = score_log(spark, sf_dir)
    return doc_summary(log, DOC_LOG_METRICS, ("model", "uc_type", "lang", "doc_id"))


def doc_log_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document scores under plain metric names, as the model roll-ups expect them."""
    return doc_log(spark, sf_dir).withColumnsRenamed({
        "avg_cer": "cer", "avg_char_f1": "char_f1", "avg_word_f1": "word_f1",
        "avg_table_teds_doc": "teds", "avg_table_cell_exact_f1_mean": "cell_f1"})


# --- layout blocks from line items ----------------------------------------------------

def _block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    pos = (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 10000000
           + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long"))
    x1 = (F.col("l_partkey") % 70) / 100
    y1 = (F.col("l_suppkey") * 13 % 70) / 100
    return li.select(
        F.col("l_orderkey").alias("page_id"), pos.alias("block_id"), pos.alias("pos"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 0.05 + F.col("l_quantity") / 250).alias("x2"),
        (y1 + 0.10).alias("y2"), "l_discount", "l_partkey", "l_linenumber")


BLOCK_COLS = ("page_id", "block_id", "pos", "x1", "y1", "x2", "y2")


def gt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_rows(spark, sf_dir).where(
        (F.col("l_partkey") + F.col("l_linenumber")) % 13 != 0).select(*BLOCK_COLS)


def pred_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.col("l_discount") / 2
    return _block_rows(spark, sf_dir).where(
        (F.col("l_partkey") + F.col("l_linenumber")) % 11 != 0
    ).withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift}).select(*BLOCK_COLS)


cte("block_rows", (), """
  SELECT l_orderkey AS page_id,
         CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 10000000 + l_suppkey * 100
           + CAST(l_quantity AS BIGINT) AS pos,
         CAST(l_partkey % 70 AS DOUBLE) / 100 AS x1, CAST(l_suppkey * 13 % 70 AS DOUBLE) / 100 AS y1,
         CAST(l_partkey % 70 AS DOUBLE) / 100 + CAST(0.05 AS DOUBLE) + l_quantity / 250 AS x2,
         CAST(l_suppkey * 13 % 70 AS DOUBLE) / 100 + CAST(0.10 AS DOUBLE) AS y2,
         l_discount, (l_partkey + l_linenumber) AS tag
  FROM lineitem""")
cte("gt_blocks", ("block_rows",), "SELECT page_id, pos, x1, y1, x2, y2 FROM block_rows WHERE tag % 13 <> 0")
cte("pred_blocks", ("block_rows",), """
  SELECT page_id, pos, x1 + l_discount / 2 AS x1, y1, x2 + l_discount / 2 AS x2, y2
  FROM block_rows WHERE tag % 11 <> 0""")
cte("block_best", ("gt_blocks", "pred_blocks"), """
  SELECT g.page_id, g.pos AS gt_pos, g.x1, g.y1, g.x2, g.y2, b.pred_pos, coalesce(b.iou, 0.0) AS iou,
         b.px1, b.py1, b.px2, b.py2
  FROM gt_blocks g LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY page_id, gt_pos ORDER BY iou DESC, pred_pos) AS rn FROM (
      SELECT page_id, gt_pos, pred_pos, px1, py1, px2, py2,
             inter / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - inter) AS iou
      FROM (SELECT g.page_id, g.pos AS gt_pos, p.pos AS pred_pos, g.x1, g.y1, g.x2, g.y2,
                   p.x1 AS px1, p.y1 AS py1, p.x2 AS px2, p.y2 AS py2,
                   greatest(0.0, least(g.x2, p.x2) - greatest(g.x1, p.x1))
                   * greatest(0.0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS inter
            FROM gt_blocks g JOIN pred_blocks p USING (page_id)) WHERE inter > 0)
  ) b ON b.page_id = g.page_id AND b.gt_pos = g.pos AND b.rn = 1""")
cte("block_status", ("block_best",), """
  SELECT *, CASE WHEN pred_pos IS NULL THEN 'missed' WHEN iou >= 0.5 THEN 'matched'
                 WHEN ga > 0 AND pa > CAST(1.8 AS DOUBLE) * ga THEN 'over_merged'
                 WHEN pa > 0 AND ga > CAST(1.8 AS DOUBLE) * pa THEN 'split' ELSE 'low_iou' END AS match_status
  FROM (SELECT *, (x2 - x1) * (y2 - y1) AS ga, (px2 - px1) * (py2 - py1) AS pa FROM block_best)""")


# --- tables from pages of text -------------------------------------------------------

def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of four columns per page, written as HTML, and its imperfect copy.

    Row 0 is the header.  The copy swaps letters in the first column and drops
    some rows.
    """
    pages = gt_pages(spark, sf_dir)
    words = F.regexp_extract_all("gt_text", F.lit(r"[A-Za-z0-9À-ÿ]++"), F.lit(0))
    n_rows = F.ceil(F.size("words") / 4).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: F.slice(
        F.col("words"), r * 4 + 1, F.lit(4)))
    header = F.array(*map(F.lit, ("w1", "w2", "w3", "w4")))
    kept = F.filter("gt_rows", lambda row, r: (r == 0) | ((r + F.col("doc_id")) % 11 != 0))
    swapped = F.transform(kept, lambda row: F.concat(
        F.array(F.replace(row[0], F.lit("th"), F.lit("tn"))), F.slice(row, 2, F.size(row))))

    def html(grid: Column) -> Column:
        def row_html(row: Column, tag: str) -> Column:
            return F.concat(F.lit(f"<tr><{tag}>"), F.array_join(row, f"</{tag}><{tag}>"), F.lit(f"</{tag}></tr>"))
        return F.concat(F.lit("<table>"), F.array_join(F.transform(grid, lambda row, r: F.when(
            r == 0, row_html(row, "th")).otherwise(row_html(row, "td"))), ""), F.lit("</table>"))

    split = settle(pages, words=words).where(F.size("words") > 0)
    gt = settle(settle(split, n_rows=n_rows), gt_rows=F.concat(F.array(header), rows))
    return settle(gt, pred_rows=swapped).select(
        "doc_id", "page_num", html(F.col("gt_rows")).alias("gt_html"), html(F.col("pred_rows")).alias("pred_html"))


cte("table_words", ("gt_pages",), """
  SELECT doc_id, page_num, list_filter(
           string_split(regexp_replace(gt_text, '[^A-Za-z0-9À-ÿ]+', ' ', 'g'), ' '), lambda w: w <> '') AS words
  FROM gt_pages""")
cte("gt_cells", ("table_words",), """
  SELECT doc_id, page_num, (k - 1) // 4 + 1 AS row, (k - 1) % 4 AS col, words[k] AS text
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM table_words WHERE len(words) > 0)
  UNION ALL
  SELECT doc_id, page_num, 0, c - 1, 'w' || c
  FROM table_words, range(1, 5) t(c) WHERE len(words) > 0""")
cte("pred_cells", ("gt_cells",), """
  SELECT doc_id, page_num, dense_rank() OVER (PARTITION BY doc_id, page_num ORDER BY row) - 1 AS row, col,
         CASE WHEN col = 0 THEN replace(text, 'th', 'tn') ELSE text END AS text
  FROM gt_cells WHERE row = 0 OR (row + doc_id) % 11 <> 0""")
cte("cell_join", ("gt_cells", "pred_cells"), """
  SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.page_num, p.page_num) AS page_num,
         coalesce(g.row, p.row) AS row, coalesce(g.col, p.col) AS col, g.text AS gt_text, p.text AS pred_text
  FROM gt_cells g FULL JOIN pred_cells p
    ON g.doc_id = p.doc_id AND g.page_num = p.page_num AND g.row = p.row AND g.col = p.col""")


def doc_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables per document, made of facts about its lines, and a reordered copy.

    A document is one row, as in the stored JSON, so its tables need no grouping.
    """
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    header = F.array(*map(F.lit, ("chars", "first", "last")))

    def facts(line: Column) -> Column:
        return F.array(F.length(line).cast("string"), F.regexp_extract(line, "^[^ ]*", 0),
                       F.regexp_extract(line, "[^ ]*$", 0))

    indexed = F.transform(F.split("text", "\n", -1), lambda line, k: F.struct(line.alias("line"), k.alias("k")))
    def third(t: int) -> Column:
        chosen = F.filter(indexed, lambda x: x["k"] % 3 == t)
        return F.concat(F.array(header), F.transform(chosen, lambda x: facts(x["line"])))

    part = [third(t) for t in range(3)]
    swapped = [F.transform(p, lambda row: F.transform(row, lambda c: F.replace(c, F.lit("th"), F.lit("tn")))) for p in part]
    keep = F.when(F.col("doc_id") % 5 == 0, F.array(swapped[2], swapped[1])).otherwise(F.array(*swapped[::-1]))
    return docs.select("doc_id", F.array(*part).alias("gt_grids"), keep.alias("pred_grids"))


# --- Markdown pages --------------------------------------------------------------------

def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines dressed as Markdown blocks, with formulas; and a changed copy."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    marks = F.array(*map(F.lit, ("# ", "- ", "> ", "", "| ", "")))
    plain = F.split(F.regexp_replace("text", r"[#>|$`\\-]", ""), "\n", -1)

    def dress(line: Column, k: Column) -> Column:
        formula = F.when(k % 5 == 0, F.concat(
            F.lit(" $x_{"), F.col("doc_id").cast("string"), F.lit("} + "), (k % 7).cast("string"), F.lit("$"))).otherwise("")
        return F.concat(F.element_at(marks, (k % 6 + 1).cast("int")), line, formula)

    gt = F.array_join(F.transform(plain, dress), "\n")
    pred = F.replace(F.replace(F.col("gt_md"), F.lit("\n> "), F.lit("\n")), F.lit("+ 3$"), F.lit("+ 9$"))
    return docs.withColumn("gt_md", gt).withColumn("pred_md", pred).select("doc_id", "gt_md", "pred_md")


cte("markdown_pages", (), r"""
  SELECT doc_id, gt_md, replace(replace(gt_md, chr(10) || '> ', chr(10)), '+ 3$', '+ 9$') AS pred_md
  FROM (SELECT doc_id, array_to_string(list_transform(lines, lambda line, k:
          ['# ', '- ', '> ', '', '| ', ''][(k - 1) % 6 + 1] || line ||
          CASE WHEN (k - 1) % 5 = 0 THEN ' $x_{' || doc_id || '} + ' || ((k - 1) % 7) || '$' ELSE '' END), chr(10)) AS gt_md
        FROM (SELECT doc_id, string_split(regexp_replace(text, '[#>|$`\\-]', '', 'g'), chr(10)) AS lines
              FROM documents))""")
