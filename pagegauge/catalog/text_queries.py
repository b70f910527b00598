"""Text metrics, normalizers and pairing over the document pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagegauge.catalog import fixtures as fx
from pagegauge.catalog.registry import query
from pagegauge.functions import metrics as M, text as X
from pagegauge.functions.exprs import prf, ratio, settle, words
from pagegauge.operators import evidence as E, pairs, scoring
from pagegauge.operators.multiset import paired_multiset_prf
from pagegauge.operators.pairs import PAGE

PAIR = ["model", "doc_id", "page_num"]


def _cer_pages(spark, sf):
    scored = settle(fx.ref_hyp(fx.page_pairs(spark, sf)), d=M.edit_distance(F.col("ref"), F.col("hyp")))
    return scored.select(
        "model", *PAGE, "matched", "d", F.length("ref").alias("n_gt"), F.length("hyp").alias("n_pred"),
        M.error_rate(F.col("d"), F.length("ref")).alias("cer"),
        M.similarity(F.col("d"), F.col("ref"), F.col("hyp")).alias("normalized_edit_similarity"))


@query("cer_page", ("distances",), """
  SELECT model, uc_type, lang, doc_id, page_num, matched, d, n_gt, n_pred,
         round(d / greatest(n_gt, 1), 6) AS cer,
         round(greatest(0.0, 1.0 - d / greatest(n_gt, n_pred, 1)), 6) AS normalized_edit_similarity
  FROM distances""")
def cer_page(spark, sf):
    return _cer_pages(spark, sf).withColumns({
        "cer": F.round("cer", 6), "normalized_edit_similarity": F.round("normalized_edit_similarity", 6)})


@query("pair_coverage", ("page_pairs",), """
  SELECT model, uc_type, lang, doc_id, count(*) AS n_pages, count_if(matched) AS n_matched_pages,
         sum(length(pred_text)) AS pred_chars
  FROM page_pairs GROUP BY ALL""")
def pair_coverage(spark, sf):
    return fx.page_pairs(spark, sf).groupBy("model", "uc_type", "lang", "doc_id").agg(
        F.count("*").alias("n_pages"), F.count_if("matched").alias("n_matched_pages"),
        F.sum(F.length("pred_text")).alias("pred_chars"))


@query("token_errors", ("page_pairs_short",), r"""
  SELECT model, doc_id, page_num, n_tokens, d, round(d / greatest(n_tokens, 1), 6) AS wer FROM (
    SELECT model, doc_id, page_num, len(rt) AS n_tokens,
           CASE WHEN rt = pt THEN 0 ELSE levenshtein(
             array_to_string(list_transform(rt, lambda t: chr(CAST(list_position(vocab, t) AS INT))), ''),
             array_to_string(list_transform(pt, lambda t: chr(CAST(list_position(vocab, t) AS INT))), '')) END AS d
    FROM (SELECT *, list_distinct(list_concat(rt, pt)) AS vocab FROM (
      SELECT *, regexp_extract_all(gt_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS rt,
             regexp_extract_all(pred_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS pt
      FROM page_pairs_short)))""")
def token_errors(spark, sf):
    split = settle(fx.page_pairs(spark, sf, fx.TOKEN_PAGE_CHARS),
                   rt=X.tokens(F.col("gt_text")), pt=X.tokens(F.col("pred_text")))
    scored = settle(split, d=M.token_distance(F.col("rt"), F.col("pt")))
    return scored.select(*PAIR, F.size("rt").alias("n_tokens"), "d",
                         F.round(M.error_rate(F.col("d"), F.size("rt")), 6).alias("wer"))


_WORD_DISTANCE = """
    CASE WHEN {r} = {p} THEN 0 ELSE levenshtein(
      array_to_string(list_transform({r}, lambda t: chr(CAST(list_position({v}, t) AS INT))), ''),
      array_to_string(list_transform({p}, lambda t: chr(CAST(list_position({v}, t) AS INT))), '')) END"""


@query("word_errors", ("page_pairs_short",), r"""
  SELECT model, doc_id, page_num,
         CASE WHEN len(rw) = 0 THEN 0.0 ELSE round(wd / len(rw), 6) END AS wer_ws,
         CASE WHEN len(rf) = 0 THEN 0.0 ELSE round(fd / len(rf), 6) END AS nwer
  FROM (SELECT *, """ + _WORD_DISTANCE.format(r="rw", p="pw", v="vw") + " AS wd, "
       + _WORD_DISTANCE.format(r="rf", p="pf", v="vf") + r""" AS fd
    FROM (SELECT *, list_distinct(list_concat(rw, pw)) AS vw, list_distinct(list_concat(rf, pf)) AS vf FROM (
      SELECT *, list_filter(regexp_split_to_array(gt_text, '\s+'), lambda w: w <> '') AS rw,
             list_filter(regexp_split_to_array(pred_text, '\s+'), lambda w: w <> '') AS pw,
             list_filter(regexp_split_to_array(regexp_replace(lower(gt_text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '') AS rf,
             list_filter(regexp_split_to_array(regexp_replace(lower(pred_text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '') AS pf
      FROM page_pairs_short)))""")
def word_errors(spark, sf):
    scored = scoring.word_error_metrics(fx.ref_hyp(fx.page_pairs(spark, sf, fx.TOKEN_PAGE_CHARS)))
    return scored.select(*PAIR, F.round("wer_ws", 6).alias("wer_ws"), F.round("nwer", 6).alias("nwer"))


@query("word_detail", ("page_pairs_short",), r"""
  SELECT model, doc_id, page_num, len(rw)::INT AS total_words_gt, CASE WHEN len(rw) = 0 THEN 0 ELSE wd END::INT AS errors,
         CASE WHEN len(rw) = 0 THEN 0 ELSE len(rw) - len(pw) END::INT AS surplus
  FROM (SELECT *, """ + _WORD_DISTANCE.format(r="rw", p="pw", v="vw") + r""" AS wd
    FROM (SELECT *, list_distinct(list_concat(rw, pw)) AS vw FROM (
      SELECT *, list_filter(regexp_split_to_array(gt_text, '\s+'), lambda w: w <> '') AS rw,
             list_filter(regexp_split_to_array(pred_text, '\s+'), lambda w: w <> '') AS pw
      FROM page_pairs_short)))""")
def word_detail(spark, sf):
    """What does not depend on the choice among equally good alignments: all errors, deletions less insertions."""
    scored = scoring.word_detail(fx.ref_hyp(fx.page_pairs(spark, sf, fx.TOKEN_PAGE_CHARS)))
    d = F.col("wer_detail")
    return scored.select(
        *PAIR, d["total_words_gt"].alias("total_words_gt"),
        (d["substitutions"] + d["deletions"] + d["insertions"]).alias("errors"),
        (d["deletions"] - d["insertions"]).alias("surplus"))


_CHAR_COUNTS = """
  SELECT model, doc_id, page_num, coalesce(sum(least(r, p)), 0) AS overlap FROM (
    SELECT model, doc_id, page_num, item, count_if(side = 'r') AS r, count_if(side = 'p') AS p FROM (
      SELECT model, doc_id, page_num, 'r' AS side, unnest({ref}) AS item FROM {pairs}
      UNION ALL SELECT model, doc_id, page_num, 'p', unnest({hyp}) FROM {pairs}) WHERE item <> ''
    GROUP BY ALL) GROUP BY ALL"""


@query("char_precision_recall", ("page_pairs",), """
  SELECT model, doc_id, page_num,
         CASE WHEN length(pred_text) = 0 THEN 0.0 ELSE round(coalesce(overlap, 0) / length(pred_text), 6) END AS char_precision,
         CASE WHEN length(gt_text) = 0 THEN 0.0 ELSE round(coalesce(overlap, 0) / length(gt_text), 6) END AS char_recall
  FROM page_pairs LEFT JOIN (""" + _CHAR_COUNTS.format(
    ref="string_split(gt_text, '')", hyp="string_split(pred_text, '')", pairs="page_pairs") + """) USING (model, doc_id, page_num)""")
def char_precision_recall(spark, sf):
    counted = settle(fx.page_pairs(spark, sf), n=M.char_overlap(F.col("gt_text"), F.col("pred_text")))
    return counted.select(
        *PAIR, F.round(ratio(F.col("n"), F.length("pred_text")), 6).alias("char_precision"),
        F.round(ratio(F.col("n"), F.length("gt_text")), 6).alias("char_recall"))


_F1 = """
  SELECT model, doc_id, page_num, CASE WHEN nr = 0 AND np = 0 THEN 1.0 WHEN nr = 0 OR np = 0 OR o = 0 THEN 0.0
         ELSE round(2.0 * (o / np) * (o / nr) / (o / np + o / nr), 6) END AS {name}
  FROM (SELECT model, doc_id, page_num, CAST(coalesce(overlap, 0) AS DOUBLE) AS o, {nr} AS nr, {np} AS np
        FROM page_pairs LEFT JOIN ({counts}) USING (model, doc_id, page_num))"""
_TOK = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


@query("char_f1", ("page_pairs",), _F1.format(
    name="char_f1", nr="length(gt_text)", np="length(pred_text)",
    counts=_CHAR_COUNTS.format(ref="string_split(gt_text, '')", hyp="string_split(pred_text, '')", pairs="page_pairs")))
def char_f1(spark, sf):
    counted = settle(fx.page_pairs(spark, sf), n=M.char_overlap(F.col("gt_text"), F.col("pred_text")))
    score = prf(F.col("n"), F.length("gt_text"), F.length("pred_text"))
    return counted.select(*PAIR, F.round(score["f1"], 6).alias("char_f1"))


@query("word_f1", ("page_pairs",), _F1.format(
    name="word_f1", nr="len(" + _TOK.format("gt_text") + ")", np="len(" + _TOK.format("pred_text") + ")",
    counts=_CHAR_COUNTS.format(ref=_TOK.format("gt_text"), hyp=_TOK.format("pred_text"), pairs="page_pairs")))
def word_f1(spark, sf):
    split = settle(fx.page_pairs(spark, sf), rt=X.tokens(F.col("gt_text")), pt=X.tokens(F.col("pred_text")))
    counted = settle(split, n=M.item_overlap(F.col("rt"), F.col("pt")))
    return counted.select(*PAIR, F.round(prf(F.col("n"), F.size("rt"), F.size("pt"))["f1"], 6).alias("word_f1"))


@query("vocabulary_prf", ("page_pairs",), r"""
  SELECT model, lang, uc_type, sum(least(r, p)) AS overlap, sum(r) AS n_ref, sum(p) AS n_pred,
         round(sum(least(r, p)) / sum(p), 6) AS precision, round(sum(least(r, p)) / sum(r), 6) AS recall
  FROM (SELECT model, lang, uc_type, item, count_if(side = 'r') AS r, count_if(side = 'p') AS p FROM (
      SELECT model, lang, uc_type, 'r' AS side, unnest(""" + _TOK.format("gt_text") + r""") AS item FROM page_pairs
      UNION ALL SELECT model, lang, uc_type, 'p', unnest(""" + _TOK.format("pred_text") + r""") FROM page_pairs) GROUP BY ALL)
  GROUP BY ALL""")
def vocabulary_prf(spark, sf):
    keys = ["model", "lang", "uc_type"]
    return paired_multiset_prf(fx.page_pairs(spark, sf), keys, "gt_text", "pred_text", X.tokens).select(
        *keys, "overlap", "n_ref", "n_pred", F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"))


# --- normalizers --------------------------------------------------------------------

@query("norm_whitespace", (), r"""
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents WHERE NOT regexp_matches(text, '&(#|[A-Za-z])')
  UNION ALL
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) FROM documents WHERE regexp_matches(text, '&(#|[A-Za-z])')""")
def norm_whitespace(spark, sf):
    return fx.texts(spark, sf, "documents").select("doc_id", X.normalize_space(F.col("text")).alias("norm"))


@query("norm_cell", (), r"""
  SELECT doc_id, trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(text,
           '<[^>]+>', ' ', 'g'), '\*\*|__|\*|_|`', '', 'g'), '\\([|])', '\1', 'g'), '×✓✗✘х', 'XXXXx'), '\s+', ' ', 'g')) AS norm
  FROM documents""")
def norm_cell(spark, sf):
    return fx.texts(spark, sf, "documents").select("doc_id", X.normalize_cell(F.col("text")).alias("norm"))


@query("norm_folded", (), r"""
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS norm
  FROM documents""")
def norm_folded(spark, sf):
    return fx.texts(spark, sf, "documents").select("doc_id", X.fold_words(F.col("text")).alias("norm"))


@query("norm_nfc", (), """
  SELECT page_id, nfc_normalize(url) AS norm_url, length(nfc_normalize(html)) AS n_chars FROM pages""")
def norm_nfc(spark, sf):
    pages = fx.texts(spark, sf, "pages")
    return pages.select(
        "page_id", X.compose(F.replace("url", F.lit("&"), F.lit("\x01"))).alias("u"),
        F.replace("html", F.lit("&"), F.lit("\x01")).alias("h"),
    ).select("page_id", F.replace("u", F.lit("\x01"), F.lit("&")).alias("norm_url"),
             F.length(X.compose(F.col("h"))).alias("n_chars"))


@query("norm_symbols", (), r"""
  SELECT doc_id, translate(regexp_replace(regexp_replace(regexp_replace(text,
           '[\x{2010}-\x{2015}\x{2212}\x{fe58}\x{fe63}\x{ff0d}]', '-', 'g'), '[\x{ff0f}\x{ff3c}]', '/', 'g'),
           '[\x{2022}\x{00b7}\x{2219}\x{22c5}\x{2027}]', ' ', 'g'), '×х', 'xx') AS norm FROM documents""")
def norm_symbols(spark, sf):
    return fx.texts(spark, sf, "documents").select("doc_id", X.unify_symbols(F.col("text")).alias("norm"))


@query("norm_html", (), r"""
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?i)<img\b[^>]*>', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)[^\n]*', ' ', 'g'),
      '(?i)<\s*br\s*/?\s*>', ' ', 'g'), '(?i)</\s*(p|div|tr|li|h[1-6]|table|section)\s*>', ' ', 'g'),
      '(?i)<\s*(p|div|tr|li|h[1-6]|table|section)\b[^>]*>', ' ', 'g'),
      '(?i)</?\s*(b|strong|i|em|u|span|font|code|sup|sub)\b[^>]*>', '', 'g'), '<[^>]+>', ' ', 'g') AS norm
  FROM pages""")
def norm_html(spark, sf):
    return fx.texts(spark, sf, "pages").select("page_id", X.drop_html(X.drop_images(F.col("html"))).alias("norm"))


@query("norm_tables_flat", ("markdown_pages",), r"""
  SELECT doc_id, coalesce(string_agg(flat, chr(10) ORDER BY k), '') AS norm FROM (
    SELECT doc_id, k, CASE WHEN contains(line, '|') THEN array_to_string(list_filter(list_transform(
             string_split(trim(line, '|'), '|'), lambda c: trim(c)), lambda c: c <> '' AND NOT regexp_full_match(c, ':?-{3,}:?')), ' ')
           ELSE line END AS flat, line
    FROM (SELECT doc_id, k, trim(lines[k]) AS line FROM (
      SELECT doc_id, string_split(gt_md, chr(10)) AS lines, unnest(range(1, len(string_split(gt_md, chr(10))) + 1)) AS k
      FROM markdown_pages)) WHERE line <> '')
  WHERE NOT (contains(line, '|') AND flat = '') GROUP BY doc_id
  UNION ALL SELECT doc_id, '' FROM markdown_pages WHERE NOT regexp_matches(gt_md, '[^\s|]')""")
def norm_tables_flat(spark, sf):
    return fx.markdown_pages(spark, sf).select("doc_id", X.flatten_pipe_tables(F.col("gt_md")).alias("norm"))


@query("norm_latex", ("markdown_pages",), r"""
  SELECT doc_id, regexp_replace(regexp_replace(trim(gt_md), '\\(left|right)\s*', '', 'g'), '\s+', '', 'g') AS norm
  FROM markdown_pages""")
def norm_latex(spark, sf):
    return fx.markdown_pages(spark, sf).select("doc_id", X.normalize_latex(F.col("gt_md")).alias("norm"))


@query("norm_plain", (), r"""
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'),
    '[`*_>#~-]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM documents""")
def norm_plain(spark, sf):
    return fx.texts(spark, sf, "documents").select("doc_id", X.markdown_to_plain(F.col("text")).alias("norm"))


# --- evidence, structure, formulas ----------------------------------------------------

@query("vocab_diff", ("page_pairs",), r"""
  SELECT model, doc_id, page_num,
         array_to_string(list_sort(list_filter(rw, lambda w: NOT list_contains(pw, w)))[1:20], ' ') AS deleted,
         array_to_string(list_sort(list_filter(pw, lambda w: NOT list_contains(rw, w)))[1:20], ' ') AS inserted
  FROM (SELECT model, doc_id, page_num,
               list_distinct(list_filter(regexp_split_to_array(gt_text, '\s+'), lambda w: w <> '')) AS rw,
               list_distinct(list_filter(regexp_split_to_array(pred_text, '\s+'), lambda w: w <> '')) AS pw
        FROM page_pairs)""")
def vocab_diff(spark, sf):
    diff = E.vocabulary_diff(F.col("gt_text"), F.col("pred_text"))
    return fx.page_pairs(spark, sf).withColumn("v", diff).select(
        *PAIR, F.array_join("v.deleted", " ").alias("deleted"), F.array_join("v.inserted", " ").alias("inserted"))


_KIND = r"""CASE WHEN t = '' THEN NULL
      WHEN regexp_matches(t, '^#{1,6}[ \t]') THEN 'heading' || length(regexp_extract(t, '^(#{1,6})[ \t]', 1))
      WHEN regexp_matches(t, '^[-*+][ \t]+') THEN 'list/item' WHEN regexp_matches(t, '^[0-9]+[.)][ \t]+') THEN 'ordered/item'
      WHEN t LIKE '>%' THEN 'quote' WHEN t LIKE '|%' THEN 'table/row' ELSE 'paragraph' END"""


@query("structure_prf", ("markdown_pages",), f"""
  SELECT doc_id, sum(least(r, p)) AS overlap, sum(r) AS n_ref, sum(p) AS n_pred FROM (
    SELECT doc_id, path, count_if(side = 'r') AS r, count_if(side = 'p') AS p FROM (
      SELECT doc_id, side, {_KIND} AS path FROM (
        SELECT doc_id, 'r' AS side, trim(unnest(string_split(gt_md, chr(10)))) AS t FROM markdown_pages
        UNION ALL SELECT doc_id, 'p', trim(unnest(string_split(pred_md, chr(10)))) FROM markdown_pages))
    WHERE path IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def structure_prf(spark, sf):
    paths = settle(fx.markdown_pages(spark, sf), r=M.structure_paths(F.col("gt_md")), p=M.structure_paths(F.col("pred_md")))
    counted = settle(paths, overlap=M.item_overlap(F.col("r"), F.col("p")))
    return counted.where((F.size("r") > 0) | (F.size("p") > 0)).select(
        "doc_id", "overlap", F.size("r").alias("n_ref"), F.size("p").alias("n_pred"))


_FORMULAS = r"""list_transform(regexp_extract_all({}, '\$([^$]+?)\$', 1), lambda f: regexp_replace(f, '\s+', '', 'g'))"""


@query("formula_prf", ("markdown_pages",), """
  SELECT doc_id, nr AS ref_formula_count, np AS pred_formula_count,
         CASE WHEN nr = 0 AND np = 0 THEN 1.0 WHEN nr = 0 OR np = 0 OR o = 0 THEN 0.0
              ELSE round(2.0 * (o / np) * (o / nr) / (o / np + o / nr), 6) END AS formula_exact_f1
  FROM (SELECT doc_id, len(rf) AS nr, len(pf) AS np, CAST(coalesce(overlap, 0) AS DOUBLE) AS o
        FROM (SELECT doc_id, """ + _FORMULAS.format("gt_md") + " AS rf, " + _FORMULAS.format("pred_md") + """ AS pf FROM markdown_pages)
        LEFT JOIN (SELECT doc_id, sum(least(r, p)) AS overlap FROM (
          SELECT doc_id, f, count_if(s = 'r') AS r, count_if(s = 'p') AS p FROM (
            SELECT doc_id, 'r' AS s, unnest(""" + _FORMULAS.format("gt_md") + """) AS f FROM markdown_pages UNION ALL
            SELECT doc_id, 'p', unnest(""" + _FORMULAS.format("pred_md") + """) FROM markdown_pages) GROUP BY ALL) GROUP BY ALL) USING (doc_id))""")
def formula_prf(spark, sf):
    found = settle(fx.markdown_pages(spark, sf), r=M.formulas(F.col("gt_md")), p=M.formulas(F.col("pred_md")))
    counted = settle(found, n=M.item_overlap(F.col("r"), F.col("p")))
    return counted.select(
        "doc_id", F.size("r").alias("ref_formula_count"), F.size("p").alias("pred_formula_count"),
        F.round(prf(F.col("n"), F.size("r"), F.size("p"))["f1"], 6).alias("formula_exact_f1"))


@query("formula_best", ("markdown_pages",), """
  SELECT doc_id, CASE WHEN nr = 0 AND np = 0 THEN 1.0 WHEN nr = 0 OR np = 0 THEN 0.0 ELSE round(best, 6) END AS mean_best
  FROM (SELECT doc_id, len(rf) AS nr, len(pf) AS np FROM (
          SELECT doc_id, """ + _FORMULAS.format("gt_md") + " AS rf, " + _FORMULAS.format("pred_md") + """ AS pf FROM markdown_pages))
  LEFT JOIN (SELECT doc_id, avg(best) AS best FROM (
      SELECT doc_id, k, max(1.0 - levenshtein(f, g) / greatest(length(f), length(g), 1)) AS best FROM (
        SELECT doc_id, k, rf[k] AS f, unnest(list_distinct(pf)) AS g FROM (
          SELECT doc_id, rf, pf, unnest(range(1, len(rf) + 1)) AS k FROM (
            SELECT doc_id, """ + _FORMULAS.format("gt_md") + " AS rf, " + _FORMULAS.format("pred_md") + """ AS pf FROM markdown_pages)))
      GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""")
def formula_best(spark, sf):
    found = settle(fx.markdown_pages(spark, sf), r=M.formulas(F.col("gt_md")), p=M.formulas(F.col("pred_md")))
    return found.select("doc_id", F.round(M.best_formula_similarity(F.col("r"), F.col("p")), 6).alias("mean_best"))


# --- page files ---------------------------------------------------------------------------

@query("page_rebase", ("gt_pages",), r"""
  SELECT stem, page_num, file_index, n_chars FROM (
    SELECT stem, file_index - min(file_index) OVER (PARTITION BY stem) + 1 AS page_num, file_index, n_chars,
           row_number() OVER (PARTITION BY stem, file_index ORDER BY name) AS rn
    FROM (SELECT regexp_extract(name, '^(.+?)_(\d+)\.md$', 1) AS stem,
                 CAST(regexp_extract(name, '^(.+?)_(\d+)\.md$', 2) AS INT) AS file_index, name, n_chars
          FROM (SELECT uc_type || '_' || lang || '_' || doc_id || '_' || (page_num + doc_id % 5) || '.md' AS name,
                       length(gt_text) AS n_chars FROM gt_pages
                UNION ALL SELECT uc_type || '_' || lang || '_' || doc_id || '_0' || (page_num + doc_id % 5) || '.md', 0
                FROM gt_pages WHERE page_num % 2 = 1))) WHERE rn = 1""")
def page_rebase(spark, sf):
    from pagegauge.sources.markdown import number_uploaded_pages
    pages = fx.gt_pages(spark, sf)
    at = (F.col("page_num") + F.col("doc_id") % 5).cast("string")
    stem = F.concat_ws("_", "uc_type", "lang", F.col("doc_id").cast("string"))
    files = pages.select(
        F.concat(stem, F.lit("_"), at, F.lit(".md")).alias("file_name"), F.length("gt_text").alias("n_chars")
    ).unionByName(pages.where(F.col("page_num") % 2 == 1).select(
        F.concat(stem, F.lit("_0"), at, F.lit(".md")).alias("file_name"), F.lit(0).alias("n_chars")))
    return number_uploaded_pages(files).select(F.col("doc_id").alias("stem"), "page_num", "file_index", "n_chars")


@query("skip_done", ("gt_pages", "pred_pages"), """
  SELECT g.doc_id, g.page_num FROM gt_pages g
  WHERE NOT EXISTS (SELECT 1 FROM pred_pages p WHERE p.model = 'm_drop' AND p.doc_id = g.doc_id AND p.page_num = g.page_num)""")
def skip_done(spark, sf):
    done = fx.pred_pages(spark, sf).where(F.col("model") == "m_drop")
    return pairs.not_done(fx.gt_pages(spark, sf), done, PAGE).select("doc_id", "page_num")


# --- no SQL counterpart: full normalizer and alignments -----------------------------------

_SHORT_F1 = _F1.replace("FROM page_pairs LEFT", "FROM page_pairs_short LEFT")


@query("mixed_pages", ("page_pairs_short",), r"""
  SELECT model, doc_id, page_num, CASE WHEN some_text THEN round(d / greatest(length(gt_text), 1), 6) END AS cer,
         CASE WHEN some_text THEN round(wd / greatest(len(rt), 1), 6) END AS wer,
         CASE WHEN some_text THEN round(greatest(0.0, 1.0 - d / greatest(length(gt_text), length(pred_text), 1)), 6) END
           AS normalized_edit_similarity,
         CASE WHEN some_text THEN char_f1 END AS char_f1, CASE WHEN some_text THEN word_f1 END AS word_f1,
         CASE WHEN page_num % 2 = 0 THEN CASE WHEN page_num % 4 = 0 THEN 0.0 ELSE 1.0 END END AS table_teds_doc,
         CASE WHEN page_num % 2 = 0 THEN 1 END AS ref_table_count, CASE WHEN page_num % 2 = 0 THEN (page_num % 4) // 2 END::INT AS pred_table_count
  FROM (SELECT *, gt_text <> '' OR pred_text <> '' AS some_text,
               CASE WHEN gt_text = pred_text THEN 0 ELSE levenshtein(""" + fx.one_byte("gt_text") + ", " + fx.one_byte("pred_text") + """) END AS d,
               """ + _WORD_DISTANCE.format(r="rt", p="pt", v="vocab") + r""" AS wd
        FROM (SELECT *, list_distinct(list_concat(rt, pt)) AS vocab FROM (
          SELECT *, """ + _TOK.format("gt_text") + " AS rt, " + _TOK.format("pred_text") + " AS pt FROM page_pairs_short)))\n  JOIN ("
       + _SHORT_F1.format(
           name="char_f1", nr="length(gt_text)", np="length(pred_text)", counts=_CHAR_COUNTS.format(
               ref="string_split(gt_text, '')", hyp="string_split(pred_text, '')", pairs="page_pairs_short"))
       + ") USING (model, doc_id, page_num) JOIN (" + _SHORT_F1.format(
           name="word_f1", nr="len(" + _TOK.format("gt_text") + ")", np="len(" + _TOK.format("pred_text") + ")",
           counts=_CHAR_COUNTS.format(ref=_TOK.format("gt_text"), hyp=_TOK.format("pred_text"), pairs="page_pairs_short"))
       + ") USING (model, doc_id, page_num)")
def mixed_pages(spark, sf):
    """Pages with text and tables scored together; every second page has a table, every fourth lost it."""
    pairs = fx.ref_hyp(fx.page_pairs(spark, sf, fx.TOKEN_PAGE_CHARS))
    html = F.concat(F.lit("<table><tr><th>page</th></tr><tr><td>"), F.col("page_num").cast("string"), F.lit("</td></tr></table>"))
    own = F.array(F.struct(F.lit(1).alias("table_id"), html.alias("html")))
    none = F.array().cast("array<struct<table_id:int,html:string>>")
    tables = pairs.withColumns({
        "gt_text": F.col("ref"), "pred_text": F.col("hyp"),
        "gt_tables": F.when(F.col("page_num") % 2 == 0, own).otherwise(none),
        "pred_tables": F.when(F.col("page_num") % 4 == 2, own).otherwise(none)})
    scored = scoring.score_pages(tables)
    numbers = ("cer", "wer", "normalized_edit_similarity", "char_f1", "word_f1", "table_teds_doc")
    return scored.select(*PAIR, *[F.round(c, 6).alias(c) for c in numbers], "ref_table_count", "pred_table_count")


@query("incremental_scores", ("page_pairs_short",), """
  SELECT model, doc_id, page_num, CASE WHEN gt_text <> '' OR pred_text <> '' THEN round(d / greatest(length(gt_text), 1), 6) END AS cer,
         CASE WHEN page_num % 3 = 0 THEN '1' ELSE '2' END AS formula_version
  FROM (SELECT *, CASE WHEN gt_text = pred_text THEN 0 ELSE levenshtein(""" + fx.one_byte("gt_text") + ", " + fx.one_byte("pred_text") + """) END AS d
        FROM page_pairs_short WHERE matched)""")
def incremental_scores(spark, sf):
    """The body of the scoring stream on three batches: a first one, a replayed one, and the rest under new formulas."""
    from pagegauge.operators.ordering import durable
    from pagegauge.sources.results import read_scores
    from pagegauge.streaming.incremental import score_batch

    pairs = fx.ref_hyp(fx.page_pairs(spark, sf, fx.TOKEN_PAGE_CHARS)).withColumn("doc_id", F.col("doc_id").cast("string"))
    none = F.array().cast("array<struct<table_id:int,html:string>>")
    keys = ["uc_type", "lang", "doc_id", "page_num"]
    gt = durable(pairs.where("model = 'm_exact'").select(*keys, "ref", F.col("ref").alias("gt_text"), none.alias("gt_tables")))
    pages = durable(pairs.where("matched").select(
        "model", *keys, "hyp", F.col("hyp").alias("pred_text"), none.alias("pred_tables"), F.lit(1).alias("received_at")))
    path = f"{spark.sparkContext.getCheckpointDir()}/incremental-{uuid.uuid4().hex}"
    first, rest = pages.where("page_num % 3 = 0"), pages.where("page_num % 3 <> 0")
    for batch, version in ((first, "1"), (first, "1"), (rest, "2")):
        score_batch(batch, gt, path, version)
    return read_scores(spark, path).select(
        "model", F.col("doc_id").cast("long").alias("doc_id"), "page_num", F.round("cer", 6).alias("cer"), "formula_version")


@query("norm_full", (), r"""
  SELECT doc_id, array_to_string(list_transform(words, lambda w, k: CASE (k - 1) % 10
           WHEN 4 THEN w || ' &' WHEN 7 THEN 'https://a.b/' || w WHEN 8 THEN w || chr(233) ELSE w END), ' ')
           || CASE WHEN len(words) % 10 = 6 THEN ' ' ELSE '' END AS text -- a run of dots at the end leaves a blank
  FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS words
        FROM documents)""")
def norm_full(spark, sf):
    """The full normalizer on whole texts dressed word by word; the SQL has the words as they must come out."""
    docs = fx.texts(spark, sf, "documents").select("doc_id", F.filter(
        F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " ", -1), lambda w: w != "").alias("words"))
    lit = F.lit

    def dress(w, k):
        forms = (
            F.concat(lit("\n## <p>"), w, lit("</p>")), F.concat(lit("**"), w, lit("**")), F.concat(lit("<b>"), w, lit("</b>")),
            F.concat(lit("["), w, lit("](http://u.v/"), w, lit(")")), F.concat(w, lit(" &amp;")), F.concat(w, lit(" .. . .")),
            F.concat(lit("`"), w, lit("`")), F.concat(lit("<https://a.b/"), w, lit(">")), F.concat(w, lit("e\u0301")),
            F.concat(w, lit("\u200b <img src='x'>\n|---|---|\n")))
        out = forms[9]
        for n in range(8, -1, -1):
            out = F.when(k % 10 == n, forms[n]).otherwise(out)
        return out

    dressed = settle(docs, dressed=F.array_join(F.transform("words", dress), " "))
    return dressed.select("doc_id", X.normalize_text(F.col("dressed")).alias("text"))


@query("text_bundle")
def text_bundle(spark, sf):
    """The five text metrics after the full normalizer."""
    scored = scoring.text_metrics(fx.normalized_pairs(spark, sf))
    return scored.select(*PAIR, *[F.round(c, 6).alias(c) for c in (
        "cer", "wer", "normalized_edit_similarity", "char_f1", "word_f1")])


@query("scan_pages")
def scan_pages(spark, sf):
    scored = scoring.score_scan(fx.normalized_pairs(spark, sf), detail=True)
    return scored.select(
        *PAIR, "cer", "cer_detail.*", *[F.round(c, 6).alias(c) for c in (
            "wer_ws", "nwer", "char_precision", "char_recall")])


@query("char_alignment", ("distances",), """
  SELECT model, doc_id, page_num, d AS n_errors, n_pred - n_gt AS surplus FROM distances WHERE n_gt > 0""")
def char_alignment(spark, sf):
    """Edit steps per page; the SQL checks the tie-free totals."""
    aligned = scoring.align_chars(fx.ref_hyp(fx.page_pairs(spark, sf))).where(F.col("ref") != "")
    d = F.col("cer_detail")
    return aligned.select(
        *PAIR, (d["substitutions"] + d["deletions"] + d["insertions"]).alias("n_errors"),
        (d["insertions"] - d["deletions"]).alias("surplus"))


@query("confusions")
def confusions(spark, sf):
    aligned = scoring.align_chars(fx.ref_hyp(fx.page_pairs(spark, sf)))
    return scoring.confusions(scoring.alignments(aligned, ["model", "doc_id", "page_num"]), ["model"])


@query("pcs_pages")
def pcs_pages(spark, sf):
    scored = scoring.score_punctuation(fx.normalized_pairs(spark, sf))
    return scored.select(*PAIR, "punct_miou", "cap_miou", "pcs")


@query("reading_order")
def reading_order(spark, sf):
    split = settle(fx.markdown_pages(spark, sf), r=X.sentences(F.col("gt_md")), p=X.sentences(F.col("pred_md")))
    scored = settle(split, s=M.reading_order(F.col("r"), F.col("p")))
    return scored.select("doc_id", F.round("s", 6).alias("reading_order_lcs"))


@query("evidence_pages")
def evidence_pages(spark, sf):
    scored = scoring.text_metrics(fx.normalized_pairs(spark, sf))
    typed = scored.withColumns({"n_gt_tables": F.lit(0), "n_pred_tables": F.lit(0)})
    return E.evidence(E.diff_pages(typed)).select(
        *PAIR, "ins_word_count", "del_word_count", "size_ratio", "has_table", "figure_mentions",
        "inserted_chunks", "deleted_chunks", "candidate_signals")


@query("markdown_bundle")
def markdown_bundle(spark, sf):
    return scoring.score_markdown(fx.markdown_pages(spark, sf), "gt_md", "pred_md").drop("gt_md", "pred_md")


@query("content_filter")
def content_filter(spark, sf):
    filtered = settle(fx.texts(spark, sf, "pages"), kept=X.filter_content(F.col("html")))
    return filtered.select("page_id", X.normalize_text(F.col("kept")).alias("text"))


@query("page_flags", (), r"""
  SELECT page_id, regexp_matches(html, '(?i)<table\b') AS has_table, regexp_matches(html, '(?i)\bfigure\b') AS figure_mentions,
         length(substring(html, 1, 400)) AS preview_chars FROM pages""")
def page_flags(spark, sf):
    html = F.col("html")
    return fx.texts(spark, sf, "pages").select(
        "page_id", E.has_table(html).alias("has_table"), E.mentions_figure(html).alias("figure_mentions"),
        F.length(F.substring(html, 1, E.PREVIEW)).alias("preview_chars"))


@query("signals", (), """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',',
    CASE WHEN r > 1.3 AND i > d * 1.5 THEN 'over_generation' END, CASE WHEN r < 0.65 AND d > i * 1.5 THEN 'omission' END,
    CASE WHEN g > 0 AND NOT t AND p = 0 THEN 'flattened_tables' END, CASE WHEN f AND i > 10 THEN 'figure_text' END,
    CASE WHEN s > 0.80 AND c > 0.25 AND r > 0.85 AND r < 1.2 THEN 'reading_order' END) AS signals
  FROM (SELECT *, l_quantity / 25 AS r, l_partkey % 30 AS i, l_suppkey % 30 AS d, l_linenumber % 3 AS g, l_partkey % 2 AS p,
               l_suppkey % 2 = 0 AS t, l_partkey % 3 = 0 AS f, l_discount * 5 AS c, 1 - l_tax AS s FROM lineitem)""")
def signals(spark, sf):
    c = F.col
    found = E.signals(
        c("l_quantity") / 25, c("l_partkey") % 30, c("l_suppkey") % 30, c("l_linenumber") % 3, c("l_partkey") % 2,
        c("l_suppkey") % 2 == 0, c("l_partkey") % 3 == 0, c("l_discount") * 5, 1 - c("l_tax"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(found, ",").alias("signals"))


@query("scoring_text", ("gt_cells", "table_words"), """
  SELECT doc_id, page_num, 'prose ' || doc_id || chr(10) || 'w1 w2 w3 w4 ' || array_to_string(words, ' ') AS scoring_text
  FROM table_words WHERE len(words) > 0""")
def scoring_text(spark, sf):
    from pagegauge.functions import grids as G
    html = F.col("gt_html")
    one = F.array(F.struct(F.lit(1).alias("table_id"), html.alias("html"), F.when(
        F.col("page_num") % 2 == 0, G.html_cells(html)).otherwise(F.array().cast(G.CELLS)).alias("cells")))
    pages = settle(fx.table_pages(spark, sf), tables=one)
    prose = F.concat(F.lit("prose "), F.col("doc_id").cast("string"))
    return pages.select("doc_id", "page_num", X.scoring_text(prose, F.col("tables")).alias("scoring_text"))


@query("pcs_summary")
def pcs_summary(spark, sf):
    from pagegauge.operators.rollup import overall_micro
    return overall_micro(pcs_pages(spark, sf), ("pcs", "punct_miou", "cap_miou"))
