"""Page scores: text, layout text and mixed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions import arrow, grids as G, metrics as M, text as X
from pagegauge.functions.exprs import f1, prf, ratio, settle, words


def normalize_pairs(
    pairs: DataFrame, gt: str = "gt_text", pred: str = "pred_text"
) -> DataFrame:
    """Add ``ref`` and ``hyp``: both sides after the full text normalizer."""
    return settle(pairs, ref=X.normalize_text(F.col(gt)), hyp=X.normalize_text(F.col(pred)))


def normalize_side(pages: DataFrame, text: str, name: str) -> DataFrame:
    """Replace a page text by its normalized form; cheaper before pairing than after.

    A plain projection, so that joins on keys alone prune it.
    """
    return pages.withColumn(name, X.normalize_text(F.col(text))).drop(text)


def text_metrics(pairs: DataFrame) -> DataFrame:
    """Character and token metrics of ``ref`` and ``hyp``; one Arrow pass, no shuffle."""
    ref, hyp = F.col("ref"), F.col("hyp")
    split = settle(pairs, _ref_tokens=X.tokens(ref), _hyp_tokens=X.tokens(hyp))
    ref_tokens, hyp_tokens = F.col("_ref_tokens"), F.col("_hyp_tokens")
    counted = settle(
        split,
        _chars=M.edit_distance(ref, hyp), _tokens=M.token_distance(ref_tokens, hyp_tokens),
        _char_overlap=M.char_overlap(ref, hyp), _token_overlap=M.item_overlap(ref_tokens, hyp_tokens))
    return counted.withColumns({
        "cer": M.error_rate(F.col("_chars"), F.length(ref)),
        "wer": M.error_rate(F.col("_tokens"), F.size(ref_tokens)),
        "normalized_edit_similarity": M.similarity(F.col("_chars"), ref, hyp),
        "char_f1": prf(F.col("_char_overlap"), F.length(ref), F.length(hyp))["f1"],
        "word_f1": prf(F.col("_token_overlap"), F.size(ref_tokens), F.size(hyp_tokens))["f1"],
    }).drop("_ref_tokens", "_hyp_tokens", "_chars", "_tokens", "_char_overlap", "_token_overlap")


def step_counts(steps: Column) -> Column:
    """Substitutions, deletions and insertions of an alignment."""
    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter(steps, lambda s: s["kind"] == kind)), F.lit(0))
    return F.struct(
        count("substitution").alias("substitutions"),
        count("deletion").alias("deletions"), count("insertion").alias("insertions"))


def char_steps(ref: Column, hyp: Column) -> Column:
    """Character alignment where the two sides differ, NULL elsewhere."""
    differs = (ref != hyp) & (ref != "")
    return arrow.char_alignment(F.when(differs, ref), F.when(differs, hyp))


def align_chars(pairs: DataFrame) -> DataFrame:
    """Add ``char_steps`` and ``cer_detail``; an empty reference counts nothing."""
    ref, hyp = F.col("ref"), F.col("hyp")
    aligned = settle(pairs, char_steps=char_steps(ref, hyp))
    counts = step_counts(F.col("char_steps"))
    return aligned.withColumn("cer_detail", F.struct(
        *[counts[k].alias(k) for k in ("substitutions", "deletions", "insertions")],
        F.length(ref).alias("total_chars_gt")))


def alignments(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Child table of non-matching characters; the missing side of a step is ``-``."""
    step = aligned.select(*keys, "ref", "hyp", F.posexplode("char_steps").alias("step_no", "step"))

    def char(side: str, pos: str) -> Column:
        at = F.col(f"step.{pos}")
        return F.when(at < 0, "-").otherwise(F.substring(F.col(side), at + 1, F.lit(1)))

    return step.select(
        *keys, "step_no", char("ref", "gt_pos").alias("gt"), char("hyp", "pred_pos").alias("pred"),
        F.col("step.kind").alias("type"))


def confusions(alignment_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Which character became which, and how often."""
    return alignment_rows.groupBy(*keys, "gt", "pred", "type").agg(F.count("*").alias("n"))


def word_error_metrics(pairs: DataFrame) -> DataFrame:
    """Whitespace-word error rate, the same after folding, and character precision/recall."""
    ref, hyp = F.col("ref"), F.col("hyp")
    split = settle(
        pairs, _rw=words(ref), _hw=words(hyp),
        _rf=words(X.fold_words(ref)), _hf=words(X.fold_words(hyp)))
    counted = settle(
        split,
        _wd=M.token_distance(F.col("_rw"), F.col("_hw")),
        _fd=M.token_distance(F.col("_rf"), F.col("_hf")),
        _co=M.char_overlap(ref, hyp))
    return counted.withColumns({
        "wer_ws": M.error_rate_or_zero(F.col("_wd"), F.size("_rw")),
        "nwer": M.error_rate_or_zero(F.col("_fd"), F.size("_rf")),
        "char_precision": ratio(F.col("_co"), F.length(hyp)),
        "char_recall": ratio(F.col("_co"), F.length(ref)),
    }).drop("_rw", "_hw", "_rf", "_hf", "_wd", "_fd", "_co")


def word_detail(pairs: DataFrame) -> DataFrame:
    """Add ``wer_detail`` and the aligned words it came from."""
    ref, hyp = F.col("ref"), F.col("hyp")
    aligned = settle(pairs, aligned=M.aligned_words(ref, hyp))
    counts = step_counts(F.col("aligned"))
    empty = F.size(words(ref)) == 0
    return aligned.withColumn("wer_detail", F.struct(
        *[F.when(empty, 0).otherwise(counts[k]).alias(k)
          for k in ("substitutions", "deletions", "insertions")],
        F.size(words(ref)).alias("total_words_gt")))


def char_errors(pairs: DataFrame) -> DataFrame:
    """Add what ``align_chars`` adds and the ``cer`` of its steps."""
    ref, d = F.col("ref"), F.col("cer_detail")
    total = F.when(ref == "", 0).otherwise(d["substitutions"] + d["deletions"] + d["insertions"])
    return align_chars(pairs).withColumn("cer", F.round(M.error_rate_or_zero(total, F.length(ref)), 6))


def score_scan(pairs: DataFrame, detail: bool = True) -> DataFrame:
    """Scan page evaluation over ``ref`` and ``hyp``."""
    ref = F.col("ref")
    scored = word_error_metrics(pairs)
    if detail:
        return char_errors(scored)
    scored = settle(scored, _chars=M.edit_distance(ref, F.col("hyp")))
    return scored.withColumn("cer", M.error_rate_or_zero(F.col("_chars"), F.length(ref))).drop("_chars")


def score_punctuation(pairs: DataFrame) -> DataFrame:
    """Punctuation and capitalization agreement (PCS) over aligned words; only pairs that differ are looked at."""
    ref, hyp = F.col("ref"), F.col("hyp")
    changes = F.filter("aligned", lambda w: w["kind"] != "match") if "aligned" in pairs.columns else M.word_changes(ref, hyp)
    changed = settle(pairs, _changes=changes)
    counted = settle(
        settle(changed, _marks=M.mark_counts(ref, F.col("_changes"))),
        per_punct=M.mark_ious(F.col("_marks")), cap_detail=M.capital_counts(ref, F.col("_changes"))).drop("_marks", "_changes")
    both_empty = (F.trim(ref) == "") & (F.trim(hyp) == "")
    scored = counted.withColumns({
        "punct_miou": M.mean_mark_iou(F.col("per_punct")),
        "cap_miou": M.capital_iou(F.col("cap_detail"), both_empty),
    })
    return scored.withColumn("pcs", F.round((F.col("punct_miou") + F.col("cap_miou")) / 2, 6))


def score_tables(pairs: DataFrame, ref: str = "gt_grids", pred: str = "pred_grids") -> DataFrame:
    """Table bundle per row from two columns of grids."""
    r, p = F.col(ref), F.col(pred)
    matched = settle(pairs, table_matches=G.match_grids(r, p))
    return matched.withColumns(G.page_metrics(r, p, F.col("table_matches")))


def page_html(tables: Column) -> Column:
    """Table HTML of a page as one pseudo page."""
    html = F.filter(F.transform(tables, lambda t: t["html"]), lambda h: F.coalesce(X.strip(h), F.lit("")) != "")
    return F.array_join(F.coalesce(html, F.array().cast("array<string>")), "\n\n")


def with_grids(read: DataFrame) -> DataFrame:
    """Both sides' grids and the first error, from two columns of read tables."""
    return read.withColumns({
        "gt_grids": F.col("_gr.grids"), "pred_grids": F.col("_pr.grids"),
        "error": F.coalesce("_gr.error", "_pr.error")}).drop("_gr", "_pr")


def score_pages(pairs: DataFrame) -> DataFrame:
    """Mixed page evaluation over gt/pred text and tables.

    Text metrics exist only where either text is non-empty, table metrics only
    where either side has a table; elsewhere they stay NULL so that means skip
    them.  Tables that cannot be read leave an ``error`` and NULL table metrics.
    Expects ``gt_text``, ``pred_text``, ``gt_tables``, ``pred_tables``.
    """
    texts = pairs if {"ref", "hyp"} <= set(pairs.columns) else normalize_pairs(pairs)
    grids = with_grids(settle(
        texts, _gr=G.read_html(page_html(F.col("gt_tables"))), _pr=G.read_html(page_html(F.col("pred_tables")))))
    scored = score_tables(text_metrics(grids))
    some_text = (F.coalesce("gt_text", F.lit("")) != "") | (F.coalesce("pred_text", F.lit("")) != "")
    some_table = (F.coalesce(F.size("gt_tables"), F.lit(0)) > 0) | (
        F.coalesce(F.size("pred_tables"), F.lit(0)) > 0)
    text_cols = ["cer", "wer", "normalized_edit_similarity", "char_f1", "word_f1"]
    table_cols = [c for c in scored.columns if c.startswith("table_") and c != "table_matches"]
    table_cols += ["ref_table_count", "pred_table_count"]
    return scored.withColumns({
        **{c: F.when(some_text, F.col(c)) for c in text_cols},
        **{c: F.when(some_table & F.col("error").isNull(), F.col(c)) for c in table_cols},
    }).drop("gt_grids", "pred_grids", "table_matches", "ref", "hyp")


def score_markdown(pairs: DataFrame, gt: str = "gt_text", pred: str = "pred_text") -> DataFrame:
    """Everything measurable on two raw Markdown pages: text, structure, order, tables, formulas.

    Tables that cannot be read leave an ``error`` and NULL table metrics.
    """
    g, p = F.col(gt), F.col(pred)
    texts = text_metrics(normalize_pairs(pairs, gt, pred)).withColumns(
        {"ref_text_len": F.length("ref"), "pred_text_len": F.length("hyp")})
    parsed = with_grids(settle(
        texts,
        _r=M.structure(g), _p=M.structure(p),
        _ro=X.sentences(g), _po=X.sentences(p),
        _rf=M.formulas(g), _pf=M.formulas(p),
        _gr=G.read_page(g), _pr=G.read_page(p))).withColumns({
            "_rs": F.col("_r.paths"), "_ps": F.col("_p.paths"), "_rst": F.col("_r.texts"), "_pst": F.col("_p.texts")}).drop("_r", "_p")
    counted = settle(
        score_tables(parsed),
        _so=M.item_overlap(F.col("_rs"), F.col("_ps")), _sto=M.item_overlap(F.col("_rst"), F.col("_pst")),
        _fo=M.item_overlap(F.col("_rf"), F.col("_pf")),
        reading_order_lcs=M.reading_order(F.col("_ro"), F.col("_po")))
    struct = prf(F.col("_so"), F.size("_rs"), F.size("_ps"))
    struct_text = prf(F.col("_sto"), F.size("_rst"), F.size("_pst"))
    return counted.withColumns({
        **{f"ast_struct_{k}": struct[k] for k in ("precision", "recall", "f1")},
        **{f"ast_struct_text_{k}": struct_text[k] for k in ("precision", "recall", "f1")},
        **M.formula_metrics(F.col("_rf"), F.col("_pf"), F.col("_fo")),
    }).drop(
        "_rs", "_ps", "_rst", "_pst", "_ro", "_po", "_rf", "_pf", "_so", "_sto", "_fo",
        "gt_grids", "pred_grids", "table_matches", "ref", "hyp")


__all__ = [
    "align_chars", "alignments", "char_errors", "char_steps", "confusions", "f1", "normalize_pairs", "page_html",
    "score_markdown", "score_pages", "score_punctuation", "score_scan", "score_tables",
    "step_counts", "text_metrics", "word_detail", "word_error_metrics",
]
