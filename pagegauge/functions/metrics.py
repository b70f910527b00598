"""Text, formula and structure metrics as column expressions over one row per pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions import arrow, patterns as P, text as X
from pagegauge.functions.exprs import let, list_where, prf, ratio, words

SHORT = 48  # longest side for which the JVM edit distance is the cheaper one


def edit_distance(ref: Column, pred: Column) -> Column:
    """Character edit distance; equal pairs are free, long pairs go to the Arrow kernel."""
    long = (ref != pred) & (F.greatest(F.length(ref), F.length(pred)) > SHORT)
    return (
        F.when(ref == pred, F.lit(0))
        .when(long, arrow.char_distance(F.when(long, ref), F.when(long, pred)))
        .otherwise(F.levenshtein(ref, pred))
        .cast("long")
    )


def short_distance(ref: Column, pred: Column) -> Column:
    """JVM-only edit distance, for cells and formulas and inside array functions."""
    return F.when(ref == pred, F.lit(0)).otherwise(F.levenshtein(ref, pred))


def similarity(distance: Column, ref: Column, pred: Column) -> Column:
    longest = F.greatest(F.length(ref), F.length(pred), F.lit(1))
    return F.greatest(F.lit(0.0), 1.0 - distance / longest)


def edit_similarity(ref: Column, pred: Column) -> Column:
    return similarity(short_distance(ref, pred), ref, pred)


def error_rate(distance: Column, n_ref: Column) -> Column:
    """Distance over reference length, with an empty reference counted as one symbol."""
    return distance / F.greatest(n_ref, F.lit(1))


def error_rate_or_zero(distance: Column, n_ref: Column) -> Column:
    """Distance over reference length; an empty reference scores 0."""
    return ratio(distance, n_ref)


def token_distance(ref: Column, pred: Column) -> Column:
    differs = ref != pred
    return F.coalesce(
        arrow.token_distance(list_where(differs, ref), list_where(differs, pred)), F.lit(0)).cast("long")


def char_overlap(ref: Column, pred: Column) -> Column:
    differs = ref != pred
    return F.coalesce(
        arrow.char_overlap(F.when(differs, ref), F.when(differs, pred)), F.length(ref)).cast("long")


def item_overlap(ref: Column, pred: Column) -> Column:
    """Multiset intersection size of two arrays."""
    differs = ref != pred
    found = arrow.item_overlap(list_where(differs, ref), list_where(differs, pred))
    return F.when(differs, found).otherwise(F.size(ref)).cast("long")


# --- punctuation and capitalization ------------------------------------------------

def aligned_words(ref: Column, pred: Column) -> Column:
    """Word pairs in order; equal texts align to themselves without Python."""
    differs = ref != pred
    same = F.transform(words(ref), lambda w: F.struct(
        F.lit("match").alias("kind"), w.alias("gt"), w.alias("pred")))
    found = arrow.word_alignment(list_where(differs, words(ref)), list_where(differs, words(pred)))
    return F.when(differs, found).otherwise(same)


def word_changes(ref: Column, pred: Column) -> Column:
    """The word pairs of ``aligned_words`` that differ."""
    differs = ref != pred
    found = arrow.word_changes(list_where(differs, words(ref)), list_where(differs, words(pred)))
    return F.when(differs, found).otherwise(F.array().cast("array<struct<kind:string,gt:string,pred:string>>"))


def mark_counts(ref: Column, changes: Column) -> Column:
    """True/false positives and misses of every punctuation mark over aligned words.

    Words that match agree in everything, so what is missed or added is in the changes, and what is left of the marked
    words of the reference agrees.
    """
    def has(side: Column, mark: str) -> Column:
        return F.coalesce(F.contains(side, F.lit(mark)), F.lit(False))

    def one(marked: Column, mark: str) -> Column:
        def count(keep) -> Column:
            return F.size(F.filter(marked, keep))

        held = F.when(~F.contains(ref, F.lit(mark)), 0).otherwise(F.regexp_count(ref, F.lit(rf"[{mark}]\S*+")))
        return let(count(lambda w: has(w["gt"], mark) & ~has(w["pred"], mark)), lambda missed: F.struct(
            F.lit(mark).alias("mark"), (held - missed).alias("tp"),
            count(lambda w: ~has(w["gt"], mark) & has(w["pred"], mark)).alias("fp"), missed.alias("fn")))

    def counts(marked: Column) -> Column:
        return F.array(*[one(marked, mark) for mark in P.PUNCTUATION_MARKS])

    any_mark = "[" + "".join(P.PUNCTUATION_MARKS) + "]"
    return let(F.filter(changes, lambda w: (
        F.coalesce(w["gt"].rlike(any_mark), F.lit(False))
        | F.coalesce(w["pred"].rlike(any_mark), F.lit(False)))), counts)


def mark_ious(counts: Column) -> Column:
    """Per-mark IoU over the marks present on either side."""
    seen = F.filter(counts, lambda c: c["tp"] + c["fp"] + c["fn"] > 0)
    return F.map_from_entries(F.transform(seen, lambda c: F.struct(
        c["mark"], F.round(c["tp"] / (c["tp"] + c["fp"] + c["fn"]), 6))))


def mean_mark_iou(ious: Column) -> Column:
    values = F.map_values(ious)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.round(F.when(F.size(values) == 0, 1.0).otherwise(total / F.size(values)), 6)


def capital_counts(ref: Column, changes: Column) -> Column:
    """Capitalization agreement over aligned words, counted like the marks."""
    def capital(side: Column) -> Column:
        return F.coalesce(side.rlike(r"^\p{Lu}"), F.lit(False))

    flags = F.transform(changes, lambda w: F.struct(capital(w["gt"]).alias("r"), capital(w["pred"]).alias("p")))
    held = F.regexp_count(ref, F.lit(P.CAPITAL_WORD))
    return let(flags, lambda flags: let(F.size(F.filter(flags, lambda f: f["r"] & ~f["p"])), lambda missed: F.struct(
        (held - missed).alias("tp"),
        F.size(F.filter(flags, lambda f: ~f["r"] & f["p"])).alias("fp"), missed.alias("fn"))))


def capital_iou(counts: Column, both_empty: Column) -> Column:
    total = counts["tp"] + counts["fp"] + counts["fn"]
    return F.round(F.when(both_empty, 1.0).otherwise(ratio(counts["tp"], total)), 6)


# --- reading order and structure -----------------------------------------------------

def reading_order(ref_sentences: Column, pred_sentences: Column) -> Column:
    """LCS of the sentence sequences over the reference length."""
    empty = (F.size(ref_sentences) == 0) & (F.size(pred_sentences) == 0)
    return F.when(empty, 1.0).otherwise(
        arrow.lcs_length(ref_sentences, pred_sentences) / F.greatest(F.size(ref_sentences), F.lit(1)))


def block_kind(line: Column) -> Column:
    """Markdown block kind of one line, outside fences."""
    stripped = F.trim(line)
    heading = F.regexp_extract(stripped, "^(#{1,6})[ \t]", 1)
    return (
        F.when(stripped == "", None)
        .when(F.length(heading) > 0, F.concat(F.lit("heading"), F.length(heading).cast("string")))
        .when(stripped.rlike(r"^[-*+][ \t]+"), "list/item")
        .when(stripped.rlike(r"^[0-9]+[.)][ \t]+"), "ordered/item")
        .when(stripped.startswith(">"), "quote")
        .when(stripped.startswith("|"), "table/row")
        .otherwise("paragraph")
    )


def structure(markdown: Column) -> Column:
    """``paths`` of the Markdown blocks of a page and ``texts``, the paths followed by those of blocks with their text.

    Fenced lines belong to the fence.  Both come from one reading of the lines.
    """
    fenced = F.regexp_replace(markdown, P.FENCED_BLOCK, "\n\x02\n")
    body = F.transform(F.split(fenced, "\n", -1), lambda x: F.struct(
        F.when(x == "\x02", F.lit("fence")).otherwise(block_kind(x)).alias("path"),
        F.trim(F.regexp_replace(x, r"^[ \t]*(#{1,6}[ \t]+|[-*+][ \t]+|[0-9]+[.)][ \t]+|>+)", "")).alias("text")))

    def listed(kept: Column) -> Column:
        paths = F.transform(kept, lambda b: b["path"])
        texts = F.filter(kept, lambda b: (b["path"] != "fence") & (b["text"] != ""))
        return F.struct(paths.alias("paths"), F.concat(paths, F.transform(
            texts, lambda b: F.concat(b["path"], F.lit("::TEXT::"), b["text"]))).alias("texts"))

    return let(F.filter(body, lambda b: b["path"].isNotNull()), listed)


def structure_paths(markdown: Column, with_text: bool = False) -> Column:
    """Nesting paths of the Markdown blocks of a page; fenced lines belong to the fence."""
    return structure(markdown)["texts" if with_text else "paths"]


# --- formulas --------------------------------------------------------------------------

def formulas(markdown: Column) -> Column:
    """Normalized formulas found by each delimiter pair in turn."""
    text = X.unescape(markdown)

    def clean(body: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(
            X.strip(X.unescape_basic(body)), P.LATEX_SIZING, ""), r"\s+", "")

    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in P.FORMULAS])
    return F.filter(F.transform(found, clean), lambda f: f != "")


def best_formula_similarity(ref: Column, pred: Column) -> Column:
    """Mean over reference formulas of the best similarity to any predicted one.

    Stays inside the row: one page's formulas never leave it.  An exact partner
    ends the search; of the others, those whose lengths differ by more than the
    best so far allows are passed over, and distances are followed only as far
    as they could still be better.
    """
    def best(formula: Column, choices: Column) -> Column:
        size = F.length(formula)

        def nearer(acc: Column, other: Column) -> Column:
            longest = F.greatest(size, other["size"])
            room = F.floor((1.0 - acc) * longest).cast("int")
            distance = F.call_function("levenshtein", formula, other["text"], room)
            # -1 (farther than that) turns into a large number.
            return F.when(F.abs(size - other["size"]) > room, acc).otherwise(
                F.greatest(acc, 1.0 - distance.bitwiseAND(F.lit(0x7FFFFFFF)) / longest))

        others = F.aggregate(choices, F.lit(0.0), nearer)
        return F.when(F.exists(choices, lambda c: c["text"] == formula), 1.0).otherwise(others)

    sized = F.transform(F.array_distinct(pred), lambda p: F.struct(F.length(p).alias("size"), p.alias("text")))
    total = let(sized, lambda choices: F.aggregate(
        F.transform(ref, lambda f: best(f, choices)), F.lit(0.0), lambda acc, v: acc + v))
    return (
        F.when((F.size(ref) == 0) & (F.size(pred) == 0), 1.0)
        .when((F.size(ref) == 0) | (F.size(pred) == 0), 0.0)
        .otherwise(total / F.size(ref))
    )


def formula_metrics(ref: Column, pred: Column, overlap: Column) -> dict[str, Column]:
    scores = prf(overlap, F.size(ref), F.size(pred))
    return {
        "ref_formula_count": F.size(ref),
        "pred_formula_count": F.size(pred),
        "formula_exact_precision": scores["precision"],
        "formula_exact_recall": scores["recall"],
        "formula_exact_f1": scores["f1"],
        "formula_best_edit_similarity_mean": best_formula_similarity(ref, pred),
    }


# --- bands ---------------------------------------------------------------------------

def upload_band(value: Column, lower_better: bool = True) -> Column:
    if lower_better:
        good, fair = value < 0.05, value <= 0.15
    else:
        good, fair = value > 0.9, value > 0.7
    return F.when(value.isNull(), "none").when(good, "good").when(fair, "fair").otherwise("poor")


def card_band(value: Column, lower_better: bool = False) -> Column:
    if lower_better:
        good, fair = value < 0.05, value < 0.15
    else:
        good, fair = value > 0.85, value > 0.60
    return F.when(value.isNull(), "none").when(good, "good").when(fair, "fair").otherwise("poor")


def percent(value: Column) -> Column:
    return F.round(value * 100, 1)
