"""Small expression helpers shared by the column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A fold over nothing: its finish gets the value.  Taking the element of a one-element ``transform`` would derive the
    type of the whole body again for every value, at each level of nesting.
    """
    return F.aggregate(F.array(), value, lambda kept, _: kept, body)


def plain_space(text: Column) -> Column:
    """Blank for every horizontal space, vertical tab for every rare line separator."""
    return F.translate(
        text, P.OTHER_SPACES + P.OTHER_BREAKS,
        " " * len(P.OTHER_SPACES) + "\x0b" * len(P.OTHER_BREAKS))


def contains_any(text: Column, chars: str | list[str]) -> Column:
    """Byte search for single characters (or listed strings), far cheaper than a character class."""
    found = F.contains(text, F.lit(chars[0]))
    for char in chars[1:]:
        found = found | F.contains(text, F.lit(char))
    return found


def where_present(text: Column, chars: str | list[str], body: Callable[[Column], Column], high: bool = False) -> Column:
    """Apply ``body`` only to texts that contain one of ``chars`` (or, if ``high``, a rare code point)."""
    def gate(t: Column) -> Column:
        hit = contains_any(t, chars)
        if high:
            # Equal byte and character counts mean ASCII: nothing to look for.
            hit = hit | ((F.octet_length(t) != F.length(t)) & t.rlike(P.HIGH))
        return F.when(hit, body(t)).otherwise(t)
    return let(text, gate)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def single_spaces(text: Column) -> Column:
    """One blank for every run of white space; single blanks, most of all runs, are left as they are."""
    return F.regexp_replace(text, r"\s{2,}+|[^\S ]", " ")


def collapse(text: Column) -> Column:
    return strip(single_spaces(text))


def lines(text: Column) -> Column:
    return F.split(text, P.LINE_BREAK, -1)


def words(text: Column) -> Column:
    """Whitespace-separated words; blank text gives an empty array."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def sub(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def list_where(condition: Column, value: Column, kind: str = "array<string>") -> Column:
    """A list for an Arrow function, empty where it is not needed.

    NULL lists must not follow each other by the thousand: Spark asks for the size of the batch after every row, and
    the list column then passes over all NULLs since the last list again.
    """
    return F.when(condition, value).otherwise(F.array().cast(kind))


def ratio(num: Column, den: Column, empty: Column | float = 0.0) -> Column:
    """``num / den`` as a double; ``empty`` when ``den`` is zero."""
    empty = empty if isinstance(empty, Column) else F.lit(float(empty))
    return F.when(den == 0, empty).otherwise(num.cast("double") / den.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(
        2 * precision * recall / (precision + recall)
    )


def prf(overlap: Column, n_ref: Column, n_pred: Column) -> Column:
    """Multiset precision/recall/F1; both sides empty scores 1, one empty scores 0."""
    precision = ratio(overlap, n_pred, F.when(n_ref == 0, 1.0).otherwise(0.0))
    recall = ratio(overlap, n_ref, F.when(n_pred == 0, 1.0).otherwise(0.0))
    return F.struct(
        precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1")
    )


def settle(df, **columns: Column):
    """Add columns in a step of their own.

    The one-element generator keeps the optimizer from inlining the
    expressions into later Arrow functions, so each is computed once per row.
    """
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(fields)))
