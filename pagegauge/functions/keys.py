"""Document keys, use-case dimensions and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions import arrow, patterns as P


def doc_key(doc_id: Column) -> Column:
    """(uc_type, lang) of ``<uc>_<lang>_<seq>``; NULL when the id does not follow it."""
    parts = F.split(doc_id, "_", -1)
    first, lang = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    valid = (F.size(parts) >= 3) & (first != "") & (lang != "")
    uc = F.when(first == "textlayer", "text_layer").otherwise(first)
    return F.when(valid, F.struct(uc.alias("uc_type"), lang.alias("lang")))


def use_cases(spark: SparkSession) -> DataFrame:
    """The nine use cases; a fixed table, safe to broadcast."""
    rows = [(uc, kind, lang, f"{kind}_{lang}") for uc, kind, lang in P.USE_CASES]
    return spark.createDataFrame(rows, "uc string, uc_type string, lang string, uc_name string")


def with_use_case(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(use_cases(df.sparkSession)), ["uc_type", "lang"], "left")


def lang_label(lang: Column) -> Column:
    pairs = [F.lit(x) for pair in P.LANG_LABELS for x in pair]
    return F.coalesce(F.create_map(*pairs)[lang], lang)


def slug(name: Column) -> Column:
    """ASCII file name: accents folded, other characters to ``_``, known extension kept."""
    folded = name
    for letter, plain in P.SLUG_LETTERS:
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    foreign = folded.rlike(r"[^\x00-\x7F]")
    folded = F.when(foreign, arrow.strip_accents(F.when(foreign, folded))).otherwise(folded)
    lowered = F.lower(folded)
    ending = F.regexp_extract(lowered, r"(?s)^.+(\.[^.]+)$", 1)
    known = ending.isin(*P.DOCUMENT_EXTENSIONS)
    stem = F.when(known, F.substring(lowered, F.lit(1), F.length(lowered) - F.length(ending))).otherwise(lowered)
    stem = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9_-]", "_"), "_+", "_")
    stem = F.regexp_replace(stem, "^_+|_+$", "")
    return F.concat(F.when(stem == "", "doc").otherwise(stem), F.when(known, ending).otherwise(""))
