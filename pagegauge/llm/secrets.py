"""Secrets in texts and how widely each is copied, in DataFrame functions only.

Kinds are found by patterns, leftmost and without overlap within a kind; spans
are code points, end exclusive.  Positions follow from the gaps that ``split``
leaves between matches.  Each candidate value is hashed, and over the whole
corpus its distinct repositories and owners are counted in steps (owner and
repository, owner, value), so that a value found in a third of all documents is
combined before each exchange.  A value with many owners is a copied example;
one with few owners that looks like a real credential is live-looking.

Defined results: a null text counts as empty and has no spans; equal values in
one document count once for ownership; a null repository or owner counts as
one of its own; rows that repeat an id or have none each get the
spans of their own text and the ownership of those values; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.store import fresh, settled

#: Kind, pattern, group of the value, fewest characters of the value.  Only ``assign`` can match a value that is too
#: short and then hide a later one, so its length is tested after matching; runs of the others end where they end.
BASE_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
MORE_KINDS = (
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}", 0, 20),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
KINDS = BASE_KINDS + MORE_KINDS
#: A text without a match of these has none of the kind; cheaper than the pattern itself.
_HINTS = {"assign": ":=", "access": ["AKIA"], "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "slack": ["xox"],
          "jwt": ["eyJ"], "pem": ["-----BEGIN "]}

#: Owners from which a value counts as widely copied.
MIN_OWNERS = 10
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your|test|xxxx|\\*\\*|12345|abcdef"
MASK = "[secret]"

_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,from:bigint,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """A list in consecutive blocks of about the square root of its length."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, size))


def earlier(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each long of a list, ``plus`` over 0 and all longs before it.

    Blocks first, then inside each block, so that no list grows one by one over all matches of a text.
    """
    def running(items: Column, first: Column) -> Column:
        return F.slice(F.aggregate(items, F.array(first), lambda acc, v: F.concat(
            acc, F.array(plus(F.element_at(acc, -1), v)))), 1, F.size(items))

    zero = F.lit(0).cast("long")

    def joined(blocks: Column) -> Column:
        bases = running(F.transform(blocks, lambda b: F.aggregate(b, zero, plus)), zero)
        return F.flatten(F.zip_with(blocks, bases, running))

    return _let(values, lambda all_values: _let(_blocks(all_values), joined))


def _spans(text: Column, rank: int) -> Column:
    """Spans of one kind; ``from`` is where the value starts (it ends with the match)."""
    kind, pattern, group, fewest = KINDS[rank]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    parts = F.zip_with(F.arrays_zip(matches.alias("m"), values.alias("v")), gaps, lambda p, g: F.struct(
        F.length(g).cast("long").alias("gap"), F.length(p["m"]).cast("long").alias("size"), p["v"].alias("value")))

    def placed(found: Column) -> Column:
        before = earlier(F.transform(found, lambda p: p["gap"] + p["size"]), lambda a, b: a + b)
        return F.zip_with(found, before, lambda p, at: F.struct(
            (at + p["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (at + p["gap"] + p["size"]).alias("end"),
            (at + p["gap"] + p["size"] - F.length(p["value"])).alias("from"), p["value"].alias("value")))

    found = F.filter(_let(parts, placed), lambda s: F.length(s["value"]) >= fewest)
    hints = _HINTS.get(kind)
    present = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in hints]) if hints else text.rlike(pattern)
    return F.when(present, found).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def text_key(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def found_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of the documents but the text, with ``spans`` sorted by start, then kind as listed, and ``text_sha256``."""
    kept = [c for c in docs.columns if c not in (text, "spans", "text_sha256")]
    whole = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
                        text_key(text).alias("text_sha256"))
    kept.append("text_sha256")
    each = whole.select(*kept, *[_spans(F.col("_text"), k).alias(f"_k{k}") for k in range(len(KINDS))])
    return each.select(*kept, F.array_sort(F.concat(*[f"_k{k}" for k in range(len(KINDS))])).alias("spans"))


def ownership(found: DataFrame, repository: str, owner: str, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(value_hash, repositories, owners, class) of every candidate value.

    ``class`` is ``shared`` (many owners), ``live`` (few owners and looks like a
    credential) or ``weak``.
    """
    values = found.select(F.col(repository).alias("repo"), F.col(owner).alias("own"), F.explode("spans").alias("s"))
    rows = values.select("repo", "own", F.sha2("s.value", 256).alias("value_hash"), looks_real(
        F.col("s.value")).alias("real")).distinct()
    by_owner = rows.groupBy("value_hash", "real", "own").agg(F.count("*").alias("repositories"))
    by_value = by_owner.groupBy("value_hash", "real").agg(
        F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    return by_value.select(
        "value_hash", "repositories", "owners",
        F.when(F.col("owners") >= min_owners, "shared").when(F.col("real"), "live").otherwise("weak").alias("class"))


def looks_real(value: Column) -> Column:
    """Neither a placeholder nor a run of few different characters, and with a digit."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (different >= 8) & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, repository: str, owner: str, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(doc_id, hash of the text, spans as an array, live and shared value hashes) of every document."""
    wanted = list(dict.fromkeys(["doc_id", repository, owner, "text"]))
    found = settled(found_in(docs.select(*wanted)), "secrets-found")
    classes = ownership(found, repository, owner, min_owners)
    row = ["doc_id", "text_sha256"]
    own = found.select(*row, F.explode("spans").alias("s")).select(
        *row, F.sha2("s.value", 256).alias("value_hash")).distinct()
    judged = own.join(classes, "value_hash").groupBy(*row).agg(
        *[F.collect_list(F.when(F.col("class") == c, F.col("value_hash"))).alias(c) for c in ("live", "shared")])
    none = F.array().cast("array<string>")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_sha256") == F.col("_own"))
    return found.select(*row, "spans").join(
        judged.withColumnsRenamed({"doc_id": "_doc", "text_sha256": "_own"}), same, "left").select(
        *row, "spans", F.coalesce("live", none).alias("live"), F.coalesce("shared", none).alias("shared"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts and joined spans per document."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank][0]}")

    counts = [count(k) for k in range(len(BASE_KINDS))]
    return scanned.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("shared").cast("long").alias("n_shared"))


def masked(docs: DataFrame, scanned: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents with every secret value replaced by ``mask``, except widely copied examples.

    Spans are met by id and text, so rows that repeat an id or have none get those of their own text.
    """
    taken = F.filter("spans", lambda s: ~F.array_contains("shared", F.sha2(s["value"], 256)))
    doc, own, hit = (fresh(docs, c) for c in ("_doc", "_own", "_hits"))
    hits = scanned.where(F.size("spans") > 0).select(
        F.col("doc_id").alias(doc), F.col("text_sha256").alias(own), F.array_sort(F.transform(taken, lambda s: F.struct(
            s["from"].alias("from"), s["end"].alias("end")))).alias(hit)).where(F.size(hit) > 0).dropDuplicates([doc, own])

    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_key() == F.col(own))
    joined = docs.join(hits, same, "left")
    return joined.withColumn("text", F.when(
        F.col(hit).isNotNull(), _without(F.col("text"), F.col(hit), mask)).otherwise(F.col("text"))).select(docs.columns)


def _without(text: Column, hits: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each of the sorted ``hits``; of overlapping ones (two kinds) only the first has a mask.

    Pieces between hits are cut from a block of the text, not from the whole text each.
    """
    size = F.length(text).cast("long")
    ends = F.concat(F.transform(hits, lambda h: h["end"]), F.array(size))
    pieces = F.zip_with(F.concat(F.transform(hits, lambda h: h["from"]), F.array(size)), earlier(
        ends, lambda a, b: F.greatest(a, b)), lambda stop, at: F.struct(at.alias("at"), stop.alias("stop")))
    kept = F.filter(pieces, lambda p: p["stop"] >= p["at"])

    def cut(block: Column) -> Column:
        first = F.element_at(block, 1)["at"]
        part = F.substring(text, (first + 1).cast("int"), (F.element_at(block, -1)["stop"] - first).cast("int"))
        return _let(part, lambda t: F.array_join(F.transform(block, lambda p: F.substring(
            t, (p["at"] - first + 1).cast("int"), (p["stop"] - p["at"]).cast("int"))), mask))

    return F.array_join(F.transform(_let(kept, _blocks), cut), mask)
