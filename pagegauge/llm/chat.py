"""Reply trees as conversations, in DataFrame functions only.

Messages name their parent.  Paths from root to leaf are enumerated by joins of
the table with itself, doubling the distance each time: after ``k`` rounds the
ancestors of every leaf up to distance ``2**k`` are known, so a thread of 400
turns takes 9 rounds.  Only ids take part.  Branches are ranked by the mean score of their
messages; texts are joined once, to the chosen paths, and each of those
becomes one formatted conversation with a loss mask over assistant texts.

Template: ``<|im_start|>role\\n text <|im_end|>\\n`` per turn (without the
blanks).  Control strings of this and other common templates inside a text get
one more backslash after their first character, those that already have some
as well, so that taking one away restores the text.  In roles, ``%`` and line
feeds are percent-encoded.

Defined results: a null text or role is empty; a message whose parent is
missing is a root; messages on a cycle belong to no path; equal scores rank by
leaf id; a null tree id is a tree of its own; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.store import settled

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"
#: Stands for a null tree id inside this module.
_NO_TREE = -(1 << 63)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def role_escaped(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def role_unescaped(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def linear(turns: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows by turn as reply trees without branches: each message answers the one before it.

    Numbers come from sorting by conversation and turn over all tasks, so a conversation with a third of all rows
    is shared by many of them.  Equal turns follow by role and text.
    """
    from pagegauge.operators.ordering import number_within

    rows = turns.select(
        F.coalesce(F.col(tree).cast("long"), F.lit(_NO_TREE)).alias("tree_id"), F.col(turn).alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = number_within(
        rows, ["tree_id"], [F.col("_turn").asc_nulls_first(), F.col("role"), F.col("text")], "msg_id")
    return numbered.select(
        "tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
        F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double").alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf, msg_id, up): every message on the path of every leaf; ``up`` is its distance from the leaf."""
    ids = settled(messages.select("tree_id", "msg_id", "parent_id"), "chat-ids")
    nodes = ids.select("tree_id", F.col("msg_id").alias("parent_id"))
    jumps = settled(ids.where("parent_id is not null").join(nodes, ["tree_id", "parent_id"]).select(
        "tree_id", "msg_id", F.col("parent_id").alias("to")).distinct(), "chat-jumps")
    inner = jumps.select("tree_id", F.col("to").alias("msg_id"))
    leaves = ids.join(inner, ["tree_id", "msg_id"], "left_anti").select("tree_id", "msg_id").distinct()
    found = leaves.select("tree_id", F.col("msg_id").alias("leaf"), "msg_id", F.lit(0).cast("long").alias("up"))
    total, reach = ids.count(), 1
    while reach <= 2 * total and not jumps.isEmpty():
        further = found.join(jumps, ["tree_id", "msg_id"]).select(
            "tree_id", "leaf", F.col("to").alias("msg_id"), (F.col("up") + reach).alias("up"))
        found = settled(found.union(further), "chat-paths")
        next_jumps = jumps.select("tree_id", F.col("msg_id").alias("_from"), F.col("to").alias("msg_id"))
        jumps = settled(next_jumps.join(jumps, ["tree_id", "msg_id"]).select(
            "tree_id", F.col("_from").alias("msg_id"), "to"), "chat-jumps")
        reach *= 2
    if reach > 2 * total:
        # What can still jump further than there are messages hangs below a cycle.
        endless = jumps.select("tree_id", F.col("msg_id").alias("leaf")).distinct()
        found = found.join(endless, ["tree_id", "leaf"], "left_anti")
    return found


def ranked(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Messages of the best ``branches`` paths of each tree (all, if None), with ``leaf`` and ``rank``.

    The best few of a tree are found first within parts of its leaves, then among those, so that a tree with very
    many leaves is ranked by many tasks.
    """
    on_path = paths(messages)
    scores = messages.select("tree_id", "msg_id", "score")
    scored = on_path.join(scores, ["tree_id", "msg_id"]).groupBy("tree_id", "leaf").agg(F.avg("score").alias("mean_score"))
    best = [F.col("mean_score").desc_nulls_last(), F.col("leaf")]
    if branches is not None:
        part = Window.partitionBy("tree_id", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(*best)
        scored = scored.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= branches).drop("_r")
        rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(*best))
        scored = scored.withColumn("rank", rank).where(F.col("rank") <= branches)
    else:
        from pagegauge.operators.ordering import number_within

        scored = number_within(scored, ["tree_id"], best, "rank")
    return on_path.join(scored, ["tree_id", "leaf"]).join(messages, ["tree_id", "msg_id"])


def formatted(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf, rank, mean_score, formatted, loss): one conversation per chosen path.

    ``loss`` lists the assistant texts as (start, length) in code points of ``formatted``.
    """
    turns = messages.select(
        "tree_id", "leaf", "rank", "mean_score", "up", F.col("role") == "assistant",
        F.concat(F.lit(OPEN), role_escaped(F.col("role")), F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body")).toDF("tree_id", "leaf", "rank", "mean_score", "up", "learn", "head", "body")
    in_order = Window.partitionBy("tree_id", "leaf").orderBy(F.col("up").desc())
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = turns.withColumn("_n", size.cast("long")).withColumn(
        "_end", F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct(
        (-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "learn",
        (F.col("_end") - F.col("_n") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))))
    whole = placed.groupBy("tree_id", "leaf", "rank", "mean_score").agg(parts.alias("_p"))
    return whole.select(
        F.when(F.col("tree_id") != _NO_TREE, F.col("tree_id")).alias("tree_id"), "leaf", "rank", "mean_score",
        F.array_join("_p.turn", "").alias("formatted"),
        F.transform(F.filter("_p", lambda p: p["learn"]), lambda p: F.struct(p["start"], p["length"])).alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns and learnt texts as they stand in the output: (conv_id, n_turns, turns_sha256, loss_*, formatted_chars)."""
    turns = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda t: t != "")
    body = F.transform(turns, lambda t: F.substring(t, len(OPEN) + 1, 2 ** 31 - 1))
    pairs = F.transform(body, lambda t: F.concat(
        role_unescaped(F.substring_index(t, "\n", 1)), F.lit("\n"),
        unescaped(F.substr(t, F.locate("\n", t) + 1)), F.lit("\n")))
    learnt = F.transform("loss", lambda s: unescaped(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return conversations.select(
        F.col("tree_id").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(pairs, ""), 256).alias("turns_sha256"), F.array_join(learnt, "").alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
