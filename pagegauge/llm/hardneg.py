"""Hard negatives of anchors by Fagin's threshold algorithm on integer inner products.

Candidates are dealt at random into shards of bounded size.  A shard keeps, for
every dimension, its rows sorted by that component.  For an anchor, sorted
access walks each list from its high end where the anchor's component is
positive and from its low end where it is negative (a zero component adds
nothing); every row met for the first time is scored in full by random access.
The threshold is the score that a row at the present depth of all lists would
have: no unseen row exceeds it.  The walk ends once the threshold lies strictly
below the kth score of every window (strictly, since ties go by id), or below
the window's lower bound, or when no row is unseen.

Two passes: the first finds each anchor's positives (its best rows of the same
label), the second its negatives, one window per positive.  In both, a shard
and the anchors that visit it meet in one partition: the rows come first, the
anchors stream past them, so a task holds one shard and one batch of anchors.
Anchors are sent to every shard (a query set against all rows, in blocks); rows
travel once a pass.  A shard answers with at most ``k`` rows a window, and a
window function merges the answers.

Components become floor(256 * x), saturated to 64 bits.  Scores are exact:
products run in floating point only where every sum fits its 53 bits, and in
Python's integers beyond that (a reported score saturates to 64 bits).

Defined results: rows with a null id, label or vector or with a null or not
finite component take no part; vectors of another length than the anchor's have
no score with it; ties go to the smaller id; fewer rows than asked give all of
them; a window of a negative positive score is empty; rows that repeat an id are
candidates of their own but never answer that id, and as an anchor such an id
stands for its smallest row by label and vector; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.store import settled

#: Components held by a shard on average, and rows below which more shards are not worth their task.
SHARD_COMPONENTS, SHARD_ROWS = 1 << 22, 2048
#: Rows taken from every list at the first step; each further step doubles it.
STEP = 64
_LONG = (1 << 63) - 1


class Shard:
    """Rows of one length: ids, labels, components (rows x dimensions) and the sorted lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        rising = np.argsort(x, axis=0, kind="stable")
        self.rising = np.ascontiguousarray(rising.T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(x, rising, 0).T)
        self.most = int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
        self.as_float = x.astype(np.float64)

    def walk(self, anchor: np.ndarray, wanted: np.ndarray, done: Callable[[int | None, np.ndarray], bool]):
        """(rows, scores) met until ``done(threshold, scores of the wanted rows met)``; only wanted rows count."""
        n = len(self.ids)
        # 100 times a score must fit 64 bits too.
        safe = self.most * sum(map(abs, anchor.tolist())) < 1 << 53
        own = anchor.astype(np.float64) if safe else anchor.astype(object)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        unseen = wanted.copy()
        left = int(unseen.sum())
        rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64 if safe else object)]
        depth, step = 0, STEP
        while left:
            end = min(n, depth + step)
            if end == n or not len(up) + len(down):
                new = np.flatnonzero(unseen)
            else:
                met = np.zeros(n, bool)
                met[self.rising[up, n - end:n - depth]] = True
                met[self.rising[down, depth:end]] = True
                new = np.flatnonzero(met & unseen)
            unseen[new] = False
            left -= len(new)
            rows.append(new)
            if safe:
                scores.append((self.as_float[new] @ own).astype(np.int64))
            else:
                scores.append((self.x[new].astype(object) * own).sum(1).astype(object))
            if not left:
                break
            last = np.concatenate([self.values[up, n - end], self.values[down, end - 1]])
            threshold = sum(a * b for a, b in zip(last.tolist(), anchor[np.concatenate([up, down])].tolist(), strict=True))
            if done(threshold, np.concatenate(scores)):
                break
            depth, step = end, 2 * step
        return np.concatenate(rows), np.concatenate(scores)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the first ``k`` by falling score, then rising id."""
        if len(scores) > k and scores.dtype != object:
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            at = np.arange(len(scores))
        order = sorted(at.tolist(), key=lambda i: (-scores[i], self.ids[rows[i]]))
        return np.array(order[:k], np.int64)

    def positives(self, anchor_id: int, label: str, anchor: np.ndarray, k: int):
        def done(threshold, scores):
            return len(scores) >= k and threshold < _kth(scores, k)

        rows, scores = self.walk(anchor, (self.labels == label) & (self.ids != anchor_id), done)
        at = self.best(rows, scores, k)
        return self.ids[rows[at]], scores[at]

    def negatives(self, anchor_id: int, label: str, anchor: np.ndarray, positives: list[int], k: int, low: int, high: int):
        """For each positive score: (ids, scores) of the best rows of another label inside its window."""
        def inside(scores, p):
            return (100 * scores >= low * p) & (100 * scores <= high * p)

        def done(threshold, scores):
            for p in positives:
                if low * p <= high * p and 100 * threshold >= low * p:
                    held = scores[inside(scores, p)]
                    if len(held) < k or threshold >= _kth(held, k):
                        return False
            return True

        wanted = (self.labels != label) & (self.ids != anchor_id)
        if all(low * p > high * p for p in positives):
            wanted[:] = False
        rows, scores = self.walk(anchor, wanted, done)
        for p in positives:
            held = np.flatnonzero(inside(scores, p).astype(bool))
            at = held[self.best(rows[held], scores[held], k)]
            yield self.ids[rows[at]], scores[at]


def _kth(scores: np.ndarray, k: int) -> int:
    if scores.dtype == object:
        return sorted(scores.tolist())[len(scores) - k]
    return int(np.partition(scores, len(scores) - k)[len(scores) - k])


def _by_length(batches: list[pa.RecordBatch]) -> dict[int, Shard]:
    table = pa.Table.from_batches(batches).combine_chunks()
    lengths = pa.compute.list_value_length(table.column("x")).to_numpy()
    out = {}
    for d in np.unique(lengths).tolist():
        part = table.take(pa.array(np.flatnonzero(lengths == d))).combine_chunks()
        x = pa.compute.list_flatten(part.column("x")).to_numpy().reshape(part.num_rows, d)
        labels = np.array(part.column("label").to_pylist(), object)
        out[d] = Shard(part.column("vec_id").to_numpy(), labels, x)
    return out


def _met(batches: Iterator[pa.RecordBatch], answer: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by shard, its own rows before the anchors: build each shard, answer each anchor."""
    shard, held, lists = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            if shards[a] != shard:
                shard, held, lists = shards[a], [], None
            if kinds[a] == 0:
                held.append(part)
                continue
            if lists is None:
                lists = _by_length(held) if held else {}
                held = []
            columns: list[list] = [[], [], [], []]
            for row in part.to_pylist():
                own = lists.get(len(row["x"]))
                if own is not None:
                    for slot, (ids, scores) in enumerate(answer(own, row)):
                        columns[0] += [row["vec_id"]] * len(ids)
                        columns[1] += [slot] * len(ids)
                        columns[2] += ids.tolist()
                        columns[3] += [max(-_LONG - 1, min(_LONG, int(s))) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.int64())], ["anchor_id", "slot", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows that take part; x holds the integer components."""
    def bad(v: Column) -> Column:
        return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))

    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("_e")).where(
        "vec_id is not null and label is not null and _e is not null").where(~F.exists("_e", bad)).select(
        "vec_id", "label", F.transform("_e", lambda v: F.floor(256 * v)).alias("x"))


def _visits(rows: DataFrame, anchors: DataFrame, shards: int, answer: Callable) -> DataFrame:
    own = rows.select("shard", F.lit(0).alias("kind"), "vec_id", "label", "x",
                      F.lit(None).cast("array<long>").alias("positives"))
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "label",
        "x", "positives")
    both = own.union(asking).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    return both.mapInArrow(lambda batches: _met(batches, answer), "anchor_id long, slot int, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: (vec_id, label, embedding).  Negatives have ``low`` to ``high`` per cent of the positive's score.
    """
    spark = vectors.sparkSession
    size = usable(vectors).agg(F.count("*").alias("n"), F.sum(F.size("x").cast("long")).alias("c")).head()
    shards = max(1, -(-(size["c"] or 0) // SHARD_COMPONENTS),
                 min(2 * spark.sparkContext.defaultParallelism, size["n"] // SHARD_ROWS))
    # Written once, so a shard's rows are the same in both passes and after a lost executor.
    rows = settled(usable(vectors).withColumn("shard", F.floor(F.rand(3) * shards).cast("int")), "hard-rows")
    first = Window.partitionBy("vec_id").orderBy("label", "x")
    anchors = rows.where(is_anchor).withColumn("_k", F.row_number().over(first)).where("_k = 1").select(
        "vec_id", "label", "x")

    def same_label(shard: Shard, row: dict):
        return [shard.positives(row["vec_id"], row["label"], np.array(row["x"], np.int64), positives)]

    found = _visits(rows, anchors.withColumn("positives", F.lit(None).cast("array<long>")), shards, same_label)
    chosen = settled(_ranked(found, positives).select(
        F.col("anchor_id"), (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "hard-positives")
    lists = chosen.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("_p")).select(
        F.col("anchor_id").alias("vec_id"), F.col("_p.positive_score").alias("positives"))

    def other_label(shard: Shard, row: dict):
        return shard.negatives(row["vec_id"], row["label"], np.array(row["x"], np.int64), row["positives"],
                               negatives, low, high)

    answers = _visits(rows, anchors.join(lists, "vec_id"), shards, other_label)
    best = _ranked(answers, negatives).withColumnRenamed("vec_id", "negative_id").withColumnRenamed(
        "score", "negative_score")
    return best.join(chosen, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
