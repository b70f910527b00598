"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook (k-means on
a bounded sample: the ``SAMPLE`` vectors with the smallest hashes).  Every
vector is listed under its pair of centroids.  For a query, pairs are visited
in order of the sum of both squared centroid distances, taken from a heap that
holds one frontier of the two sorted lists (the multi-sequence traversal),
until the visited lists hold ``fraction`` of the index.  What the visited lists
hold is reranked by the exact distance.

Lists are stored by first centroid, in parts of bounded size; a query goes to
each of its first centroids once, with the second centroids to look at there.
Equal vectors: only the smallest ``k + 1`` ids of each can be among any
query's ``k`` nearest, so the others are left out of the lists before the
exchange (they still are queries).

``fraction`` is a share because neighbours of data without structure lie
anywhere: on such data half of the index gives a recall of about 0.95.  Data
with clusters need far less.

Defined results: null, zero and not finite vectors, null ids and vectors of
another length than most take no part; ties go to the smaller id; fewer
candidates than ``k`` give all of them; repeated ids count as one vector each
but never answer their own query; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.store import settled

CENTROIDS, SAMPLE, ROUNDS = 64, 8192, 12
FRACTION = 0.5
#: Vectors in a part of a list, and queries that meet it at a time.
PART, QUERIES = 8192, 1024


def kmeans(data: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    k = min(k, len(data))
    centers = data[np.random.default_rng(5).choice(len(data), k, replace=False)].copy()
    for _ in range(rounds):
        own = distances(data, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, data)
        counts = np.bincount(own, minlength=k)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def visited(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs by rising sum of distances until their lists hold ``wanted`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    listed = sizes[np.ix_(a, b)].tolist()
    heap = [(da[0] + db[0], 0, 0)]
    out, held = [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        if listed[i][j]:
            out.append((int(a[i]), int(b[j])))
            held += listed[i][j]
        # Each pair is pushed once: along a row, and down the first column.
        if j + 1 < len(db):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0")

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = rows.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(
        F.desc("c"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else -1))


def codebooks(rows: DataFrame, centroids: int) -> tuple | None:
    """(mean, scale, codebook of the first half, of the second) of the sample, both in the shifted and scaled space."""
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(b.column("embedding")) for b in batches if b.num_rows]
        book = None
        if parts:
            data = np.concatenate(parts)
            # Distances of vectors far from the origin would cancel, and those of huge ones overflow.
            scale = 2.0 ** int(np.frexp(np.abs(data).max())[1])
            mean = (data / scale).mean(0)
            data, half = data / scale - mean, data.shape[1] // 2
            book = pickle.dumps((mean, scale, kmeans(data[:, :half], centroids), kmeans(data[:, half:], centroids)))
        yield pa.RecordBatch.from_arrays([pa.array([book], pa.binary())], ["book"])

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
    found = sample.repartition(1).mapInArrow(fit, "book binary").head(1)
    return pickle.loads(found[0]["book"]) if found and found[0]["book"] else None


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, fraction: float = FRACTION, centroids: int = CENTROIDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, by Euclidean distance."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    books = codebooks(rows, centroids)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mean, scale, *books = books
    half = books[0].shape[1]
    n_second = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = matrix(batch.column("embedding")) / scale - mean
                yield pa.RecordBatch.from_arrays([
                    *batch.columns, pa.array(distances(data[:, :half], books[0]).argmin(1).astype(np.int32)),
                    pa.array(distances(data[:, half:], books[1]).argmin(1).astype(np.int32))],
                    ["vec_id", "embedding", "first", "second"])

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.withColumn("_k", F.row_number().over(copies)).where(F.col("_k") <= k + 1).drop("_k")
    kind = rows.schema["embedding"].dataType.simpleString()
    index = settled(distinct.mapInArrow(place, f"vec_id long, embedding {kind}, first int, second int"), "multi-index")
    # At most one row per pair of centroids.
    sizes = np.zeros((len(books[0]), n_second), np.int64)
    for r in index.groupBy("first", "second").count().collect():
        sizes[r["first"], r["second"]] = r["count"]
    wanted = max(k + 1, int(np.ceil(fraction * sizes.sum())))
    parts = (sizes.sum(1) // PART + 1).tolist()

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per query, first centroid and part of its list, with the second centroids to look at."""
        for batch in batches:
            if not batch.num_rows:
                continue
            data = matrix(batch.column("embedding")) / scale - mean
            d_first, d_second = distances(data[:, :half], books[0]), distances(data[:, half:], books[1])
            rows_, first_, part_, masks = [], [], [], []
            for q in range(len(data)):
                looks: dict[int, np.ndarray] = {}
                for a, b in visited(d_first[q], d_second[q], sizes, wanted):
                    looks.setdefault(a, np.zeros(n_second, bool))[b] = True
                for a, mask in looks.items():
                    packed = np.packbits(mask).tobytes()
                    for part in range(parts[a]):
                        rows_.append(q)
                        first_.append(a)
                        part_.append(part)
                        masks.append(packed)
            taken = batch.take(pa.array(rows_, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(first_, pa.int32()), pa.array(part_, pa.int32()), pa.array(masks, pa.binary())],
                ["query_id", "query", "block", "first", "part", "looks"])

    asked = rows.where(is_query)
    blocks = asked.count() // QUERIES + 1
    queries = asked.select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    planned = queries.withColumnRenamed("query", "embedding").mapInArrow(
        plan, f"query_id long, query {kind}, block int, first int, part int, looks binary")
    n_parts = F.element_at(F.lit(parts), F.col("first") + 1)
    lists = index.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rerank(key, held, asking):
        return _rerank(held, asking, k, n_second)

    keys = ["first", "part", "block"]
    found = lists.groupBy(*keys).cogroup(planned.groupBy(*keys)).applyInArrow(
        rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _rerank(held: pa.Table, asking: pa.Table, k: int, n_second: int) -> pa.Table:
    out_q, out_v, out_s = [], [], []
    if held.num_rows and asking.num_rows:
        ids, second = held.column("vec_id").to_numpy(), held.column("second").to_numpy()
        data, own = matrix(held.column("embedding")), matrix(asking.column("query"))
        query_ids = asking.column("query_id").to_numpy()
        looks = np.stack([np.unpackbits(np.frombuffer(m, np.uint8), count=n_second).astype(bool)
                          for m in asking.column("looks").to_pylist()])
        # Huge components would overflow when squared; a power of two scales without rounding.
        scale = 2.0 ** max(0, int(np.frexp(max(np.abs(data).max(), np.abs(own).max()))[1]) - 400)
        if scale > 1:
            data, own = data / scale, own / scale
        middle = data.mean(0)
        near_data, near_own = data - middle, own - middle
        norms = (near_data ** 2).sum(1)
        for a in range(0, len(own), 64):
            near = distances(near_own[a:a + 64], near_data)
            # Products round differently from differences: how far, at most, grows with the norms.
            slack = 8 * np.finfo(float).eps * (data.shape[1] + 4) * (norms + (near_own[a:a + 64] ** 2).sum(1)[:, None])
            slack += 8 * np.finfo(float).eps * np.abs(middle).max() * np.sqrt(
                data.shape[1] * (np.maximum(near, 0) + slack))
            near[~looks[a:a + 64][:, second]] = np.inf
            near[query_ids[a:a + 64, None] == ids] = np.inf
            for q in range(len(near)):
                row = near[q]
                if len(row) > k:
                    # Keep whatever may be among the nearest, then measure exactly.
                    at_most = row + slack[q]
                    row = np.where(row - slack[q] <= np.partition(at_most, k - 1)[k - 1], row, np.inf)
                at = np.flatnonzero(np.isfinite(row))
                exact = scale * np.sqrt(((data[at] - own[a + q]) ** 2).sum(1))
                best = np.lexsort((ids[at], exact))[:k]
                out_q += [query_ids[a + q]] * len(best)
                out_v += ids[at][best].tolist()
                out_s += exact[best].tolist()
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                     "score": pa.array(out_s, pa.float64())})
