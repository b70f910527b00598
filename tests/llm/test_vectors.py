"""Whitening and hard negatives against numpy and brute force."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegauge.llm import hardneg, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, score double, x string, index int, slot int"
DATA = Path("/root/testdata/sf0.001")


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, label, 0.5, "x", 1, 2) for k, v, label in rows], SCHEMA)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(9001, None, 1), (9002, [1.0, None, 2.0], 1), (9003, [nan, 1.0, 2.0], 1), (9004, [inf, 1.0, 2.0], 1),
            (9005, [], 1), (9006, [1.0, 2.0], 1), (9007, [1.0, 2.0, 3.0, 4.0], 2)]


def whitened_by_numpy(rows, k):
    x = np.array([[math.floor(256 * np.float64(np.float32(c))) for c in v] for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("entries", [1 << 20, 24])
def test_whitening_equals_numpy(spark, monkeypatch, entries):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 2 if entries == 24 else 1024)
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=3) * [3, 1, 0.5]).tolist(), 0) for k in range(300)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(200)] + [(5, rows[7][1], 0), (None, rows[8][1], None)]
    found = whitening.whitened(vectors_of(spark, rows + odd_rows()), 2).collect()
    n, deviation, projected, explained = whitened_by_numpy(rows, 2)
    assert n == 300 and len(found) == 2 * len(rows)
    assert all(r.n == n and r.identity_error < 1e-9 for r in found)
    expected = sorted(zip([str(r[0]) for r in rows], deviation.tolist(), np.abs(projected).round(9).tolist(), strict=True))
    by_row = {}
    for r in found:
        by_row.setdefault((str(r.vec_id), r.deviation, r.component), []).append(abs(r.whitened))
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    for key, dev, y in expected:
        for c in (1, 2):
            assert by_row[key, dev, c].pop() == pytest.approx(y[c - 1], abs=1e-9)
    signs = {(r.component, np.sign(r.whitened * projected[k, r.component - 1]))
             for r in found if r.vec_id is not None and r.vec_id < 300 and r.vec_id not in (5,) for k in [r.vec_id]}
    assert len(signs) == 2  # one sign per component, the same for all rows


def test_whitening_of_nothing_and_of_huge_entries(spark):
    assert whitening.whitened(vectors_of(spark, odd_rows()[:5])).collect() == []
    assert whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    # Of more components than carry variance, those that do.
    line = whitening.whitened(vectors_of(spark, [(k, [float(k), 2.0 * k, 0.0], 0) for k in range(20)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 20
    huge = whitening.whitened(vectors_of(spark, [(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0), (3, [1e9, 5.0], 0)])).collect()
    assert {r.deviation for r in huge} == {None} and {r.n for r in huge} == {3}
    wide = whitening.whitened(vectors_of(spark, [(1, [3e6, 0.0], 0), (2, [-3e6, 1.0], 0), (3, [2e6, 0.0], 0)])).collect()
    n, deviation, *_ = whitened_by_numpy([(1, [3e6, 0.0], 0), (2, [-3e6, 1.0], 0), (3, [2e6, 0.0], 0)], 1)
    assert {r.vec_id: r.deviation for r in wide} == dict(zip([1, 2, 3], deviation.tolist(), strict=True))


def brute(rows, anchors, positives, negatives, low, high):
    x = {k: [math.floor(256 * float(np.float32(c))) for c in v] for k, v, _ in rows}
    label = {k: y for k, _, y in rows}
    out = []
    for a in anchors:
        score = {k: sum(p * q for p, q in zip(x[a], x[k], strict=True))
                 for k in x if k != a and len(x[k]) == len(x[a])}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if label[k] == label[a]][:positives]:
            inside = [k for k in order if label[k] != label[a] and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(a, p, r + 1, k, score[p], score[k]) for r, k in enumerate(inside[:negatives])]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize(("shard_rows", "step"), [(2048, 64), (40, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shard_rows, step):
    monkeypatch.setattr(hardneg, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(hardneg, "STEP", step)
    rng = random.Random(2)
    # Few values, so many ties; equal vectors; a hot label; vectors of another length and of zeros.
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.gauss(0, 1)]) for _ in range(3)], 0 if k % 3 else rng.randint(1, 4))
            for k in range(400)]
    rows += [(1000 + k, rows[1][1], k % 2) for k in range(60)]
    rows += [(2000 + k, [rng.gauss(0, 1), 1.0], k % 2) for k in range(20)] + [(3000, [0.0, 0.0, 0.0], 1), (3100, [], 0)]
    vectors = vectors_of(spark, rows + odd_rows()[:4] + [(9100, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)])
    found = hardneg.hard_negatives(vectors, F.col("vec_id") % 50 == 0, 3, 4, 30, 90)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())
    assert got == brute(rows, [k for k, _, _ in rows if k % 50 == 0], 3, 4, 30, 90)


def test_hard_negatives_of_large_components(spark):
    rng = random.Random(3)
    rows = [(k, [float(np.float32(rng.uniform(-1, 1) * 2.0 ** 21)) for _ in range(3)], k % 2) for k in range(60)]
    found = hardneg.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, 2, 3).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found) == brute(rows, [0, 20, 40], 2, 3, 30, 90)
    assert hardneg.hard_negatives(vectors_of(spark, odd_rows()[:4]), F.col("vec_id") % 2 == 0).collect() == []


def test_the_walk_stops_before_the_end():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 2)) * 1000
    shard = hardneg.Shard(np.arange(20_000), np.array(["a", "b"] * 10_000, object), x.astype(np.int64))
    seen = []
    done = shard.walk
    shard.walk = lambda *a: seen.append(done(*a)) or seen[-1]
    shard.positives(0, "a", np.array([700, -20]), 5)
    assert len(seen[0][0]) < 5_000


@pytest.mark.skipif(not DATA.exists(), reason="driver tables not present")
def test_hard_negatives_equal_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    cursor = duck.execute(queries.SQL["op12_hard_negatives"])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall())
    found = queries.QUERIES["op12_hard_negatives"](spark, str(DATA))
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == want and want
