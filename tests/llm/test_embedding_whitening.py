import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_whitening as w


def brute(rows, most=16):
    """vec_id -> (n, deviation, whitened per component), and explained, by eigenvectors of V."""
    fine = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    once = sorted({tuple(x) for _, x in fine})
    n, sums = len(once), [sum(c) for c in zip(*once)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in once])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    out = {}
    for i, x in fine:
        y = np.array([(n * c - s) / n for c, s in zip(x, sums)])
        out.setdefault(i, []).append((n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), y @ v / np.sqrt(e)))
    return out, e / np.trace(centred.T @ centred / n)


def vectors(n=400, d=20, seed=3):
    chance = np.random.default_rng(seed)
    mixing = chance.normal(size=(d, d)) * np.geomspace(4, 0.2, d)
    rows = [(int(k), [float(np.float32(c)) for c in chance.normal(size=d) @ mixing]) for k in range(n)]
    return rows + [(n + k, rows[k % 7][1]) for k in range(150)] + [(7, rows[9][1]), (None, rows[1][1])]


def test_against_eigenvectors(spark):
    rows = vectors()
    odd = [(900, None), (901, [1.0] * 19 + [None]), (902, [math.nan] + [0.0] * 19), (903, [math.inf] * 20), (904, [1e300] * 20)]
    frame = spark.createDataFrame([(i, v, 5, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, x string").repartition(7)
    got = w.whitened_components(frame)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want, explained = brute(rows)
    found, signs = {}, {}
    for r in got.collect():
        found.setdefault((r.vec_id, r.deviation), []).append(r)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-10
    assert sum(map(len, found.values())) == 16 * len(rows)
    for (vec_id, deviation), own in found.items():
        n, _, z = next(x for x in want[vec_id] if x[1] == deviation)
        for r in own:
            assert r.n == n
            if abs(z[r.component - 1]) > 1e-3:
                sign = signs.setdefault(r.component, np.sign(r.whitened * z[r.component - 1]))
                assert abs(r.whitened - sign * z[r.component - 1]) < 1e-6


def test_rotations_keep_small_columns():
    """Columns of very different scales: deviations to full relative precision."""
    chance = np.random.default_rng(1)
    q, _ = np.linalg.qr(chance.normal(size=(60, 8)))
    scales = np.geomspace(1e12, 1e-9, 8)
    lengths, v = w.jacobi(np.linalg.qr(q * scales, mode="r"))
    assert np.allclose(lengths, scales, rtol=1e-13, atol=0) and np.allclose(np.abs(v), np.eye(8), atol=1e-12)


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_rotations_against_svd(d):
    r = np.random.default_rng(d).normal(size=(d, d))
    lengths, v = w.jacobi(r)
    assert np.allclose(lengths, np.linalg.svd(r, compute_uv=False), rtol=1e-12) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)


def test_each_pair_meets_once():
    for d in (2, 4, 10):
        pairs = [tuple(sorted(x)) for p, q in w._rounds(d) for x in zip(p.tolist(), q.tolist())]
        assert len(pairs) == len(set(pairs)) == d * (d - 1) // 2


def test_dependent_dimensions_add_nothing(spark):
    chance = np.random.default_rng(5)
    rows = [(k, [float(a), float(b), float(a), 3.0, float(a + b)]) for k, (a, b) in enumerate(chance.integers(-9, 9, size=(60, 2)))]
    got = w.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.max("component"), F.max("identity_error")).first()[0] == 2 and got.count() == 120


def test_lengths_have_fits_of_their_own(spark):
    chance = np.random.default_rng(6)
    short, long = ([(k, [float(x) for x in chance.normal(size=d)]) for k in range(50)] for d in (2, 3))
    both = w.whitened_components(spark.createDataFrame(short + long + [(1, [])], "vec_id long, embedding array<float>").repartition(6))
    alone = [w.whitened_components(spark.createDataFrame(x, "vec_id long, embedding array<float>")) for x in (short, long)]
    key = lambda f: sorted((r.vec_id, r.component, r.deviation, round(r.whitened, 9)) for r in f.collect())
    assert key(both) == sorted(key(alone[0]) + key(alone[1]))
    arrays = w.whiten(spark.createDataFrame(short, "vec_id long, embedding array<float>"), w.fit(spark.createDataFrame(short, "vec_id long, embedding array<float>")))
    assert arrays.columns == ["vec_id", "whitened"] and {len(r.whitened) for r in arrays.collect()} == {2}


def test_deviations_beyond_a_long():
    centre = w.Centre.of(3, [0, 3 * (1 << 40)])
    assert centre.deviations(np.array([[1 << 31, 0], [1, 1 << 40], [1 << 61, 0]])) == [None, 9, None]
    near = w.Centre.of(1, [0, 0])
    assert near.deviations(np.array([[3_037_000_499, 0], [3_037_000_500, 0]])) == [3_037_000_499**2, None]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert w.whitened_components(spark.createDataFrame([], schema)).count() == 0
    assert w.whitened_components(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = [(k, [1.0, 2.0]) for k in range(9)]  # one distinct vector has no components
    assert w.whitened_components(spark.createDataFrame(same, schema)).count() == 0
