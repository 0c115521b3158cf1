"""Operator 11 against a dense eigensolver and exact integers."""

import numpy as np
import pytest

from examlytics.llm import whitening

SF = "/root/testdata/sf0.01"


def exact(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, u = np.linalg.eigh(y.T @ y / n)
    return x, n, s, y, values[::-1], u[:, ::-1]


def check(rows, kept, components=8):
    """``rows`` of the operator against ``kept`` (id, vector) pairs."""
    x, n, s, y, values, u = exact([v for _, v in kept])
    k = min(components, x.shape[1], int((values > x.shape[1] * whitening.EPS * values[0]).sum()))
    got = sorted(rows, key=lambda r: (r.vec_id, r.deviation, r.component))
    assert len(got) == n * k
    dev = {}
    for (i, _), row in zip(kept, x.tolist()):
        dev.setdefault(i, []).append(sum((n * a - int(b)) ** 2 for a, b in zip(row, s)))
    for i, found in dev.items():
        assert sorted(r.deviation for r in got if r.vec_id == i) == sorted(d for d in found for _ in range(k))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    by = {}
    for r in got:
        by.setdefault(r.component, []).append((r.vec_id, r.whitened))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
    if len({i for i, _ in kept}) == n:
        order = np.argsort([i for i, _ in kept])
        for c in range(1, k + 1):
            want = (y @ u[:, c - 1] / np.sqrt(values[c - 1]))[order]
            have = np.array([w for _, w in sorted(by[c])])
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
    return k


def test_query_against_a_dense_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert check(whitening.query(spark, SF).collect(), rows) == 8


@pytest.mark.parametrize("dims,seed", [(3, 1), (8, 2), (50, 3), (120, 4)])
def test_solver_reaches_double_precision(dims, seed):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((dims, 3 * dims))
    a = m @ m.T
    a += np.outer(a[:, 0], a[:, 0]) / 9  # one large, the others close together
    passes = []

    def times(v):
        passes.append(v.shape[1])
        return a @ v

    values, u, residuals = whitening.largest_pairs(times, dims, 8)
    want = np.linalg.eigvalsh(a)[::-1][: min(8, dims)]
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert residuals.max() <= 64 * 8 * np.sqrt(dims) * whitening.EPS * want[0]
    assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-13
    assert max(passes) <= whitening.SPACE and len(passes) < 400


def test_a_missed_direction_is_found():
    a = np.diag([9.0, 8, 7, 6, 5, 4, 3, 2])
    x = np.eye(8)[:, [0, 1, 3]]
    found = whitening.missed_direction(lambda v: a @ v, x, np.array([9.0, 8, 6]), np.random.default_rng(0))
    assert abs(abs(found[2, 0]) - 1) < 1e-8
    assert whitening.missed_direction(lambda v: a @ v, np.eye(8)[:, :3], np.array([9.0, 8, 7]), np.random.default_rng(0)) is None


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, n string, component double").repartition(3)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(40)] + [(3, rng.standard_normal(5).tolist()), (77, [0.5] * 5), (78, [0.5] * 5)]
    bad = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0, 0.0, 0.0])]
    assert check(whitening.whiten(frame(spark, good + bad)).collect(), good) == 5
    nameless = whitening.whiten(frame(spark, [*good[:40], (None, good[0][1])])).where("vec_id is null").collect()
    assert len(nameless) == 5


def test_few_vectors_have_few_components(spark):
    rng = np.random.default_rng(9)
    three = [(i, rng.standard_normal(12).tolist()) for i in range(4)]
    assert check(whitening.whiten(frame(spark, three)).collect(), three) == 3


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(frame(spark, rows)).count() == 0


def test_exact_deviations_beyond_doubles():
    c = whitening.Center(10**9, [3, -(10**18)], np.array([0, -(10**9)]), np.array([3e-9, 0.0]))
    x = np.array([[7, 5], [0, -(10**9)]])
    want = [sum((c.n * int(a) - s) ** 2 for a, s in zip(r, c.sums)) for r in x]
    assert whitening._deviations(c, x) == want
