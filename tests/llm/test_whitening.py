"""Whitening against exact integers and a plain eigen decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from marketlens.llm import whitening
from marketlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, components=8):
    """Rows by vec_id from exact sums and NumPy's symmetric eigenvalues."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    c = np.array([[float(Fraction(n * v[j] - sums[j], n)) for j in range(d)] for v in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for v in x]
    whitened = c @ vectors[:, :components] / np.sqrt(values[:components])
    return [i for i, _ in kept], n, deviation, whitened, values[:components] / values.sum()


def check(got, rows, components=8):
    ids, n, deviation, whitened, explained = plain(rows, components)
    assert len(got) == len(ids) * components
    at = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in got:
        k, j = at[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(explained[j], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
        if abs(whitened[k, j]) > 1e-3:
            assert signs.setdefault(j, np.sign(r.whitened * whitened[k, j])) == np.sign(r.whitened * whitened[k, j])
        assert abs(r.whitened) == pytest.approx(abs(whitened[k, j]), rel=1e-6, abs=1e-6)


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(QUERIES["op13_embedding_whitening"](spark, SF).collect(), rows)


def test_cases(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=9) * range(1, 10)]) for i in range(40)]
    rows += [(100, rows[0][1]), (101, None), (102, [None] * 9), (103, [float("nan")] * 9), (104, [float("inf")] + [0.0] * 8)]
    more = rows + [(105, [1.0]), (106, []), (107, [1e300] * 9)]  # another length, empty, beyond exact sums
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in more], "vec_id long, embedding array<double>, n string, component int")
    check(whitening.whiten(df.repartition(5)).collect(), rows)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id = 3")).collect() == []  # no variance
    twice = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [0.0, 2.0])], df.select("vec_id", "embedding").schema))
    assert sorted((str(x.vec_id), x.component, x.n, round(abs(x.whitened), 6), x.explained) for x in twice.collect()) == [
        ("1", 1, 3, 0.707107, 1.0), ("1", 1, 3, 0.707107, 1.0), ("None", 1, 3, 1.414214, 1.0),
    ]


def test_integer_vectors_and_big_deviations(spark):
    df = spark.createDataFrame([(i, [i * 10**8, -i]) for i in range(-2, 3)], "vec_id long, embedding array<long>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, 1).collect()}
    want = {i: (5 * 1024 * i * 10**8) ** 2 + (5 * 1024 * i) ** 2 for i in range(-2, 3)}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()}


@pytest.mark.parametrize("shape", [(3, 3), (20, 7), (5, 12), (64, 64)])
def test_eigen_of_scatter(shape):
    a = np.random.default_rng(shape[0]).normal(size=shape) * np.logspace(0, -5, shape[1])
    scatter = a.T @ a
    factor = whitening.pivoted_cholesky(scatter)
    assert np.allclose(factor @ factor.T, scatter, atol=1e-12 * np.trace(scatter))
    values, vectors = whitening.eigen(scatter)
    want = np.linalg.eigvalsh(scatter)[::-1][: len(values)]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert (np.diff(values) <= 0).all()
