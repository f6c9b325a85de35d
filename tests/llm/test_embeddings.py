"""Whitening against the eigenvectors of the whole covariance, on awkward vectors and on none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickbars.llm import queries
from tickbars.llm.whitening import Whitening, bidiagonalise

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, whitened string, deviation int, block string"


def frame(spark, vectors):
    rows = [(i, v, 1, "x", "w", 3, "b") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected(vectors, dims):
    valid = {i: v for i, v in enumerate(vectors) if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)}
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in valid.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    e, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    return x, fit, e[::-1], vectors.T[::-1]


def random_vectors():
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((600, 12)) * np.linspace(2, 0.2, 12)).astype(np.float32).tolist()
    v += v[:50] + [v[7]] * 200
    v += [None, [], [None] * 12, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [1.0] * 11, [0.5] * 13, [0.0] * 12, [-0.0] * 12]
    return v


def test_as_by_eigenvectors(spark):
    vectors = random_vectors()
    x, fit, e, right = expected(vectors, 12)
    table = frame(spark, vectors)
    fitted = Whitening.fit(table)
    n, s = len(fit), fit.sum(axis=0)
    assert fitted.n == n and fitted.sums == s.tolist() and fitted.components.shape == (4, 12)
    assert np.allclose(fitted.eigenvalues, e[:4], rtol=1e-11) and np.isclose(fitted.trace, e.sum(), rtol=1e-12)
    assert np.allclose(np.abs((fitted.components * right[:4]).sum(axis=1)), 1, atol=1e-12)
    assert fitted.identity_error < 1e-9
    assert fitted.apply(table).columns == ["vec_id", "embedding", "label", "x", "block", "deviation", "whitened"]
    rows = {r.vec_id: r for r in fitted.apply(table).collect()}
    assert set(rows) == set(x)
    for i, r in rows.items():
        assert r.deviation == int(((n * x[i] - s) ** 2).sum())
        mine = (x[i] - s / n) @ (right[:4] * np.sign((right[:4] * fitted.components).sum(axis=1))[:, None]).T / np.sqrt(e[:4])
        assert np.allclose(r.whitened, mine, atol=1e-8)


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[float("nan"), 1.0]]])
def test_too_few_vectors(spark, vectors):
    table = frame(spark, vectors)
    fitted = Whitening.fit(table)
    assert fitted.components.shape[0] == 0 and fitted.identity_error == 0.0
    assert all(r.whitened == [] for r in fitted.apply(table).collect())


def test_rank_and_huge_entries(spark):
    line = [[float(i), 2.0 * i, 0.0] for i in range(20)]
    fitted = Whitening.fit(frame(spark, line))
    assert fitted.components.shape == (1, 3) and fitted.steps <= 3
    assert np.allclose(np.abs(fitted.components[0]), np.array([1, 2, 0]) / np.sqrt(5))
    huge = [[1e14, 0.0], [-1e14, 1.0], [3e38, 2.0], [0.0, 3.0]]
    fitted = Whitening.fit(frame(spark, huge))
    assert fitted.n == 4 and {r.deviation for r in fitted.apply(frame(spark, huge)).collect()} == {None}


@pytest.mark.parametrize("values", [[5] * 6 + [1] * 10, [5, 5, 3, 3, 3, 1], [1] * 8, [1e3, 1, 1e-3, 1e-6], [2, 2]])
def test_repeated_singular_values(values):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((200, len(values))))
    turn, _ = np.linalg.qr(rng.standard_normal((len(values),) * 2))
    x = q * np.array(values, float) @ turn

    def products(p):
        u = x @ p
        return x.T @ u, float(u @ u)

    found, right, steps = bidiagonalise(products, len(values), float((x * x).sum()), 4)
    assert np.allclose(found, sorted(values, reverse=True)[:4], rtol=1e-9, atol=1e-9) and steps <= len(values)
    assert np.allclose(right @ right.T, np.eye(len(right)), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ right.T, axis=0), found, rtol=1e-9, atol=1e-9)


def test_query(spark, tmp_path):
    vectors = random_vectors()
    frame(spark, vectors).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op13_whitening(spark, str(tmp_path))
    assert found.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    x, fit, e, _ = expected(vectors, 12)
    rows = found.collect()
    assert len(rows) == 4 * len(x) and {r.component for r in rows} == {1, 2, 3, 4} and {r.n for r in rows} == {len(fit)}
    for r in rows[:50]:
        assert np.isclose(r.explained, e[r.component - 1] / e.sum(), rtol=1e-10)
    by = found.groupBy("component").agg(F.avg("whitened").alias("m")).collect()
    assert len(by) == 4
    frame(spark, []).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op13_whitening(spark, str(tmp_path / "none")).count() == 0
