"""Whitening against numpy's own eigenvectors and exact whole-number sums."""

from fractions import Fraction

import numpy as np
import pytest

from strandline.llm import whitening
from strandline.llm.queries import QUERIES


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "flat": np.random.default_rng(1).uniform(0.9, 1.1, 64),
    "falling fast": 10.0 ** -np.arange(40),
    "wide": np.r_[1e6, np.geomspace(1e2, 1e-3, 63)],
    "repeated": np.r_[5.0, [3.0] * 12, [1.0] * 30],
    "close": np.r_[1 + np.arange(20) * 1e-9, np.linspace(0, 0.5, 44)],
    "rank 3": np.r_[7.0, 2.0, 1.0, np.zeros(20)],
    "one": np.array([4.0]),
    "large": np.r_[np.linspace(1, 1.2, 150), np.linspace(0, 0.99, 150)],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_eigenvectors(name):
    values = SPECTRA[name]
    a = spectrum(values)
    found, vectors = whitening.leading(a)
    true = np.sort(np.linalg.eigvalsh(a))[::-1]
    norm = np.abs(a).sum(axis=1).max()
    rank = int((true > 8 * len(a) * whitening.EPS * norm).sum())
    assert len(found) == min(8, rank)
    assert np.abs(found - true[: len(found)]).max() <= 1e-14 * norm * len(a) ** 0.5
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() <= 1e-13


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia_counts_eigenvalues(name):
    a = spectrum(SPECTRA[name])
    true = np.linalg.eigvalsh(a)
    inertia = whitening.Inertia(a)
    for s in np.r_[-1.0, np.unique(np.round(SPECTRA[name], 12)) * 1.0001 + 1e-9, 1e9]:
        if np.abs(true - s).min() > 1e-11 * np.abs(true).max():
            assert inertia.below(float(s)) == (true < s).sum()


def test_a_settled_block_that_misses_one_is_an_error():
    a = spectrum(SPECTRA["flat"])
    with pytest.raises(RuntimeError, match="eigenvectors"):
        whitening._in_interval(a, 0.85, 1.0, 64, whitening.WhiteningConfig(most_rounds=3))


def test_no_eigenvalue():
    assert whitening.leading(np.zeros((3, 3)))[1].shape == (3, 0)


@pytest.mark.parametrize("most", [10, 1 << 30, (1 << 52) - 1])
def test_squares_are_exact(most):
    values = np.random.default_rng(2).integers(-most, most, (50, 4))
    true = [[sum(int(r[i]) * int(r[j]) for r in values) for j in range(4)] for i in range(4)]
    assert whitening.squares(values).tolist() == true


def expected(vectors, scale=1024, shift=100_000):
    x = [[int(np.floor(scale * float(c))) + shift for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)]
    return x, n, s, np.array(cov)


def test_query_equals_plain_sums(spark, sf_dir):
    rows = QUERIES["op11_embedding_whitening"](spark, sf_dir).collect()
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    x, n, s, _ = expected(list(given.values()))
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(rows) == 8 * n and {r["n"] for r in rows} == {n}
    by = {i: (r, c) for i, r, c in zip(given, x, centred, strict=True)}
    for r in rows:
        own, c = by[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(own, s, strict=True))
        assert abs(abs(r["whitened"]) - abs(c @ v[:, k]) / e[k] ** 0.5) < 1e-9
        assert abs(r["explained"] - e[k] / e.sum()) < 1e-9 and r["identity_error"] < 1e-9
    made = np.array([r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))]).reshape(n, 8)
    assert np.abs(made.T @ made / n - np.eye(8)).max() < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -0.25, 3.0], [1.0, 2.0, -3.0], [1.0, 2.0, -3.0], [-7.5, 0.0, 0.125]]
    bad = [None, [], [1.0, None, 2.0], [1.0, nan, 2.0], [inf, 0.0, 0.0], [1.0], [1.0, 2.0, 3.0, 4.0], [1e300, 0.0, 0.0]]
    data = [(None if i == 1 else i, v, 1, 0.5, 2) for i, v in enumerate([*bad, *good])]
    df = spark.createDataFrame(data, "id int, v array<double>, n int, whitened double, component int").repartition(3)
    rows = whitening.whiten(df.select("id", "v")).collect()
    _, n, _, cov = expected(good)
    assert n == 4 and len(rows) == 12 and {r["n"] for r in rows} == {4} and {r["id"] for r in rows} == {8, 9, 10, 11}
    model = whitening.fit(df.select("id", "v"))
    assert np.array_equal(model.covariance, cov)
    # Rank two or three: what has no variance has no whitened value.
    flat = spark.createDataFrame([(i, [1.0 * i, 2.0 * i, 5.0]) for i in range(9)], "id int, v array<float>")
    found = whitening.whiten(flat).collect()
    assert [r["component"] for r in found if r["whitened"] is not None] == [1] * 9 and {r["explained"] for r in found if r["component"] > 1} == {0.0}
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "id int, v array<float>")).collect()
    assert len(same) == 6 and {(r["whitened"], r["deviation"], r["identity_error"]) for r in same} == {(None, 0, 0.0)}
    none = spark.createDataFrame([(i, v) for i, v in enumerate(bad[:5])], "id int, v array<double>")
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none.limit(0)).count() == 0


def test_large_numbers(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.integers(-(1 << 40), 1 << 40, (30, 3)) * 1.0).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id int, v array<double>")
    _, n, s, cov = expected(vectors)
    assert np.array_equal(whitening.fit(df).covariance, cov)
    assert {r["deviation"] for r in whitening.whiten(df).collect()} == {None}
