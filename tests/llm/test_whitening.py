import numpy as np
import pytest

from albumweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(x, k=8):
    """(whitened up to sign, shares, deviations) from numpy's own decomposition."""
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    _, sv, vt = np.linalg.svd(c, full_matrices=False)
    e = sv**2 / n
    return c @ vt[:k].T / np.sqrt(e[:k]), e[:k] / (c * c).sum() * n, ((n * x - s).astype(object) ** 2).sum(1)


def integers(v):
    return np.floor(1024 * v.astype(np.float32).astype(float)).astype(np.int64) + 100000


def table(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids if ids is not None else range(len(v)), v, strict=True)], SCHEMA)


def check(out, x, ids, k, tol=1e-7):
    n = len(x)
    white, shares, dev = brute(x, k)
    assert len(out) == n * k and set(out.n) == {n} and out.identity_error.max() < 1e-4
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(np.abs((got * white).mean(0)) - 1).max() < tol
    assert np.abs(got - white * np.sign((got * white).sum(0))).max() < tol * 100
    assert np.allclose(out.drop_duplicates("component").sort_values("component").explained, shares, rtol=1e-6)
    assert out[out.component == 1].set_index("vec_id").deviation.loc[ids].tolist() == dev.tolist()


def test_equals_a_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12)
    out = whitening.whitened(table(spark, v).selectExpr("*", "1 AS n", "'x' AS whitened", "2 AS component").repartition(3)).toPandas()
    check(out, integers(v), list(range(300)), 8)


def test_few_dimensions_and_directions_far_weaker_than_the_first(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 3)) * [4000.0, 1.0, 0.01]
    check(whitening.whitened(table(spark, v)).toPandas(), integers(v), list(range(200)), 3, 1e-6)


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(-50, 50, size=(100, 2)) / 16
    v = np.concatenate([a, a, np.full((100, 2), 7.0)], 1)
    out = whitening.whitened(table(spark, v)).toPandas()
    assert set(out.component) == {1, 2} and abs(out.drop_duplicates("component").explained.sum() - 1) < 1e-9


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [nan] * 5), (903, [inf, 0.0, 0.0, 0.0, 0.0]), (904, [-inf, 0.0, 0.0, 0.0, 0.0]), (905, []), (906, [1.0] * 4), (907, [1e30, 0.0, 0.0, 0.0, 0.0])]
    rows = table(spark, v).union(spark.createDataFrame(odd, SCHEMA))
    check(whitening.whitened(rows).toPandas(), integers(v), list(range(60)), 5)


def test_repeated_rows_count_and_null_ids_stay(spark):
    v = np.array([[0.0, 1.0], [0.0, 1.0], [2.0, 5.0], [4.0, -3.0]])
    rows = spark.createDataFrame([(1, v[0].tolist()), (1, v[1].tolist()), (None, v[2].tolist()), (3, v[3].tolist())], SCHEMA)
    out = whitening.whitened(rows).toPandas()
    assert len(out) == 8 and out.vec_id.isna().sum() == 2 and set(out.n) == {4}
    x = integers(v)
    assert sorted(out[out.component == 1].deviation) == sorted(brute(x)[2].tolist())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.isEmpty()


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[1 << 40, 5], [3, 7], [-(1 << 39), 11]], np.int64)
    s = [int(v) for v in x.astype(object).sum(0)]
    want = [[10**6 * int(a) - b for a, b in zip(r, s, strict=True)] for r in x]
    assert whitening.deviations(x, 10**6, s).tolist() == want
