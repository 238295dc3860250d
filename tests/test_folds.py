import numpy as np
import pyarrow as pa
import pytest

from sigwarn.operators import folds as f


def made(seed=4, pools=("a", "b"), parts=5, n=160, d=4):
    """Rows of two pools whose classes overlap; part None belongs to no fold."""
    rng, rows = np.random.default_rng(seed), []
    for p, pool in enumerate(pools):
        for k in range(n):
            y = int(rng.random() < 0.3)
            x = rng.normal(size=d) * [1, 50, 0.01, 1][:d] + 0.8 * y * np.array([1, 30, 0.004, 0])[:d] + 10 * p
            rows.append((pool, int(k * parts // n) if k % 11 else None, k, y, [float(v) for v in x]))
    return rows


SCHEMA = "pool string, part long, seq long, label int, features array<double>"


def plain_fit(x, y, strength=1.0):
    """(intercept and coefficients on x as it is) by Newton's steps on one training set."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1)
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    penalty = np.diag([0.0, *[1 / strength] * x.shape[1]])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve((w * p * (1 - p) * z.T) @ z + penalty, z.T @ (w * (p - y)) + penalty @ b)
    raw = b[1:] / std
    return np.r_[b[0] - raw @ mean, raw]


def arrays(rows, pool):
    own = [r for r in rows if r[0] == pool]
    part = np.array([-1 if r[1] is None else r[1] for r in own])
    return part, np.array([r[3] for r in own]), np.array([r[4] for r in own])


@pytest.mark.parametrize("cuts", [1, 7])
def test_scalers_of_folds(spark, cuts):
    rows = made()
    got = {(r["pool"], r["part"]): r for r in f.fold_scalers(spark.createDataFrame(rows, SCHEMA).repartition(cuts)).collect()}
    assert sorted(got) == [(p, k) for p in "ab" for k in range(5)]
    for (pool, k), r in got.items():
        part, _, x = arrays(rows, pool)
        assert r["n"] == (part != k).sum() and np.allclose(r["mean"], x[part != k].mean(axis=0)) and np.allclose(r["std"], x[part != k].std(axis=0))


@pytest.mark.parametrize("strength", [1.0, 50.0])
def test_models_of_folds_are_those_of_one_fit_each(spark, strength):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    models = f.fit_logistic(df, strength)
    table = {(r["pool"], r["part"]): np.r_[r["intercept"], r["coefficients"]] for r in models.table(df).collect()}
    scores = {(r["pool"], r["seq"]): r["prob"] for r in f.score(df, models).collect()}
    assert len(scores) == sum(r[1] is not None for r in rows) and all((g <= f.TOLERANCE).all() for g in models.gradient.values())
    for pool in "ab":
        part, y, x = arrays(rows, pool)
        for k in range(5):
            want = plain_fit(x[part != k], y[part != k], strength)
            assert np.allclose(table[pool, k], want, rtol=1e-5, atol=1e-6)
            for s in np.flatnonzero(part == k):
                assert abs(scores[pool, s] - 1 / (1 + np.exp(-want[0] - x[s] @ want[1:]))) < 1e-6


def test_a_part_that_holds_most_of_its_pool(spark):
    rows = [(p, 0 if k is not None and s % 10 < 8 else 1, s, y, x) for p, k, s, y, x in made(9, ("a",))]
    df = spark.createDataFrame(rows, SCHEMA)
    models = f.fit_logistic(df)
    part, y, x = arrays(rows, "a")
    for r in models.table(df).collect():
        want = plain_fit(x[part != r["part"]], y[part != r["part"]])
        assert np.allclose(np.r_[r["intercept"], r["coefficients"]], want, rtol=1e-4, atol=1e-5)


def test_constant_features_separable_classes_and_useless_folds(spark):
    rows = [("a", k % 3, k, int(k >= 30), [float(k), 5.0, float(k % 3 == 1)]) for k in range(60)]
    rows += [("one class", k % 2, k, 0, [float(k), 1.0, 0.0]) for k in range(10)] + [("small", k % 2, k, k // 2 % 2, [float(k), 1.0, 0.0]) for k in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    models = f.fit_logistic(df, least_train=10)
    assert set(models.pools) == {"a"}
    part, y, x = arrays(rows, "a")
    for r in models.table(df).collect():
        got, want = np.r_[r["intercept"], r["coefficients"]], plain_fit(x[part != r["part"]], y[part != r["part"]])
        # what a feature that is constant in training adds is the same for the rows learnt from
        assert np.allclose(got[0] + x[part != r["part"]] @ got[1:], want[0] + x[part != r["part"]] @ want[1:], atol=1e-5)
    tested = f.fit_logistic(df, both_tested=True)
    assert set(tested.pools) == {"a", "small"}
    nothing = f.fit_logistic(df.limit(0))
    assert not nothing.pools and f.score(df, nothing).count() == 0 and f.fold_scalers(df.limit(0)).count() == 0


def test_losses_probabilities_and_folds_of_rows():
    m = np.array([[-800.0, -3.0, 0.0], [800.0, 2.0, -0.5]])
    y = np.array([[1], [0]])
    loss, p = f._logistic(m, y)
    assert np.allclose(loss, np.logaddexp(0, np.where(y == 1, -m, m))) and np.allclose(p, np.exp(-np.logaddexp(0, -m)))
    assert f._folds_of(pa.array([7, None, 3, 9, 7]), {7: 1, 3: 2}).tolist() == [1, -1, 2, -1, 1]
    groups = {k: at.tolist() for k, at in f._groups(pa.array(["a", "b", "a", None]), pa.array([1, None, 1, None]))}
    assert groups == {("a", 1): [0, 2], ("b", None): [1], (None, None): [3]}
