import numpy as np

from sigwarn.operators import permutation as p
from sigwarn.operators.metrics import auc_ap


def rows(seed=2, n=120):
    rng = np.random.default_rng(seed)
    out = [("m", s, k, int(rng.random() < 0.25), float(rng.integers(0, 30)) / 30) for s in (1, 2, 3) for k in range(n)]
    return out + [("m", 4, k, 0, 0.5) for k in range(5)]


def test_permutations_are_even():
    n, places = 12, np.zeros((12, 12))
    for rep in range(1, 4001):
        order = p.shuffled(n, "s", rep)
        assert sorted(order) == list(range(n))
        places[np.arange(n), order] += 1
    assert ((places - 4000 / n) ** 2 / (4000 / n)).sum() < 200  # chi-squared, 121 degrees of freedom
    neighbours = np.mean([abs(np.diff(p.shuffled(100, "s", rep))).mean() for rep in range(1, 300)])
    assert abs(neighbours - 101 / 3) < 1


def test_labels_move_as_places_do_without_places_being_sorted(monkeypatch):
    rng = np.random.default_rng(3)
    k, (a, b, c) = np.arange(1, 70_001, dtype=object), p.multipliers("s", 5)
    x = (k * (a + 1) + b) % p.PRIME
    y = (x * x + c) % p.PRIME
    assert (p.numbers(70_000, "s", 5) == ((y * y + x) % p.PRIME).astype(np.int64)).all()
    whole = p.numbers
    for n, numbers in ((70_000, whole), (900, lambda n, seed, rep: whole(n, seed, rep) % np.uint32(200))):  # the second has many ties
        monkeypatch.setattr(p, "numbers", numbers)
        label = (rng.random(n) < 0.3).astype(np.uint8)
        assert all((p.moved(label, "s", rep) == np.flatnonzero(label[p.shuffled(n, "s", rep)])).all() for rep in range(1, 20))


def test_areas_of_packed_ranks_are_exact(spark):
    df = spark.createDataFrame(rows(), "model string, subject_id int, seq int, label int, prob double").repartition(3)
    got = {r["subject_id"]: (r["auc"], r["ap"]) for r in p.null_areas(df, ["model", "subject_id"], 0).collect()}
    want = {r["subject_id"]: (r["auc"], r["ap"]) for r in auc_ap(df, ["subject_id"]).where("auc is not null").collect()}
    assert set(got) == set(want) == {1, 2, 3} and all(np.allclose(got[k], want[k]) for k in want)


def test_test_by_plain_loops(spark):
    data, reps = rows(), 130
    df = spark.createDataFrame(data, "model string, subject_id int, seq int, label int, prob double").repartition(4)
    means = []
    for rep in range(reps + 1):
        each = []
        for s in (1, 2, 3):
            own = [r for r in data if r[1] == s]
            y, v = np.array([r[3] for r in own]), np.array([r[4] for r in own])
            y = y if rep == 0 else y[p.shuffled(len(y), "perm", rep)]
            pos, neg = v[y == 1], v[y == 0]
            auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
            each.append((auc, np.mean([(pos >= x).sum() / (v >= x).sum() for x in pos])))
        means.append(np.round(np.mean(each, axis=0), 9))
    means = np.array(means)
    got = {r["metric"]: r for r in p.permutation_test(df, ["model"], "subject_id", reps).collect()}
    for k, metric in enumerate(p.METRICS):
        null, r = means[1:, k], got[metric]
        assert np.allclose([r["observed"], r["null_mean"], r["null_sd"]], [means[0, k], null.mean(), null.std(ddof=1)], atol=1e-8)
        assert r["p"] == ((null >= means[0, k]).sum() + 1) / (reps + 1)
    assert p.permutation_test(df.limit(0), ["model"], "subject_id", 3).count() == 0
