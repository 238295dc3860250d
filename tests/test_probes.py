import numpy as np

from sigwarn.operators import probes as pb


def made(seed=1):
    rng, rows = np.random.default_rng(seed), []
    for s, size in ((10, 40), (20, 55), (30, 33)):
        for k in range(size):
            rows.append((s, k, [float(v) for v in rng.normal(size=4) * [1, 20, 1, 1] + [0.9 * (s == 10), 15 * (s == 20), 0, 5]]))
    return rows


def plain_probe(x, y, classes, strength=1.0):
    """Weights on x as it is, by plain gradient steps until they stand."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    onehot, w = np.eye(classes)[y], np.zeros((classes, z.shape[1]))
    penalty = np.append(0.0, np.full(x.shape[1], 1 / strength))
    inverse = np.linalg.inv(0.5 * z.T @ z + np.diag(penalty) + 1e-9 * np.eye(z.shape[1]))
    for _ in range(20_000):
        p = np.exp(z @ w.T)
        g = (p / p.sum(axis=1, keepdims=True) - onehot).T @ z + penalty * w
        w = w - g @ inverse
        if np.abs(g).max() < 1e-9:
            break
    return w, mean, std


def test_probes_are_those_of_one_fit_each(spark):
    rows, groups = made(), {"all": [0, 1, 2, 3], "first": [0], "noise": [2, 3]}
    df = pb.dealt(spark.createDataFrame(rows, "subject_id long, seq long, features array<double>").repartition(5), 3)
    held = [(r["subject_id"], r["seq"], r["fold"], r["features"]) for r in df.collect()]
    sizes = {(s, f): sum(h[0] == s and h[2] == f for h in held) for s in (10, 20, 30) for f in range(3)}
    assert all(max(sizes[s, f] for f in range(3)) - min(sizes[s, f] for f in range(3)) <= 1 for s in (10, 20, 30))
    models = pb.train(df, groups)
    assert models.gradient <= pb.TOLERANCE and models.subjects == [10, 20, 30]
    told = {(r["probe"], r["fold"], r["subject_id"]): (r["n"], r["hits"]) for r in pb.recalls(df, models).collect()}
    accs = {g: [] for g in groups}
    for g, places in groups.items():
        for f in range(3):
            x, y, fold = np.array([h[3] for h in held])[:, places], np.array([h[0] // 10 - 1 for h in held]), np.array([h[2] for h in held])
            w, mean, std = plain_probe(x[fold != f], y[fold != f], 3)
            guess = (np.c_[np.ones((fold == f).sum()), (x[fold == f] - mean) / std] @ w.T).argmax(axis=1)
            each = [((guess == c) & (y[fold == f] == c)).sum() for c in range(3)]
            assert [told[g, f, s] for s in (10, 20, 30)] == [(sizes[s, f], each[k]) for k, s in enumerate((10, 20, 30))]
            accs[g].append(np.mean([e / sizes[s, f] for e, s in zip(each, (10, 20, 30), strict=True)]))
    got = {r["probe"]: r for r in pb.identifiability(pb.recalls(df, models)).collect()}
    for g in groups:
        assert np.allclose([got[g]["mean_acc"], got[g]["std_acc"], got[g]["multiple_of_chance"]], [np.mean(accs[g]), np.std(accs[g]), 3 * np.mean(accs[g])])
    assert got["all"]["mean_acc"] > got["noise"]["mean_acc"]


def test_no_rows_and_one_subject(spark):
    df = spark.createDataFrame([(1, k, [float(k), 1.0]) for k in range(6)], "subject_id long, seq long, features array<double>")
    for rows in (df, df.limit(0)):
        dealt = pb.dealt(rows, 3)
        assert pb.recalls(dealt, pb.train(dealt, {"all": [0, 1]})).count() == 0
