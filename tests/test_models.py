import numpy as np
from pyspark.sql import functions as F

from sigwarn.operators import models as d


def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i % 2, i, int(i % 3 == 0), [float(v) for v in rng.normal(2 * (i % 3 == 0), 0.3, 4)]) for i in range(60)]
    return spark.createDataFrame(data, "subject_id long, seq long, label int, features array<double>")


def test_classes_weigh_the_same(spark):
    got = {r["label"]: r["weight"] for r in d.weighted(rows(spark)).select("label", "weight").distinct().collect()}
    assert got == {0: 60 / (2 * 40), 1: 60 / (2 * 20)}


def test_each_subject_is_scored_by_models_of_others(spark):
    got = d.leave_one_out(rows(spark), d.margin()).collect()
    assert sorted(r["seq"] for r in got) == list(range(60))
    assert all((r["prob"] > 0.5) == (r["label"] == 1) for r in got)


def exact_margin(kernel, y, weight, regularised):
    """(decision values of the rows, objective) of the margin with this kernel and no offset, by coordinate ascent on the dual."""
    share = weight / weight.sum()
    a, top = np.zeros(len(y)), share / regularised
    for _ in range(3000):
        for i in range(len(y)):
            a[i] = np.clip(a[i] + (1 - y[i] * ((a * y) @ kernel[i])) / kernel[i, i], 0, top[i])
    f = kernel @ (a * y)
    return f, (share * np.maximum(0, 1 - y * f)).sum() + regularised / 2 * (a * y) @ f


def test_landmarks_span_the_kernel(spark):
    df = d.vectors(rows(spark)).withColumnRenamed("vector", "scaled").orderBy("seq")
    x = np.array([r["features"] for r in df.collect()])
    want, gaps = d.gaussian(x, x, 0.25), []
    for size in (5, 20, 60):
        mapped = d.Landmarks(size, 0.25).fit(df).transform(df).orderBy("seq").collect()
        z = np.array([r["mapped"].toArray() for r in mapped])
        gaps.append(np.abs(z @ z.T - want).max())
    assert gaps[2] < 1e-6 and gaps[2] < gaps[1] < gaps[0]


def test_kernel_margin_beside_the_exact_solution(spark):
    """All rows as landmarks: nearly the objective of the exact dual solution; a third of them: the same side for nearly all rows."""
    rng = np.random.default_rng(5)
    data = [(k % 3, k, int(np.hypot(*p) > 1.1), [float(v) for v in p]) for k, p in enumerate(rng.normal(size=(90, 2)))]
    df = d.weighted(d.vectors(spark.createDataFrame(data, "subject_id long, seq long, label int, features array<double>"))).withColumn("scaled", F.col("vector"))
    held = df.orderBy("seq").collect()
    x, y, weight = np.array([r["features"] for r in held]), np.array([2 * r["label"] - 1 for r in held]), np.array([r["weight"] for r in held])
    exact, least = exact_margin(d.gaussian(x, x, 0.5), y, weight, 0.05)
    for size in (90, 30):
        model = d.kernel_margin(size, 0.5, 0.05, 100, offset=False).fit(df)  # the exact solution has no offset
        out = model.transform(df).orderBy("seq").collect()
        f = np.array([r["rawPrediction"][1] for r in out])
        w = np.asarray(model.stages[-1].coefficients.toArray())
        found = (weight / weight.sum() * np.maximum(0, 1 - y * f)).sum() + 0.025 * w @ w
        assert found <= 1.05 * least, (size, found, least)
        assert (np.sign(f) == np.sign(exact)).mean() >= 0.95
