import numpy as np
from pyspark.sql import functions as F

from sigwarn.operators import ordered as o
from sigwarn.operators import protocols as pr


def series(labels):
    return [(1, k, y, [float(k)]) for k, y in enumerate(labels)]


SCHEMA = "subject_id long, seq long, label int, features array<double>"


def test_parts_of_events(spark):
    df = spark.createDataFrame(series([0, 1, 1, 0, 0, 1, 0, 0]) + [(2, 0, 0, [0.0]), (2, 1, 0, [0.0])], SCHEMA)
    got = {(r["subject_id"], r["seq"]): r["part"] for r in o.event_parts(o.blocks(df, ["subject_id"]), ["subject_id"]).collect()}
    assert [got[1, k] for k in range(8)] == [1, 1, 1, 2, 2, 2, None, None] and got[2, 0] is None


def test_protocols_hold_out_what_they_say(spark):
    df = spark.createDataFrame(series([0, 1, 0, 0, 1, 0, 0, 1, 0, 0]), SCHEMA)
    rows = {(r["protocol"], r["seq"]): (r["pool"], r["part"]) for r in pr.assigned(df).collect()}
    assert len(rows) == 50 and {p for p, _ in rows} == set(pr.PROTOCOLS)
    assert all(rows["left_out", k] == ("left_out|all", "1") for k in range(10))
    assert [rows["within_temporal", k][1] for k in range(10)] == [None] * 8 + ["test"] * 2
    assert [rows["event_left_out", k] for k in (0, 1, 2, 9)] == [("event_left_out|1", p) for p in ("1", "1", "2", None)]


def plain_alarms(prob, threshold, k, m, span):
    out, free = np.zeros(len(prob), dtype=int), 0
    for i in range(len(prob)):
        if (prob[max(0, i - m + 1) : i + 1] >= threshold).sum() >= k and i >= free:
            out[i], free = 1, i + span + 1
    return out


def test_calibrated_folds_by_plain_loops(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    grid = [round(0.05 + 0.01 * k, 9) for k in range(91)]
    for part in ("1", "2"):
        y = np.zeros(200, dtype=int)
        y[60:75], y[140:150] = 1, 1
        raw = np.clip(0.3 * y + rng.random(200) * 0.7, 0, 1)
        rows += [(part, k, int(y[k]), float(raw[k])) for k in range(200)]
        padded = np.r_[np.zeros(5), raw, np.zeros(4)]
        prob = np.array([padded[k : k + 10].sum() / 10 for k in range(200)])
        best = None
        for t in grid:
            a = plain_alarms(prob, t, 2, 4, 9)
            sens, rate = a[y == 1].mean(), a[y == 0].sum() / ((y == 0).sum() * 600 / 3600)
            if rate <= 1.0 and (best is None or sens > best[1] + 1e-12):
                best = (t, sens, 1 - a[y == 0].mean(), rate)
        want[part] = best
    df = spark.createDataFrame(rows, "part string, seq long, label int, prob double").repartition(3)
    found = pr.calibrated(df, ["part"], 600, 1.0, 2, 4, 9)
    got = {r["part"]: r for r in found.collect()}
    for part, (threshold, sens, spec, rate) in want.items():
        r = got[part]
        assert np.allclose([r["threshold"], r["sens_alarm"], r["spec_alarm"], r["fpr_per_hour"]], [threshold, sens, spec, rate]) and (r["n_pos"], r["n_neg"]) == (25, 175)
    summary = pr.over_folds(found.withColumn("g", F.lit(1)), ["g"]).first()
    assert summary["n_folds"] == 2 and np.isclose(summary["sens_mean"], np.mean([w[1] for w in want.values()])) and summary["sens_event"] == np.mean([w[1] > 0 for w in want.values()])
