import random
import time

import numpy as np
from pyspark.sql import functions as F

from sigwarn.operators import metrics as m
from sigwarn.operators import ordered as o


def plain(votes, span):
    out, blocked = [], 0
    for v in votes:
        if blocked:
            blocked -= 1
            out.append(0)
        else:
            out.append(int(v))
            blocked = span if v else 0
    return out


def rows(spark, probs, labels):
    return spark.createDataFrame([(1, i, float(p), y) for i, (p, y) in enumerate(zip(probs, labels, strict=True))], "subject_id long, seq long, prob double, label int").repartition(3)


def event_row(spark, probs, labels):
    a = o.blocks(o.alarms(rows(spark, probs, labels), ["subject_id"]), ["subject_id"])
    return m.event_level(a, ["subject_id"], 10).first()


def test_all_positive_background_is_bounded_by_the_refractory_period(spark):
    r = event_row(spark, [1.0] * 1080, [0] * 1080)
    assert r["fpr_h_event"] <= 2.1 and r["event_sensitivity"] is None


def test_one_anticipated_event(spark):
    r = event_row(spark, [0.9 if 205 <= i < 220 else 0.1 for i in range(400)], [int(200 <= i < 230) for i in range(400)])
    assert (r["n_events"], r["event_sensitivity"]) == (1, 1.0)


def test_quiet_model_has_no_alarms(spark):
    assert event_row(spark, [0.0] * 400, [0] * 400)["n_alarms"] == 0


def test_no_background_has_no_rate(spark):
    assert event_row(spark, [0.0] * 50, [1] * 50)["fpr_h_event"] is None


def test_chunked_alarms_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    probs = [rng.random() for _ in range(500)]
    df = rows(spark, probs, [0] * 500)
    for chunk, span in ((7, 3), (7, 20), (64, 11), (1000, 5)):
        got = [r["alarm"] for r in o.alarms(df, ["subject_id"], 0.4, 2, 3, span, chunk=chunk).orderBy("seq").collect()]
        votes = [sum(p >= 0.4 for p in probs[max(0, i - 2) : i + 1]) >= 2 for i in range(500)]
        assert got == plain(votes, span)


def test_what_a_chunk_hands_over_by_plain_loops():
    for seed in range(12):
        rng = random.Random(seed)
        at = np.array(sorted(rng.sample(range(100, 400), rng.choice([0, 1, 5, 90, 300]))), dtype=np.int64)
        span, want = rng.choice([0, 1, 7, 60]), []
        for blocked in range(span + 1):
            free = 100 + blocked
            for p in at:
                free = p + span + 1 if p >= free else free
            want.append(max(0, free - 400))
        assert o.handed_over(at, 100, 400, span).tolist() == want


def test_a_chunk_hands_over_in_steps_of_the_refractory_period(monkeypatch):
    steps, whole = [], np.where
    monkeypatch.setattr(o.np, "where", lambda *a: (steps.append(1), whole(*a))[1])
    began = time.process_time()
    for _ in range(20):
        o.handed_over(np.arange(1 << 16), 0, 1 << 16, 180)
    assert len(steps) <= 20 * ((1 << 16) // 181 + 1) and time.process_time() - began < 0.6


def test_a_chunk_hands_over_as_fast_with_short_refractory_periods():
    at, took = np.arange(0, 1 << 16, 2), 0.0
    for span in (0, 1, 20):
        want = [max(0, free - (1 << 16)) for free in _walked(at, span)]
        began = time.process_time()
        for _ in range(10):
            assert o.handed_over(at, 0, 1 << 16, span).tolist() == want
        took += time.process_time() - began
    assert took < 1.0  # in steps of the period: about 9 s


def _walked(at, span):
    at = at.tolist()
    for blocked in range(span + 1):
        free = blocked
        for p in at:
            free = p + span + 1 if p >= free else free
        yield free


def test_smoothing_pads_with_zeros(spark):
    x = [i * i for i in range(20)]
    got = [r["smoothed"] for r in o.smooth(rows(spark, x, [0] * 20), ["subject_id"]).orderBy("seq").collect()]
    assert got == [sum(x[max(0, i - 5) : i + 5]) / 10 for i in range(20)]
    short = [r["smoothed"] for r in o.smooth(rows(spark, [0.5] * 3, [0] * 3), ["subject_id"]).collect()]
    assert short == [0.5] * 3


def test_clock_wraps_and_rolls_over(spark):
    t = spark.createDataFrame([("a", 1, "23:50:00", "00:05:00"), ("a", 2, "00:06:00", "01:00:00"), ("a", 3, "24:10:00", "25:00:00"), ("a", 4, "bad", "01:00:00")], "subject_id string, seq int, start_clock string, end_clock string")
    got = [(r["abs_start"], r["abs_end"]) for r in o.rebuild_clock(t, ["subject_id"]).orderBy("seq").collect()]
    assert got[0] == (85800, 86700) and got[1] == (86760, 90000)
    assert got[3][0] is None


def test_leave_one_event_out_needs_two_blocks(spark):
    one = o.blocks(rows(spark, [0.1] * 200, [int(50 <= i < 60) for i in range(200)]), ["subject_id"])
    assert o.leave_one_event_out(one, ["subject_id"]).count() == 0
    two = o.blocks(rows(spark, [0.1] * 400, [int(i % 200 >= 190) for i in range(400)]), ["subject_id"])
    got = o.leave_one_event_out(two, ["subject_id"]).orderBy("fold").collect()
    assert [(r["fold"], r["test_rows"], r["test_positives"], r["train_rows"]) for r in got] == [(1, 200, 10, 200), (2, 200, 10, 200)]


def test_leave_one_event_out_meets_no_list_of_blocks(spark):
    labels = [int(x) for x in random.Random(4).choices("001", k=300)]
    df = o.blocks(rows(spark, [0.1] * 300, labels), ["subject_id"])
    got = o.leave_one_event_out(df, ["subject_id"], least_train=1, least_test=1)
    ends = [i for i in range(300) if labels[i] and not (i + 1 < 300 and labels[i + 1])]
    want = [(k + 1, end - begin, sum(labels[begin + 1 : end + 1])) for k, (begin, end) in enumerate(zip([-1, *ends], ends, strict=False))]
    want = [(k, n, p, 300 - n, sum(labels) - p) for k, n, p in want if 0 < p < n]
    assert sorted(tuple(r[c] for c in ("fold", "test_rows", "test_positives", "train_rows", "train_positives")) for r in got.collect()) == want
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not any("seq#" in x for x in joins)  # no row is compared with the blocks' ends


def test_auc_and_ap_count_ties(spark):
    df = rows(spark, [0.9, 0.5, 0.5, 0.1], [1, 1, 0, 0])
    r = m.auc_ap(df, ["subject_id"]).first()
    assert abs(r["auc"] - 0.875) < 1e-12 and abs(r["ap"] - (0.5 + 0.5 * 2 / 3)) < 1e-12
    assert m.auc_ap(df.where(F.col("label") == 1), ["subject_id"]).first()["auc"] is None


def test_score_counts_over_ranges_of_scores(spark):
    rng = random.Random(8)
    data = [(s, None if k % 31 == 3 else rng.randrange(60) / 60, rng.choice([0, 1, 1, None])) for s in ("a", None, "c") for k in range(300 if s != "c" else 2)]
    got = m.score_counts(spark.createDataFrame(data, "s string, prob double, label int").repartition(5), ["s"])
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("_range" in x or "prob#" not in x for x in windows)  # none over all scores of a group
    low = lambda p: -1.0 if p is None else p
    for r in got.collect():
        own = [d for d in data if d[0] == r["s"]]
        known = lambda at: [d[2] for d in own if d[2] is not None and at(low(d[1]))]
        count = lambda y, at: known(at).count(y) if known(at) else None
        p = low(r["prob"])
        assert (r["p"], r["n"]) == (count(1, lambda x: x == p), count(0, lambda x: x == p))
        assert (r["tp"], r["fp"], r["all_p"], r["all_n"]) == (count(1, lambda x: x >= p), count(0, lambda x: x >= p), count(1, lambda x: True), count(0, lambda x: True))
    assert got.count() == len({(s, p) for s, p, _ in data})
