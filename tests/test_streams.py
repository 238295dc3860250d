"""Streams over several micro-batches: late rows, repeated rows, disorder."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from sigwarn import registry  # noqa: F401  the plans need it first
from sigwarn.plans import streams as plans
from sigwarn.streaming import online

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_late_rows_are_dropped_and_counted(spark):
    batches = [[(1, 0, 1.0), (2, 12, 3.0), (2, 12, 3.0)], [(3, 100, 5.0), (4, 15, 7.0)], [(5, 130, 9.0)], [(6, 20, 100.0), (7, 95, 11.0), (3, 100, 5.0)], [(8, 300, 13.0)]]
    rows = [(b, key, "a", at(s), v) for b, batch in enumerate(batches) for key, s, v in batch]
    df = spark.createDataFrame(rows, "b int, key int, who string, ts timestamp, v double")
    seen = []
    stream = plans.arriving(df, "late", F.col("b"), 5)
    out = plans.to_end(online.sliding(stream, ["who"], "ts", "v", "20 seconds", "10 seconds", "30 seconds", ["key"]), "windows", told=lambda q: seen.append(online.dropped_late(q)))
    got = {int((r["start"] - T0).total_seconds()): (r["samples"], r["mean"]) for r in out.collect()}
    # row 6 comes when the watermark of batch 1, 100 - 30 seconds, holds; row 4 is in time as no watermark held before it
    assert got == {-10: (1, 1.0), 0: (3, 11 / 3), 10: (2, 5.0), 80: (1, 11.0), 90: (2, 8.0), 100: (1, 5.0), 120: (1, 9.0), 130: (1, 9.0)}
    assert seen == [1]


def plain_alarms(prob, threshold, k, m, span):
    out, free = [], 0
    for i in range(len(prob)):
        fires = sum(p is not None and p >= threshold for p in prob[max(0, i - m + 1) : i + 1]) >= k and i >= free
        out.append(int(fires))
        free = i + span + 1 if fires else free
    return out


def test_shuffled_batches_give_the_alarms_of_the_ordered_series(spark):
    rng, rows, want = np.random.default_rng(6), [], {}
    for who in ("a", "b", "c"):
        prob = [None if k % 23 == 7 else float(rng.random()) for k in range(150)]
        want |= {(who, k): a for k, a in enumerate(plain_alarms(prob, 0.5, 3, 5, 6))}
        # a row comes up to 25 seconds late, in the batch of the time at which it comes
        rows += [(int((k * 10 + rng.integers(0, 25)) // 300), who, at(k * 10), k, p) for k, p in enumerate(prob)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[k] for k in order], "b int, who string, ts timestamp, seq long, prob double")
    out = plans.to_end(online.online_alarms(plans.arriving(df, "mixed", F.col("b"), 6), "who", "ts", 0.5, 3, 5, 6, late="60 seconds"), "alarms")
    got = {(r["who"], r["seq"]): r["alarm"] for r in out.collect()}
    assert got == {key: a for key, a in want.items() if key[1] * 10 < 1490 - 60}


def test_a_silent_subject_begins_anew(spark):
    rows = [(0, "a", 0, 1.0), (0, "a", 1, 1.0), (1, "b", 500, 0.0), (2, "b", 1000, 0.0), (3, "a", 1001, 1.0), (4, "b", 2000, 0.0), (5, "b", 3000, 0.0)]
    df = spark.createDataFrame([(b, who, at(s), s, p) for b, who, s, p in rows], "b int, who string, ts timestamp, seq long, prob double")
    for idle, alarm in ((None, 1), ("100 seconds", 0)):
        out = plans.to_end(online.online_alarms(plans.arriving(df, "idle", F.col("b"), 6), "who", "ts", 0.5, 3, 3, 2, late="10 seconds", idle=idle), "alarms")
        assert {r["seq"]: r["alarm"] for r in out.where("who = 'a'").collect()} == {0: 0, 1: 0, 1001: alarm}


def test_batches_of_scores_read_a_stored_table(spark, monkeypatch):
    sources = []
    monkeypatch.setattr(plans, "arriving", lambda df, name, batch, batches: sources.append(df) or df)
    monkeypatch.setattr(plans, "to_end", lambda df, name: df)
    monkeypatch.setattr(plans.online, "online_alarms", lambda df, *a, **k: df)
    plans.streamed(spark, "/root/testdata/sf0.001")
    plan = sources[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
