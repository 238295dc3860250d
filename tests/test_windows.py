"""Joins of windows with events by buckets of time are those of every window with every event."""

import random

import pytest
from pyspark.sql import functions as F

from sigwarn.operators import windows as w


def tables(spark, seed):
    rng = random.Random(seed)
    recs = [(s, r, 30_000, r * 40_000, r * 40_000 + 30_000) for s in (1, 2) for r in range(4)]
    events = []
    for s, r, size, start, _ in recs:
        for k in range(rng.randint(0, 3)):
            on = rng.randint(0, size - 100)
            events.append((s, r, k, on, on + rng.randint(1, 2500), start + on, start + on + rng.randint(1, 2500)))
    r = spark.createDataFrame(recs, "subject_id long, recording_id long, n_seconds long, abs_start long, abs_end long")
    e = spark.createDataFrame(events, "subject_id long, recording_id long, event_idx long, onset long, offset long, abs_onset long, abs_offset long")
    return r, e, recs, events


@pytest.mark.parametrize(("seed", "bucket"), [(1, 700), (2, 5000), (3, 10**6)])
def test_labels_and_distances_in_buckets(spark, seed, bucket):
    r, e, recs, events = tables(spark, seed)
    lead, horizon, after, width = 6000, 900, 2000, 1200
    rows = w.label_windows(w.grid(r, width, 600), e, r, lead, horizon, after, bucket=bucket)
    got = {(x["subject_id"], x["recording_id"], x["start_sec"]): x["label"] for x in rows.collect()}
    for (s, rec, start), label in got.items():
        own = [v for v in events if (v[0], v[1]) == (s, rec)]
        excluded = any(start < min(v[4] + after, 30_000) and start + width > v[3] for v in own)
        ahead = {t for v in own if v[3] >= lead for t in range(v[3] - lead, v[3] - horizon)}
        covered = sum(t in ahead for t in range(start, start + width))
        assert label == (-1 if excluded else 1 if covered == width else -1 if covered else 0)
    clocked = rows.withColumns({"abs_end": F.col("abs_start") + F.col("end_sec"), "abs_start": F.when(F.col("win_idx") != 3, F.col("abs_start") + F.col("start_sec"))})
    far = {(x["subject_id"], x["recording_id"], x["win_idx"]) for x in w.far_from_events(clocked, e, 1500, bucket).collect()}
    for x in clocked.collect():
        near = x["abs_start"] is not None and any(v[0] == x["subject_id"] and x["abs_start"] < v[6] + 1500 and x["abs_end"] > v[5] - 1500 for v in events)
        assert ((x["subject_id"], x["recording_id"], x["win_idx"]) in far) == (x["label"] == 1 or not near)


@pytest.mark.parametrize(("seed", "bucket"), [(1, 900), (4, 20_000)])
def test_clean_recordings_in_buckets(spark, seed, bucket):
    r, e, recs, events = tables(spark, seed)
    before, after = 15_000, 9000
    for x in w.clean_recordings(r, e, before, after, bucket).collect():
        hits = []
        for v in events:
            if v[0] == x["subject_id"]:
                if v[1] == x["recording_id"]:
                    hits.append((False, v[5], v[2], "has_event", 0.0))
                elif v[5] >= x["abs_end"] and v[5] - x["abs_end"] < before:
                    hits.append((True, v[5], v[2], "before_event", (v[5] - x["abs_end"]) / 3600))
                elif v[5] < x["abs_end"] and x["abs_start"] - v[6] < after:
                    hits.append((True, v[5], v[2], "after_event", (x["abs_start"] - v[6]) / 3600))
        want = min(hits)[3:] if hits else (None, None)
        assert (x["reason"], x["gap_hours"]) == want
