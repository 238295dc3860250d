from pyspark.sql import functions as F

from sigwarn.operators import metrics as m
from sigwarn.operators import ordered as o
from sigwarn.registry import QUERIES  # noqa: F401  registers the plans in their order
from sigwarn.plans import evaluation as e


def test_rows_meet_the_alarms_without_counting_votes_again(spark):
    """The votes of all rows were worked out three times: for candidates, for their entry and for the result."""
    rows = spark.createDataFrame([(s, i, float(i * (s + 2) % 7) / 7, 0) for s in (0, 1) for i in range(300)] + [(None, i, 1.0, 0) for i in range(30)], "subject_id long, seq long, prob double, label int")
    found = o.alarms(rows, ["subject_id"], 0.5, 3, 5, 20, chunk=64, place="seq")
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert set(found.columns) == {"subject_id", "seq", "prob", "label", "alarm"}
    held: dict = {}
    for r in found.orderBy("seq").collect():
        held.setdefault(r["subject_id"], []).append(r)
    assert {k: len(v) for k, v in held.items()} == {0: 300, 1: 300, None: 30}
    for series in held.values():
        want, blocked = [], 0
        for i in range(len(series)):
            vote = sum(r["prob"] >= 0.5 for r in series[max(0, i - 4) : i + 1]) >= 3
            want.append(int(vote and not blocked))
            blocked = 20 if want[-1] else max(0, blocked - 1)
        assert [r["alarm"] for r in series] == want


def test_scores_are_ordered_only_where_no_threshold_fits(spark, monkeypatch):
    """Youden's threshold, which needs all scores in order, was worked out for every group."""
    rates = {0: (0.9, 0.1), 1: (0.5, 0.97), 2: (0.99, 0.97), 3: (0.3, 0.02)}  # scores of positives and negatives
    rows = spark.createDataFrame([("x", s, i, int(i % 4 == 0), rates[s][int(i % 4 > 0)]) for s in rates for i in range(40)], "model string, subject_id long, seq long, label int, prob double")
    fits = m.operating_threshold(m.grid_rates(rows, e.BY, e.STEP), e.BY, e.TARGET)
    every = m.youden(m.roc_points(rows, e.BY), e.BY).select(*e.BY, F.col("threshold").alias("y"))
    clipped = F.least(F.greatest(F.coalesce("y", F.lit(0.95)), F.lit(0.05)), F.lit(0.95))
    want = {r["subject_id"]: r["t"] for r in fits.join(every, e.BY, "left").select("subject_id", F.coalesce("threshold", clipped).alias("t")).collect()}
    seen, plain = set(), m.roc_points

    def points(df, by):
        seen.update(r["subject_id"] for r in df.select("subject_id").distinct().collect())
        return plain(df, by)

    monkeypatch.setattr(m, "roc_points", points)
    got = {r["subject_id"]: r["threshold"] for r in e.thresholds(rows).collect()}
    assert got == want and seen == {1, 2}
