"""Queries on alarms along a grid of thresholds, and on methods beside the best one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigwarn.functions import r6, random_predictor, ratio
from sigwarn.operators import curves as cv
from sigwarn.operators import metrics as m
from sigwarn.operators import ordered as o
from sigwarn.operators import statistics as st
from sigwarn.plans.evaluation import (
    AREAS, ALARM_LEVEL, BY, EVALUATE, EVENT_COLUMNS, EVENTS, GRID, K, M, POINTS, RATIOS, REFRACTORY, STEP, TARGET, YOUDEN, alarm_sql, block_sql, evaluated, flag, thresholds,
)
from sigwarn.registry import query
from sigwarn.sources.results import stored
from sigwarn.sources.tables import SCORED, scored

LEAD_HOURS = 25 / 60


def grid_sql(grid: list[float], table: str = "scored") -> str:
    """cn(model, subject_id, threshold, tp, fp, n1, n0, n_events, events_hit): alarms of each threshold, by recursion."""
    by = "model, subject_id, threshold"
    return f"""gs AS (SELECT t.threshold, s.* FROM {table} s, (SELECT unnest({grid})::DOUBLE AS threshold) t), {alarm_sql('gs', by, 'threshold', 'ga')}, {block_sql('ga', 'gb', by)},
gp AS (SELECT model, subject_id, threshold, block, max(alarm) AS hit, sum(alarm * label) AS tp, sum(alarm * (1 - label)) AS fp, sum(label) AS n1, sum(1 - label) AS n0 FROM gb GROUP BY ALL),
cn AS (SELECT model, subject_id, threshold, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(n1)::BIGINT AS n1, sum(n0)::BIGINT AS n0, count(block) AS n_events, coalesce(sum(hit) FILTER (block IS NOT NULL), 0)::BIGINT AS events_hit FROM gp GROUP BY ALL)"""


def counted(spark: SparkSession, sf_dir: str, points: int = 91) -> DataFrame:
    return cv.alarm_counts(stored(o.blocks(scored(spark, sf_dir), BY, place="seq"), "blocks"), BY, cv.even_grid(points=points), K, M, REFRACTORY, place="seq")


@query(f"""WITH RECURSIVE {SCORED}, {grid_sql(cv.even_grid())}, f AS (SELECT *, row_number() OVER (PARTITION BY model, subject_id ORDER BY tp::DOUBLE / greatest(n1, 1) DESC, threshold) AS k FROM cn WHERE n0 > 0 AND fp / (n0 * {STEP} / 3600.0::DOUBLE) <= {TARGET}),
s AS (SELECT DISTINCT model, subject_id FROM scored), {AREAS}, {POINTS}, {YOUDEN} SELECT s.model, s.subject_id, round(coalesce(f.threshold, least(greatest(coalesce(y.threshold, 0.95), 0.05), 0.95)), 6) AS threshold FROM s LEFT JOIN f ON f.model = s.model AND f.subject_id = s.subject_id AND f.k = 1 LEFT JOIN yo y ON y.model = s.model AND y.subject_id = s.subject_id""")
def f4_alarm_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operating threshold where sensitivity and false alarms are those of alarms."""
    found = m.operating_threshold(cv.alarm_rates(counted(spark, sf_dir), BY, STEP), BY, TARGET)
    y = m.youden(m.roc_points(scored(spark, sf_dir), BY), BY).select(*BY, F.col("threshold").alias("fallback"))
    clipped = F.least(F.greatest(F.coalesce("fallback", F.lit(0.95)), F.lit(0.05)), F.lit(0.95))
    return found.join(y, BY, "left").select(*BY, r6(F.coalesce("threshold", clipped)).alias("threshold"))


@query(f"""WITH RECURSIVE {SCORED}, {grid_sql(cv.even_grid())}, f AS (SELECT *, row_number() OVER (PARTITION BY model, subject_id ORDER BY events_hit::DOUBLE / n_events DESC, threshold) AS k FROM cn WHERE n_events > 0 AND n0 > 0 AND fp / (n0 * {STEP} / 3600.0::DOUBLE) <= {TARGET}), s AS (SELECT DISTINCT model, subject_id FROM scored),
nx AS (SELECT *, coalesce(lead(subject_id) OVER (PARTITION BY model ORDER BY subject_id), min(subject_id) OVER (PARTITION BY model)) AS other FROM s) SELECT nx.model, nx.subject_id, nx.other, round(coalesce(f.threshold, 0.5), 6) AS threshold FROM nx LEFT JOIN f ON f.model = nx.model AND f.subject_id = nx.other AND f.k = 1""")
def f5_borrowed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with the largest event sensitivity on the next subject, for each subject; 0.5 where none fits."""
    rates = cv.alarm_rates(counted(spark, sf_dir), BY, STEP, events=True)
    fits = m.operating_threshold(rates.where("sens is not null"), BY, TARGET)
    w = Window.partitionBy("model")
    ring = rates.select(*BY).distinct().select(*BY, F.coalesce(F.lead("subject_id").over(w.orderBy("subject_id")), F.min("subject_id").over(w)).alias("other"))
    lent = fits.select("model", F.col("subject_id").alias("other"), "threshold")
    return ring.join(lent, ["model", "other"], "left").select(*BY, "other", r6(F.coalesce("threshold", F.lit(0.5))).alias("threshold"))


@query(f"WITH RECURSIVE {SCORED}, {grid_sql(cv.even_grid(points=37))} SELECT model, round(threshold, 6) AS threshold, round(sum(events_hit)::DOUBLE / greatest(sum(n_events), 1), 6) AS event_sensitivity, round(sum(fp) / (sum(n0) * {STEP} / 3600.0::DOUBLE), 6) AS fpr_h, round(1 - exp(-sum(fp) / (sum(n0) * {STEP} / 3600.0::DOUBLE) * {LEAD_HOURS}::DOUBLE), 6) AS random_sensitivity FROM cn GROUP BY model, threshold")
def k3_operating_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sensitivity and false alarms an hour, pooled over subjects, at 37 thresholds, beside alarms at random."""
    pooled = counted(spark, sf_dir, 37).groupBy("model", "threshold").agg(F.sum("events_hit").alias("hit"), F.sum("n_events").alias("n"), F.sum("fp").alias("fp"), F.sum("tn").alias("tn"))
    rate = ratio(F.col("fp"), (F.col("fp") + F.col("tn")) * STEP / 3600)
    return pooled.select("model", r6(F.col("threshold")).alias("threshold"), r6(ratio(F.col("hit"), F.greatest("n", F.lit(1)))).alias("event_sensitivity"), r6(rate).alias("fpr_h"), r6(random_predictor(rate, F.lit(LEAD_HOURS))).alias("random_sensitivity"))


SMOOTHED = "sm AS (SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY model, subject_id) < 10 THEN prob ELSE sum(prob) OVER (PARTITION BY model, subject_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 END AS prob) FROM scored)"
PICKED = f"""f AS (SELECT *, row_number() OVER (PARTITION BY model, subject_id ORDER BY sens DESC, threshold) AS k FROM gr WHERE fpr_h <= {TARGET}), s AS (SELECT DISTINCT model, subject_id FROM scored), {AREAS}, {POINTS}, {YOUDEN}
SELECT s.model, s.subject_id, coalesce(f.threshold, least(greatest(coalesce(y.threshold, 0.95), 0.05), 0.95)) AS threshold, least(greatest(coalesce(y.threshold, 0.95), 0.05), 0.95) AS youden FROM s LEFT JOIN f ON f.model = s.model AND f.subject_id = s.subject_id AND f.k = 1 LEFT JOIN yo y ON y.model = s.model AND y.subject_id = s.subject_id"""
CALIBRATED = f"""{SCORED}, {SMOOTHED}, th AS (WITH {GRID.replace('scored', 'sm')}, {PICKED.replace('scored', 'sm')}), rw AS (WITH {GRID}, {PICKED}),
sx AS (SELECT sm.*, th.threshold FROM sm JOIN th USING (model, subject_id)), {alarm_sql('sx', threshold='threshold')}, {block_sql('alarmed', 'ab')}"""


@query(f"WITH RECURSIVE {CALIBRATED}, {EVENTS}, lev AS ({ALARM_LEVEL}), ex AS (SELECT model, subject_id, {EVENT_COLUMNS} FROM ev), wn AS (SELECT model, subject_id, count(*) FILTER (label = 1 AND prob >= youden) AS w_tp, count(*) FILTER (label = 0 AND prob >= youden) AS w_fp, count(*) FILTER (label = 1) AS w_n1, count(*) FILTER (label = 0) AS w_n0 FROM scored JOIN rw USING (model, subject_id) GROUP BY ALL) SELECT lev.model, lev.subject_id, round(th.threshold, 6) AS threshold, lev.sensitivity, lev.specificity, lev.precision, lev.f1, lev.fpr_h, ex.n_events, ex.events_hit, ex.event_sensitivity, round(rw.youden, 6) AS window_threshold, round(CASE WHEN w_n1 > 0 THEN w_tp::DOUBLE / w_n1 ELSE 0 END, 6) AS window_sensitivity, round(CASE WHEN w_n0 > 0 THEN w_fp / (w_n0 * {STEP} / 3600.0::DOUBLE) END, 6) AS window_fpr_h FROM lev JOIN ex USING (model, subject_id) JOIN th USING (model, subject_id) JOIN rw USING (model, subject_id) JOIN wn USING (model, subject_id)")
def f8_calibrated_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing, the operating threshold of the smoothed scores and its alarms, beside raw scores at Youden's threshold."""
    both = stored(o.smooth(scored(spark, sf_dir), BY, place="seq").select(*BY, "seq", "label", "prob", "smoothed"), "smoothed")
    raw, smooth = both.drop("smoothed"), both.drop("prob").withColumnRenamed("smoothed", "prob")
    chosen = stored(thresholds(smooth), "thresholds")
    alarmed = o.alarms(smooth.join(F.broadcast(chosen), BY), BY, F.col("threshold"), K, M, REFRACTORY, place="seq")  # a row per series
    alarmed = stored(alarmed.select(*BY, "seq", "label", "alarm"), "alarms")
    flagged = stored(o.blocks(alarmed, BY, place="seq").select(*BY, "label", "alarm", "block"), "flagged")
    level, events = m.confusion(flagged, BY, F.col("alarm") == 1), m.event_level(flagged, BY, STEP)
    y = m.youden(m.roc_points(raw, BY), BY).select(*BY, F.col("threshold").alias("_y"))
    at = raw.join(y, BY, "left").withColumn("window_threshold", F.least(F.greatest(F.coalesce("_y", F.lit(0.95)), F.lit(0.05)), F.lit(0.95)))
    windows = m.confusion(at, [*BY, "window_threshold"], F.col("prob") >= F.col("window_threshold"))
    hours = lambda: (F.col("fp") + F.col("tn")) * STEP / 3600
    windows = windows.select(*BY, r6(F.col("window_threshold")).alias("window_threshold"), r6(F.col("sensitivity")).alias("window_sensitivity"), r6(ratio(F.col("fp"), hours())).alias("window_fpr_h"))
    level = level.select(*BY, *[r6(F.col(x)).alias(x) for x in RATIOS if x != "balanced_accuracy"], r6(ratio(F.col("fp"), hours())).alias("fpr_h"))
    events = events.select(*BY, "n_events", "events_hit", r6(F.col("event_sensitivity")).alias("event_sensitivity"))
    return level.join(events, BY).join(windows, BY).join(chosen.withColumn("threshold", r6(F.col("threshold"))), BY)


#: The two scoring rules and a third that knows nothing.
THREE = SCORED.replace("scored AS (", "scored AS (SELECT 'noise' AS model, subject_id, seq, event_id, t_us, label, (event_id * 6007 % 1000) / 1000.0::DOUBLE AS prob FROM e1 UNION ALL ")
#: Needs df(model, metric, d): pv has the exact p of the signed ranks of d, zeros ranked too.
EXACT = """rk AS (SELECT model, metric, d, 2 * rank() OVER (PARTITION BY model, metric ORDER BY abs(d)) + count(*) OVER (PARTITION BY model, metric, abs(d)) - 1 AS r2 FROM df WHERE d IS NOT NULL),
nz AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY r2) AS k, sum(r2) FILTER (d > 0) OVER (PARTITION BY model, metric) AS w2, count(*) OVER (PARTITION BY model, metric) AS kk FROM rk WHERE d <> 0),
dp AS (SELECT DISTINCT model, metric, 0::BIGINT AS k, 0::BIGINT AS s, 1.0::DOUBLE AS w FROM nz UNION ALL SELECT * FROM (SELECT p.model, p.metric, nz.k, (p.s + c.b * nz.r2)::BIGINT AS s, sum(p.w / 2) AS w FROM dp p JOIN nz ON nz.model = p.model AND nz.metric = p.metric AND nz.k = p.k + 1, (VALUES (0), (1)) AS c(b) GROUP BY ALL)),
pv AS (SELECT model, metric, least(1.0, 2 * least(sum(w) FILTER (s >= w2), sum(w) FILTER (s <= w2))) AS p FROM dp JOIN (SELECT DISTINCT model, metric, kk, coalesce(w2, 0) AS w2 FROM nz) z USING (model, metric) WHERE k = kk GROUP BY ALL)"""
COMPARED = ["auc", "ap", "sensitivity", "fpr_h_window"]


@query(f"""WITH RECURSIVE {THREE}, {EVALUATE.removeprefix(SCORED + ', ')}, mn AS (SELECT model, avg(ap) AS a FROM evald GROUP BY 1), bs AS (SELECT model AS top FROM mn ORDER BY a DESC, model LIMIT 1),
pr AS (SELECT e.*, b.auc AS b_auc, b.ap AS b_ap FROM evald e JOIN evald b ON b.subject_id = e.subject_id AND b.model = (SELECT top FROM bs)), df AS (SELECT model, 'auc' AS metric, round(b_auc - auc, 12) AS d FROM pr UNION ALL SELECT model, 'ap', round(b_ap - ap, 12) FROM pr), {EXACT},
ag AS (SELECT model, count(*) AS n, {', '.join(f'round(avg({x}), 6) AS {x}_mean, round(stddev_samp({x}), 6) AS {x}_std' for x in COMPARED)} FROM pr GROUP BY 1 HAVING count(*) >= 5)
SELECT ag.*, round((SELECT p FROM pv WHERE pv.model = ag.model AND metric = 'auc'), 6) AS p_auc, round((SELECT p FROM pv WHERE pv.model = ag.model AND metric = 'ap'), 6) AS p_ap FROM ag""")
def k8_against_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of methods, and how likely their difference from the best one is by chance."""
    s = scored(spark, sf_dir)
    noise = s.where("model = 'level'").withColumns({"model": F.lit("noise"), "prob": (F.col("event_id") * 6007 % 1000) / F.lit(1000.0)})
    table = m.evaluate(s.unionByName(noise), BY, flag(), STEP)
    out = st.against_best(table, "model", "subject_id", COMPARED, "ap", ["auc", "ap"])
    return out.select("model", "n", *[r6(F.col(c)).alias(c) for c in out.columns if c not in ("model", "n")])


@query(f"WITH RECURSIVE {EVALUATE}, df AS (SELECT 'x' AS model, 'ap' AS metric, round(a.ap - b.ap, 12) AS d FROM evald a JOIN evald b ON a.subject_id = b.subject_id AND a.model = 'mixed' AND b.model = 'level' WHERE round(a.ap - b.ap, 12) <> 0), {EXACT} SELECT count(*) AS n, round(coalesce(sum(r2) FILTER (d > 0), 0) / 2.0::DOUBLE, 6) AS w_plus, round(coalesce(sum(r2) FILTER (d < 0), 0) / 2.0::DOUBLE, 6) AS w_minus, round((SELECT p FROM pv), 6) AS p FROM rk")
def k4_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir)
    pairs = e.where("model = 'mixed'").select("subject_id", F.col("ap").alias("x")).join(e.where("model = 'level'").select("subject_id", F.col("ap").alias("y")), "subject_id")
    return st.wilcoxon(pairs, "x", "y").select("n", *[r6(F.col(c)).alias(c) for c in ("w_plus", "w_minus", "p")])
