"""Queries on scored windows: metrics, thresholds, alarms, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigwarn.functions import hash_uniform, r6, ratio, two_sided_sql
from sigwarn.operators import metrics as m
from sigwarn.operators import ordered as o
from sigwarn.operators import statistics as st
from sigwarn.operators.curves import even_grid
from sigwarn.operators.permutation import permutation_test, shuffled_sql
from sigwarn.registry import query
from sigwarn.sources.results import stored
from sigwarn.sources.tables import SCORED, scored

BY = ["model", "subject_id"]
THRESHOLD, K, M, REFRACTORY, STEP, TARGET = 0.5, 3, 6, 20, 600, 1.0


def flag() -> Column:
    return F.col("prob") >= THRESHOLD


def alarm_sql(table: str = "scored", by: str = "model, subject_id", threshold: str = str(THRESHOLD), name: str = "alarmed") -> str:
    """Common table expressions down to `name`: the rows of table with alarm. Needs WITH RECURSIVE."""
    cols = [c.strip() for c in by.split(",")]
    same = " AND ".join(f"c.{c} = f.{c}" for c in cols)
    pick = ", ".join(f"c.{c}" for c in cols)
    return f"""{name}_v AS (SELECT *, sum(CASE WHEN prob >= {threshold} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY seq ROWS BETWEEN {M - 1} PRECEDING AND CURRENT ROW) >= {K} AS vote,
row_number() OVER (PARTITION BY {by} ORDER BY seq) - 1 AS rn FROM {table}),
{name}_f AS (SELECT {by}, min(rn) AS rn FROM {name}_v WHERE vote GROUP BY {by}
UNION ALL SELECT * FROM (SELECT {pick}, min(c.rn) AS rn FROM {name}_f f JOIN {name}_v c ON {same} AND c.vote AND c.rn > f.rn + {REFRACTORY} GROUP BY {pick})),
{name} AS (SELECT c.*, CASE WHEN f.rn IS NULL THEN 0 ELSE 1 END AS alarm FROM {name}_v c LEFT JOIN {name}_f f ON {same} AND c.rn = f.rn)"""


def block_sql(table: str, name: str, by: str = "model, subject_id") -> str:
    return f"""{name}_b AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY {by} ORDER BY seq), 0) <> 1 THEN 1 ELSE 0 END AS begins FROM {table}),
{name}_c AS (SELECT *, CASE WHEN label = 1 THEN sum(begins) OVER (PARTITION BY {by} ORDER BY seq) END::BIGINT AS block FROM {name}_b),
{name} AS (SELECT *, CASE WHEN label = 1 THEN row_number() OVER (PARTITION BY {by}, block ORDER BY seq) END AS pos, CASE WHEN label = 1 THEN count(*) OVER (PARTITION BY {by}, block) END AS block_len FROM {name}_c)"""


AREAS = """dst AS (SELECT model, subject_id, prob, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY ALL),
ct AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER g AS tot_p, sum(n) OVER g AS tot_n FROM dst
WINDOW g AS (PARTITION BY model, subject_id), w AS (PARTITION BY model, subject_id ORDER BY prob DESC)),
areas AS (SELECT model, subject_id, CASE WHEN max(tot_p) > 0 AND max(tot_n) > 0 THEN sum(n * (tp - p) + p * n / 2.0)::DOUBLE / (max(tot_p) * max(tot_n)) END AS auc,
CASE WHEN max(tot_p) > 0 AND max(tot_n) > 0 THEN sum(p * tp / (tp + fp)::DOUBLE) / max(tot_p) END AS ap FROM ct GROUP BY ALL)"""
CONFUSION = f"""cf AS (SELECT model, subject_id, count(*) FILTER (label = 1 AND prob >= {THRESHOLD}) AS tp, count(*) FILTER (label = 0 AND prob >= {THRESHOLD}) AS fp,
count(*) FILTER (label = 1 AND prob < {THRESHOLD}) AS fn, count(*) FILTER (label = 0 AND prob < {THRESHOLD}) AS tn FROM scored GROUP BY ALL),
cm AS (SELECT *, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS sensitivity, CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END AS specificity,
CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM cf)"""
EVENTS = """pb AS (SELECT model, subject_id, block, max(alarm) AS hit, sum(alarm) AS al, sum(CASE WHEN label = 0 THEN alarm ELSE 0 END) AS fa, sum(1 - label) AS r0 FROM ab GROUP BY ALL),
ev AS (SELECT model, subject_id, count(block) AS n_events, coalesce(sum(hit) FILTER (block IS NOT NULL), 0)::BIGINT AS events_hit, sum(al)::BIGINT AS n_alarms, sum(fa)::BIGINT AS n_false_alarms, sum(r0) AS r0 FROM pb GROUP BY ALL)"""
EVENT_COLUMNS = f"""n_events, events_hit, n_alarms, n_false_alarms, round(CASE WHEN n_events > 0 THEN events_hit::DOUBLE / n_events END, 6) AS event_sensitivity,
round(CASE WHEN r0 > 0 THEN n_false_alarms::DOUBLE / (r0 * {STEP} / 3600.0::DOUBLE) END, 6) AS fpr_h_event"""
ALARMED = f"{SCORED}, {alarm_sql()}, {block_sql('alarmed', 'ab')}"


def alarmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.blocks(stored(o.alarms(scored(spark, sf_dir), BY, THRESHOLD, K, M, REFRACTORY, place="seq"), "alarms"), BY, place="seq")


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.event_level(alarmed(spark, sf_dir), BY, STEP)
    return e.withColumn("event_sensitivity", r6(F.col("event_sensitivity"))).withColumn("fpr_h_event", r6(F.col("fpr_h_event")))


@query(f"WITH {SCORED}, {CONFUSION} SELECT model, subject_id, tp, fp, fn, tn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS f1, round((sensitivity + specificity) / 2, 6) AS balanced_accuracy FROM cm")
def d2_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = m.confusion(scored(spark, sf_dir), BY, flag())
    return c.select(*BY, "tp", "fp", "fn", "tn", *[r6(F.col(x)).alias(x) for x in ("sensitivity", "specificity", "precision", "f1", "balanced_accuracy")])


EVALUATE = f"""{SCORED}, {CONFUSION}, {AREAS}, evald AS (SELECT c.model, c.subject_id, round(auc, 4) AS auc, round(ap, 4) AS ap, round(sensitivity, 4) AS sensitivity, round(specificity, 4) AS specificity, round(precision, 4) AS precision,
round(f1, 4) AS f1, round((sensitivity + specificity) / 2, 4) AS balanced_accuracy, round(CASE WHEN fp + tn > 0 THEN fp / ((fp + tn) * {STEP} / 3600.0::DOUBLE) END, 4) AS fpr_h_window, tp + fn AS n_pos, fp + tn AS n_neg FROM cm c JOIN areas USING (model, subject_id))"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.evaluate(scored(spark, sf_dir), BY, flag(), STEP)


@query(f"WITH {EVALUATE} SELECT * FROM evald")
def d3_window_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir)


RATIOS = ("sensitivity", "specificity", "precision", "f1", "balanced_accuracy")
#: The last part of a statement on ab(model, subject_id, label, alarm).
ALARM_LEVEL = f"""SELECT model, subject_id, tp, fp, fn, tn, round(sn, 6) AS sensitivity, round(sp, 6) AS specificity, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1, round((sn + sp) / 2, 6) AS balanced_accuracy, round(CASE WHEN fp + tn > 0 THEN fp / ((fp + tn) * {STEP} / 3600.0::DOUBLE) END, 6) AS fpr_h
FROM (SELECT *, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS sn, CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END AS sp FROM
(SELECT model, subject_id, count(*) FILTER (label = 1 AND alarm = 1) AS tp, count(*) FILTER (label = 0 AND alarm = 1) AS fp, count(*) FILTER (label = 1 AND alarm = 0) AS fn, count(*) FILTER (label = 0 AND alarm = 0) AS tn FROM ab GROUP BY ALL))"""


@query(f"WITH RECURSIVE {ALARMED} {ALARM_LEVEL}")
def d4_alarm_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = m.confusion(alarmed(spark, sf_dir), BY, F.col("alarm") == 1)
    rate = ratio(F.col("fp"), (F.col("fp") + F.col("tn")) * STEP / 3600)
    return c.select(*BY, "tp", "fp", "fn", "tn", *[r6(F.col(x)).alias(x) for x in RATIOS], r6(rate).alias("fpr_h"))


@query(f"WITH {SCORED}, {AREAS} SELECT model, subject_id, round(auc, 6) AS auc FROM areas")
def d5_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.auc_ap(scored(spark, sf_dir), BY).select(*BY, r6(F.col("auc")).alias("auc"))


@query(f"WITH {SCORED}, {AREAS} SELECT model, subject_id, round(ap, 6) AS ap FROM areas")
def d6_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.auc_ap(scored(spark, sf_dir), BY).select(*BY, r6(F.col("ap")).alias("ap"))


POINTS = "pts AS (SELECT model, subject_id, prob AS threshold, tp::DOUBLE / tot_p AS tpr, fp::DOUBLE / tot_n AS fpr FROM ct WHERE tot_p > 0 AND tot_n > 0)"
YOUDEN = "yj AS (SELECT model, subject_id, threshold, round(tpr - fpr, 12) AS j, row_number() OVER (PARTITION BY model, subject_id ORDER BY round(tpr - fpr, 12) DESC, threshold DESC) AS k FROM pts), yo AS (SELECT model, subject_id, CASE WHEN j > 0 THEN threshold END AS threshold, greatest(j, 0.0) AS j FROM yj WHERE k = 1)"


@query(f"WITH {SCORED}, {AREAS}, {POINTS}, {YOUDEN} SELECT model, subject_id, round(threshold, 6) AS threshold, round(j, 6) AS j FROM yo")
def d7_youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = m.youden(m.roc_points(scored(spark, sf_dir), BY), BY)
    return y.select(*BY, r6(F.col("threshold")).alias("threshold"), r6(F.col("j")).alias("j"))


@query(f"WITH {SCORED}, {AREAS}, f AS (SELECT model, subject_id, prob, round(2 * tp / (tp + fp + tot_p)::DOUBLE, 12) AS f1 FROM ct WHERE tot_p > 0 AND tot_n > 0), g AS (SELECT *, row_number() OVER (PARTITION BY model, subject_id ORDER BY f1 DESC, prob DESC) AS k FROM f) SELECT model, subject_id, round(prob, 6) AS threshold, round(f1, 6) AS f1 FROM g WHERE k = 1")
def d7_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.best_f1(scored(spark, sf_dir), BY).select(*BY, r6(F.col("threshold")).alias("threshold"), r6(F.col("f1")).alias("f1"))


@query(f"WITH {SCORED}, {AREAS}, {POINTS} SELECT model, subject_id, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM pts")
def d7_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.roc_points(scored(spark, sf_dir), BY).select(*BY, *[r6(F.col(c)).alias(c) for c in ("threshold", "tpr", "fpr")])


@query(f"WITH {SCORED}, {AREAS}, {POINTS}, {YOUDEN}, h AS (SELECT model, subject_id, threshold, row_number() OVER (PARTITION BY model, subject_id ORDER BY fpr, threshold DESC) AS k FROM pts WHERE tpr >= 0.8) SELECT yo.model, yo.subject_id, round(coalesce(h.threshold, yo.threshold), 6) AS threshold FROM yo LEFT JOIN h ON yo.model = h.model AND yo.subject_id = h.subject_id AND h.k = 1")
def d8_recall_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.recall_target(m.roc_points(scored(spark, sf_dir), BY), BY, 0.8).select(*BY, r6(F.col("threshold")).alias("threshold"))


@query(f"WITH {SCORED}, {CONFUSION} SELECT model, subject_id, round(CASE WHEN fp + tn > 0 THEN fp / ((fp + tn) * {STEP} / 3600.0::DOUBLE) END, 6) AS fpr_h_window FROM cm")
def d9_window_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.window_fpr(scored(spark, sf_dir), BY, flag(), STEP).withColumn("fpr_h_window", r6(F.col("fpr_h_window")))


@query(f"WITH RECURSIVE {ALARMED}, {EVENTS} SELECT model, subject_id, n_events, events_hit, round(CASE WHEN n_events > 0 THEN events_hit::DOUBLE / n_events END, 6) AS event_sensitivity FROM ev")
def d10_event_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir).select(*BY, "n_events", "events_hit", "event_sensitivity")


@query(f"WITH RECURSIVE {ALARMED}, {EVENTS} SELECT model, subject_id, n_false_alarms, round(CASE WHEN r0 > 0 THEN n_false_alarms::DOUBLE / (r0 * {STEP} / 3600.0::DOUBLE) END, 6) AS fpr_h_event FROM ev")
def d11_event_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir).select(*BY, "n_false_alarms", "fpr_h_event")


@query(f"WITH RECURSIVE {ALARMED}, {EVENTS}, {AREAS} SELECT model, subject_id, round(auc, 6) AS auc, round(ap, 6) AS ap, {EVENT_COLUMNS} FROM ev JOIN areas USING (model, subject_id)")
def d12_event_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = m.auc_ap(scored(spark, sf_dir), BY).select(*BY, r6(F.col("auc")).alias("auc"), r6(F.col("ap")).alias("ap"))
    return events_of(spark, sf_dir).join(areas, BY)


SKILL = f"{SCORED}, {AREAS}, pv AS (SELECT model, subject_id, avg(label) AS prevalence FROM scored GROUP BY ALL), sk AS (SELECT model, subject_id, ap, prevalence, (ap - prevalence) / (1 - prevalence) AS skill FROM areas JOIN pv USING (model, subject_id))"


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    prev = s.groupBy(*BY).agg(F.avg("label").alias("prevalence"))
    return m.auc_ap(s, BY).join(prev, BY).withColumn("skill", m.skill(F.col("ap"), F.col("prevalence")))


@query(f"WITH {SKILL} SELECT model, subject_id, round(prevalence, 6) AS prevalence, round(skill, 6) AS skill FROM sk")
def d13_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir).select(*BY, r6(F.col("prevalence")).alias("prevalence"), r6(F.col("skill")).alias("skill"))


@query(f"WITH {SKILL} SELECT model, round(avg(skill), 6) AS skill_mean, round(stddev_pop(skill), 6) AS skill_std, round(median(skill), 6) AS skill_median FROM sk GROUP BY model")
def d13_skill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills(spark, sf_dir).groupBy("model").agg(r6(F.avg("skill")).alias("skill_mean"), r6(F.stddev_pop("skill")).alias("skill_std"), r6(F.percentile("skill", F.lit(0.5))).alias("skill_median"))


@query(f"WITH {SCORED}, c AS (SELECT model, subject_id, sum(label)::BIGINT AS n1, sum(1 - label)::BIGINT AS n0 FROM scored GROUP BY ALL) SELECT model, subject_id, n1, n0, round(n1::DOUBLE / (n1 + n0), 6) AS prevalence, round(CASE WHEN n1 + least(n0, 2 * n1, 5000) > 0 THEN n1::DOUBLE / (n1 + least(n0, 2 * n1, 5000)) ELSE 0 END, 6) AS prevalence_capped FROM c")
def d14_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = m.prevalence(scored(spark, sf_dir), BY, 2)
    return p.select(*BY, "n1", "n0", r6(F.col("prevalence")).alias("prevalence"), r6(F.col("prevalence_capped")).alias("prevalence_capped"))


EVERY = ("auc", "ap", *RATIOS, "fpr_h_window")


@query(f"WITH {EVALUATE} SELECT model, " + ", ".join(f"round(avg({x}), 6) AS {x}_mean, round(stddev_samp({x}), 6) AS {x}_std" for x in EVERY) + " FROM evald GROUP BY model")
def d15_method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).groupBy("model").agg(*[r6(f(x)).alias(f"{x}_{n}") for x in EVERY for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


@query(f"WITH RECURSIVE {ALARMED}, {EVENTS}, {CONFUSION} SELECT model, subject_id, round(CASE WHEN fp + tn > 0 THEN fp / ((fp + tn) * {STEP} / 3600.0::DOUBLE) END, 6) AS fpr_h_window, round(CASE WHEN r0 > 0 THEN n_false_alarms::DOUBLE / (r0 * {STEP} / 3600.0::DOUBLE) END, 6) AS fpr_h_event, round(CASE WHEN n_events > 0 THEN events_hit::DOUBLE / n_events END, 6) AS event_sensitivity FROM ev JOIN cm USING (model, subject_id)")
def d16_fpr_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = m.window_fpr(scored(spark, sf_dir), BY, flag(), STEP).withColumn("fpr_h_window", r6(F.col("fpr_h_window")))
    return events_of(spark, sf_dir).join(w, BY).select(*BY, "fpr_h_window", "fpr_h_event", "event_sensitivity")


@query(f"WITH {EVALUATE} SELECT model, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(ap) > 0 THEN corr(ap, n_pos) END, 6) AS r FROM evald WHERE ap IS NOT NULL GROUP BY model")
def d17_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pearson(evaluated(spark, sf_dir), "ap", "n_pos", ["model"])


SEEDED = ", ".join(f"('{s}')" for s in ("0", "1", "2", "3", "4"))


@query(f"WITH {SCORED}, u AS (SELECT s.seed, c.subject_id, c.label, c.event_id, ('0x' || substr(md5('chance' || s.seed || '|' || c.event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS prob FROM scored c, (VALUES {SEEDED}) AS s(seed) WHERE c.model = 'level'), v AS (SELECT seed, count(*) FILTER (label = 1 AND prob >= 0.5)::DOUBLE / count(*) FILTER (label = 1) AS sens FROM u GROUP BY seed) SELECT round(avg(sens), 6) AS sens_mean, round(stddev_pop(sens), 6) AS sens_std, count(*) AS seeds, string_agg(round(sens * 1000)::BIGINT::VARCHAR, ',' ORDER BY seed) AS per_mille FROM v")
def d18_seed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).where("model = 'level'").select("event_id", "label")
    runs = [s.withColumn("seed", F.lit(k)).withColumn("prob", hash_uniform(f"chance{k}", F.col("event_id"))) for k in range(5)]
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    one = every.groupBy("seed").agg(ratio(F.sum(F.when((F.col("prob") >= 0.5) & (F.col("label") == 1), 1).otherwise(0)), F.sum("label")).alias("sens"))
    return one.agg(r6(F.avg("sens")).alias("sens_mean"), r6(F.stddev_pop("sens")).alias("sens_std"), F.count(F.lit(1)).alias("seeds"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", F.round(F.col("sens") * 1000).cast("long").cast("string").alias("v")))), lambda x: x["v"]), ",").alias("per_mille"))


@query(f"WITH {SCORED}, h AS (SELECT *, CASE WHEN ('0x' || substr(md5('pool|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN 1 ELSE 0 END AS test FROM scored) SELECT model, subject_id, count(*) AS rows, count(*) FILTER (label = 1 AND prob >= {THRESHOLD}) AS tp, count(*) FILTER (label = 0 AND prob >= {THRESHOLD}) AS fp FROM h WHERE test = 1 GROUP BY GROUPING SETS ((model), (model, subject_id))")
def d21_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scored(spark, sf_dir).where(hash_uniform("pool", F.col("event_id")) < 0.2)
    return t.groupingSets([["model"], ["model", "subject_id"]], "model", "subject_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when((F.col("label") == 1) & flag(), 1)).alias("tp"), F.count(F.when((F.col("label") == 0) & flag(), 1)).alias("fp"))


@query(f"WITH RECURSIVE {ALARMED} SELECT model, subject_id, seq, alarm FROM ab")
def e4_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.alarms(scored(spark, sf_dir), BY, THRESHOLD, K, M, REFRACTORY, place="seq").select(*BY, "seq", "alarm")


GRID = f"g AS (SELECT round(0.05 + k * ((0.95 - 0.05) / 90), 9)::DOUBLE AS threshold FROM generate_series(0, 90) AS t(k)), gr AS (SELECT model, subject_id, threshold, count(*) FILTER (label = 1 AND prob >= threshold)::DOUBLE / greatest(count(*) FILTER (label = 1), 1) AS sens, CASE WHEN count(*) FILTER (label = 0) > 0 THEN count(*) FILTER (label = 0 AND prob >= threshold)::DOUBLE / (count(*) FILTER (label = 0) * {STEP} / 3600.0::DOUBLE) END AS fpr_h FROM scored, g GROUP BY ALL)"


@query(f"WITH {SCORED}, {GRID}, f AS (SELECT *, row_number() OVER (PARTITION BY model, subject_id ORDER BY sens DESC, threshold) AS k FROM gr WHERE fpr_h <= {TARGET}), s AS (SELECT DISTINCT model, subject_id FROM scored), {AREAS}, {POINTS}, {YOUDEN} SELECT s.model, s.subject_id, round(coalesce(f.threshold, least(greatest(coalesce(y.threshold, 0.95), 0.05), 0.95)), 6) AS threshold FROM s LEFT JOIN f ON f.model = s.model AND f.subject_id = s.subject_id AND f.k = 1 LEFT JOIN yo y ON y.model = s.model AND y.subject_id = s.subject_id")
def f4_operating_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds(scored(spark, sf_dir)).select(*BY, r6(F.col("threshold")).alias("threshold"))


def thresholds(s: DataFrame) -> DataFrame:
    """Operating threshold of each group at window level, else Youden's, clipped to [0.05, 0.95]."""
    found = stored(m.operating_threshold(m.grid_rates(s, BY, STEP), BY, TARGET), "fits")
    unfit = F.broadcast(found.where("threshold is null").select(*BY))  # a row per group at most
    y = m.youden(m.roc_points(s.join(unfit, BY, "left_semi"), BY), BY).select(*BY, F.col("threshold").alias("fallback"))
    clipped = F.least(F.greatest(F.coalesce("fallback", F.lit(0.95)), F.lit(0.05)), F.lit(0.95))
    return found.join(y, BY, "left").select(*BY, F.coalesce("threshold", clipped).alias("threshold"))


@query(f"WITH {SKILL}, o AS (SELECT model, subject_id, skill - lag(skill) OVER (PARTITION BY model ORDER BY subject_id) AS step FROM sk) SELECT model, bool_and(step >= 0) AS rising FROM o WHERE step IS NOT NULL GROUP BY model")
def f6_monotonic_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("skill") - F.lag("skill").over(Window.partitionBy("model").orderBy("subject_id"))
    return skills(spark, sf_dir).withColumn("step", step).where("step is not null").groupBy("model").agg(F.bool_and(F.col("step") >= 0).alias("rising"))


@query(f"WITH {SCORED}, {AREAS}, at1 AS (SELECT model, subject_id, prob, sum(label) AS p, count(*) AS t FROM scored GROUP BY ALL), rk AS (SELECT *, sum(t) OVER (PARTITION BY model, subject_id ORDER BY prob) - t + (t + 1) / 2.0::DOUBLE AS r, sum(p) OVER (PARTITION BY model, subject_id) AS n1, sum(t) OVER (PARTITION BY model, subject_id) AS n FROM at1), u AS (SELECT model, subject_id, sum(r * p) - max(n1) * (max(n1) + 1) / 2.0::DOUBLE AS u, max(n1)::DOUBLE AS n1, max(n - n1)::DOUBLE AS n0, max(n)::DOUBLE AS n, sum((t::DOUBLE * t * t - t)) AS ties FROM rk GROUP BY ALL) SELECT model, subject_id, round(u, 6) AS u, round((u - n1 * n0 / 2) / sd, 6) AS z, round(" + two_sided_sql("greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sd") + ", 5) AS p FROM (SELECT *, sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM u)")
def k5_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mann_whitney(scored(spark, sf_dir), BY).select(*BY, r6(F.col("u")).alias("u"), r6(F.col("z")).alias("z"), F.round("p", 5).alias("p"))


@query(f"WITH {SCORED}, at2 AS (SELECT model, subject_id, prob, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY ALL), cd AS (SELECT *, sum(p) OVER w / (sum(p) OVER g)::DOUBLE AS f1, sum(n) OVER w / (sum(n) OVER g)::DOUBLE AS f0, lead(prob) OVER w - prob AS dx FROM at2 WINDOW g AS (PARTITION BY model, subject_id), w AS (PARTITION BY model, subject_id ORDER BY prob)) SELECT model, subject_id, round(coalesce(sum(abs(f1 - f0) * dx), 0), 6) AS distance FROM cd GROUP BY ALL")
def k6_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.wasserstein(scored(spark, sf_dir), BY).select(*BY, r6(F.col("distance")).alias("distance"))


BOOT_N = 200


@query(f"WITH {SKILL}, nb AS (SELECT model, subject_id, skill, row_number() OVER (PARTITION BY model ORDER BY subject_id) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM sk), dr AS (SELECT b.i AS rep, x.model, ('0x' || substr(md5('boot|' || b.i || '|' || x.k), 1, 8))::BIGINT % x.n AS pick FROM nb x, generate_series(0, {BOOT_N - 1}) AS b(i)), mm AS (SELECT d.model, d.rep, avg(nb.skill) AS v FROM dr d JOIN nb ON nb.model = d.model AND nb.k = d.pick GROUP BY ALL) SELECT model, round(avg(v), 6) AS boot_mean, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM mm GROUP BY model")
def k2_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = st.bootstrap(skills(spark, sf_dir), "model", "subject_id", "skill", BOOT_N)
    return b.select("model", *[r6(F.col(c)).alias(c) for c in ("boot_mean", "ci_low", "ci_high")])


PERM_N = 1000


@query(f"""WITH {SCORED}, a AS (SELECT subject_id, seq, label, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS k FROM scored WHERE model = 'level'),
b AS (SELECT model, subject_id, row_number() OVER w AS k, rank() OVER (PARTITION BY model, subject_id ORDER BY prob) + (count(*) OVER (PARTITION BY model, subject_id, prob) - 1) / 2.0::DOUBLE AS mid,
rank() OVER (PARTITION BY model, subject_id ORDER BY prob DESC) + count(*) OVER (PARTITION BY model, subject_id, prob) - 1 AS reached FROM scored WINDOW w AS (PARTITION BY model, subject_id ORDER BY seq)),
z AS (SELECT subject_id, count(*) AS n, sum(label) AS p FROM a GROUP BY 1),
pm AS (SELECT g.i AS rep, a.subject_id, a.label, row_number() OVER (PARTITION BY g.i, a.subject_id ORDER BY {shuffled_sql('a.k', 'g.i', 'perm')}, a.k) AS k FROM a, generate_series(1, {PERM_N}) AS g(i)),
ps AS (SELECT rep, subject_id, k FROM pm WHERE label = 1 UNION ALL SELECT 0, subject_id, k FROM a WHERE label = 1),
rk AS (SELECT b.model, ps.rep, ps.subject_id, b.mid, b.reached, count(*) OVER (PARTITION BY b.model, ps.rep, ps.subject_id ORDER BY b.reached RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM ps JOIN b USING (subject_id, k)),
ar AS (SELECT model, rep, subject_id, (sum(mid) - max(p) * (max(p) + 1) / 2.0::DOUBLE) / (max(p) * (max(n) - max(p))) AS auc, sum(tp::DOUBLE / reached) / max(p) AS ap FROM rk JOIN z USING (subject_id) WHERE p < n GROUP BY ALL),
mn AS (SELECT model, rep, metric, round(avg(v), 9) AS v FROM (SELECT model, rep, 'auc' AS metric, auc AS v FROM ar UNION ALL SELECT model, rep, 'ap', ap FROM ar) GROUP BY ALL),
ob AS (SELECT model, metric, v AS observed FROM mn WHERE rep = 0)
SELECT model, metric, round(max(observed), 6) AS observed, round(avg(v), 6) AS null_mean, round(stddev_samp(v), 6) AS null_sd, round((count(*) FILTER (v >= observed) + 1)::DOUBLE / (count(*) + 1), 6) AS p FROM mn JOIN ob USING (model, metric) WHERE rep > 0 GROUP BY model, metric""")
def k1_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean areas of subjects beside those of 1000 permutations of labels inside subjects."""
    t = permutation_test(scored(spark, sf_dir), ["model"], "subject_id", PERM_N)
    return t.select("model", "metric", *[r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "null_sd", "p")])


K3_GRID = even_grid()


@query(f"WITH {SCORED}, g AS (SELECT unnest({K3_GRID})::DOUBLE AS threshold), r AS (SELECT threshold, count(*) FILTER (label = 1 AND prob >= threshold)::DOUBLE / count(*) FILTER (label = 1) AS sens, count(*) FILTER (label = 0 AND prob >= threshold)::DOUBLE / (count(*) FILTER (label = 0) * {STEP} / 3600.0::DOUBLE) AS fpr_h FROM scored, g WHERE model = 'level' GROUP BY ALL) SELECT round(threshold, 6) AS threshold, round(sens, 6) AS sens, round(fpr_h, 6) AS fpr_h, round(1 - exp(-fpr_h * 0.5), 6) AS random_sens FROM r")
def h5_random_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigwarn.functions import random_predictor

    g = m.grid_rates(scored(spark, sf_dir).where("model = 'level'").withColumn("one", F.lit(1)), ["one"], STEP)
    return g.select(r6(F.col("threshold")).alias("threshold"), r6(F.col("sens")).alias("sens"), r6(F.col("fpr_h")).alias("fpr_h"), r6(random_predictor(F.col("fpr_h"), F.lit(0.5))).alias("random_sens"))


@query(f"WITH {SCORED}, h AS (SELECT subject_id, label, ('0x' || substr(md5('uniform|' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM scored WHERE model = 'level'), pv AS (SELECT subject_id, avg(label) AS pr FROM h GROUP BY 1), s AS (SELECT 'uniform' AS baseline, subject_id, label, u >= 0.5 AS hit FROM h UNION ALL SELECT 'majority', h.subject_id, label, pr > 0.5 FROM h JOIN pv USING (subject_id) UNION ALL SELECT 'stratified', h.subject_id, label, u < pr FROM h JOIN pv USING (subject_id)) SELECT baseline, subject_id, count(*) FILTER (label = 1 AND hit) AS tp, count(*) FILTER (label = 0 AND hit) AS fp, count(*) FILTER (label = 1 AND NOT hit) AS fn, count(*) FILTER (label = 0 AND NOT hit) AS tn FROM s GROUP BY ALL")
def k7_chance_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.chance_scores(scored(spark, sf_dir).where("model = 'level'"), ["subject_id"], "event_id")
    return m.confusion(s, ["baseline", "subject_id"], F.col("hit")).select("baseline", "subject_id", "tp", "fp", "fn", "tn")
