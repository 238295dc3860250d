"""Queries that compare methods, subjects and protocols, and on matrices and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigwarn.functions import r6, ratio, sigmoid
from sigwarn.operators import compare as c
from sigwarn.operators import metrics as m
from sigwarn.operators import ordered as o
from sigwarn.plans.evaluation import ALARMED, AREAS, BY, EVALUATE, EVENT_COLUMNS, EVENTS, alarmed, evaluated, events_of
from sigwarn.plans.labelling import BASE, GRID, LABELS, LEAD, ZONES, labelled
from sigwarn.plans.series import BLOCKS, LEVEL, blocked, level
from sigwarn.registry import query
from sigwarn.sources import results
from sigwarn.sources.tables import CELLS, INCIDENTS, SCORED, incidents, matrices

LEADS = (10_800, 21_600, 32_400)
METRICS = ["auc", "ap", "sensitivity", "specificity"]


def sweep_sql() -> str:
    one = "SELECT {lead}::INTEGER AS lead, label, count(*) AS windows FROM (WITH {body} SELECT label FROM labelled) GROUP BY label"
    return " UNION ALL ".join(one.format(lead=lead, body=f"{BASE}, {GRID}, {zones_sql(lead)}, {LABELS}") for lead in LEADS)


def zones_sql(lead: int) -> str:
    """ZONES with another lead; the time excluded after an event stays."""
    head, tail = ZONES.split("lz0 AS", 1)
    return head + "lz0 AS" + tail.replace(str(LEAD), str(lead))


@query(sweep_sql())
def b6_label_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for lead in LEADS:
        one = labelled(spark, sf_dir, lead).groupBy("label").agg(F.count(F.lit(1)).alias("windows")).select(F.lit(lead).alias("lead"), "label", "windows")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {EVALUATE}, p AS (SELECT subject_id, max(ap) FILTER (model = 'level') AS x, max(ap) FILTER (model = 'mixed') AS y FROM evald GROUP BY 1 HAVING count(*) = 2) SELECT subject_id, x AS ap_level, y AS ap_mixed, round(y - x, 6) AS delta FROM p WHERE (SELECT count(*) FROM p) >= 5")
def c5_paired_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir)
    pairs = c.paired(e.where("model = 'level'"), e.where("model = 'mixed'"), "subject_id", "ap")
    return pairs.select("subject_id", F.col("x").alias("ap_level"), F.col("y").alias("ap_mixed"), r6(F.col("y") - F.col("x")).alias("delta"))


@query(f"WITH {EVALUATE}, {INCIDENTS}, n AS (SELECT subject_id, count(*) AS n_incidents, count(DISTINCT recording_id) AS days FROM incidents GROUP BY 1) SELECT model, subject_id, auc, ap, n_incidents, days FROM evald JOIN n USING (subject_id)")
def c6_metrics_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = incidents(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_incidents"), F.countDistinct("recording_id").alias("days"))
    return evaluated(spark, sf_dir).join(n, "subject_id").select(*BY, "auc", "ap", "n_incidents", "days")


@query(f"WITH RECURSIVE {ALARMED}, {EVENTS}, {EVALUATE.removeprefix(SCORED + ', ')} SELECT model, subject_id, sensitivity, fpr_h_window, {EVENT_COLUMNS} FROM evald JOIN ev USING (model, subject_id)")
def c7_window_beside_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select(*BY, "sensitivity", "fpr_h_window").join(events_of(spark, sf_dir), BY)


@query(f"WITH RECURSIVE {ALARMED}, b AS (SELECT model, subject_id, block, avg(alarm) AS sens FROM ab WHERE block IS NOT NULL GROUP BY ALL) SELECT model, subject_id, count(*) AS folds, round(avg(sens), 6) AS mean_sensitivity, round(avg(CASE WHEN sens > 0 THEN 1.0 ELSE 0.0 END), 6) AS sens_event FROM b GROUP BY ALL")
def d19_event_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = alarmed(spark, sf_dir).where("block is not null").groupBy(*BY, "block").agg(F.avg("alarm").alias("sens"))
    return c.fold_summary(folds, BY, "sens").select(*BY, "folds", r6(F.col("mean")).alias("mean_sensitivity"), r6(F.col("share_positive")).alias("sens_event"))


@query(f"WITH {BLOCKS}, s AS (SELECT subject_id, count(*) AS rows, sum(label)::BIGINT AS positives, max(block) AS blocks FROM ab GROUP BY 1), e AS (SELECT subject_id, block, max(seq) AS last FROM ab WHERE block IS NOT NULL GROUP BY ALL), b AS (SELECT *, lag(last) OVER (PARTITION BY subject_id ORDER BY block) AS after FROM e), t AS (SELECT b.subject_id, b.block AS fold, count(*) AS test_rows, sum(label)::BIGINT AS test_positives FROM b JOIN ab ON ab.subject_id = b.subject_id AND ab.seq <= b.last AND ab.seq > coalesce(b.after, -1) GROUP BY ALL) SELECT subject_id, fold, rows - test_rows AS train_rows, positives - test_positives AS train_positives, test_rows, test_positives FROM t JOIN s USING (subject_id) WHERE blocks >= 2 AND rows - test_rows >= 10 AND test_rows >= 2 AND positives - test_positives BETWEEN 1 AND rows - test_rows - 1 AND test_positives BETWEEN 1 AND test_rows - 1")
def e14_leave_one_event_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.leave_one_event_out(blocked(spark, sf_dir), ["subject_id"], least_train=10, least_test=2, place="seq")


@query(f"WITH {LEVEL}, n AS (SELECT *, seq + 1 <= floor(round(count(*) OVER (PARTITION BY subject_id) * 0.6::DOUBLE, 9)) AS early FROM lv), t AS (SELECT subject_id, count(*) FILTER (early) AS own, count(*) FILTER (NOT early) AS test_rows FROM n GROUP BY 1), g AS (SELECT subject_id, own, test_rows, (SELECT count(*) FROM lv) - own - test_rows AS others FROM t) SELECT subject_id, v.variant, CASE v.variant WHEN 'cross' THEN others WHEN 'calibrated' THEN others + own ELSE own END::BIGINT AS train_rows, test_rows FROM g, (VALUES ('cross'), ('calibrated'), ('within')) AS v(variant)")
def e15_calibration_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.calibration_sizes(level(spark, sf_dir), "subject_id", 0.6)


RANKED = f"{EVALUATE}, rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ap NULLS LAST, subject_id) AS place FROM evald)"


@query(f"WITH {RANKED} SELECT model, place::INTEGER AS place, subject_id, ap, auc < 0.45 AS collapsed FROM rk WHERE place <= 5")
def f1_worst_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("model").orderBy(F.col("ap").asc_nulls_last(), "subject_id")
    return evaluated(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 5").select("model", "place", "subject_id", "ap", (F.col("auc") < 0.45).alias("collapsed"))


METHODS = f"{EVALUATE}, mt AS (SELECT model, avg(auc) AS auc, avg(ap) AS ap, avg(n_pos / (n_pos + n_neg)) AS prevalence FROM evald GROUP BY 1)"


@query(f"WITH {METHODS} SELECT model, round(ap, 6) AS ap, round(auc, 6) AS auc, row_number() OVER (ORDER BY round(ap, 6) DESC NULLS LAST, model)::INTEGER AS place FROM mt")
def f2_rank_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = evaluated(spark, sf_dir).groupBy("model").agg(r6(F.avg("ap")).alias("ap"), r6(F.avg("auc")).alias("auc"))
    return c.ranked(means, "ap", "model")


@query(f"""WITH {LEVEL}, s AS (SELECT *, row_number() OVER (PARTITION BY subject_id, label ORDER BY md5('tier|' || subject_id || '|' || seq), seq) AS h, count(*) OVER (PARTITION BY subject_id, label) AS nl, count(*) OVER (PARTITION BY subject_id) AS n FROM lv),
t AS (SELECT 'leaky' AS tier, prob, label FROM s WHERE h > floor(round(nl * 0.8::DOUBLE, 9)) UNION ALL SELECT 'rigorous', prob, label FROM s WHERE seq + 1 > floor(round(n * 0.8::DOUBLE, 9))),
    rk AS (SELECT *, rank() OVER (PARTITION BY tier ORDER BY prob) + (count(*) OVER (PARTITION BY tier, prob) - 1) / 2.0::DOUBLE AS r FROM t),
    a AS (SELECT tier, count(*) AS rows, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS auc FROM rk GROUP BY tier)
    SELECT row_number() OVER (ORDER BY tier, auc DESC)::INTEGER AS place, tier, rows, round(auc, 6) AS auc, round(max(auc) FILTER (tier = 'leaky') OVER () - max(auc) FILTER (tier = 'rigorous') OVER (), 6) AS gap FROM a""")
def f7_protocol_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = level(spark, sf_dir), ["subject_id"]
    leaky = o.stratified_split(rows, by, {"train": 0.8, "test": 0.2}, seed="tier").where("part = 'test'").select(F.lit("leaky").alias("tier"), "label", "prob")
    rigorous = o.position_split(rows, by).where("part = 'test'").select(F.lit("rigorous").alias("tier"), "label", "prob")
    both = leaky.unionByName(rigorous)
    areas = both.groupBy("tier").agg(F.count(F.lit(1)).alias("rows")).join(m.auc_ap(both, ["tier"]), "tier")
    whole = Window.partitionBy(F.lit(1))  # a row per tier
    best = lambda tier: F.max(F.when(F.col("tier") == tier, F.col("auc"))).over(whole)
    place = F.row_number().over(whole.orderBy("tier", F.desc("auc")))
    return areas.select(place.alias("place"), "tier", "rows", r6(F.col("auc")).alias("auc"), r6(best("leaky") - best("rigorous")).alias("gap"))


@query(f"WITH {LEVEL}, t AS (SELECT subject_id AS fold, count(*) AS test_rows, sum(label)::BIGINT AS test_positives FROM lv GROUP BY 1) SELECT fold, test_rows, test_positives, ((SELECT count(*) FROM lv) - test_rows)::BIGINT AS train_rows, ((SELECT sum(label) FROM lv) - test_positives)::BIGINT AS train_positives FROM t")
def g1_subject_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.fold_sizes(level(spark, sf_dir), "subject_id")


@query(f"WITH {INCIDENTS}, {LEVEL}, a AS (SELECT DISTINCT subject_id FROM lv WHERE label = 1), b AS (SELECT DISTINCT subject_id FROM incidents WHERE onset >= {LEAD}) SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, CASE WHEN b.subject_id IS NULL THEN 'first' WHEN a.subject_id IS NULL THEN 'second' ELSE 'both' END AS found FROM a FULL JOIN b ON a.subject_id = b.subject_id")
def g2_shared_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.shared(level(spark, sf_dir).where("label = 1"), incidents(spark, sf_dir).where(F.col("onset") >= LEAD), "subject_id")


@query(f"WITH {METHODS} SELECT model AS method, round(auc, 6) AS auc, round(ap, 6) AS ap, NULL::DOUBLE AS prevalence FROM mt UNION ALL SELECT 'chance', 0.5, NULL, round(avg(prevalence), 6) FROM mt")
def g3_stack_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir)
    ours = e.groupBy(F.col("model").alias("method")).agg(r6(F.avg("auc")).alias("auc"), r6(F.avg("ap")).alias("ap"))
    share = e.groupBy("model").agg(F.avg(ratio(F.col("n_pos"), F.col("n_pos") + F.col("n_neg"))).alias("p")).agg(r6(F.avg("p")).alias("prevalence"))
    return ours.unionByName(share.select(F.lit("chance").alias("method"), F.lit(0.5).alias("auc"), "prevalence"), allowMissingColumns=True)


@query(f"WITH {LEVEL}, z AS (SELECT subject_id, seq, prob * 8 - 4 AS margin FROM lv) SELECT subject_id, seq, round(1 / (1 + exp(-margin)), 6) AS squashed, round((margin - min(margin) OVER g) / (max(margin) OVER g - min(margin) OVER g + 1e-9), 6) AS scaled FROM z WINDOW g AS (PARTITION BY subject_id)")
def h1_squash_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = level(spark, sf_dir).withColumn("margin", F.col("prob") * 8 - 4), F.col("margin")
    ends = rows.groupBy("subject_id").agg(F.min("margin").alias("low"), F.max("margin").alias("high"))
    return rows.join(ends, "subject_id").select("subject_id", "seq", r6(sigmoid(x)).alias("squashed"), r6((x - F.col("low")) / (F.col("high") - F.col("low") + 1e-9)).alias("scaled"))


@query(f"WITH {CELLS} SELECT seq, (i * 7 + CASE WHEN j > i THEN j - 1 ELSE j END)::INTEGER AS place, round(a, 6) AS a FROM cells WHERE i <> j")
def h3_off_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.col("a"), lambda x, k: F.floor(k / F.col("n")) != k % F.col("n"))
    return matrices(spark, sf_dir).select("seq", F.posexplode(kept).alias("place", "a")).select("seq", "place", r6(F.col("a")).alias("a"))


@query(f"WITH {CELLS}, v AS (SELECT seq, 0 AS place, j, a FROM cells WHERE i = 2 UNION ALL SELECT seq, 8, i, a FROM cells WHERE j = 2) SELECT seq, (place + j)::INTEGER AS place, round(a, 6) AS a FROM v")
def h4_channel_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n, k = F.col("a"), F.col("n"), F.lit(2)
    row = F.slice(a, k * n + 1, n)
    column = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i * n + k))
    return matrices(spark, sf_dir).select("seq", F.posexplode(F.concat(row, column)).alias("place", "a")).select("seq", "place", r6(F.col("a")).alias("a"))


@query(f"WITH {CELLS} SELECT seq, 'row_' || i || '_ch' || j AS feature, round(a, 6) AS value FROM cells")
def h6_named_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.concat(F.lit("row_"), F.floor(k / 8).cast("string"), F.lit("_ch"), (k % 8).cast("string")))
    wide = matrices(spark, sf_dir).select("seq", F.map_from_arrays(names, "a").alias("features"))
    return wide.select("seq", F.explode("features").alias("feature", "value")).select("seq", "feature", r6(F.col("value")).alias("value"))


@query(f"WITH {EVALUATE}, p AS (SELECT round(auc, 1) AS c, CASE WHEN n_pos > 50 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM evald) SELECT name, value, count(*) AS folds FROM (SELECT 'C' AS name, c AS value FROM p UNION ALL SELECT 'weight', w FROM p) WHERE value IS NOT NULL GROUP BY ALL")
def h7_parameters_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.create_map(F.lit("C"), F.round("auc", 1), F.lit("weight"), F.when(F.col("n_pos") > 50, 1.0).otherwise(0.5))
    stored = evaluated(spark, sf_dir).select(F.to_json(chosen).alias("params"))
    return c.parameter_counts(stored, "params")


@query(f"WITH {CELLS}, f AS (SELECT seq, i AS ch, sum(abs(a)) AS v FROM cells WHERE i <> j GROUP BY ALL), t AS (SELECT seq, j AS ch, sum(abs(a)) AS v FROM cells WHERE i <> j GROUP BY ALL) SELECT f.seq, round(avg(f.v), 6) AS mean_degree, round(stddev_pop(t.v), 6) AS std_out, round(stddev_pop(f.v), 6) AS std_in, round(max(t.v - f.v), 6) AS top_flow FROM f JOIN t ON f.seq = t.seq AND f.ch = t.ch GROUP BY f.seq")
def i9_graph_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.degrees(matrices(spark, sf_dir), "seq").select("seq", *[r6(F.col(x)).alias(x) for x in ("mean_degree", "std_out", "std_in", "top_flow")])


@query(f"WITH {CELLS} SELECT x.seq, x.i::INTEGER AS i, y.i::INTEGER AS j, round(corr(x.a, y.a), 5) AS r FROM cells x JOIN cells y ON x.seq = y.seq AND x.j = y.j AND x.i < y.i GROUP BY ALL")
def i12_channel_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.row_correlations(matrices(spark, sf_dir), "seq", 8).select("seq", "i", "j", F.round("r", 5).alias("r"))


@query(f"WITH {LEVEL}, k AS (SELECT subject_id, label, count(*) AS n FROM lv GROUP BY ALL) SELECT subject_id, label, n AS rows, round((sum(n) OVER ())::DOUBLE / (n * count(*) OVER ()), 6) AS weight FROM k")
def j8_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.balanced_weights(level(spark, sf_dir), ["subject_id", "label"]).withColumn("weight", r6(F.col("weight")))


RELABELLED = f"{BLOCKS}, r AS (SELECT 'level' AS model, subject_id, prob, CASE WHEN block IS NOT NULL AND block_len - pos >= 1 THEN 0 ELSE label END AS label FROM ab)"


@query(f"WITH {RELABELLED}, {AREAS.replace('FROM scored', 'FROM r')} SELECT subject_id, round(auc, 6) AS auc, round(ap, 6) AS ap FROM areas")
def j13_rescore_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = m.auc_ap(o.relabel_last(blocked(spark, sf_dir), 1), ["subject_id"])
    return a.select("subject_id", r6(F.col("auc")).alias("auc"), r6(F.col("ap")).alias("ap"))


@query(f"WITH {EVALUATE}, {INCIDENTS}, n AS (SELECT subject_id, count(*) AS n FROM incidents GROUP BY 1) SELECT model, count(*) AS subjects, round(corr(auc, n), 5) AS r FROM evald JOIN n USING (subject_id) WHERE auc IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def j10_auc_against_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = incidents(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    both = evaluated(spark, sf_dir).where("auc is not null").join(n, "subject_id")
    return both.groupBy("model").agg(F.count(F.lit(1)).alias("subjects"), F.round(F.corr("auc", "n"), 5).alias("r")).where("subjects >= 3")


TABLE = f"{EVALUATE}, tb AS (SELECT subject_id::VARCHAR AS subject_id, auc, ap, sensitivity, specificity FROM evald WHERE model = 'level')"


@query(f"WITH {TABLE} SELECT * FROM tb UNION ALL SELECT 'MEAN', round(avg(auc), 4), round(avg(ap), 4), round(avg(sensitivity), 4), round(avg(specificity), 4) FROM tb UNION ALL SELECT 'STD', round(stddev_samp(auc), 4), round(stddev_samp(ap), 4), round(stddev_samp(sensitivity), 4), round(stddev_samp(specificity), 4) FROM tb")
def a7_result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.with_summary(evaluated(spark, sf_dir).where("model = 'level'"), "subject_id", METRICS)


@query(f"WITH {TABLE} SELECT * FROM tb")
def a8_read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = results.write_table(a7_result_table(spark, sf_dir))
    return results.read_table(spark, path, "subject_id", METRICS)


@query(f"WITH {LEVEL} SELECT subject_id, count(*) AS rows, round(avg(prob), 6) AS mean_prob FROM lv GROUP BY 1")
def a6_resumed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = level(spark, sf_dir)
    path = results.fresh_path(spark, "features")
    results.write_missing(rows.where("subject_id % 2 = 0"), path, "subject_id")
    results.write_missing(rows, path, "subject_id")
    return spark.read.parquet(path).groupBy(F.col("subject_id").cast("long").alias("subject_id")).agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("prob")).alias("mean_prob"))
