"""Queries that train models: embeddings are the features of windows, their labels the subjects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarn.functions import micros, r6
from sigwarn.operators import folds as fd
from sigwarn.operators import graphs
from sigwarn.operators import margins as mg
from sigwarn.operators import models as d
from sigwarn.operators import ordered as o
from sigwarn.operators import probes as pb
from sigwarn.operators import protocols as pr
from sigwarn.operators import windows as w
from sigwarn.operators.metrics import auc_ap, skill
from sigwarn.plans.evaluation import K, M, REFRACTORY, TARGET
from sigwarn.plans.labelling import GAP, labelled
from sigwarn.plans.labelling import STEP as LABEL_STEP
from sigwarn.plans.labelling import WIDTH as WIDTH_SEC
from sigwarn.plans.series import block_events, blocked, level
from sigwarn.registry import query
from sigwarn.sources.results import stored
from sigwarn.sources.tables import CELLS, DAY, SUBJECTS, matrices, read

WIDTH = 64


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = matrices(spark, sf_dir).where(F.size("a") == WIDTH).where(~F.exists("a", lambda x: x.isNull() | F.isnan(x)))
    return whole.select("subject_id", "seq", "label", F.col("a").alias("features"))


def _left_out(name: str, doc: str, estimator: Callable[[], Estimator]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return d.leave_one_out(featured(spark, sf_dir), estimator())

    run.__name__, run.__doc__ = name, doc
    query()(run)


for _name, _doc, _estimator in (
    ("j3_forest", "Random forest.", d.forest),
    ("j4_boosted_trees", "Boosted trees.", d.boosted),
    ("j6_dense_network", "Dense network.", lambda: d.dense(WIDTH)),
):
    _left_out(_name, _doc, _estimator)


@query()
def j5_kernel_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin with a Gaussian kernel on features of landmarks."""
    return mg.leave_one_out(featured(spark, sf_dir))


@query(f"""WITH {CELLS}, s AS (SELECT DISTINCT subject_id AS fold FROM cells) SELECT fold, (i * 8 + j)::INTEGER AS feature, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std
FROM s JOIN cells ON cells.subject_id <> fold GROUP BY ALL""")
def j1_fold_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation by which each fold scales a feature, from its training rows alone."""
    rows = left_out(featured(spark, sf_dir))
    each = fd.fold_scalers(rows).select(F.col("part").alias("fold"), F.posexplode(F.arrays_zip("mean", "std")).alias("feature", "v"))
    return each.select("fold", "feature", r6(F.col("v.mean")).alias("mean"), r6(F.col("v.std")).alias("std"))


def left_out(rows: DataFrame) -> DataFrame:
    """Every subject's rows are scored by a model of all the others'."""
    return rows.select("subject_id", "seq", "label", "features", F.lit("all").alias("pool"), F.col("subject_id").alias("part"))


def fitted_scores(rows: DataFrame, **guards) -> DataFrame:
    """rows(pool, part, label, features, ...) that folds hold out, with prob: all folds are fitted together."""
    table = stored(rows, "folds")
    return fd.score(table, fd.fit_logistic(table, **guards))


@query()
def j2_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression with class weights."""
    return fitted_scores(left_out(featured(spark, sf_dir))).select("subject_id", "seq", "label", "prob")


@query()
def j7_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.grid_search(featured(spark, sf_dir), [0.01, 0.1, 1.0], 3)


SIDE, PROBE_FOLDS = 8, 3


def described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[int]]]:
    """(subject_id, seq, label, features): cells of each matrix and its descriptors; and the places of each group of features."""
    rows = featured(spark, sf_dir).withColumn("features", F.concat("features", graphs.descriptors(F.col("features"))))
    cells, groups = SIDE * SIDE, {}
    at = cells
    for name, size in {**{g: SIDE for g in graphs.GROUPS}, "scalars": len(graphs.SCALARS), "singular": graphs.SINGULAR}.items():
        groups[name] = list(range(at, at + size))
        at += size
    return rows, {"cells": list(range(cells)), "descriptors": list(range(cells, at))} | groups


def probed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, list[int]]]:
    """Recalls of the probes of all groups and channels (a channel: its row and column), the rows and the groups."""
    rows, groups = described(spark, sf_dir)
    table = stored(rows, "described")
    channels = {f"channel_{c}": sorted({c * SIDE + k for k in range(SIDE)} | {k * SIDE + c for k in range(SIDE)}) for c in range(SIDE)}
    dealt = pb.dealt(table, PROBE_FOLDS)
    return pb.recalls(dealt, pb.train(dealt, groups | channels, PROBE_FOLDS, tolerance=1e-4)), table, groups


@query()
def j9_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well groups of features and single channels tell subjects apart, from all rows."""
    return pb.identifiability(probed(spark, sf_dir)[0])


@query()
def j10_identifiability_against_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature group's identifiability beside the mean area of left-out subjects, and their correlation over groups."""
    told, rows, groups = probed(spark, sf_dir)
    width = max(max(p) for p in groups.values()) + 1
    # features outside the group are constant, so that one fit serves all groups
    only = lambda places: F.transform(F.arrays_zip(F.col("features"), F.lit([int(j in places) for j in range(width)]).alias("m")), lambda x: x["features"] * x["m"])
    masked = [only(set(places)) for places in groups.values()]
    each = rows.select("subject_id", "seq", "label", F.inline(F.array(*[F.struct(F.lit(g).alias("pool"), m.alias("features")) for g, m in zip(groups, masked, strict=True)])))
    scored = fitted_scores(each.withColumn("part", F.col("subject_id")))
    area = auc_ap(scored, ["pool", "subject_id"]).groupBy(F.col("pool").alias("probe")).agg(F.avg("auc").alias("lopo_auc"))
    both = pb.identifiability(told).join(area, "probe").select("probe", F.col("mean_acc").alias("identifiability"), "lopo_auc")
    return both.crossJoin(F.broadcast(both.agg(F.corr("identifiability", "lopo_auc").alias("r"))))  # one row


@query()
def j11_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.principal_components(featured(spark, sf_dir), 50)[1]


#: Sizes below which a left-out event isn't a fold.
LEAST_TRAIN, LEAST_TEST = 50, 30
TYPES = ("view", "click", "error", "purchase", "signup")


def window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, seq, label, features): labelled windows in order, without excluded ones, described by their events."""
    e = read(spark, sf_dir, "events")
    second = F.floor(micros(F.col("ts")) / F.lit(1_000_000))
    at = e.select((F.col("user_id") % SUBJECTS).alias("subject_id"), F.floor(second / DAY).cast("long").alias("recording_id"), F.pmod(second, F.lit(DAY)).alias("_at"), "event_type", "value")
    step = F.floor(F.col("_at") / LABEL_STEP)
    last, first = F.least(step, F.lit((DAY - WIDTH_SEC) // LABEL_STEP)), F.greatest(F.lit(0), F.floor((F.col("_at") - WIDTH_SEC) / LABEL_STEP) + 1)
    held = at.withColumn("win_idx", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))))).groupBy("subject_id", "recording_id", "win_idx")
    told = held.agg(*[F.count(F.when(F.col("event_type") == t, 1)).cast("double").alias(t) for t in TYPES], F.avg("value").alias("_mean"), F.max("value").alias("_max"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = labelled(spark, sf_dir).where("label <> -1").join(told, ["subject_id", "recording_id", "win_idx"], "left")
    features = F.array(*[zero(t) for t in TYPES], F.log1p(zero("_mean")), F.log1p(zero("_max")), (F.col("start_sec") / 3600).cast("double"))
    return rows.select("subject_id", (F.col("recording_id") * 100 + F.col("win_idx")).alias("seq"), "label", features.alias("features"))


@query()
def j12_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of each protocol over all its held-out rows. The folds of all protocols are fitted together."""
    scored = fitted_scores(pr.assigned(stored(window_table(spark, sf_dir), "windows")), least_train=LEAST_TRAIN, least_test=LEAST_TEST, both_tested=True)
    return auc_ap(scored, ["protocol"])


def event_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.assigned(stored(window_table(spark, sf_dir), "windows"), ("event_left_out",))
    scored = fitted_scores(rows, least_train=LEAST_TRAIN, least_test=LEAST_TEST, both_tested=True).withColumn("event_idx", F.col("part").cast("long"))
    return pr.calibrated(scored, ["subject_id", "event_idx"], LABEL_STEP, TARGET, K, M, REFRACTORY)


@query()
def j12_event_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every left-out event of a subject: smoothed scores, the operating threshold and its alarms."""
    return event_folds(spark, sf_dir)


@query()
def j12_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the left-out events of each subject, and the share of events that an alarm anticipates."""
    return pr.over_folds(event_folds(spark, sf_dir), ["subject_id"])


@query()
def j14_leads_against_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean areas and skill of subjects, on all blocks and on leads alone, and what changes."""
    whole = blocked(spark, sf_dir)
    values = level(spark, sf_dir).select("subject_id", "seq", F.array("prob", (F.col("t_us") / 3.6e9 % 24).cast("double")).alias("features"))
    leads = w.lead_only(whole, o.classify_leads(block_events(whole), ["subject_id"], GAP, 0), ["subject_id"])
    variants = [rows.select("subject_id", "seq", "label", F.lit(name).alias("pool")) for name, rows in (("all", whole), ("lead", leads))]
    rows = variants[0].unionByName(variants[1]).join(values, ["subject_id", "seq"]).withColumn("part", F.col("subject_id"))
    scored = fitted_scores(rows).withColumnRenamed("pool", "variant")
    share = scored.groupBy("variant", "subject_id").agg(F.avg("label").alias("prevalence"))
    each = auc_ap(scored, ["variant", "subject_id"]).join(share, ["variant", "subject_id"]).withColumn("skill", skill(F.col("ap"), F.col("prevalence")))
    out = each.groupBy("variant").agg(*[F.avg(c).alias(c) for c in ("auc", "ap", "skill")]).withColumn("_g", F.lit(1))
    value = lambda c, v: F.max(F.when(F.col("variant") == v, F.col(c)))
    return out.groupBy("_g").agg(*[e for c in ("auc", "ap", "skill") for e in (value(c, "all").alias(f"{c}_all"), value(c, "lead").alias(f"{c}_lead"), (value(c, "lead") - value(c, "all")).alias(f"{c}_change"))]).drop("_g")
