"""Protocols as fold assignments on one table, and the evaluation of what their folds score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.functions import ratio
from sigwarn.operators import curves as cv
from sigwarn.operators import metrics as m
from sigwarn.operators import ordered as o
from sigwarn.operators.prefix import numbered
from sigwarn.sources.results import stored

PROTOCOLS = ("left_out", "within_temporal", "within_random", "pooled_random", "event_left_out")


def assigned(rows: DataFrame, protocols: tuple[str, ...] = PROTOCOLS, share: float = 0.8) -> DataFrame:
    """Rows of every protocol with `protocol`, `pool` and `part`, as folds.fit_logistic() reads them.

    left_out: each subject by all others. within_temporal, within_random, pooled_random: the last rows of each subject, or
    rows drawn by class, by the others of the subject or of all subjects. event_left_out: the rows after the previous block of
    positives up to the end of a block, by all others of the subject. A row is there once a protocol, whatever the number of folds.
    """
    by, subject = ["subject_id"], F.col("subject_id").cast("string")
    tested = F.when(F.col("part") == "test", F.lit("test"))
    dealt = {
        "left_out": lambda: (rows, F.lit("all"), subject),
        "within_temporal": lambda: (o.position_split(rows, by, share), subject, tested),
        "within_random": lambda: (o.stratified_split(rows, by, {"train": share, "test": 1 - share}), subject, tested),
        "pooled_random": lambda: (o.stratified_split(rows, by, {"train": share, "test": 1 - share}), F.lit("all"), tested),
        "event_left_out": lambda: (o.event_parts(o.blocks(rows, by), by), subject, F.col("part").cast("string")),
    }
    out = None
    for name in protocols:
        df, pool, part = dealt[name]()
        one = df.select("subject_id", "seq", "label", "features", F.lit(name).alias("protocol"), F.concat_ws("|", F.lit(name), pool).alias("pool"), part.alias("part"))
        out = one if out is None else out.unionByName(one)
    return out


def calibrated(scored: DataFrame, by: list[str], step: float, target: float, k: int = 5, m_rows: int = 12, refractory: int = 180, width: int = 10, grid: list[float] | None = None) -> DataFrame:
    """auc, ap, threshold, sens_alarm, spec_alarm, fpr_per_hour, n_pos, n_neg of each group of scored(by, seq, label, prob).

    Scores are smoothed; the threshold is that of the grid with the largest sensitivity of alarms among those with at most
    target false alarms an hour, or Youden's, clipped to [0.05, 0.95]; sensitivity and specificity are those of alarm rows.
    """
    rows = numbered(scored.select(*by, "seq", "label", "prob"), by, out="_place").drop("_rows")
    smooth = o.smooth(rows, by, width=width, place="_place")
    smooth = stored(o.blocks(smooth.drop("prob").withColumnRenamed("smoothed", "prob"), by, place="_place"), "smoothed")
    counts = cv.alarm_counts(smooth, by, grid or cv.even_grid(), k, m_rows, refractory, place="_place")
    fits = m.operating_threshold(cv.alarm_rates(counts, by, step), by, target)
    fallback = m.youden(m.roc_points(smooth, by), by).select(*by, F.col("threshold").alias("_y"))
    clipped = F.least(F.greatest(F.coalesce("_y", F.lit(0.95)), F.lit(0.05)), F.lit(0.95))
    chosen = stored(fits.join(fallback, by, "left").select(*by, F.coalesce("threshold", clipped).alias("threshold")), "thresholds")
    alarmed = o.alarms(smooth.join(chosen, by), by, F.col("threshold"), k, m_rows, refractory, place="_place")
    level = m.confusion(alarmed, by, F.col("alarm") == 1)
    level = level.select(*by, F.col("sensitivity").alias("sens_alarm"), F.col("specificity").alias("spec_alarm"), ratio(F.col("fp"), (F.col("fp") + F.col("tn")) * step / 3600).alias("fpr_per_hour"), (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"))
    return m.auc_ap(smooth, by).join(chosen, by).join(level, by)


def over_folds(folds: DataFrame, by: list[str]) -> DataFrame:
    """n_folds, means of the folds of each group, and sens_event, the share of folds with any alarm on a positive row."""
    names = {"auc": "auc_mean", "ap": "ap_mean", "sens_alarm": "sens_mean", "fpr_per_hour": "fpr_h_mean"}
    return folds.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(n) for c, n in names.items()], F.avg((F.col("sens_alarm") > 0).cast("double")).alias("sens_event"))
