"""Exact window-level and event-level metrics, thresholds and summaries.

`by` names the columns of a group. Scores are aggregated to distinct values before they are ordered, so the ordered
part has a row per distinct score. Undefined window ratios are 0, undefined event ratios and areas are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.functions import r6, ratio
from sigwarn.operators.prefix import join_null_safe
from sigwarn.sources.results import stored


def confusion(df: DataFrame, by: list[str], flag: Column, label: str = "label") -> DataFrame:
    """tp, fp, fn, tn, sensitivity, specificity, precision, f1, balanced_accuracy of each group."""
    y, hit = F.col(label) == 1, flag
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = df.groupBy(*by).agg(n(y & hit).alias("tp"), n(~y & hit).alias("fp"), n(y & ~hit).alias("fn"), n(~y & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumn("sensitivity", ratio(tp, tp + fn, 0.0)).withColumn("specificity", ratio(tn, tn + fp, 0.0)).withColumn("precision", ratio(tp, tp + fp, 0.0))
    return out.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn, 0.0)).withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def score_counts(df: DataFrame, by: list[str], label: str = "label", value: str = "prob") -> DataFrame:
    """p and n (positives and negatives) at each distinct score, all_p and all_n of the group, tp and fp at or above the score.

    Scores are dealt out by ranges, each of which is totalled and starts from the totals above it, so a group is the work of many tasks.
    """
    at = df.groupBy(*by, value).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    rows = stored(at.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "counts")
    series, own = Window.partitionBy(*by), Window.partitionBy(*by, "_range").orderBy(F.desc(value))
    above = series.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # a row per range that the group reaches into
    whole = {"all_p": F.sum("_p").over(series), "all_n": F.sum("_n").over(series)}
    handed = parts.select(*by, "_range", *[c.alias(k) for k, c in whole.items()], *[F.sum(c).over(above).alias(f"_above{c}") for c in ("_p", "_n")])
    met = join_null_safe(rows, handed, [*by, "_range"])
    total = lambda high, low: F.coalesce(high + low, high, low)
    return met.withColumns({"tp": total(F.col("_above_p"), F.sum("p").over(own)), "fp": total(F.col("_above_n"), F.sum("n").over(own))}).drop("_range", "_above_p", "_above_n")


def auc_ap(df: DataFrame, by: list[str], label: str = "label", value: str = "prob") -> DataFrame:
    """auc (ties count half) and ap (sum of precision over steps of recall); null where a class is missing."""
    c = score_counts(df, by, label, value)
    both = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    above = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("p") * F.col("n") / 2.0)
    steps = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    return c.groupBy(*by).agg(F.when(both, above / (F.max("all_p") * F.max("all_n"))).alias("auc"), F.when(both, steps / F.max("all_p")).alias("ap"))


def roc_points(df: DataFrame, by: list[str], label: str = "label", value: str = "prob") -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score of groups with both classes; the origin, above all scores, is not a row."""
    c = score_counts(df, by, label, value).where("all_p > 0 and all_n > 0")
    return c.select(*by, F.col(value).alias("threshold"), (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("fp") / F.col("all_n")).alias("fpr"))


def youden(points: DataFrame, by: list[str]) -> DataFrame:
    """threshold of the first largest tpr - fpr as scores fall; null for the origin, where no score does better than it."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    best = points.groupBy(*by).agg(F.max(F.struct(j.alias("j"), F.col("threshold"))).alias("b"))
    return best.select(*by, F.when(F.col("b.j") > 0, F.col("b.threshold")).alias("threshold"), F.greatest(F.col("b.j"), F.lit(0.0)).alias("j"))


def best_f1(df: DataFrame, by: list[str], label: str = "label", value: str = "prob") -> DataFrame:
    """threshold of the largest F1; of equal ones the highest."""
    c = score_counts(df, by, label, value).where("all_p > 0 and all_n > 0")
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_p")), 12)
    return c.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), F.col(value).alias("threshold"))).alias("b")).select(*by, "b.threshold", "b.f1")


def recall_target(points: DataFrame, by: list[str], target: float) -> DataFrame:
    """The threshold of the lowest fpr with tpr at or above the target, ties to the higher threshold; else Youden's."""
    fits = points.where(F.col("tpr") >= target).groupBy(*by).agg(F.min(F.struct("fpr", (-F.col("threshold")).alias("t"))).alias("b"))
    return youden(points, by).withColumnRenamed("threshold", "fallback").join(fits, by, "left").select(*by, F.coalesce(-F.col("b.t"), F.col("fallback")).alias("threshold"))


def window_fpr(df: DataFrame, by: list[str], flag: Column, step: float, label: str = "label") -> DataFrame:
    """False positive rows per hour of negative rows."""
    y0 = F.col(label) == 0
    return df.groupBy(*by).agg(ratio(F.sum((flag & y0).cast("long")), F.sum(y0.cast("long")) * step / 3600).alias("fpr_h_window"))


def event_level(alarmed: DataFrame, blocked_by: list[str], step: float, label: str = "label") -> DataFrame:
    """n_events, events_hit, event_sensitivity, fpr_h_event, n_alarms, n_false_alarms of each group; alarmed has alarm and block."""
    y0 = F.col(label) == 0
    per_block = alarmed.groupBy(*blocked_by, "block").agg(F.max("alarm").alias("hit"), F.sum("alarm").alias("alarms"), F.sum(F.when(y0, F.col("alarm")).otherwise(0)).alias("false"), F.sum(y0.cast("long")).alias("rows0"))
    out = per_block.groupBy(*blocked_by).agg(
        F.count("block").alias("n_events"), F.coalesce(F.sum(F.when(F.col("block").isNotNull(), F.col("hit"))), F.lit(0)).cast("long").alias("events_hit"),
        F.sum("alarms").cast("long").alias("n_alarms"), F.sum("false").cast("long").alias("n_false_alarms"), F.sum("rows0").cast("long").alias("rows0"),
    )
    out = out.withColumn("event_sensitivity", ratio(F.col("events_hit"), F.col("n_events"))).withColumn("fpr_h_event", ratio(F.col("n_false_alarms"), F.col("rows0") * step / 3600))
    return out.drop("rows0")


def skill(ap: Column, prevalence: Column) -> Column:
    return F.try_divide(ap - prevalence, 1 - prevalence)


def prevalence(df: DataFrame, by: list[str], cap_ratio: int = 5, cap_rows: int = 5000, label: str = "label") -> DataFrame:
    """n1, n0, prevalence, and prevalence with the negatives capped at min(n0, cap_ratio * n1, cap_rows)."""
    out = df.groupBy(*by).agg(F.sum((F.col(label) == 1).cast("long")).alias("n1"), F.sum((F.col(label) == 0).cast("long")).alias("n0"))
    capped = F.least(F.col("n0"), cap_ratio * F.col("n1"), F.lit(cap_rows))
    return out.withColumn("prevalence", ratio(F.col("n1"), F.col("n1") + F.col("n0"), 0.0)).withColumn("prevalence_capped", ratio(F.col("n1"), F.col("n1") + capped, 0.0))


def evaluate(df: DataFrame, by: list[str], flag: Column, step: float, label: str = "label", value: str = "prob") -> DataFrame:
    """One row per group: areas, confusion metrics and false positives per hour, rounded to 4 digits; n_pos, n_neg."""
    rows = confusion(df, by, flag, label).join(auc_ap(df, by, label, value), by).join(window_fpr(df, by, flag, step, label), by)
    names = ["auc", "ap", "sensitivity", "specificity", "precision", "f1", "balanced_accuracy", "fpr_h_window"]
    return rows.select(*by, *[F.round(n, 4).alias(n) for n in names], (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"))


def summary_rows(table: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """The table with two more rows, key MEAN and STD (sample), rounded to 4 digits; nulls and NaN don't count."""
    clean = table.select(F.col(key).cast("string").alias(key), *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in metrics])
    rows = [clean.agg(*[F.round(f(m), 4).alias(m) for m in metrics]).select(F.lit(name).alias(key), *metrics) for name, f in (("MEAN", F.avg), ("STD", F.stddev_samp))]
    return clean.select(key, *[F.round(m, 4).alias(m) for m in metrics]).unionByName(rows[0]).unionByName(rows[1])


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """corr of complete pairs; null for fewer than 3 or without variance. Also n."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    grouped = pairs.groupBy(*(by or []))
    flat = (F.coalesce(F.var_pop(x), F.lit(0.0)) == 0) | (F.coalesce(F.var_pop(y), F.lit(0.0)) == 0) | (F.count(F.lit(1)) < 3)
    return grouped.agg(F.count(F.lit(1)).alias("n"), r6(F.when(~flat, F.corr(x, y))).alias("r"))


def grid_rates(df: DataFrame, by: list[str], step: float, first: float = 0.05, last: float = 0.95, points: int = 91, label: str = "label", value: str = "prob") -> DataFrame:
    """sens and fpr_h of each threshold of an even grid, at window level. Rows are binned by the grid once, not copied to it."""
    gap = (last - first) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("k"), F.round(first + k * gap, 9).alias("threshold")))
    # the number of thresholds that a score reaches, corrected at the edges by comparing with them
    k = F.least(F.greatest(F.floor((F.col(value) - first) / gap).cast("int"), F.lit(-1)), F.lit(points - 1))
    at = lambda i: F.round(F.lit(first) + i * gap, 9)
    k = F.when((k + 1 <= points - 1) & (F.col(value) >= at(k + 1)), k + 1).when((k >= 0) & (F.col(value) < at(k)), k - 1).otherwise(k)
    bins = df.select(*by, k.alias("k"), F.col(label).alias("y")).groupBy(*by, "k").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") == 0).cast("long")).alias("n"))
    every = df.select(*by).distinct().select(*by, F.inline(grid)).unionByName(df.select(*by).distinct().select(*by, F.lit(-1).alias("k"), F.lit(None).cast("double").alias("threshold")))
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc("k"))
    c = every.join(bins, [*by, "k"], "left").withColumns({"tp": F.coalesce(F.sum("p").over(down), F.lit(0)), "fp": F.coalesce(F.sum("n").over(down), F.lit(0)), "all_p": F.coalesce(F.sum("p").over(w), F.lit(0)), "all_n": F.coalesce(F.sum("n").over(w), F.lit(0))})
    return c.where("k >= 0").select(*by, "threshold", (F.col("tp") / F.greatest(F.col("all_p"), F.lit(1))).alias("sens"), ratio(F.col("fp"), F.col("all_n") * step / 3600).alias("fpr_h"))


def operating_threshold(rates: DataFrame, by: list[str], target: float) -> DataFrame:
    """The threshold with the largest sens among those with fpr_h at or below the target, ties to the smaller; null if none fits."""
    fits = rates.where(F.col("fpr_h") <= target).groupBy(*by).agg(F.max(F.struct("sens", (-F.col("threshold")).alias("t"))).alias("b"))
    return rates.select(*by).distinct().join(fits, by, "left").select(*by, (-F.col("b.t")).alias("threshold"), F.col("b.sens").alias("sens"))
