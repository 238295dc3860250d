"""Tests, resampling and chance baselines as DataFrame jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.functions import hash_order, hash_uniform, ratio, two_sided


def mann_whitney(df: DataFrame, by: list[str], label: str = "label", value: str = "prob") -> DataFrame:
    """u of the positives from mean ranks, z with the correction for ties, and its two-sided p with the correction for continuity, of each group with both classes."""
    at = df.groupBy(*by, value).agg(F.sum(label).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("t"))
    w = Window.partitionBy(*by)
    at = at.withColumns({"r": F.sum("t").over(w.orderBy(value)) - F.col("t") + (F.col("t") + 1) / 2, "n1": F.sum("p").over(w), "n": F.sum("t").over(w)})
    u = at.groupBy(*by).agg((F.sum(F.col("r") * F.col("p")) - F.max("n1") * (F.max("n1") + 1) / 2).alias("u"), F.max("n1").alias("n1"), F.max("n").alias("n"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n1, n0, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    off = F.col("u") - n1 * n0 / 2
    p = two_sided(F.try_divide(F.greatest(F.abs(off) - 0.5, F.lit(0.0)), spread))
    return u.where("n1 > 0 and n1 < n").withColumns({"z": F.try_divide(off, spread), "p": p})


def wasserstein(df: DataFrame, by: list[str], label: str = "label", value: str = "prob") -> DataFrame:
    """distance between the distributions of value in the two classes: the area between their distribution functions."""
    at = df.groupBy(*by, value).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    w = Window.partitionBy(*by)
    up = w.orderBy(value)
    f1, f0 = ratio(F.sum("p").over(up), F.sum("p").over(w)), ratio(F.sum("n").over(up), F.sum("n").over(w))
    area = at.withColumn("area", F.abs(f1 - f0) * (F.lead(value).over(up) - F.col(value)))
    return area.groupBy(*by).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("distance"))


def wilcoxon(pairs: DataFrame, x: str, y: str, by: list[str] | None = None, split_zeros: bool = False, greater: bool = False) -> DataFrame:
    """n, w_plus, w_minus of the signed ranks of x - y, ties by mean rank, and their exact p; by group if named.

    Pairs with a null take no part. Zero differences are left out, or, with split_zeros, ranked too, and half of their
    ranks go to either side. p is that of the signs of the other ranks, all signs being equally likely; null where
    all differences are zero. A group is a table of subjects: its ranks meet in one row.
    """
    by = by or []
    d = pairs.withColumn("d", F.col(x) - F.col(y)).withColumn("a", F.round(F.abs("d"), 12)).where("a is not null" if split_zeros else "a <> 0")
    keys = by or [F.lit(1)]
    r = F.rank().over(Window.partitionBy(*keys).orderBy("a")) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "a")) - 1) / 2.0
    up, down = F.when((F.col("a") > 0) & (F.col("d") > 0), F.col("r")), F.when((F.col("a") > 0) & (F.col("d") < 0), F.col("r"))
    half = F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("r"))), F.lit(0.0)) / 2
    signed, zero = F.collect_list(F.when(F.col("a") > 0, F.col("r"))), F.lit(0.0)
    out = d.withColumn("r", r).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(up), zero).alias("_up"), F.coalesce(F.sum(down), zero).alias("_down"), half.alias("_half"), signed.alias("_r"))

    @F.pandas_udf("double")
    def exact(ranks: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(list(r), v, greater) if len(r) else None for r, v in zip(ranks, w, strict=True)], dtype="float64")

    p = F.nullif(exact("_r", "_up"), F.lit(float("nan")))
    return out.select(*by, "n", (F.col("_up") + F.col("_half")).alias("w_plus"), (F.col("_down") + F.col("_half")).alias("w_minus"), p.alias("p"))


def against_best(table: DataFrame, method: str, subject: str, metrics: list[str], rank_by: str, tested: list[str], least: int = 5) -> DataFrame:
    """(method, n, metric means and sample deviations, p of each tested metric) of methods beside the best one.

    The best has the largest mean of rank_by, ties to the first name. A method counts over the subjects it shares with
    the best, and is left out with fewer than `least`. p is wilcoxon() of the best against it; null for the best itself.
    """
    means = table.groupBy(method).agg(F.avg(rank_by).alias("_m"))
    top = means.agg(F.max("_m").alias("_top"))
    first = means.join(F.broadcast(top), F.col("_m") == F.col("_top")).agg(F.min(method).alias("_best"))  # one row
    ours = table.join(F.broadcast(first), F.col(method) == F.col("_best")).select(F.col(subject).alias("_s"), *[F.col(x).alias(f"_b_{x}") for x in tested])
    both = table.join(ours, F.col(subject) == F.col("_s"))
    per = both.groupBy(method).agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{x}_{n}") for x in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]).where(F.col("n") >= least)
    long = both.select(method, F.inline(F.array(*[F.struct(F.lit(x).alias("_metric"), F.col(f"_b_{x}").alias("_x"), F.col(x).alias("_y")) for x in tested])))
    p = wilcoxon(long, "_x", "_y", [method, "_metric"], split_zeros=True)
    wide = p.groupBy(method).agg(*[F.max(F.when(F.col("_metric") == x, F.col("p"))).alias(f"p_{x}") for x in tested])
    return per.join(wide, method, "left")


def wilcoxon_p(ranks: list[float], w_plus: float, greater: bool = False) -> float:
    """Exact p of w_plus from the distribution over all signs of the given mean ranks, two-sided or greater."""
    doubled = [int(round(2 * r)) for r in ranks]
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1
    for r in doubled:
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    ways /= ways.sum()
    at = int(round(2 * w_plus))
    upper, lower = ways[at:].sum(), ways[: at + 1].sum()
    return float(upper if greater else min(1.0, 2 * min(upper, lower)))


def bootstrap(table: DataFrame, by: str, unit: str, value: str, n_boot: int, seed: str = "boot", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """boot_mean, ci_low, ci_high of the mean of value over units drawn with replacement, n_boot times per group."""
    w = Window.partitionBy(by)
    units = table.select(by, value, (F.row_number().over(w.orderBy(unit)) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    draws = units.select(by, "k", "n", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    pick = F.conv(F.substring(hash_order(seed, F.col("rep"), F.col("k")), 1, 8), 16, 10).cast("long") % F.col("n")
    means = draws.select(by, "rep", pick.alias("k")).join(units.select(by, "k", value), [by, "k"]).groupBy(by, "rep").agg(F.avg(value).alias("v"))
    return means.groupBy(by).agg(F.avg("v").alias("boot_mean"), F.percentile("v", F.lit(low)).alias("ci_low"), F.percentile("v", F.lit(high)).alias("ci_high"))


def chance_scores(df: DataFrame, by: list[str], key: str, label: str = "label") -> DataFrame:
    """Every row once per baseline with `hit`: uniform (u >= 0.5), majority (share of positives above 0.5), stratified (u below the share)."""
    share = F.avg(label).over(Window.partitionBy(*by))
    rows = df.select(*by, label, hash_uniform("uniform", F.col(key)).alias("u"), share.alias("share"))
    kinds = F.array(F.struct(F.lit("uniform").alias("baseline"), (F.col("u") >= 0.5).alias("hit")), F.struct(F.lit("majority").alias("baseline"), (F.col("share") > 0.5).alias("hit")), F.struct(F.lit("stratified").alias("baseline"), (F.col("u") < F.col("share")).alias("hit")))
    return rows.select(*by, label, F.inline(kinds))
