"""Comparison of methods, folds and subjects, and descriptors of matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.functions import ratio


def paired(first: DataFrame, second: DataFrame, key: str, metric: str, least: int = 5) -> DataFrame:
    """(key, x, y) of the keys that both have; empty with fewer than `least` of them."""
    both = first.select(key, F.col(metric).alias("x")).join(second.select(key, F.col(metric).alias("y")), key)
    enough = both.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return both.crossJoin(F.broadcast(enough)).drop("_n")  # one row at most


def fold_summary(folds: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, folds, mean, share_positive): a metric of folds and the share of folds where it is above 0."""
    above = F.when(F.col(metric) > 0, 1.0).otherwise(0.0)
    return folds.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.avg(metric).alias("mean"), F.avg(above).alias("share_positive"))


def ranked(table: DataFrame, metric: str, key: str) -> DataFrame:
    """Rows of a short table of methods with their place: larger first, nulls last, ties by key."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.col(metric).desc_nulls_last(), key)))


def fold_sizes(df: DataFrame, subject: str, label: str = "label") -> DataFrame:
    """(fold, test and train rows and positives): each subject is tested once and all others train; no row is copied."""
    tests = df.groupBy(F.col(subject).alias("fold")).agg(F.count(F.lit(1)).alias("test_rows"), F.sum(label).alias("test_positives"))
    total = tests.agg(F.sum("test_rows").alias("_r"), F.sum("test_positives").alias("_p"))
    out = tests.crossJoin(F.broadcast(total))  # one row
    return out.select("fold", "test_rows", "test_positives", (F.col("_r") - F.col("test_rows")).alias("train_rows"), (F.col("_p") - F.col("test_positives")).alias("train_positives"))


def calibration_sizes(df: DataFrame, subject: str, share: float, order: str = "seq") -> DataFrame:
    """(subject, variant, train_rows, test_rows): tests on a subject's last rows; trains on others, on others and its first rows, or on those alone."""
    count = F.count(F.lit(1)).over(Window.partitionBy(subject))
    place = F.row_number().over(Window.partitionBy(subject).orderBy(order))
    early = F.when(place <= F.floor(F.round(count * share, 9)), 1).otherwise(0)
    own = df.select(subject, early.alias("_e")).groupBy(subject).agg(F.sum("_e").alias("own"), F.sum(1 - F.col("_e")).alias("test_rows"))
    total = own.agg((F.sum("own") + F.sum("test_rows")).alias("_all"))
    sizes = own.crossJoin(F.broadcast(total)).withColumn("others", F.col("_all") - F.col("own") - F.col("test_rows"))  # one row
    variants = {"cross": F.col("others"), "calibrated": F.col("others") + F.col("own"), "within": F.col("own")}
    return sizes.select(subject, "test_rows", F.inline(F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("train_rows")) for k, v in variants.items()])))


def shared(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, found): 'both', 'first' or 'second', by the tables that have the key."""
    sides = first.select(key, F.lit(1).alias("_s")).unionByName(second.select(key, F.lit(2).alias("_s")))
    found = sides.groupBy(key).agg(F.bit_or("_s").alias("_s"))
    return found.select(key, F.when(F.col("_s") == 1, "first").when(F.col("_s") == 2, "second").otherwise("both").alias("found"))


def parameter_counts(table: DataFrame, params: str) -> DataFrame:
    """(name, value, folds) of parameters that are stored as JSON text; null values are left out."""
    read = F.from_json(params, "map<string,double>")
    return table.select(F.explode(read).alias("name", "value")).where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("folds"))


def balanced_weights(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, weight): the weight of a row with which all groups of `by` weigh the same and the mean weight is 1."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("rows").alias("_r"), F.count(F.lit(1)).alias("_g"))
    return sizes.crossJoin(F.broadcast(total)).select(*by, "rows", ratio(F.col("_r"), F.col("rows") * F.col("_g")).alias("weight"))  # one row


def degrees(matrices: DataFrame, key: str) -> DataFrame:
    """(key, mean_degree, std_out, std_in, top_flow): absolute off-diagonal sums of rows (in) and columns (out) of n x n matrices."""
    a, n = F.col("a"), F.col("n")
    spots = F.sequence(F.lit(0), n - 1)
    summed = lambda at: F.transform(spots, lambda i: F.aggregate(F.filter(spots, lambda j: i != j), F.lit(0.0), lambda s, j: s + F.abs(F.get(a, at(i, j)))))
    d = matrices.select(key, "n", summed(lambda i, j: i * n + j).alias("into"), summed(lambda i, j: j * n + i).alias("out"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.col("n")
    d = d.withColumn("mean_degree", mean("into")).withColumn("_o", mean("out"))
    spread = lambda c, mid: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - F.col(mid)) * (x - F.col(mid))) / F.col("n"))
    return d.select(key, "mean_degree", spread("out", "_o").alias("std_out"), spread("into", "mean_degree").alias("std_in"), F.array_max(F.zip_with("out", "into", lambda x, y: x - y)).alias("top_flow"))


def row_correlations(matrices: DataFrame, key: str, n: int) -> DataFrame:
    """(key, i, j, r): Pearson correlation of rows i < j of each matrix, within its row of the table; null where one is constant."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("a", i * n + 1, F.lit(n)))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    centre = lambda x: F.transform(x, lambda v: v - F.aggregate(x, F.lit(0.0), lambda s, w: s + w) / n)
    centred = matrices.select(key, F.transform(rows, centre).alias("_c"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(i + 1, n)])
    each = centred.select(key, "_c", F.inline(pairs)).withColumn("_x", F.get("_c", F.col("i"))).withColumn("_y", F.get("_c", F.col("j")))
    return each.select(key, "i", "j", F.try_divide(dot("_x", "_y"), F.sqrt(dot("_x", "_x") * dot("_y", "_y"))).alias("r"))
