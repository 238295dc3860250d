"""Places, frames and running totals over chunks of any size are those of windows over whole series."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigwarn.operators import ordered as o
from sigwarn.operators import prefix as p


def rows(spark, n=230):
    data = [(s, k * 3 + k % 2, None if k % 17 == 5 else (k * 7919 % 101) / 101, int(k // 9 % 3 == 1)) for s, size in (("a", n), ("b", 7), (None, 40)) for k in range(size)]
    return spark.createDataFrame(data, "s string, t long, v double, y int").repartition(7)


def same(got, want, *columns):
    pick = lambda df: sorted(map(str, df.select("s", "t", *columns).collect()))
    assert pick(got) == pick(want)


def test_places(spark):
    w = Window.partitionBy("s")
    want = rows(spark).withColumns({"_n": F.row_number().over(w.orderBy("t")).cast("long") - 1, "_rows": F.count(F.lit(1)).over(w)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = p.numbered(rows(spark), ["s"], "t")
        same(got, want, "_n", "_rows")
        same(p.numbered(rows(spark).drop("v"), [], ["s", "t"]).drop("_rows"), rows(spark).withColumn("_n", F.row_number().over(Window.orderBy("s", "t")).cast("long") - 1), "_n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("chunk", [5, 16, 1000])
def test_frames_and_running_totals(spark, chunk):
    df = p.numbered(rows(spark), ["s"], "t")
    w = Window.partitionBy("s").orderBy("t")
    got = p.framed(df, ["s"], "_n", 5, 3, {"f": F.count("v"), "g": (F.max("t"), 2, 0)}, chunk)
    same(got, rows(spark).withColumns({"f": F.count("v").over(w.rowsBetween(-5, 3)), "g": F.max("t").over(w.rowsBetween(-2, 0))}), "f", "g")
    mark = F.when(F.col("t") % 5 == 0, F.col("t"))
    got = p.scanned(df, ["s"], "_n", {"a": F.col("y")}, {"b": mark}, {"c": mark}, chunk)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    same(got, rows(spark).withColumns({"a": F.sum("y").over(up), "b": F.max(mark).over(up), "c": F.min(mark).over(down)}), "a", "b", "c")


def test_blocks_across_chunks(spark, monkeypatch):
    want = {(r["s"], r["t"]): (r["block"], r["pos"], r["block_len"]) for r in o.blocks(rows(spark).withColumnRenamed("y", "label"), ["s"], "t").collect()}
    for f in ("framed", "scanned"):
        whole = getattr(p, f)
        monkeypatch.setattr(o, f, lambda *a, whole=whole, **k: whole(*a, **k, chunk=4))
    got = {(r["s"], r["t"]): (r["block"], r["pos"], r["block_len"]) for r in o.blocks(rows(spark).withColumnRenamed("y", "label"), ["s"], "t").collect()}
    assert got == want and max(v[2] or 0 for v in got.values()) == 9
    firsts = [k for k in range(230) if k // 9 % 3 == 1 and (k - 1) // 9 % 3 != 1]
    assert all(got["a", 3 * k + k % 2] == (i + 1, 1, 9) for i, k in enumerate(firsts[:-1]))


def test_no_window_over_a_whole_series(spark):
    plan = o.alarms(rows(spark), ["s"], 0.5, 2, 4, 3, "t", "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in x or "_to" in x or "_k" in x or "_chunk" in x for x in windows), windows
