"""Places, frames and running totals of ordered rows without a task per series.

A series is cut into chunks. What a chunk needs of the rest of its series is little: how many rows come before it, a few
rows at its edges, or one carried value. So a series of any length is the work of as many tasks as it has chunks; windows
over a whole series only see one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.sources.results import stored

#: Rows of a chunk.
CHUNK_ROWS = 65_536
#: Tasks of a scan, as a multiple of the session's shuffle partitions.
SCAN_TASKS = 4


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, where the columns `on` are equal or both null."""
    other = right.select(*[F.col(c).alias(f"_right_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in on])


def numbered(df: DataFrame, by: list[str], order: str | list[str] = "seq", out: str = "_n") -> DataFrame:
    """df with the place of each row in its series, from 0, and `_rows`, the rows of the series.

    Rows are dealt out by ranges of (by, order) and written with the number of their range; a row's place is its place
    in the part of the series that lies in its range, and the rows of the series in earlier ranges. The written table is what
    is returned, so df is worked out once. `order` must tell rows apart.
    """
    order = [order] if isinstance(order, str) else order
    rows = stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_k"))
    series = Window.partitionBy(*by)  # a row per range that the series reaches into
    counts = counts.select(*by, "_range", (F.sum("_k").over(series.orderBy("_range")) - F.col("_k")).alias("_before"), F.sum("_k").over(series).alias("_rows"))
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    met = join_null_safe(rows, counts, [*by, "_range"])
    return met.withColumn(out, (F.col("_before") + F.row_number().over(own) - 1).cast("long")).drop("_range", "_before")


def framed(df: DataFrame, by: list[str], place: str, before: int, after: int, columns: dict[str, Column | tuple[Column, int, int]], chunk: int = CHUNK_ROWS) -> DataFrame:
    """df with aggregates over the rows from `before` places earlier to `after` places later; (aggregate, b, a) takes a narrower frame.

    Rows are cut by place; those within reach of a neighbouring chunk go there as well and are dropped afterwards.
    """
    chunk = max(chunk, before, after, 1)
    own, at = F.floor(F.col(place) / chunk), F.pmod(F.col(place), F.lit(chunk))
    near = F.array_compact(F.array(own, F.when(at >= chunk - before, own + 1), F.when(at < after, own - 1)))
    rows = df.withColumn("_chunk", own).withColumn("_to", F.explode(near))
    here = Window.partitionBy(*by, "_to").orderBy(place)
    over = lambda c, b=before, a=after: c.over(here.rowsBetween(-b, a))
    return rows.withColumns({name: over(*c) if isinstance(c, tuple) else over(c) for name, c in columns.items()}).where(F.col("_to") == F.col("_chunk")).drop("_to", "_chunk")


def scanned(df: DataFrame, by: list[str], place: str, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, following: dict[str, Column] | None = None, chunk: int = CHUNK_ROWS) -> DataFrame:
    """df with running totals: sums up to each row, the last value that isn't null up to it, and the next from it on.

    `last` must not fall and `following` not rise along the series, as places do. Every chunk is aggregated once, chunks are totalled
    per series, and each chunk starts from what it is handed.
    """
    sums, last, following = sums or {}, last or {}, following or {}
    own = F.floor(F.col(place) / chunk)
    names = [*sums, *last, *following]
    rows = df.withColumns({"_chunk": own} | {f"_v_{k}": c for k, c in (sums | last | following).items()})
    parts = rows.groupBy(*by, "_chunk").agg(*[F.sum(f"_v_{k}").alias(f"_c_{k}") for k in sums], *[F.max(f"_v_{k}").alias(f"_c_{k}") for k in last], *[F.min(f"_v_{k}").alias(f"_c_{k}") for k in following])
    series = Window.partitionBy(*by)  # a row per chunk
    past, rest = series.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1), series.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    over = {k: F.coalesce(F.sum(f"_c_{k}").over(past), F.lit(0)) for k in sums} | {k: F.max(f"_c_{k}").over(past) for k in last} | {k: F.min(f"_c_{k}").over(rest) for k in following}
    handed = parts.select(*by, "_chunk", *[c.alias(f"_h_{k}") for k, c in over.items()])
    here = Window.partitionBy(*by, "_chunk")
    up, down = here.orderBy(place).rowsBetween(Window.unboundedPreceding, 0), here.orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)
    found = {k: F.col(f"_h_{k}") + F.coalesce(F.sum(f"_v_{k}").over(up), F.lit(0)) for k in sums}
    found |= {k: F.coalesce(F.max(f"_v_{k}").over(up), F.col(f"_h_{k}")) for k in last} | {k: F.coalesce(F.min(f"_v_{k}").over(down), F.col(f"_h_{k}")) for k in following}
    # a task sorts its rows both ways and holds both, so there are more tasks than elsewhere
    tasks = SCAN_TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = join_null_safe(rows, handed, [*by, "_chunk"]).repartition(tasks, *by, "_chunk")
    return met.withColumns(found).drop("_chunk", *[f"{p}{k}" for k in names for p in ("_v_", "_h_")])
