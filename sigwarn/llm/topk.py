"""Exact inner-product top-k by bounds from segment statistics, coarse to fine.

A vector is cut into s equal segments with mean m and deviation d each. By Cauchy-Schwarz on the centred segments, the
squared distance of q and x is at least sum(len * ((mq - mx)^2 + (dq - dx)^2)), so their inner product is at most
sum(len * (mq * mx + dq * dx)): a product of two short vectors. The same product with the least and the greatest
statistics of a group of rows bounds the whole group.

Rows are grouped by the nearest of at most CENTRES sampled statistics, a group is split into blocks by hash. A query
first meets the block that it is in itself, which needs no copy and gives it a floor: its k-th exact score there. Then
it is sent to the blocks of just those groups whose bound reaches that floor, and rows are sent only where queries
come. Within a block, coarse bounds give a first k, whose exact scores raise the floor; what the coarse and then the
finer bounds leave above it is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.llm.store import materialize

#: Segments of the coarse and of the finer bounds.
LEVELS = (4, 16)
#: Rows of a block of queries and of a block of candidates, about.
QUERY_BLOCK, ROW_BLOCK = 8192, 8192
#: Components of a block at most, about: blocks of longer vectors have fewer rows.
BLOCK_NUMBERS = 1 << 22
#: A score here may be one beyond the range: no floor.
LEAST = -(2**63)
#: Groups of rows at most; what goes to the driver and to every task is two short vectors a group.
CENTRES = 256
#: Queries of a block that are compared at a time.
TILE = 256
FOUND = "query_id long, vec_id long, score long"


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(len) times mean and deviation of each segment; products of two such rows bound inner products from above."""
    parts = np.array_split(v, min(segments, max(1, v.shape[1])), axis=1)
    length = np.sqrt([p.shape[1] for p in parts])
    return np.concatenate([np.stack([p.mean(1) if p.shape[1] else np.zeros(len(p)) for p in parts], 1) * length, np.stack([p.std(1) if p.shape[1] else np.zeros(len(p)) for p in parts], 1) * length], axis=1)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers: exact, at the ends of their range where they go beyond it."""
    most = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q))
    if most < 2**53:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole, strict=True)), -(2**63)), 2**63 - 1) for row in x], dtype=np.int64)


def block_top_k(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, floors: np.ndarray | None = None) -> pd.DataFrame:
    """(query_id, vec_id, score): the k best rows of a block for each query of a block; ties to the smaller row id.

    Rows that score below a query's floor are left out. NaN is no floor.
    """
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (q, x))
    coarse_x, fine_x = statistics(x, LEVELS[0]), statistics(x, LEVELS[1])
    floors = np.full(len(q), -np.inf) if floors is None else np.where(np.isnan(floors), -np.inf, floors)
    out = [np.zeros((0, 3), np.int64)]
    take = min(len(x), 2 * k + 2)
    for at in range(0, len(q) if len(x) else 0, TILE):
        tile, ids, least = q[at : at + TILE], q_ids[at : at + TILE], floors[at : at + TILE]
        coarse_q, fine_q = statistics(tile, LEVELS[0]), statistics(tile, LEVELS[1])
        slack = rounding(coarse_q, np.linalg.norm(coarse_x, axis=1))
        bound = coarse_q @ coarse_x.T + slack
        bound[ids[:, None] == x_ids[None, :]] = -np.inf
        firsts = np.argpartition(-bound, take - 1, axis=1)[:, :take]
        for i in range(len(tile)):
            first = firsts[i][bound[i, firsts[i]] > -np.inf]
            scores, floor = inner(x[first], tile[i]), least[i]
            if len(first) >= k and (kth := np.partition(scores, -k)[-k]) > LEAST:
                floor = max(floor, kth)
            survivors = np.flatnonzero((bound[i] >= floor) & (bound[i] > -np.inf))
            finer = fine_x[survivors] @ fine_q[i]
            survivors = survivors[finer + 1e-6 * np.abs(finer) + slack[i, survivors] >= floor]
            exact = inner(x[survivors], tile[i])
            best = np.lexsort((x_ids[survivors], ~exact))[:k]
            best = best[exact[best] >= least[i]]
            out.append(np.stack([np.full(len(best), ids[i]), x_ids[survivors[best]], exact[best]], axis=1).astype(np.int64))
    return pd.DataFrame(np.concatenate(out), columns=["query_id", "vec_id", "score"])


def rounding(q: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a computed bound may lack: for each query's statistics and each norm of a row's."""
    return 1e-6 * np.linalg.norm(q, axis=1)[:, None] * norms[None, :] + 1e-3


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bounds of the inner products of queries with any row of each group, from the ends of the group's statistics."""
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return bound + rounding(q, np.linalg.norm(np.maximum(np.abs(low), np.abs(high)), axis=1))


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20, scale: int = 64, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by query_every, the k best other vectors.

    Components become floor(scale * x); scores are integer inner products, ties go to the smaller id, and a query with
    fewer than k others gets all. Vectors that are null or hold null or non-finite components and rows with a null id
    take no part. Rows that repeat an id count once, with the smallest of their vectors. A vector that is shorter than
    another counts as continued by zeros. Components become 64-bit integers, and scores are exact; a component or a score
    beyond that range is at its end. An empty table gives an empty result; other columns are not looked at.
    """
    placed, groups = place_rows(vectors, id_col, vector_col, scale, row_block)
    query_block = max(1, min(query_block, BLOCK_NUMBERS // max(1, groups["width"])))
    is_query = F.col("id") % query_every == 0

    def own(x: pd.DataFrame) -> pd.DataFrame:
        ids, v = x["id"].to_numpy(np.int64), _matrix(x["v"])
        asks = x["asks"].to_numpy(bool)
        return block_top_k(ids[asks], v[asks], ids, v, k)

    home = materialize(placed.withColumn("asks", is_query).groupBy("block").applyInPandas(own, FOUND))
    floors = home.groupBy("query_id").agg(F.when((F.count(F.lit(1)) >= k) & (F.min("score") > LEAST), F.min("score")).alias("floor")).withColumnRenamed("query_id", "id")
    queries = materialize(placed.where(is_query).join(floors, "id", "left"))
    sent = open_blocks(queries, groups)

    # queries of a block are dealt to so many parts; its rows are copied to each, and to none where no query comes
    parts = sent.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
    asked = sent.join(parts, "block").join(queries.select("id", "v", "floor"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = placed.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return block_top_k(q["id"].to_numpy(np.int64), _matrix(q["v"]), x["id"].to_numpy(np.int64), _matrix(x["v"]), k, q["floor"].to_numpy(np.float64, na_value=np.nan))

    met = asked.select("block", "part", "id", "v", "floor").groupBy("block", "part").cogroup(dealt.select("block", "part", "id", "v").groupBy("block", "part")).applyInPandas(pair, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def place_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, row_block: int) -> tuple[DataFrame, dict]:
    """(id, v, centre, block) of the vectors that take part, as a written table, and of its groups: boxes, first blocks, numbers of blocks.

    A group is split by hash into blocks of about row_block rows, so many equal vectors are several blocks.
    """
    whole = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale))
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    rows = materialize(rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v")))
    n_rows, width = rows.select(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    row_block = max(1, min(row_block, BLOCK_NUMBERS // max(1, width)))

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, batches):
            yield pd.DataFrame({"id": b["id"], "shape": list(statistics(_matrix(b["v"], width), LEVELS[1]))})

    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(min(CENTRES, -(-n_rows // row_block)) or 1)
    centres = np.array([r["shape"] for r in drawn.mapInPandas(shapes, "id long, shape array<double>").collect()])
    numbers = 2 * min(LEVELS[1], max(1, width))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, batches):
            s = statistics(_matrix(b["v"], width), LEVELS[1])
            b["centre"] = np.argmin((centres * centres).sum(1)[None] - 2 * s @ centres.T, axis=1).astype(np.int32)
            yield b

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in filter(len, batches):
            s, c = statistics(_matrix(b["v"], width), LEVELS[1]), b["centre"].to_numpy()
            kinds = np.unique(c)
            yield pd.DataFrame({"centre": kinds, "n": [int((c == j).sum()) for j in kinds], "low": [s[c == j].min(0) for j in kinds], "high": [s[c == j].max(0) for j in kinds]})

    grouped = materialize(rows.mapInPandas(nearest, "id long, v array<long>, centre int"))
    ends = [F.array(*[f(F.get(name, F.lit(j))) for j in range(numbers)]).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    found = grouped.mapInPandas(boxes, "centre int, n long, low array<double>, high array<double>").groupBy("centre").agg(F.sum("n").alias("n"), *ends).orderBy("centre").collect()
    count = np.zeros(max(1, len(centres)), np.int64)
    for r in found:
        count[r["centre"]] = -(-r["n"] // row_block)
    first = np.cumsum(count) - count
    at = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("centre"))
    block = at(first) + F.pmod(F.xxhash64("id"), at(np.maximum(count, 1)))
    boxed = {"centre": [r["centre"] for r in found], "low": np.array([r["low"] for r in found]), "high": np.array([r["high"] for r in found]), "first": first, "count": count, "width": width}
    return grouped.withColumn("block", block.cast("long")), boxed


def open_blocks(queries: DataFrame, groups: dict) -> DataFrame:
    """(id, block): the blocks beside its own that a query must meet, as their group's bound reaches the query's floor."""

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.array(groups["centre"])
        for b in filter(len, batches):
            bound = box_bounds(statistics(_matrix(b["v"], groups["width"]), LEVELS[1]), groups["low"], groups["high"])
            floor = b["floor"].to_numpy(np.float64, na_value=np.nan)
            open_ = (bound >= floor[:, None]) | np.isnan(floor)[:, None]
            spans = [[{"first": int(groups["first"][c]), "last": int(groups["first"][c] + groups["count"][c] - 1)} for c in known[row]] for row in open_]
            yield pd.DataFrame({"id": b["id"], "block": b["block"], "spans": spans})

    spans = queries.select("id", "v", "floor", "block").mapInPandas(reach, "id long, block long, spans array<struct<first: long, last: long>>")
    each = spans.select("id", F.col("block").alias("own"), F.inline("spans")).select("id", "own", F.explode(F.sequence("first", "last")).alias("block"))
    return each.where("block <> own").select("id", "block")


def _matrix(column: pd.Series, width: int = 0) -> np.ndarray:
    """The rows of a column as doubles, continued by zeros to the longest or to width."""
    rows = list(column)
    longest = max([width, *map(len, rows)])
    if all(len(r) == longest for r in rows):
        return np.array(rows, dtype=np.float64).reshape(len(rows), longest)
    out = np.zeros((len(rows), longest))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out
