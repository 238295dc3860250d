"""Optimal length buckets: boundaries from a dynamic programme over the global histogram, batches by token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.llm.store import id_of_any_name, materialize

BUCKETS, BUDGET = 8, 65_536
#: Batches form in shards of about so many documents, so that no task holds a whole bucket.
SHARD_ROWS = 20_000


def length_of(text: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most `buckets` upper bounds, among the lengths, with the least total padding up to the bound.

    cost[j] after b buckets is min over i of cost[i] + lengths[j] * rows(i..j) - tokens(i..j). The best i does not
    fall as j grows, so each layer is filled by halving. Of equal costs the smaller i is taken. No lengths: no bounds.
    """
    order = np.argsort(lengths)
    size, n = np.asarray(lengths, dtype=np.float64)[order], np.asarray(counts, dtype=np.float64)[order]
    m = len(size)
    if not m:
        return []
    rows, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    best = np.concatenate([[0], np.full(m, np.inf)])
    came = []
    for _ in range(min(buckets, m)):
        layer, back = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        layer[0] = 0
        todo = [(1, m, 0, m - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + size[j - 1] * (rows[j] - rows[i]) - (total[j] - total[i])
            k = int(np.argmin(cost))
            layer[j], back[j] = cost[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        best = layer
        came.append(back)
    out, j = [], m
    for back in reversed(came):
        if j > 0:
            out.append(int(size[j - 1]))
            j = int(back[j])
    return sorted(set(out))


@id_of_any_name("n_tokens", "bucket", "bound", "shard", "batch", "position", "padding")
def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket, bound, shard, batch, position, padding of every row of docs.

    A batch holds max(1, budget // bound) documents, each padded to the bucket's bound; a document longer than the
    budget is a batch by itself. Buckets are cut into shards by the hash of the id, and rows are numbered by length
    and id inside them, so that only the last batch of a shard can be short. Bounds are lengths of documents, told apart at
    any length, so the padding is the least that so many buckets can have. Null texts count as empty: length 0,
    with a bucket of bound 0 or the smallest. Repeated rows are packed each, rows with a null id too. An empty table
    gives an empty result; other columns are not looked at. Where the id is named like one of the other results, that
    one gets a trailing underscore.
    """
    sized = docs.select(F.col(id_col).alias("_id"), length_of(F.col(text_col)).alias("n_tokens"))
    sized = materialize(sized.withColumn("_row", F.monotonically_increasing_id()))
    # distinct lengths add up to no more than all words: of a table of w words the histogram has at most sqrt(2 * w) rows
    found = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow()
    lengths, counts = np.asarray(found["n_tokens"]), np.asarray(found["n"])
    bounds = boundaries(lengths, counts, buckets) or [0]
    held = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds))
    # as many whole batches as come to about shard_rows documents
    shards = [max(1, int(-(-h // shard_rows))) for h in held]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds[:-1]]).cast("array<long>"), lambda b: b < F.col("n_tokens")))
    out = sized.withColumn("bucket", bucket).withColumn("bound", pick(bounds).cast("long"))
    out = out.withColumn("shard", F.pmod(F.xxhash64("_id", "_row"), pick(shards)).cast("int"))
    order = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "_id", "_row")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))))
    out = out.withColumn("_n", F.row_number().over(order) - 1)
    out = out.withColumn("batch", F.floor(F.col("_n") / per).cast("long")).withColumn("position", (F.col("_n") % per).cast("int"))
    out = out.withColumn("padding", F.col("bound") - F.col("n_tokens"))
    return out.select(F.col("_id").alias(id_col), "n_tokens", "bucket", "bound", "shard", "batch", "position", "padding")
