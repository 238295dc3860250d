"""Quality classifier: supervised subword embeddings with a softmax output, trained by stochastic gradient descent.

A document is the mean of the learned vectors of its features: its words and its character 3- and 4-grams, each
hashed to one of BUCKETS rows. Two output vectors and a softmax give the probability of each class. As the output is
linear in the mean, scoring folds embedding and output into one number per bucket, which is the same function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.llm.store import discard, id_of_any_name, materialize
from sigwarn.llm.words import Words, byte_blocks, mix

BUCKETS = 1 << 16
DIMENSION = 12
#: At most so many labelled rows are learned from: those with the smallest hash of their id.
SAMPLE_ROWS = 6000
#: And of these as many as have so many numbers of features together, 6 bytes each.
SAMPLE_NUMBERS = 24_000_000
EPOCHS, RATE = 6, 0.5
#: A document is accepted from this probability on.
THRESHOLD = 0.3


def held_out(id_column: str, folds: int):
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a block's documents, and the document of each. Case and white space count."""
    wide, n = data.astype(np.uint32), len(data)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found, owners = [], []
    for size, odd in ((3, np.uint32(0x85EBCA6B)), (4, np.uint32(0xC2B2AE35))):
        if n < size:
            continue
        h = wide[: n - size + 1] * odd
        for k in range(1, size):
            h = (h ^ wide[k : n - size + 1 + k]) * np.uint32(0x01000193)
        own = doc[: n - size + 1]
        inside = own == doc[size - 1 :]
        found.append((h ^ (h >> np.uint32(15)))[inside] & np.uint32(BUCKETS - 1))
        owners.append(own[inside])
    words = Words(data, offsets)
    found.append((mix(words.hash) & np.uint64(BUCKETS - 1)).astype(np.uint32))
    owners.append(words.doc.astype(np.int32))
    return np.concatenate(found), np.concatenate(owners)


def train(buckets: np.ndarray, shares: np.ndarray, cuts: np.ndarray, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """One value per bucket and a bias. Document i has buckets and shares from cuts[i] to cuts[i + 1]. None: all values 0."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    out, bias = rng.uniform(-0.1, 0.1, (2, DIMENSION)), np.zeros(2)
    # the order of the documents does not depend on the partitions
    rows = sorted((i for i in range(len(labels)) if labels[i] in (0, 1) and cuts[i + 1] > cuts[i]), key=lambda i: (cuts[i + 1] - cuts[i], buckets[cuts[i] : cuts[i + 1]].tobytes()))
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at = slice(cuts[rows[k]], cuts[rows[k] + 1])
            used, share = buckets[at], shares[at]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ table[used]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[labels[rows[k]]] -= 1
            back = error @ out
            out -= rate * np.outer(error, mean)
            bias -= rate * error
            table[used] -= rate * len(used) ** 0.5 * share[:, None] * back
    return (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in byte_blocks(batch.column("text")):
            buckets, owner = features(data, offsets)
            pairs, counts = np.unique(owner.astype(np.int64) * BUCKETS + buckets, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(1, end - at) * BUCKETS)
            rows = [((b % BUCKETS).astype(np.uint16).view(np.int16), (c / max(1, c.sum())).astype(np.float32)) for b, c in zip(np.split(pairs, cuts), np.split(counts, cuts), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").slice(at, end - at), pa.array([r[0] for r in rows], pa.list_(pa.int16())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), batch.column("label").slice(at, end - at)],
                names=["_id", "buckets", "share", "label"],
            )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = SAMPLE_ROWS, numbers: int = SAMPLE_NUMBERS) -> tuple[np.ndarray, float]:
    """Learn from at most `sample` labelled ids outside the held-out fold; whole texts, nothing but texts.

    What comes to the driver is bounded by rows and by size: ids are taken in the order of their hashes as long as their
    features are no more than `numbers`. Rows of labels with a null id or label take no part; of an id with several
    labels the largest counts, of one with several texts the text with the smallest hash.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds))
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sparse = materialize(found.select("_id", "text", "label").mapInArrow(_sparse, f"_id {kind}, buckets array<short>, share array<float>, label int"))
    order = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)  # over at most `sample` ids
    within = sparse.select("_id", F.size("buckets").alias("_n")).withColumn("_n", F.sum("_n").over(order)).where(F.col("_n") <= numbers)
    found = sparse.join(F.broadcast(within.select("_id")), "_id", "left_semi").drop("_id").toArrow().combine_chunks()
    discard(sparse)
    if not len(found):
        return train(np.zeros(0, np.uint16), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    lists = found["buckets"].chunk(0)
    cuts = np.asarray(lists.offsets, dtype=np.int64)
    return train(np.asarray(lists.flatten()).view(np.uint16), np.asarray(found["share"].chunk(0).flatten()), cuts - cuts[0], np.asarray(found["label"]))


@id_of_any_name("held_out", "score", "predicted")
def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. A text without features gets the score of the bias alone."""
    value, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at, end, data, offsets in byte_blocks(batch.column("text")):
                buckets, owner = features(data, offsets)
                total = np.bincount(owner, weights=value.value[buckets], minlength=end - at)
                count = np.bincount(owner, minlength=end - at)
                parts.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias))))
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64())], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col, folds).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs, whatever their names; scores are computed beside each row.

    Null texts count as empty, and score the bias alone. Repeated rows are judged each; a null id stays and gives no
    label. An empty table gives an empty result; without labels every text scores one half and stays.
    """
    model = fit(docs, labels, id_col, text_col)
    value, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf("boolean")
    def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            parts = [np.zeros(0, bool)]
            for at, end, data, offsets in byte_blocks(pa.array(column, pa.large_string())):
                buckets, owner = features(data, offsets)
                total = np.bincount(owner, weights=value.value[buckets], minlength=end - at)
                z = total / np.maximum(np.bincount(owner, minlength=end - at), 1) + bias
                parts.append(1 / (1 + np.exp(-z)) >= THRESHOLD)
            yield pd.Series(np.concatenate(parts))

    return docs.where(accepted(F.coalesce(F.col(text_col), F.lit(""))))
