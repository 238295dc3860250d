"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are lower-cased words and an end. The most frequent tokens (the head) are dealt by rank to classes of WIDTH;
all others to eight tail classes by their shape (length, last character, bytes beyond ASCII), and in each to WIDTH
cells by their hash. A token's probability is that of its class given the context, times that of its place in the class
given the context: in the head the token itself, in the tail its cell, of which it has its smoothed share. Both
softmaxes sum hashed weights of n-gram features (previous token, previous two) and skip features (second and third last
token), and start from the corpus's log shares. Features are hashed from the words themselves, whatever their rank; the
nearest and the third last word count by shape too where they are in the tail.

Training goes over all training documents in ROUNDS parts. In each, every task follows the gradient on its own
documents from the common weights; the changes are averaged, each weighted by how often its row was touched. Small
partitions are read by one task together, as what a task hands on has the size of the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.llm.quality import held_out
from sigwarn.llm.store import discard, id_of_any_name, materialize
from sigwarn.llm.words import Words, byte_blocks, mix

HEAD, WIDTH, SHAPES = 512, 24, 8
GROUPS = -(-HEAD // WIDTH)
CLASSES = GROUPS + SHAPES
#: Rows of weights that features are hashed to; powers of 2, not above 2 ** 16.
CLASS_ROWS, WORD_ROWS = 1 << 15, 1 << 16
#: What stands before a text in the context.
START = np.uint64(0x73746172742D6F66)
#: Partial sums that are added up in one group.
FAN_IN = 64
#: A task of a round hands on all weights, so there are no more tasks than training tokens / TASK_TOKENS, but one a core.
TASK_TOKENS = 1 << 22
ROUNDS, STEP_TOKENS, RATE, SHRINK = 2, 1 << 14, 0.25, 20
#: Weights of a row that take a step of the same size share so much of its squared gradient.
SPREAD = 4
#: Counts of so many frequent tokens go to all executors; all others are joined.
CACHED = 1 << 16
END = np.uint64(0x656E642D6F662D74)
ODD = np.uint64(0xD6E8FEB86659FD93)
CELL_SHIFT = 40
ADD = 0.1


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and document of every token, the ends too, and where each document's tokens start."""
    n = len(words.hash) + words.n_docs
    h, shape, doc = np.empty(n, np.uint64), np.zeros(n, np.int64), np.empty(n, np.int64)
    at, ends = np.arange(len(words.hash)) + words.doc, words.bounds[1:] + np.arange(words.n_docs)
    h[at], h[ends], shape[at] = words.hash, END, words.shape
    doc[at], doc[ends] = words.doc, np.arange(words.n_docs)
    return h, shape, doc, words.bounds[:-1] + np.arange(words.n_docs)


def cell(h: np.ndarray) -> np.ndarray:
    """The cell of each hash in its tail class."""
    return ((h >> np.uint64(CELL_SHIFT)) % np.uint64(WIDTH)).astype(np.int64)


class Lookup:
    """Index of a hash among given ones by two direct tables; given ones that fit in neither are left out."""

    BITS = 19

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.tables, rest = known, [], np.arange(len(known))
        for k in range(2):
            slot = self._slot(known[rest], k)
            table = np.full(1 << self.BITS, -1, dtype=np.int32)
            table[slot[::-1]] = rest[::-1]
            self.tables.append(table)
            rest = rest[table[slot] != rest]
        self.left_out = rest

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(20 * k + 3)) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        if len(self.known):
            for k in (1, 0):
                i = self.tables[k][self._slot(h, k)]
                out = np.where((i >= 0) & (self.known[i] == h), i, out)
        return out


class Model:
    """Weights and the corpus's shares; scores and follows the gradient on blocks of tokens."""

    def __init__(self, cached: np.ndarray, counts: np.ndarray, tail: np.ndarray, types: np.ndarray) -> None:
        self.cached, self.counts, self.tail, self.types = cached, counts, tail, types
        self.class_w, self.word_w = np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, WIDTH), np.float32)
        head = np.zeros(GROUPS * WIDTH)
        n = min(HEAD, len(counts))
        head[:n] = counts[:n] + ADD
        head = head.reshape(GROUPS, WIDTH)
        places = np.concatenate([head, tail + ADD * (types + 1)])
        share = places.sum(1)
        with np.errstate(divide="ignore"):
            self.class_b = np.log(share / share.sum()).astype(np.float32)
            self.word_b = np.log(places / np.maximum(share[:, None], 1e-300)).astype(np.float32)
        self.lookup = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lookup": None}

    def index(self, h: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = Lookup(self.cached)
        return self.lookup(h)

    def context(self, h: np.ndarray, shape: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, place in the class, and the class and word rows of each token's features."""
        index = self.index(h)
        is_head = (index >= 0) & (index < HEAD)
        group = np.where(is_head, index // WIDTH, GROUPS + shape)
        coarse = np.where(is_head, h, shape.astype(np.uint64))

        def back(x: np.ndarray, k: int) -> np.ndarray:
            out = np.full(len(x), START)
            out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], START)
            return out

        def row(kind: int, x: np.ndarray, rows: int) -> np.ndarray:
            return (mix(x ^ mix(np.full(1, kind, np.uint64))) & np.uint64(rows - 1)).astype(np.intp)

        a, b, near, far = back(h, 1), back(h, 2), back(coarse, 1), back(coarse, 3)
        in_class = np.stack([row(k, x, CLASS_ROWS) for k, x in enumerate((near, a, b, far, a * ODD + b))])
        g = mix(group.astype(np.uint64) + np.uint64(1))
        in_word = np.stack([row(8 + k, x + g, WORD_ROWS) for k, x in enumerate((near, a, b, far))])
        return group, np.where(is_head, index % WIDTH, cell(h)), in_class, in_word

    def _soft(self, z: np.ndarray) -> np.ndarray:
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def outputs(self, group: np.ndarray, in_class: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all classes, and of all places in the true class."""
        z = self.class_w.take(in_class[0], axis=0)
        for r in in_class[1:]:
            z += self.class_w.take(r, axis=0)
        z += self.class_b
        y = self.word_w.take(in_word[0], axis=0)
        for r in in_word[1:]:
            y += self.word_w.take(r, axis=0)
        y += self.word_b.take(group, axis=0)
        return self._soft(z), self._soft(y)

    def log10(self, group: np.ndarray, place: np.ndarray, in_class: np.ndarray, in_word: np.ndarray) -> np.ndarray:
        """log10 probability of each token; of tail tokens without the token's own log10(c + ADD)."""
        out = np.empty(len(group))
        for at in range(0, len(group), STEP_TOKENS):
            cut = slice(at, at + STEP_TOKENS)
            p, q = self.outputs(group[cut], in_class[:, cut], in_word[:, cut])
            all_of = np.arange(len(p))
            both = np.maximum(p[all_of, group[cut]], 1e-30), np.maximum(q[all_of, place[cut]], 1e-30)
            out[cut] = np.log10(both[0], dtype=np.float64) + np.log10(both[1], dtype=np.float64)
        norm = np.log10(self.tail + ADD * (self.types + 1))
        return out - np.where(group >= GROUPS, norm[np.maximum(group - GROUPS, 0), place], 0.0)

    def follow(self, group: np.ndarray, place: np.ndarray, in_class: np.ndarray, in_word: np.ndarray, state: dict) -> None:
        """Gradient steps over the tokens; state holds the sum of squared gradients and the touches of each row."""
        for at in range(0, len(group), STEP_TOKENS):
            cut = slice(at, at + STEP_TOKENS)
            p, q = self.outputs(group[cut], in_class[:, cut], in_word[:, cut])
            all_of = np.arange(len(p))
            p[all_of, group[cut]] -= 1
            q[all_of, place[cut]] -= 1
            p, q = (np.ascontiguousarray(x.T, dtype=np.float64) for x in (p, q))
            for r in in_class[:, cut]:
                self._step(self.class_w, state["class"], r, p)
            for r in in_word[:, cut]:
                self._step(self.word_w, state["word"], r, q)

    def _step(self, weights: np.ndarray, state: tuple[np.ndarray, np.ndarray], rows: np.ndarray, error: np.ndarray) -> None:
        if not len(rows):
            return
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        ordered = rows[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        touched, place = ordered[first], np.empty(len(rows), np.intp)
        place[order] = np.cumsum(first) - 1
        count = np.bincount(place)
        gradient = np.empty((len(touched), len(error)), np.float32)
        for k, column in enumerate(error):
            gradient[:, k] = np.bincount(place, weights=column)
        gradient /= (count[:, None] + SHRINK).astype(np.float32)
        squares = state[0][touched] + np.einsum("ij,ij->i", gradient, gradient) / np.float32(SPREAD)
        state[0][touched] = squares
        state[1][touched] += count
        gradient *= (RATE / np.sqrt(squares + 1e-3))[:, None]
        weights[touched] = weights.take(touched, axis=0) - gradient

    def state(self) -> dict:
        return {"class": (np.zeros(CLASS_ROWS, np.float32), np.zeros(CLASS_ROWS, np.float32)), "word": (np.zeros(WORD_ROWS, np.float32), np.zeros(WORD_ROWS, np.float32))}


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, shape, c): how often every token occurs in the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in byte_blocks(batch.column("text")):
                h, shape, _, _ = tokens(Words(data, offsets))
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                found.append((u, shape[first], c))
            if found:
                h, shape, c = (np.concatenate(x) for x in zip(*found, strict=True))
                u, first, back = np.unique(h, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(shape[first]), pa.array(np.bincount(back, weights=c).astype(np.int64))], names=["h", "shape", "c"])

    return texts.mapInArrow(run, "h long, shape long, c long").groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


def _round(texts: DataFrame, model: Model) -> None:
    """One round of training on the rows of texts; changes the model's weights."""
    shared, rows_per = texts.sparkSession.sparkContext.broadcast(model), 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, any_rows = shared.value, False
        own = Model(common.cached, common.counts, common.tail, common.types)
        own.class_w, own.word_w, own.lookup = common.class_w.copy(), common.word_w.copy(), common.lookup
        state = own.state()
        for batch in batches:
            for _, _, data, offsets in byte_blocks(batch.column("text")):
                h, shape, doc, _ = tokens(Words(data, offsets))
                own.follow(*own.context(h, shape, doc), state)
                any_rows = True
        common.lookup = own.lookup
        if not any_rows:
            return
        for kind, name in enumerate(("class", "word")):
            change = getattr(own, f"{name}_w") - getattr(common, f"{name}_w")
            touches = state[name][1]
            packed = np.concatenate([change * touches[:, None], touches[:, None]], axis=1).astype(np.float32)
            blocks = range(0, len(packed), rows_per)
            yield pa.RecordBatch.from_arrays([pa.array([kind * 1000 + b // rows_per for b in blocks], pa.int32()), pa.array([packed[b : b + rows_per].tobytes() for b in blocks], pa.binary())], names=["block", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in sorted(frame["sums"])], axis=0).astype(np.float32)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "sums": [total.tobytes()]})

    some = texts.mapInArrow(run, "block int, sums binary").withColumn("part", F.floor(F.spark_partition_id() / FAN_IN).cast("int"))
    some = some.groupBy("block", "part").applyInPandas(lambda f: add(f).assign(part=f["part"].iloc[0] // FAN_IN), "block int, sums binary, part int")
    some = some.groupBy("block", "part").applyInPandas(add, "block int, sums binary")
    for row in some.groupBy("block").applyInPandas(add, "block int, sums binary").collect():  # the size of the weights
        kind, block = divmod(row["block"], 1000)
        weights = (model.class_w, model.word_w)[kind]
        sums = np.frombuffer(row["sums"], np.float32).reshape(-1, weights.shape[1] + 1)
        weights[block * rows_per : block * rows_per + len(sums)] += sums[:, :-1] / np.maximum(sums[:, -1:], 1)
    shared.unpersist()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> tuple[Model, DataFrame, int, int]:
    """The model, the table of token counts (h, c), the number of training tokens and of distinct ones."""
    part = F.floor(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) / folds) % ROUNDS
    texts = docs.where(~held_out(id_col, folds)).select(part.alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = materialize(count_tokens(texts.select("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "h").limit(CACHED).toArrow()
    cached = np.asarray(top["h"].combine_chunks() if top.num_rows else pa.array([], pa.int64())).astype(np.int64).view(np.uint64)
    cached_counts = np.asarray(top["c"].combine_chunks() if top.num_rows else pa.array([], pa.int64())).astype(np.float64)
    out = Lookup(cached).left_out
    cached, cached_counts = np.delete(cached, out), np.delete(cached_counts, out)
    heads = [int(x) for x in cached[:HEAD].view(np.int64)]
    tail, types = np.zeros((SHAPES, WIDTH)), np.zeros((SHAPES, WIDTH))
    rest = counts.where(~F.col("h").isin(heads)) if heads else counts
    at = F.shiftrightunsigned("h", CELL_SHIFT) % WIDTH
    for row in rest.groupBy("shape", at.alias("cell")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # a row per cell
        tail[row["shape"], row["cell"]], types[row["shape"], row["cell"]] = row["c"], row["v"]
    model = Model(cached, cached_counts, tail, types)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(total) // TASK_TOKENS)
    for k in range(ROUNDS):
        _round(texts.where(F.col("part") == k).select("text").coalesce(tasks), model)
    return model, counts.select("h", "c"), int(total), int(distinct)


@id_of_any_name("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows whose crc32 of the id leaves a remainder.

    Null texts count as empty: their only token is the end. A null id counts as the text ''. Repeated rows are scored
    each. Without any training row all counts are 0. An empty table gives an empty result; other columns are not looked at.
    """
    model, counts, total, distinct = fit(docs, id_col, text_col, folds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out(id_col, folds).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_count = np.log10(m.counts + ADD)
        for batch in batches:
            for at, end, data, offsets in byte_blocks(batch.column("text")):
                h, shape, doc, starts = tokens(Words(data, offsets))
                index = m.index(h)
                own = np.where(index >= 0, log_count[np.maximum(index, 0)] if len(log_count) else 0.0, 0.0)
                group, place, in_class, in_word = m.context(h, shape, doc)
                token_score = m.log10(group, place, in_class, in_word) + np.where(group >= GROUPS, own, 0.0)
                n = end - at
                sums = [np.bincount(doc, weights=x, minlength=n) for x in (own, token_score)]
                unknown = index < 0
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=unknown, minlength=n))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[unknown].view(np.int64)))
                out = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [out.column(0), out.column(1), out.column(2), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, weights=~unknown, minlength=n).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), rest],
                    names=["row", "id", "held_out", "n_tokens", "n_known", "own", "score", "rest"],
                )

    found = materialize(rows.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, own double, score double, rest array<long>"))
    rest = found.select("row", F.explode("rest").alias("h")).join(counts, "h", "left")
    rest = rest.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("log_c"))
    norm = math.log10(total + ADD * (distinct + 1))
    log_c = F.coalesce("log_c", F.lit(0.0))
    return found.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("own") + log_c - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("score") + log_c).alias("score"),
    )
