"""Label-permutation tests of areas: each group's ranks are packed once, labels are permuted over them in blocks of replicates."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.sources.results import stored

#: A prime below 2 ** 31: squares of its residues fit into 64 bits in every engine.
PRIME = 2**31 - 1
METRICS = ("auc", "ap")
#: Numbers that are worked out at a time, so that they stay in a processor's cache.
STEP = 1 << 14


def multipliers(seed: str, rep: int) -> tuple[int, int, int]:
    """Three numbers below 2 ** 28 of a replicate, from the md5 of seed and replicate, equal in every engine."""
    text = hashlib.md5(f"{seed}|{rep}".encode()).hexdigest()
    return tuple(int(text[7 * k : 7 * k + 7], 16) for k in range(3))


def _reduced(x: np.ndarray, spare: np.ndarray) -> None:
    """x below 2 ** 63 becomes its remainder by PRIME: 2 ** 31 leaves 1, so upper bits are added to lower ones."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, np.uint64(PRIME), out=x)
        np.add(x, spare, out=x)
    np.subtract(x, np.uint64(PRIME), out=spare)  # wraps to a large number where x is smaller
    np.minimum(x, spare, out=x)


def numbers(n: int, seed: str, rep: int) -> np.ndarray:
    """The number, squared twice modulo a prime, that places 1..n are ordered by in a replicate."""
    a, b, c = (np.uint64(m) for m in multipliers(seed, rep))
    out, spare = np.empty(n, np.uint32), np.empty(min(n, STEP), np.uint64)
    for at in range(0, n, STEP):
        x = np.arange(at + 1, min(at + STEP, n) + 1, dtype=np.uint64)
        s = spare[: len(x)]
        x *= a + np.uint64(1)
        x += b
        _reduced(x, s)
        y = x * x
        y += c
        _reduced(y, s)
        y *= y
        y += x
        _reduced(y, s)
        out[at : at + STEP] = y
    return out


def shuffled(n: int, seed: str, rep: int) -> np.ndarray:
    """A permutation of n places: places in the order of their numbers(), ties by place."""
    return np.argsort(numbers(n, seed, rep), kind="stable")


def moved(positive: np.ndarray, seed: str, rep: int) -> np.ndarray:
    """The places of positive rows after a permutation: flatnonzero(positive[shuffled(n, seed, rep)]), without places being sorted.

    Numbers carry the label in their last bit through one sort of values. Where equal numbers have both labels, the order of
    places decides.
    """
    number = numbers(len(positive), seed, rep)
    order = np.sort((number << np.uint32(1)) | positive)
    hit = (order & np.uint32(1)).astype(bool)
    mixed = np.flatnonzero((order[1:] ^ order[:-1]) == 1)
    if len(mixed):
        twice = np.unique(order[mixed] >> np.uint32(1))
        low = np.zeros(1 << 16, dtype=bool)
        low[twice & np.uint32(0xFFFF)] = True
        at = np.flatnonzero(low[number & np.uint32(0xFFFF)])
        at = at[np.isin(number[at], twice)]
        at = at[np.argsort(number[at], kind="stable")]
        begin = np.searchsorted(number[at], twice)
        for first, place in zip(begin, np.searchsorted(order, twice << np.uint32(1)), strict=True):
            own = at[first : first + np.searchsorted(number[at[first:]], number[at[first]], side="right")]
            hit[place : place + len(own)] = positive[own]
    return np.flatnonzero(hit)


def shuffled_sql(k: str, rep: str, seed: str) -> str:
    """The number that shuffled() orders by, of place k from 1."""
    part = lambda at: f"('0x' || substr(md5('{seed}|' || {rep}), {at}, 7))::BIGINT"
    x = f"(({k} * ({part(1)} + 1) + {part(8)}) % {PRIME})"
    y = f"(({x} * {x} + {part(15)}) % {PRIME})"
    return f"(({y} * {y} + {x}) % {PRIME})"


def areas(positions: np.ndarray, code: np.ndarray, mid_rank: np.ndarray, reached: np.ndarray) -> tuple[float, float]:
    """(auc, ap) where the rows at `positions` are the positive ones; of each distinct score, mid_rank counts from the lowest, reached the rows at or above it."""
    p, n = len(positions), len(code)
    count = np.bincount(code[positions], minlength=len(mid_rank))
    auc = ((count * mid_rank).sum() - p * (p + 1) / 2) / (p * (n - p))
    above = np.cumsum(count[::-1])[::-1]
    return auc, (count * (above / reached)).sum() / p


def null_areas(df: DataFrame, by: list[str], n_perm: int, order: str = "seq", label: str = "label", value: str = "prob", seed: str = "perm", block: int = 100) -> DataFrame:
    """(by, rep, auc, ap): of the labels as they are (rep 0) and of n_perm permutations inside each group with both classes.

    A group's rows are packed in order once: a bit a label, and four bytes for the place of its score among the distinct ones. Blocks
    of replicates go to different tasks; groups with the same labels share their permutations. A group must fit one task.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    named = ", ".join(f"`{b}` {types[b]}" for b in by)
    rows = df.where(F.col(label).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(*by, F.col(order).alias("_o"), F.col(label).cast("int").alias("_y"), F.col(value).cast("double").alias("_v"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        first, frame = frame.iloc[:1][by].astype(object), frame.sort_values(["_o", "_y", "_v"], na_position="first")
        y, n = frame["_y"].to_numpy() == 1, len(frame)
        if not 0 < y.sum() < n:
            return first.iloc[:0].assign(_n=[], _labels=[], _code=[])
        code = np.unique(frame["_v"].to_numpy(), return_inverse=True)[1].astype(np.int32)
        return first.assign(_n=n, _labels=np.packbits(y).tobytes(), _code=code.tobytes())

    packed = stored(rows.groupBy(*by).applyInPandas(pack, f"{named}, _n long, _labels binary, _code binary"), "packed")
    firsts = F.sequence(F.lit(0), F.lit(n_perm), F.lit(block))
    dealt = packed.select("*", F.md5("_labels").alias("_same"), F.explode(firsts).alias("_first"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n, first, out, groups = int(part["_n"].iloc[0]), int(part["_first"].iloc[0]), [], []
        y = np.unpackbits(np.frombuffer(part["_labels"].iloc[0], np.uint8), count=n)
        for k, content in enumerate(part["_code"]):
            code = np.frombuffer(content, np.int32)
            count = np.bincount(code)
            upto = np.cumsum(count)
            groups.append((part.iloc[k][by].to_list(), code, upto - (count - 1) / 2, n - upto + count))
        for rep in range(first, min(first + block, n_perm + 1)):
            positions = moved(y, seed, rep) if rep else np.flatnonzero(y)
            out += [(*key, rep, *areas(positions, *ranks)) for key, *ranks in groups]
        return pd.DataFrame(out, columns=[*by, "rep", *METRICS])

    return dealt.groupBy("_first", "_n", "_same").applyInPandas(run, f"{named}, rep int, auc double, ap double")


def permutation_test(df: DataFrame, over: list[str], unit: str, n_perm: int = 1000, **named) -> DataFrame:
    """(over, metric, observed, null_mean, null_sd, p) of the mean AUC and the mean average precision of units.

    p = (1 + permutations at or above the observed mean) / (1 + permutations); null_sd is the sample's.
    """
    each = null_areas(df, [*over, unit], n_perm, **named)
    means = each.groupBy(*over, "rep").agg(*[F.round(F.avg(m), 9).alias(m) for m in METRICS])
    long = means.select(*over, "rep", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])))
    seen = F.max(F.when(F.col("rep") == 0, F.col("v"))).over(Window.partitionBy(*over, "metric"))  # a row a replicate
    null = long.withColumn("observed", seen).where("rep > 0")
    above = F.sum((F.col("v") >= F.col("observed")).cast("int"))
    return null.groupBy(*over, "metric").agg(F.max("observed").alias("observed"), F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_sd"), ((above + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
