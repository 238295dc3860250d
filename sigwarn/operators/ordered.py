"""Operators on rows in order: smoothing, alarms, blocks of positives, relabelling and chronological splits.

`by` names the columns of a series, `order` the column that orders it without ties. Nulls in `by` form their own
series; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.operators.prefix import CHUNK_ROWS, framed, join_null_safe, numbered, scanned
from sigwarn.sources.results import stored


def placed(df: DataFrame, by: list[str], order: str, place: str | None) -> tuple[DataFrame, str, list[str]]:
    """df with a column of places from 0, its name, and the columns to drop in the end. `place` names one that df has."""
    return (df, place, []) if place else (numbered(df, by, order), "_n", ["_n", "_rows"])


def smooth(df: DataFrame, by: list[str], order: str = "seq", value: str = "prob", width: int = 10, out: str = "smoothed", place: str | None = None) -> DataFrame:
    """Centred moving sum over rows -width//2 .. width - width//2 - 1, divided by width; series shorter than width stay as they are."""
    df, n, extra = placed(df, by, order, place)
    near = (F.sum(value), width // 2, width - width // 2 - 1)
    seen = framed(df, by, n, width - 1, width - 1, {"_some": F.count(F.lit(1)), "_near": near})  # a short series has fewer rows in reach of each row
    return seen.withColumn(out, F.when(F.col("_some") < width, F.col(value)).otherwise(F.col("_near") / width)).drop("_some", "_near", *extra)


def smooth_causal(df: DataFrame, by: list[str], order: str = "seq", value: str = "prob", width: int = 10, out: str = "smoothed", place: str | None = None) -> DataFrame:
    """Mean of the last width rows; only rows that have so many."""
    df, n, extra = placed(df, by, order, place)
    found = framed(df, by, n, width - 1, 0, {out: F.sum(value)}).withColumn(out, F.col(out) / width)
    return found.where(F.col(n) >= width - 1).drop(*extra)


def votes(df: DataFrame, by: list[str], threshold: Column | float, k: int, m: int, order: str = "seq", value: str = "prob", place: str | None = None) -> DataFrame:
    """df with `vote`: whether at least k of the last m rows reach the threshold."""
    df, n, extra = placed(df, by, order, place)
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    found = framed(df, by, n, m - 1, 0, {"vote": F.sum((F.col(value) >= threshold).cast("int"))})
    return found.withColumn("vote", F.col("vote") >= k).drop(*extra)


def _first_free(at: np.ndarray, span: int) -> np.ndarray:
    return np.searchsorted(at, at + span + 1)


def fire(at: np.ndarray, start: int, blocked: int, span: int) -> np.ndarray:
    """Whether each candidate position fires, the first `blocked` positions from start on being suppressed."""
    fires, follow = np.zeros(len(at), dtype=bool), _first_free(at, span)
    i = int(np.searchsorted(at, start + blocked))
    while i < len(at):
        fires[i] = True
        i = int(follow[i])
    return fires


def handed_over(at: np.ndarray, start: int, end: int, span: int) -> np.ndarray:
    """For each number 0..span of positions suppressed at start, how many are still suppressed at end."""
    follow, blocked = _first_free(at, span), np.arange(span + 1)
    i = np.searchsorted(at, start + blocked)
    left = np.maximum(0, start + blocked - end)
    if len(at):
        last = np.where(follow < len(at), follow, np.arange(len(at)))
        while ((far := last[last]) != last).any():  # chains of all candidates at once, twice as far in each step
            last = far
        some = i < len(at)
        left[some] = np.maximum(0, at[last[i[some]]] + span + 1 - end)
    return left


def alarms(df: DataFrame, by: list[str], threshold: Column | float = 0.5, k: int = 5, m: int = 12, refractory: int = 180, order: str = "seq", value: str = "prob", chunk: int = CHUNK_ROWS, place: str | None = None) -> DataFrame:
    """df with `alarm` (0 or 1): k of the last m rows reach the threshold and no alarm fired in the last `refractory` rows.

    `place` names a column of df that counts a series' rows in order from 0; without it they are numbered here. Votes are
    aggregates over frames of rows. The refractory rule is sequential, so only candidate rows go to helpers, in chunks
    of the series' row numbers: each chunk first tells what it hands over for any number of rows suppressed at its
    start; these short tables are composed per series; then every chunk fires on its own.
    """
    df, n, extra = placed(df, by, order, place)
    df = df if n == "_n" else df.withColumn("_n", F.col(n).cast("long"))
    # two steps follow from the candidates, and rows only meet the alarms: votes are counted once
    candidates = stored(votes(df, by, threshold, k, m, order, value, n).where("vote").select(*by, "_n", F.floor(F.col("_n") / chunk).cast("long").alias("_chunk")), "candidates")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = ", ".join(f"`{b}` {types[b]}" for b in by)

    def tables(frame: pd.DataFrame) -> pd.DataFrame:
        c = int(frame["_chunk"].iloc[0])
        over = handed_over(np.sort(frame["_n"].to_numpy()), c * chunk, (c + 1) * chunk, refractory)
        return frame.iloc[:1][by].astype(object).assign(_chunk=c, _over=[over.tolist()])

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, last, entry = frame.sort_values("_chunk"), 0, None, []
        for c, over in zip(frame["_chunk"], frame["_over"], strict=True):
            if last is not None:
                state = max(0, state - (c - last - 1) * chunk)
            entry.append(state)
            state, last = int(over[state]), c
        return frame[by].astype(object).assign(_chunk=frame["_chunk"], _blocked=entry)

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(frame["_n"].to_numpy())
        fires = fire(at, int(frame["_chunk"].iloc[0]) * chunk, int(frame["_blocked"].iloc[0]), refractory)
        return pd.DataFrame({b: pd.Series([frame[b].iloc[0]] * int(fires.sum()), dtype=object) for b in by} | {"_n": at[fires]})

    over = candidates.groupBy(*by, "_chunk").applyInPandas(tables, f"{keys}, _chunk long, _over array<long>")
    entry = over.groupBy(*by).applyInPandas(compose, f"{keys}, _chunk long, _blocked long")
    entered = join_null_safe(candidates, entry, [*by, "_chunk"])
    fired = entered.groupBy(*by, "_chunk").applyInPandas(follow, f"{keys}, _n long")
    return join_null_safe(df, fired.withColumn("_fired", F.lit(1)), [*by, "_n"], "left").withColumn("alarm", F.coalesce("_fired", F.lit(0))).drop("_n", "_fired", *extra)


def blocks(df: DataFrame, by: list[str], order: str = "seq", label: str = "label", place: str | None = None) -> DataFrame:
    """df with `block`: 1, 2, ... for maximal runs of label 1, null elsewhere; and `pos`, `block_len`: place in it from 1, its rows."""
    df, n, extra = placed(df, by, order, place)
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    df = df.withColumn("_at", F.when(positive, F.col(n)))
    edges = framed(df, by, n, 1, 1, {"_first": F.min("_at"), "_last": F.max("_at")})
    begin, end = F.col("_at") == F.col("_first"), F.col("_at") == F.col("_last")
    found = scanned(edges, by, n, {"block": F.coalesce(begin, F.lit(False)).cast("long")}, {"_start": F.when(begin, F.col(n))}, {"_stop": F.when(end, F.col(n))})
    held = lambda c: F.when(F.col("_at").isNotNull(), c)
    out = found.withColumns({"block": held(F.col("block")), "pos": held((F.col(n) - F.col("_start") + 1).cast("long")), "block_len": held((F.col("_stop") - F.col("_start") + 1).cast("long"))})
    return out.drop("_at", "_first", "_last", "_start", "_stop", *extra)


def relabel_last(blocked: DataFrame, keep: int, label: str = "label") -> DataFrame:
    """Only the last `keep` rows of each block stay positive."""
    return blocked.withColumn(label, F.when(F.col("block").isNull(), F.col(label)).otherwise((F.col("block_len") - F.col("pos") < keep).cast("int")))


def trim_tail(blocked: DataFrame, drop: int, label: str = "label") -> DataFrame:
    """The last `drop` rows of each block become negative."""
    return blocked.withColumn(label, F.when(F.col("block").isNull(), F.col(label)).otherwise((F.col("block_len") - F.col("pos") >= drop).cast("int")))


def thirds(blocked: DataFrame) -> DataFrame:
    """df with `third` of each positive row: early, middle or late, bounds at block_len // 3 and twice that."""
    step = F.floor(F.col("block_len") / 3)
    return blocked.withColumn("third", F.when(F.col("block").isNotNull(), F.when(F.col("pos") <= step, "early").when(F.col("pos") <= 2 * step, "middle").otherwise("late")))


def chronological_split(df: DataFrame, by: list[str], validation: float = 0.2, order: str = "seq", label: str = "label") -> DataFrame:
    """df with `part`: the first ceil(n * (1 - validation)) rows of each class of a series train, the others validate."""
    train = F.col("_n") < F.ceil(F.round(F.col("_rows") * (1 - validation), 9))
    return numbered(df, [*by, label], order).withColumn("part", F.when(train, "train").otherwise("val")).drop("_n", "_rows")


def position_split(df: DataFrame, by: list[str], share: float = 0.8, order: str = "seq", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """df with `part`: the first floor(n * share) rows of a series, and the others."""
    early = F.col("_n") < F.floor(F.round(F.col("_rows") * share, 9))
    return numbered(df, by, order).withColumn("part", F.when(early, names[0]).otherwise(names[1])).drop("_n", "_rows")


def split_at_late_positive(df: DataFrame, by: list[str], share: float = 0.3, least: int = 2, order: str = "seq", label: str = "label") -> DataFrame:
    """df with `part`: test begins at the n-th last positive, n = max(least, floor(positives * share)) but leaving one to train on."""
    w = Window.partitionBy(*by)
    total = F.sum(label).over(w)
    n = F.least(F.greatest(F.floor(F.round(total * share, 9)), F.lit(least)), total - 1)
    back = F.sum(label).over(w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_first", F.when((F.col(label) == 1) & (back == n), F.col(order))).withColumn("_start", F.max("_first").over(w))
    return marked.withColumn("part", F.when(F.col(order) >= F.col("_start"), "test").otherwise("train")).drop("_first", "_start")


def expanding_folds(df: DataFrame, by: list[str], shares: tuple[float, ...] = (0.4, 0.6, 0.8), test: float = 0.2, order: str = "seq") -> DataFrame:
    """Rows of each fold with `fold` and `part`: train on the first share of a series, test on the next."""
    rows = numbered(df, by, order)
    folds = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(s).alias("share")) for k, s in enumerate(shares)]))
    rows = rows.withColumn("_f", folds)
    cut, end = F.floor(F.round(F.col("_rows") * F.col("_f.share"), 9)), F.floor(F.round(F.col("_rows") * (F.col("_f.share") + test), 9))
    part = F.when(F.col("_n") < cut, "train").when(F.col("_n") < end, "test")
    return rows.withColumn("fold", F.col("_f.fold")).withColumn("part", part).where("part is not null").drop("_n", "_rows", "_f")


def leave_one_event_out(blocked: DataFrame, by: list[str], order: str = "seq", label: str = "label", least_train: int = 50, least_test: int = 30, place: str | None = None) -> DataFrame:
    """(by, fold, train and test rows and positives): fold k tests on the rows after block k-1's end up to block k's end.

    Series with one block, and folds that are too small or lack a class on either side, are left out. A row's fold is the
    block that it lies in or that comes next, from one scan of the series, so rows meet no list of blocks.
    """
    df, n, _ = placed(blocked, by, order, place)
    rows = scanned(df.select(*dict.fromkeys([*by, n, label, "block"])), by, n, following={"fold": F.col("block")})
    parts = stored(rows.groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("test_rows"), F.sum(label).alias("test_positives")), "parts")
    series = parts.groupBy(*by).agg(F.sum("test_rows").alias("rows"), F.sum("test_positives").alias("positives"), F.count("fold").alias("blocks"))
    out = join_null_safe(parts.where("fold is not null"), series, by).where("blocks >= 2")
    out = out.withColumn("train_rows", F.col("rows") - F.col("test_rows")).withColumn("train_positives", F.col("positives") - F.col("test_positives"))
    fits = f"train_rows >= {least_train} and test_rows >= {least_test} and train_positives between 1 and train_rows - 1 and test_positives between 1 and test_rows - 1"
    return out.where(fits).select(*by, "fold", "train_rows", "train_positives", "test_rows", "test_positives")


def event_parts(blocked: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """blocked with `part`: k for the rows after block k-1's end up to block k's end, null after the last block."""
    ends = (F.col("block").isNotNull() & (F.col("pos") == F.col("block_len"))).cast("long")
    found = scanned(numbered(blocked, by, order), by, "_n", {"_ended": ends}, following={"_more": F.when(ends == 1, F.col("_n"))})
    part = F.when(F.col("_more").isNotNull(), F.col("_ended") - ends + 1)
    return found.withColumn("part", part).drop("_n", "_rows", "_ended", "_more")


def stratified_split(df: DataFrame, by: list[str], shares: dict[str, float], key: str = "seq", label: str = "label", seed: str = "split") -> DataFrame:
    """df with `part`: each class of a series is dealt by hash order to the parts in the given shares."""
    from sigwarn.functions import hash_order

    w = Window.partitionBy(*by, label)
    n = F.row_number().over(w.orderBy(hash_order(seed, *[F.col(b) for b in by], F.col(key)), key))
    rows, part, total = F.count(F.lit(1)).over(w), None, 0.0
    for name, share in shares.items():
        total += share
        hit = n <= F.floor(F.round(rows * total, 9))
        part = F.when(hit, name) if part is None else part.when(hit, name)
    return df.withColumn("part", part.otherwise(list(shares)[-1]))


def rebuild_clock(timeline: DataFrame, by: list[str], order: str = "seq", start: str = "start_clock", end: str = "end_clock") -> DataFrame:
    """df with `abs_start`, `abs_end` in seconds since midnight of the first day, from HH:MM:SS texts.

    An end before its start is on the next day. A start more than an hour before the previous end begins a new day.
    Hours of 24 and more are allowed. Texts that are no clock give null.
    """
    def seconds(c: str) -> Column:
        p = F.split(F.col(c), ":")
        return F.when(F.col(c).rlike(r"^[0-9]{1,3}:[0-9]{2}:[0-9]{2}$"), p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long"))

    w = Window.partitionBy(*by).orderBy(order)
    t = timeline.withColumn("_s", seconds(start)).withColumn("_e", seconds(end))
    t = t.withColumn("_e", F.when(F.col("_e") < F.col("_s"), F.col("_e") + 86_400).otherwise(F.col("_e")))
    # days of earlier rollovers cancel in the comparison, but for the day that the previous end itself ran over
    t = t.withColumn("_roll", F.coalesce((F.col("_s") < F.lag("_e").over(w) - 3600).cast("long"), F.lit(0)))
    days = F.sum("_roll").over(w) * 86_400
    return t.withColumn("abs_start", F.col("_s") + days).withColumn("abs_end", F.col("_e") + days).drop("_s", "_e", "_roll")


def classify_leads(events: DataFrame, by: list[str], gap: int, room: int) -> DataFrame:
    """events with `kind` (lead: the first, or gap seconds after the previous offset; else clustered) and `reconstructable` (room seconds into its recording)."""
    w = Window.partitionBy(*by).orderBy("abs_onset", "recording_id", "event_idx")
    since = F.col("abs_onset") - F.lag("abs_offset").over(w)
    return events.withColumn("kind", F.when(since.isNull() | (since >= gap), "lead").otherwise("clustered")).withColumn("reconstructable", F.col("onset") >= room)
