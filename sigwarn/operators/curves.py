"""Alarms at many thresholds at once: counts of alarms, false alarms and events hit along a grid.

At a threshold, k of the last m rows reach it just where the k-th largest of them does. That value is one window
aggregate for all thresholds, so rows are never copied to the grid: helpers follow the refractory rule at each
threshold over the same candidate rows, in chunks of a series, as in `ordered.alarms`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.functions import ratio
from sigwarn.operators.ordered import fire, handed_over, placed
from sigwarn.operators.prefix import CHUNK_ROWS, framed, join_null_safe
from sigwarn.sources.results import stored


def even_grid(first: float = 0.05, last: float = 0.95, points: int = 91) -> list[float]:
    return [round(first + k * (last - first) / (points - 1), 9) for k in range(points)]


def vote_level(df: DataFrame, k: int, m: int, by: list[str], place: str, value: str) -> DataFrame:
    """df with `_q`, the largest threshold that k of the last m rows reach; null where there are fewer than k."""
    near = framed(df, by, place, m - 1, 0, {"_q": F.collect_list(value)})
    return near.withColumn("_q", F.get(F.sort_array("_q", asc=False), F.lit(k - 1)))


def alarm_counts(blocked: DataFrame, by: list[str], grid: list[float], k: int = 5, m: int = 12, refractory: int = 180, order: str = "seq", value: str = "prob", label: str = "label", chunk: int = CHUNK_ROWS, place: str | None = None) -> DataFrame:
    """(by, threshold, tp, fp, fn, tn, n_events, events_hit) for each threshold of the grid; blocked has `block`.

    tp and fp are alarms on positive and on other rows. Nulls in `by` form their own series.
    """
    levels = np.array(sorted(grid))
    rows, n, _ = placed(blocked.select(*dict.fromkeys([*by, order, value, label, "block", *([place] if place else [])])), by, order, place)
    rows = vote_level(rows, k, m, by, n, value).withColumn("_n", F.col(n).cast("long"))
    candidates = stored(rows.where(F.col("_q") >= float(levels[0])).select(*by, "_n", "_q", F.coalesce(F.col(label) == 1, F.lit(False)).alias("_y"), "block", F.floor(F.col("_n") / chunk).cast("long").alias("_chunk")), "candidates")
    types = {f.name: f.dataType.simpleString() for f in blocked.schema.fields}
    keys = ", ".join(f"`{b}` {types[b]}" for b in by)

    def tables(frame: pd.DataFrame) -> pd.DataFrame:
        c, frame = int(frame["_chunk"].iloc[0]), frame.sort_values("_n")
        at, q = frame["_n"].to_numpy(), frame["_q"].to_numpy()
        over = np.concatenate([handed_over(at[q >= t], c * chunk, (c + 1) * chunk, refractory) for t in levels])
        return frame.iloc[:1][by].astype(object).assign(_chunk=c, _over=[over.tolist()])

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, last, entry = frame.sort_values("_chunk"), np.zeros(len(levels), dtype=np.int64), None, []
        for c, over in zip(frame["_chunk"], frame["_over"], strict=True):
            if last is not None:
                state = np.maximum(0, state - (c - last - 1) * chunk)
            entry.append(state.tolist())
            state, last = np.asarray(over).reshape(len(levels), refractory + 1)[np.arange(len(levels)), state], c
        return frame[by].astype(object).assign(_chunk=frame["_chunk"], _blocked=entry)

    def follow(frame: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n")
        at, q, y, block = (frame[c].to_numpy() for c in ("_n", "_q", "_y", "block"))
        start, blocked_at, out = int(frame["_chunk"].iloc[0]) * chunk, entered["_blocked"].iloc[0], []
        first, last = (int(block[y].min()), int(block[y].max())) if y.any() else (None, None)  # only these can reach into other chunks, so other hits are handed on as a number
        for t, held in zip(levels, blocked_at, strict=True):
            own = np.flatnonzero(q >= t)
            own = own[fire(at[own], start, int(held), refractory)]
            if len(own):
                hit = np.unique(block[own][y[own]])
                out += [(t, None, int(y[own].sum()), int((~y[own]).sum()), int(((hit != first) & (hit != last)).sum()))] + [(t, int(b), 0, 0, 0) for b in {first, last} & set(hit.tolist())]
        found = pd.DataFrame(out, columns=["threshold", "block", "tp", "fp", "inside"]).astype({"threshold": float, "block": "Int64", "tp": "int64", "fp": "int64", "inside": "int64"})
        return pd.DataFrame({b: pd.Series([frame[b].iloc[0]] * len(found), dtype=object) for b in by} | {c: found[c] for c in found})

    over = candidates.groupBy(*by, "_chunk").applyInPandas(tables, f"{keys}, _chunk long, _over array<long>")
    entry = over.groupBy(*by).applyInPandas(compose, f"{keys}, _chunk long, _blocked array<long>")
    # what a chunk is handed has a number per threshold: it comes beside the chunk's rows, not on each of them
    fired = candidates.groupBy(*by, "_chunk").cogroup(entry.groupBy(*by, "_chunk")).applyInPandas(follow, f"{keys}, threshold double, block long, tp long, fp long, inside long")
    counts = fired.groupBy(*by, "threshold", "block").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "inside")])
    counts = counts.groupBy(*by, "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.count("block") + F.sum("inside")).alias("events_hit"))
    whole = blocked.groupBy(*by).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) == 0).cast("long")).alias("_m"), F.coalesce(F.max("block"), F.lit(0)).alias("n_events"))
    every = whole.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in levels])))
    zero = F.lit(0).cast("long")
    out = join_null_safe(every, counts, [*by, "threshold"], "left").withColumns({c: F.coalesce(c, zero) for c in ("tp", "fp", "events_hit")})
    return out.select(*by, "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_m") - F.col("fp")).alias("tn"), "n_events", "events_hit")


def alarm_rates(counts: DataFrame, by: list[str], step: float, events: bool = False) -> DataFrame:
    """(by, threshold, sens, fpr_h) of alarm_counts(): sens of rows (0 without positives), or of events (null without them)."""
    sens = ratio(F.col("events_hit"), F.col("n_events")) if events else ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)
    return counts.select(*by, "threshold", sens.alias("sens"), ratio(F.col("fp"), (F.col("fp") + F.col("tn")) * step / 3600).alias("fpr_h"))
