"""Structured Streaming jobs: sliding windows of samples, alarms of arriving scores, running counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigwarn.operators.metrics import confusion
from sigwarn.operators.ordered import fire


def within_lateness(samples: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Samples once each (by key), without those that come later than `late` behind the newest one of earlier batches.

    The operator's progress counts every row dropped for its lateness: see dropped_late(). Its state is the keys of rows
    that could still be repeated, and ends with the watermark.
    """
    return samples.withWatermark(ts, late).dropDuplicates([*key, ts])


def sliding(samples: DataFrame, by: list[str], ts: str, value: str, length: str = "20 seconds", step: str = "10 seconds", late: str = "1 minute", key: list[str] | None = None) -> DataFrame:
    """(by, start, samples, mean) of each sliding window, for outputMode append: a window comes out once, when the watermark has passed it.

    With `key`, repeated samples count once and late ones are dropped and counted before they are cut into windows.
    """
    timely = within_lateness(samples, key, ts, late) if key else samples.withWatermark(ts, late)
    w = timely.groupBy(F.window(ts, length, step).alias("w"), *by)
    return w.agg(F.count(F.lit(1)).alias("samples"), F.avg(value).alias("mean")).select(*by, F.col("w.start").alias("start"), "samples", "mean")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's operators have dropped behind the watermark, over the progress that it keeps."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def online_alarms(scores: DataFrame, subject: str, ts: str, threshold: float, k: int, m: int, refractory: int, order: str = "seq", value: str = "prob", late: str = "1 minute", idle: str | None = None) -> DataFrame:
    """(subject, ts, order, alarm) of arriving scores: K of the last M at or above the threshold, then `refractory` rows without alarm.

    Rows may arrive in any order within `late`. A subject's rows wait in a buffer, sorted by ts and order, until the watermark passes
    them; then they are followed in order, so the alarms are those of the ordered series. A row that comes when
    later ones have been followed is dropped. State is the waiting rows, the last M-1 flags and the rows still suppressed; with
    `idle` a subject begins anew after a gap of more than that, and its state ends when the watermark has passed such a gap. Null scores count as below the threshold.
    """
    types = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    silent = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    rows = scores.withWatermark(ts, late).select(subject, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, place, score, text, left, upto, last = state.get if state.exists else ([], [], [], "", 0, -1, -1)
        arrived = pd.concat([pd.DataFrame({"a": at, "p": place, "v": score}, dtype="float64").astype({"a": "int64", "p": "int64"})] + [pd.DataFrame({"a": p["_us"].to_numpy(), "p": p[order].to_numpy(), "v": p[value].to_numpy()}) for p in (parts if not state.hasTimedOut else ())])
        arrived = arrived[arrived["a"] > upto].sort_values(["a", "p"], kind="stable")
        mark = state.getCurrentWatermarkMs()
        due = arrived["a"] < mark * 1000
        now, wait = arrived[due], arrived[~due]
        us, hits = now["a"].to_numpy(), (now["v"] >= threshold).to_numpy().astype(np.int64)
        flags, out = np.array([int(c) for c in text], dtype=np.int64), np.zeros(len(now), dtype=np.int32)
        since = np.diff(us, prepend=last if last >= 0 else us[:1])
        anew = np.flatnonzero(since > silent * 1000).tolist() if silent else []
        for begin, end in zip([0, *anew], [*anew, len(now)], strict=True):
            if begin in anew:
                flags, left = flags[:0], 0
            if end > begin:
                seen = np.concatenate([np.zeros(m, dtype=np.int64), flags, hits[begin:end]])
                total = np.cumsum(seen)[-(end - begin) - m :]
                at = np.flatnonzero(total[m:] - total[:-m] >= k)
                at = at[fire(at, 0, left, refractory)]
                out[begin + at] = 1
                left = max(0, (int(at[-1]) + refractory + 1 if len(at) else left) - (end - begin))
                flags = seen[m:][-m:]
        last = int(us[-1]) if len(us) else last
        upto = max(upto, mark * 1000 - 1)
        if state.hasTimedOut and wait.empty and now.empty:
            state.remove()
        else:
            state.update((wait["a"].tolist(), wait["p"].tolist(), wait["v"].tolist(), "".join(map(str, flags[-(m - 1) :].tolist() if m > 1 else [])), left, upto, last))
            if not wait.empty:
                state.setTimeoutTimestamp(max(mark, int(wait["a"].iloc[0]) // 1000))
            elif silent:
                state.setTimeoutTimestamp(max(mark, last // 1000 + silent))
        if len(now):
            yield pd.DataFrame({subject: pd.Series([key[0]] * len(now), dtype=object), ts: pd.to_datetime(now["a"].to_numpy(), unit="us"), order: now["p"].to_numpy(), "alarm": out})

    held = "at array<long>, place array<long>, score array<double>, flags string, suppressed int, upto long, last long"
    return rows.groupBy(subject).applyInPandasWithState(run, f"`{subject}` {types[subject]}, `{ts}` timestamp, `{order}` long, alarm int", held, "append", GroupStateTimeout.EventTimeTimeout)


def running_counters(alarms: DataFrame, by: list[str]) -> DataFrame:
    """Hits, false alarms, misses and quiet rows so far; for outputMode update or complete."""
    return confusion(alarms, by, F.col("alarm") == 1).select(*by, "tp", "fp", "fn", "tn")
