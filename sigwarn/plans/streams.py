"""Streaming queries run over the given tables to their end; their SQL is the batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigwarn.functions import r6
from sigwarn.operators import ordered as o
from sigwarn.plans.evaluation import K, M, REFRACTORY, THRESHOLD, alarm_sql
from sigwarn.plans.series import LEVEL, level
from sigwarn.registry import query
from sigwarn.sources.results import fresh_path, stored
from sigwarn.sources.tables import SUBJECTS, read
from sigwarn.streaming import online

STREAM_ALARMS = f"{LEVEL}, {alarm_sql('lv', 'subject_id')}"


def to_end(stream: DataFrame, name: str, mode: str = "append", told: Callable[[StreamingQuery], None] = lambda q: None) -> DataFrame:
    """What a stream has written when all its input is read; `told` gets the finished query."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, f"{name}-progress")).trigger(availableNow=True)
    running = (writer.format("parquet").option("path", path) if mode == "append" else writer.foreachBatch(keep)).start()
    running.awaitTermination()
    told(running)
    return spark.read.schema(stream.schema).parquet(path)


def arriving(df: DataFrame, name: str, batch: Column | None = None, batches: int = 1) -> DataFrame:
    """df as a stream of files, one after the other by the number of their batch."""
    path = fresh_path(df.sparkSession, name)
    for k in range(batches):
        (df if batch is None else df.where(batch == k).coalesce(1)).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1 if batch is not None else 1000).parquet(path)


#: Events arrive in BATCHES; most on time, every LATE_EVERY-th LATE_DAYS late. The watermark waits WAIT_HOURS.
BATCHES, BATCH_DAYS, LATE_EVERY, LATE_DAYS, WAIT_HOURS = 6, 5, 50, 12, 24


def batch_of(days: Column, late: Column) -> Column:
    return F.least(F.floor((days + F.when(late, LATE_DAYS).otherwise(0)) / BATCH_DAYS), F.lit(BATCHES - 1)).cast("int")


def delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events; those that are late come in a later batch than others of their day."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % SUBJECTS).alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    first = e.agg(F.min(F.to_date("ts"))).first()[0]
    batch = batch_of(F.datediff(F.to_date("ts"), F.lit(first)), F.col("event_id") % LATE_EVERY == 0)
    return arriving(e, "samples", batch, BATCHES)


#: kept(row of e with its batch b): what the watermark of two batches before lets through; wm: the last watermark, in milliseconds.
ARRIVED = f"""e AS (SELECT event_id, user_id % {SUBJECTS} AS subject_id, epoch_us(ts) AS us, value, least((ts::DATE - (SELECT min(ts)::DATE FROM events) + CASE WHEN event_id % {LATE_EVERY} = 0 THEN {LATE_DAYS} ELSE 0 END) // {BATCH_DAYS}, {BATCHES - 1}) AS b FROM events),
mx AS (SELECT b, max(us // 1000) - {WAIT_HOURS} * 3600000 AS top FROM e GROUP BY b),
kept AS (SELECT e.* FROM e WHERE us > 1000 * coalesce((SELECT max(top) FROM mx WHERE mx.b <= e.b - 2), 0)),
wm AS (SELECT max(top) AS wm FROM mx)"""


@query(f"WITH {ARRIVED}, w AS (SELECT subject_id, value, (us // 3600000000 - k) * 3600 AS start_sec FROM kept, (VALUES (0), (1)) AS v(k)) SELECT subject_id, start_sec, count(*) AS samples, round(avg(value), 6) AS mean FROM w WHERE (start_sec + 7200) * 1000 <= (SELECT wm FROM wm) GROUP BY ALL")
def l1_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has passed, without what came too late for it."""
    counted = online.sliding(delayed(spark, sf_dir), ["subject_id"], "ts", "value", "2 hours", "1 hour", f"{WAIT_HOURS} hours", ["event_id"])
    return to_end(counted, "windows").select("subject_id", F.unix_timestamp("start").alias("start_sec"), "samples", r6(F.col("mean")).alias("mean"))


@query(f"WITH {ARRIVED} SELECT (SELECT count(*) FROM e) AS arrived, (SELECT count(*) FROM e) - (SELECT count(*) FROM kept) AS dropped")
def l1_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows arrived, and how many of them the stream dropped as too late, by its own progress."""
    seen: list[int] = []
    timely = online.within_lateness(delayed(spark, sf_dir), ["event_id"], "ts", f"{WAIT_HOURS} hours")
    to_end(timely, "timely", told=lambda q: seen.append(online.dropped_late(q)))
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("arrived"), F.lit(seen[0]).cast("long").alias("dropped"))


#: Scores arrive in batches of SPREAD_DAYS, each up to a day too late or not; the buffer waits WAIT_HOURS + a day.
SPREAD_DAYS, BUFFER_HOURS = 5, 60


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(level(spark, sf_dir).select("subject_id", "seq", "t_us", F.timestamp_micros("t_us").alias("ts"), "prob"), "scores")  # each batch reads it
    first = rows.agg(F.min("t_us")).first()[0]
    moved = F.col("t_us") - first + F.when(F.col("seq") % 3 == 0, 86_400_000_000).otherwise(0)
    batch = F.least(F.floor(moved / (SPREAD_DAYS * 86_400_000_000)), F.lit(BATCHES)).cast("int")
    scores = arriving(rows.drop("t_us").orderBy(F.xxhash64("seq", "subject_id")), "scores", batch, BATCHES + 1)
    return to_end(online.online_alarms(scores, "subject_id", "ts", THRESHOLD, K, M, REFRACTORY, late=f"{BUFFER_HOURS} hours"), "alarms")


@query(f"WITH RECURSIVE {STREAM_ALARMS} SELECT subject_id, seq, alarm FROM alarmed WHERE t_us < 1000 * (SELECT max(t_us // 1000) - {BUFFER_HOURS} * 3600000 FROM lv)")
def l2_stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of scores that come in disorder over batches: those of the ordered series, as far as the watermark has come."""
    return streamed(spark, sf_dir).select("subject_id", "seq", "alarm")


@query(f"WITH RECURSIVE {STREAM_ALARMS} SELECT subject_id, count(*) FILTER (label = 1 AND alarm = 1) AS tp, count(*) FILTER (label = 0 AND alarm = 1) AS fp, count(*) FILTER (label = 1 AND alarm = 0) AS fn, count(*) FILTER (label = 0 AND alarm = 0) AS tn FROM alarmed GROUP BY 1")
def l3_stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = o.alarms(level(spark, sf_dir), ["subject_id"], THRESHOLD, K, M, REFRACTORY, place="seq").select("subject_id", "label", "alarm")
    return to_end(online.running_counters(arriving(flagged, "flagged"), ["subject_id"]), "counters", "complete")
