"""The logical tables of the queries, built from the tables at hand, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sigwarn.functions import micros
from sigwarn.operators.prefix import numbered

SUBJECTS, DAY = 21, 86_400
INCIDENT_VALUE = 120
HOUR = 3600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, subject_id, seq, event_id, t_us, label, prob): two scoring rules on the stream of events in order."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % SUBJECTS).alias("subject_id"), micros(F.col("ts")).alias("t_us"), "event_type", "value")
    e = numbered(e, ["subject_id"], ["t_us", "event_id"], "seq").drop("_rows").withColumn("label", (F.col("event_type") == "error").cast("int"))
    level = F.col("value") / (F.col("value") + 50)
    noise = (F.col("event_id") * 7919 % 1000) / F.lit(1000.0)
    models = F.array(F.struct(F.lit("level").alias("model"), level.alias("prob")), F.struct(F.lit("mixed").alias("model"), ((level + noise) / 2).alias("prob")))
    return e.select(F.inline(models), "subject_id", "seq", "event_id", "t_us", "label").select("model", "subject_id", "seq", "event_id", "t_us", "label", "prob")


SCORED = f"""e0 AS (SELECT event_id, user_id % {SUBJECTS} AS subject_id, epoch_us(ts) AS t_us, event_type, value FROM events),
e1 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t_us, event_id) - 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM e0),
scored AS (SELECT 'level' AS model, subject_id, seq, event_id, t_us, label, value / (value + 50) AS prob FROM e1
UNION ALL SELECT 'mixed', subject_id, seq, event_id, t_us, label, (value / (value + 50) + (event_id * 7919 % 1000) / 1000.0::DOUBLE) / 2 FROM e1)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, recording_id, event_idx, onset, offset, abs_onset, abs_offset): strong errors, seconds; a recording is a day."""
    e = read(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("value") >= INCIDENT_VALUE))
    e = e.select((F.col("user_id") % SUBJECTS).alias("subject_id"), "event_id", F.floor(micros(F.col("ts")) / F.lit(1_000_000)).cast("long").alias("abs_onset"))
    e = e.withColumn("recording_id", F.floor(F.col("abs_onset") / DAY).cast("long"))
    e = e.withColumn("event_idx", F.row_number().over(Window.partitionBy("subject_id", "recording_id").orderBy("abs_onset", "event_id")).cast("long"))
    onset = F.col("abs_onset") - F.col("recording_id") * DAY
    return e.select("subject_id", "recording_id", "event_idx", onset.alias("onset"), (onset + HOUR).alias("offset"), "abs_onset", (F.col("abs_onset") + HOUR).alias("abs_offset"))


INCIDENTS = f"""i0 AS (SELECT user_id % {SUBJECTS} AS subject_id, event_id, epoch_us(ts) // 1000000 AS abs_onset FROM events WHERE event_type = 'error' AND value >= {INCIDENT_VALUE}),
i1 AS (SELECT *, abs_onset // {DAY} AS recording_id FROM i0),
incidents AS (SELECT subject_id, recording_id, row_number() OVER (PARTITION BY subject_id, recording_id ORDER BY abs_onset, event_id) AS event_idx,
abs_onset - recording_id * {DAY} AS onset, abs_onset - recording_id * {DAY} + {HOUR} AS "offset", abs_onset, abs_onset + {HOUR} AS abs_offset FROM i1)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, recording_id, n_seconds, abs_start, abs_end): the days on which a subject has events."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % SUBJECTS).alias("subject_id"), F.floor(micros(F.col("ts")) / F.lit(86_400_000_000)).cast("long").alias("recording_id")).distinct()
    return e.select("subject_id", "recording_id", F.lit(DAY).cast("long").alias("n_seconds"), (F.col("recording_id") * DAY).alias("abs_start"), ((F.col("recording_id") + 1) * DAY).alias("abs_end"))


RECORDINGS = f"""recordings AS (SELECT DISTINCT user_id % {SUBJECTS} AS subject_id, epoch_us(ts) // 86400000000 AS recording_id, {DAY}::BIGINT AS n_seconds,
(epoch_us(ts) // 86400000000) * {DAY} AS abs_start, (epoch_us(ts) // 86400000000 + 1) * {DAY} AS abs_end FROM events)"""


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, seq, label, n, a): embeddings of 64 numbers read as 8 x 8 matrices, row-major."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("subject_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 2).cast("int").alias("label"), F.lit(8).alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("a"))


#: (subject_id, seq, label, i, j, a) with i and j from 0.
CELLS = """cells AS (SELECT label::BIGINT AS subject_id, vec_id AS seq, (vec_id % 2)::INTEGER AS label, (k - 1) // 8 AS i, (k - 1) % 8 AS j, embedding[k]::DOUBLE AS a
FROM embeddings, generate_series(1, 64) AS g(k))"""
