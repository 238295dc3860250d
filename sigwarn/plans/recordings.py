"""Queries on recordings, annotation texts and segments. Files and texts are written from the tables at hand."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarn.functions import micros, r6
from sigwarn.operators import windows as w
from sigwarn.plans.series import LEVEL, level
from sigwarn.registry import query
from sigwarn.sources import recordings as rec
from sigwarn.sources.results import fresh_path
from sigwarn.sources.tables import INCIDENTS, RECORDINGS, SUBJECTS, incidents, read, recordings

RATE = 8
KEYS = ["subject_id", "recording_id"]
EXCLUDED = (12, 11, 20)


def signal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file per subject and day with a signal per type of event, values in order; some files are cut short."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % SUBJECTS).alias("subject_id"), F.floor(micros(F.col("ts")) / F.lit(86_400_000_000)).alias("recording_id"), "event_type", micros(F.col("ts")).alias("t"), "event_id", F.round(F.col("value") * 10).cast("int").alias("d"))
    rate = RATE
    days = e.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("event_type", "t", "event_id", "d"))).alias("s"))
    flat = days.select(F.concat_ws("/", F.lit("made"), "subject_id", F.concat("recording_id", F.lit(".edf"))).alias("path"), F.transform("s", lambda x: x["event_type"]).alias("names"), F.transform("s", lambda x: x["d"]).alias("d"), "recording_id")

    @F.pandas_udf("binary")
    def packed(names: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for n, v in zip(names, values, strict=True):
            n, v = np.asarray(n), np.asarray(v)
            kinds = sorted(set(n))
            out.append(rec.encode(kinds, [v[n == k] for k in kinds], rate))
        return pd.Series(out)

    content = packed("names", "d")
    return flat.select("path", F.when(F.col("recording_id") % 9 == 4, F.substring(content, 1, 300)).otherwise(content).alias("content"))


DECODED = f"""WITH e AS (SELECT user_id % {SUBJECTS} AS subject_id, epoch_us(ts) // 86400000000 AS recording_id, event_type, round(value * 10) AS d, row_number() OVER (PARTITION BY user_id % {SUBJECTS}, epoch_us(ts) // 86400000000, event_type ORDER BY epoch_us(ts), event_id) - 1 AS i FROM events),
s AS (SELECT subject_id, recording_id, event_type, max(i) + 1 AS n, sum(d) AS d, sum(d * (i % 7)) AS wd FROM e GROUP BY ALL), m AS (SELECT subject_id, recording_id, ((max(n) + {RATE - 1}) // {RATE}) * {RATE} AS n FROM s GROUP BY ALL)
SELECT s.subject_id || '/' || s.recording_id AS recording, event_type AS channel, m.n::BIGINT AS samples, {RATE}.0::DOUBLE AS fs, round(d / 10, 1) AS sum_uv, round(wd / 10, 1) AS weighted_uv FROM s JOIN m USING (subject_id, recording_id) WHERE recording_id % 9 <> 4"""


def decoded_sums(chunks: DataFrame) -> DataFrame:
    x = chunks.where("error is null").select(F.regexp_extract("path", r"made/(.*)\.edf", 1).alias("recording"), F.get("names", F.col("place")).alias("channel"), "fs", "start_sample", F.posexplode("samples").alias("k", "v"))
    g = x.groupBy("recording", "channel", "fs").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("v").cast("double") * 1e6).alias("s"), F.sum(F.col("v").cast("double") * 1e6 * ((F.col("start_sample") + F.col("k")) % 7)).alias("t"))
    return g.select("recording", "channel", "samples", "fs", (F.round("s", 1) + 0.0).alias("sum_uv"), (F.round("t", 1) + 0.0).alias("weighted_uv"))


@query(DECODED)
def a1_decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_sums(rec.decode(signal_files(spark, sf_dir)))


@query(DECODED)
def a1_file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, written to a folder and read back by ranges of records."""
    folder = fresh_path(spark, "signals")
    rec.write_files(signal_files(spark, sf_dir), folder)
    return decoded_sums(rec.read_ranges(spark, folder))


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, recording_id, place, name): the channels of a recording under other spellings; some twice, some missing."""
    t = F.array(*[F.lit(c) for c in rec.CHANNELS])
    each = recordings(spark, sf_dir).select(*KEYS, F.posexplode(t).alias("k", "channel"))
    kind = (F.col("recording_id") + 7 * F.col("k") + F.col("subject_id")) % 6
    c = F.col("channel")
    spelled = F.when(kind == 1, F.array(F.lower(c))).when(kind == 2, F.array(F.concat(F.lit(" "), F.replace(c, F.lit("-"), F.lit(" - "))))).when(kind == 3, F.array(F.concat(F.replace(c, F.lit("-"), F.lit("- ")), F.lit(" ")))).when(kind == 4, F.array(F.concat(c, F.lit("-0")), F.concat(c, F.lit("-1")))).otherwise(F.array(c))
    kept = each.where(~((kind == 5) & ((F.col("recording_id") + F.col("subject_id")) % 10 == 0)))
    return kept.select(*KEYS, "k", F.posexplode(spelled).alias("twin", "name")).select(*KEYS, (F.col("k") * 2 + F.col("twin")).alias("place"), "name")


NAMED = f"""{RECORDINGS}, ch AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate(rec.CHANNELS))}) AS v(k, channel)),
kd AS (SELECT subject_id, recording_id, k, channel, (recording_id + 7 * k + subject_id) % 6 AS kind, (recording_id + subject_id) % 10 = 0 AS thin FROM recordings, ch)"""
#: Place of a channel among the names of its recording: each channel before it counts once, or twice where it has a twin.
PLACED = f"{NAMED}, pl AS (SELECT *, bool_or(thin AND kind = 5) OVER r AS short, coalesce(sum(CASE WHEN kind = 4 THEN 2 ELSE 1 END) OVER (PARTITION BY subject_id, recording_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM kd WINDOW r AS (PARTITION BY subject_id, recording_id))"


@query(f"WITH {PLACED} SELECT subject_id, recording_id, k::INTEGER AS ch_idx, channel, place::INTEGER AS place FROM pl WHERE NOT short")
def a2_channel_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rec.map_channels(raw_names(spark, sf_dir), KEYS).where(F.size("missing") == 0)
    return m.select(*KEYS, F.inline("channels"))


@query(f"WITH {NAMED} SELECT subject_id, recording_id, string_agg(channel, ',' ORDER BY k) AS missing FROM kd WHERE thin AND kind = 5 GROUP BY ALL")
def a2_rejected_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.map_channels(raw_names(spark, sf_dir), KEYS).where(F.size("missing") > 0).select(*KEYS, F.array_join("missing", ",").alias("missing"))


@query(f"WITH e AS (SELECT user_id % {SUBJECTS} AS subject_id, epoch_us(ts) // 86400000000 AS recording_id, count(*) AS n FROM events GROUP BY ALL) SELECT subject_id, recording_id, n / 2.0::DOUBLE AS fs, n IN (2, 3) AS accepted FROM e")
def a3_sampling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy((F.col("user_id") % SUBJECTS).alias("subject_id"), F.floor(micros(F.col("ts")) / F.lit(86_400_000_000)).cast("long").alias("recording_id")).agg((F.count(F.lit(1)) / 2.0).alias("fs"))
    return rec.check_rate(e, 1)


def annotation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, text): the incidents of a subject as annotation text, with both forms of its lines; some blocks declare a wrong number."""
    day = recordings(spark, sf_dir).join(incidents(spark, sf_dir).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("event_idx", "onset", "offset"))).alias("e")), KEYS, "left")
    found = F.coalesce(F.size("e"), F.lit(0))
    numbered = F.col("subject_id") % 2 == 0
    label = lambda x: F.when(numbered, F.concat(F.lit("Seizure "), x["event_idx"].cast("string"))).otherwise("Seizure")
    lines = F.transform(F.coalesce("e", F.array().cast("array<struct<event_idx:bigint,onset:bigint,offset:bigint>>")), lambda x: F.concat(label(x), F.lit(" Start Time: "), x["onset"].cast("string"), F.lit(" seconds\n"), label(x), F.lit(" End Time: "), x["offset"].cast("string"), F.lit(" seconds\n")))
    declared = F.when((found > 0) & (F.col("recording_id") % 7 == 3), found + 1).otherwise(found)
    name = F.when(F.col("subject_id") % 3 == 0, "FILE NAME: ").otherwise("File Name: ")
    block = F.concat(name, F.col("recording_id").cast("string"), F.lit(".edf\nFile Start Time: 00:00:00\nFile End Time: 24:00:00\nNumber of Seizures in File: "), declared.cast("string"), F.lit("\n"), F.array_join(lines, ""), F.lit("\n"))
    per = day.select("subject_id", F.struct("recording_id", block.alias("b")).alias("b")).groupBy("subject_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return per.select("subject_id", F.concat(F.lit("Data Sampling Rate: 256 Hz\n\n"), F.array_join(F.transform("b", lambda x: x["b"]), "")).alias("text"))


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation texts, written to a folder per subject and read back."""
    path = fresh_path(spark, "texts")
    annotation_texts(spark, sf_dir).repartition("subject_id").write.partitionBy("subject_id").text(path)
    return rec.read_texts(spark, path)


AGREEING = f"{INCIDENTS}, ag AS (SELECT * FROM incidents WHERE recording_id % 7 <> 3)"


@query(f'WITH {AGREEING} SELECT subject_id::VARCHAR AS subject_id, recording_id || \'.edf\' AS recording_id, event_idx::INTEGER AS event_idx, onset::DOUBLE AS onset, "offset"::DOUBLE AS "offset" FROM ag')
def a4_annotated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.annotated_events(rec.annotation_blocks(stored_texts(spark, sf_dir)))


@query(f"WITH {INCIDENTS} SELECT subject_id::VARCHAR AS subject_id, recording_id || '.edf' AS recording_id, (count(*) + 1)::INTEGER AS declared, count(*)::INTEGER AS found_onsets, count(*)::INTEGER AS found_offsets FROM incidents WHERE recording_id % 7 = 3 GROUP BY ALL")
def a4_disagreeing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.disagreeing(rec.annotation_blocks(stored_texts(spark, sf_dir)))


@query(f"WITH {AGREEING}, s AS (SELECT DISTINCT user_id % {SUBJECTS} AS subject_id FROM events) SELECT s.subject_id::VARCHAR AS subject_id, count(DISTINCT ag.recording_id) AS n_files, count(ag.recording_id) AS n_events FROM s LEFT JOIN ag USING (subject_id) WHERE s.subject_id NOT IN {EXCLUDED} GROUP BY 1")
def a5_subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.subject_counts(stored_texts(spark, sf_dir), tuple(str(x) for x in EXCLUDED))


@query(f"WITH {RECORDINGS}, {INCIDENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY recording_id) - 1 AS k, recording_id - lag(recording_id) OVER (PARTITION BY subject_id ORDER BY recording_id) AS gap FROM recordings), h AS (SELECT DISTINCT subject_id, recording_id FROM incidents WHERE recording_id % 7 <> 3) SELECT o.subject_id::VARCHAR AS subject_id, o.recording_id || '.edf' AS recording_id, (k * 86400)::BIGINT AS abs_start, ((k + 1) * 86400)::BIGINT AS abs_end, h.recording_id IS NOT NULL AS has_event FROM o LEFT JOIN h ON o.subject_id = h.subject_id AND o.recording_id = h.recording_id")
def a4_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.timeline(rec.annotation_blocks(stored_texts(spark, sf_dir))).drop("seq")


WIDTH, STRIDE = 64, 32


@query(f"WITH {LEVEL}, z AS (SELECT subject_id, count(*) AS n FROM lv GROUP BY 1), g AS (SELECT subject_id, unnest(generate_series(0, n - {WIDTH}, {STRIDE})) AS first FROM z WHERE n >= {WIDTH}) SELECT g.subject_id, (first // {STRIDE})::BIGINT AS win_idx, first::BIGINT AS start, count(*)::INTEGER AS samples, round(avg(prob), 6) AS mean, round(sum(prob * (seq - first)), 6) AS moment FROM g JOIN lv ON lv.subject_id = g.subject_id AND seq BETWEEN first AND first + {WIDTH - 1} GROUP BY ALL")
def b2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = w.segments(level(spark, sf_dir), ["subject_id"], "seq", "prob", WIDTH, STRIDE)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    return s.select("subject_id", "win_idx", "start", F.size("samples").alias("samples"), r6(add("samples") / WIDTH).alias("mean"), r6(add(F.transform("samples", lambda x, k: x * k))).alias("moment"))
