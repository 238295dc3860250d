"""Queries on recordings and events: window grids, labels, clean recordings, leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarn.functions import r6
from sigwarn.operators import ordered as o
from sigwarn.operators import windows as w
from sigwarn.registry import query
from sigwarn.sources.tables import DAY, INCIDENTS, RECORDINGS, incidents, recordings

WIDTH, STEP, LEAD, HORIZON, AFTER, GAP = 7200, 3600, 21_600, 3600, 21_600, 86_400

GRID = f"""grid AS (SELECT subject_id, recording_id, abs_start, k AS win_idx, k * {STEP} AS start_sec, k * {STEP} + {WIDTH} AS end_sec FROM recordings, generate_series(0, ({DAY} - {WIDTH}) // {STEP}) AS t(k))"""
ZONES = f"""xz AS (SELECT subject_id, recording_id, onset AS z_start, least("offset" + {AFTER}, {DAY}) AS z_end FROM incidents),
lz0 AS (SELECT subject_id, recording_id, onset - {LEAD} AS s, onset - {HORIZON} AS e FROM incidents WHERE onset >= {LEAD}),
lz1 AS (SELECT *, max(e) OVER (PARTITION BY subject_id, recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lz0),
lz2 AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, recording_id ORDER BY s, e) AS g FROM lz1),
lz AS (SELECT subject_id, recording_id, min(s) AS z_start, max(e) AS z_end FROM lz2 GROUP BY subject_id, recording_id, g)"""
LABELS = f"""hx AS (SELECT g.subject_id, g.recording_id, g.win_idx FROM grid g JOIN xz z ON g.subject_id = z.subject_id AND g.recording_id = z.recording_id AND g.start_sec < z.z_end AND g.end_sec > z.z_start GROUP BY ALL),
hl AS (SELECT g.subject_id, g.recording_id, g.win_idx, bool_or(g.start_sec >= z.z_start AND g.end_sec <= z.z_end) AS inside FROM grid g JOIN lz z ON g.subject_id = z.subject_id AND g.recording_id = z.recording_id AND g.start_sec < z.z_end AND g.end_sec > z.z_start GROUP BY ALL),
labelled AS (SELECT g.*, CASE WHEN hx.win_idx IS NOT NULL THEN -1 WHEN hl.win_idx IS NULL THEN 0 WHEN hl.inside THEN 1 ELSE -1 END AS label FROM grid g LEFT JOIN hx USING (subject_id, recording_id, win_idx) LEFT JOIN hl USING (subject_id, recording_id, win_idx))"""
BASE = f"{INCIDENTS}, {RECORDINGS}"


def labelled(spark: SparkSession, sf_dir: str, lead: int = LEAD) -> DataFrame:
    r = recordings(spark, sf_dir)
    return w.label_windows(w.grid(r, WIDTH, STEP), incidents(spark, sf_dir), r, lead, HORIZON, AFTER)


@query(f"WITH {RECORDINGS}, {GRID} SELECT subject_id, recording_id, win_idx, start_sec, end_sec FROM grid")
def b1_window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.grid(recordings(spark, sf_dir), WIDTH, STEP).select("subject_id", "recording_id", "win_idx", "start_sec", "end_sec")


@query(f"WITH {BASE}, {ZONES} SELECT * FROM xz")
def b3_exclusion_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.exclusion_zones(incidents(spark, sf_dir), recordings(spark, sf_dir), AFTER)


@query(f"WITH {BASE}, {ZONES} SELECT * FROM lz")
def b4_lead_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.lead_zones(incidents(spark, sf_dir), LEAD, HORIZON)


@query(f"WITH {BASE}, {GRID}, {ZONES}, {LABELS} SELECT subject_id, recording_id, win_idx, label FROM labelled")
def b5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("subject_id", "recording_id", "win_idx", "label")


@query(f"WITH {BASE}, {GRID}, {ZONES}, {LABELS} SELECT subject_id, recording_id, win_idx, label FROM labelled WHERE label <> -1")
def b7_drop_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).where("label <> -1").select("subject_id", "recording_id", "win_idx", "label")


@query(f"WITH {BASE}, {GRID}, {ZONES}, {LABELS} SELECT subject_id, recording_id, win_idx, label FROM labelled WHERE subject_id IN (SELECT subject_id FROM labelled GROUP BY 1 HAVING count(*) FILTER (label = 1) >= 5 AND count(*) FILTER (label = 0) > 0)")
def b8_usable_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.usable_subjects(labelled(spark, sf_dir), ["subject_id"], 5).select("subject_id", "recording_id", "win_idx", "label")


@query(f"WITH {BASE}, {GRID}, {ZONES}, {LABELS}, k AS (SELECT *, recording_id * 100 + win_idx AS seq FROM labelled), c AS (SELECT *, least(2 * count(*) FILTER (label = 1) OVER (PARTITION BY subject_id), 5000) AS cap, row_number() OVER (PARTITION BY subject_id, label ORDER BY md5('cap|' || subject_id || '|' || seq), seq) AS n FROM k) SELECT subject_id, seq, label FROM c WHERE label = 1 OR (label = 0 AND n <= cap)")
def b9_cap_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("seq", F.col("recording_id") * 100 + F.col("win_idx"))
    return w.cap_negatives(rows, ["subject_id"], 2).select("subject_id", "seq", "label")


@query(f"WITH {BASE}, {GRID}, {ZONES}, {LABELS}, k AS (SELECT *, recording_id * 100 + win_idx AS seq FROM labelled), c AS (SELECT *, row_number() OVER (PARTITION BY subject_id, label ORDER BY md5('sample|' || subject_id || '|' || seq), seq) AS n FROM k) SELECT subject_id, seq, label FROM c WHERE n <= 10")
def b10_sample_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("seq", F.col("recording_id") * 100 + F.col("win_idx"))
    return w.sample_per_class(rows, ["subject_id"], 10).select("subject_id", "seq", "label")


CLEAN = f"""hit AS (SELECT r.subject_id, r.recording_id, e.abs_onset, e.event_idx, CASE WHEN r.recording_id = e.recording_id THEN 'has_event' WHEN e.abs_onset >= r.abs_end THEN 'before_event' ELSE 'after_event' END AS reason,
CASE WHEN r.recording_id = e.recording_id THEN 0 WHEN e.abs_onset >= r.abs_end THEN e.abs_onset - r.abs_end ELSE r.abs_start - e.abs_offset END / 3600.0::DOUBLE AS gap_hours FROM recordings r JOIN incidents e ON r.subject_id = e.subject_id
AND (r.recording_id = e.recording_id OR (e.abs_onset >= r.abs_end AND e.abs_onset - r.abs_end < {GAP}) OR (e.abs_onset < r.abs_end AND r.abs_start - e.abs_offset < {GAP}))),
fst AS (SELECT *, row_number() OVER (PARTITION BY subject_id, recording_id ORDER BY reason <> 'has_event', abs_onset, event_idx) AS k FROM hit)"""


@query(f"WITH {BASE}, {CLEAN} SELECT r.subject_id, r.recording_id FROM recordings r WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.subject_id = r.subject_id AND h.recording_id = r.recording_id)")
def c1_clean_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.clean_recordings(recordings(spark, sf_dir), incidents(spark, sf_dir), GAP, GAP).where("reason is null").select("subject_id", "recording_id")


@query(f"WITH {BASE}, {CLEAN} SELECT r.subject_id, r.recording_id, f.reason, round(f.gap_hours, 6) AS gap_hours FROM recordings r LEFT JOIN fst f ON f.subject_id = r.subject_id AND f.recording_id = r.recording_id AND f.k = 1")
def c2_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.clean_recordings(recordings(spark, sf_dir), incidents(spark, sf_dir), GAP, GAP).select("subject_id", "recording_id", "reason", r6(F.col("gap_hours")).alias("gap_hours"))


@query(f"WITH {BASE}, {GRID}, {ZONES}, {LABELS} SELECT subject_id, recording_id, win_idx, label FROM labelled l WHERE label = 1 OR NOT EXISTS (SELECT 1 FROM incidents e WHERE e.subject_id = l.subject_id AND l.abs_start + l.start_sec < e.abs_offset + 7200 AND l.abs_start + l.end_sec > e.abs_onset - 7200)")
def c3_far_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    rows = rows.select("subject_id", "recording_id", "win_idx", "label", (F.col("abs_start") + F.col("end_sec")).alias("abs_end"), (F.col("abs_start") + F.col("start_sec")).alias("abs_start"))
    return w.far_from_events(rows, incidents(spark, sf_dir), 7200).select("subject_id", "recording_id", "win_idx", "label")


@query(f"WITH {BASE}, s AS (SELECT *, abs_onset - lag(abs_offset) OVER (PARTITION BY subject_id ORDER BY abs_onset, recording_id, event_idx) AS since FROM incidents) SELECT subject_id, recording_id, event_idx, CASE WHEN since IS NULL OR since >= {GAP} THEN 'lead' ELSE 'clustered' END AS kind, onset >= {LEAD} AS reconstructable FROM s")
def e6_lead_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.classify_leads(incidents(spark, sf_dir), ["subject_id"], GAP, LEAD).select("subject_id", "recording_id", "event_idx", "kind", "reconstructable")


@query(f"WITH {BASE}, {GRID}, {ZONES}, {LABELS} SELECT subject_id, count(*) AS windows, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, round(CASE WHEN count(*) FILTER (label = 1) > 0 THEN count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1) END, 6) AS ratio FROM labelled GROUP BY 1")
def d1_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.count(F.when(F.col("label") == v, 1))
    return labelled(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("windows"), n(1).alias("positives"), n(0).alias("negatives"), r6(F.try_divide(n(0).cast("double"), n(1))).alias("ratio"))
