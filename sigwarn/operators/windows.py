"""Window grids, zones around events, labels, joins of windows with events, and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.functions import hash_order

KEYS = ["subject_id", "recording_id"]
#: Seconds of a bucket of time. Intervals meet in the buckets that both reach into, so a subject's many events don't meet all its windows.
BUCKET = 14_400


def buckets(start: Column, end: Column, size: int = BUCKET) -> Column:
    """The buckets that an interval reaches into, for explode(); none for an unknown or reversed one."""
    first, last = F.floor(start / size), F.floor(end / size)
    return F.when(first <= last, F.sequence(first, last))


def grid(recordings: DataFrame, width: int, step: int) -> DataFrame:
    """win_idx, start_sec, end_sec of every window that fits into its recording of n_seconds."""
    fits = recordings.where(F.col("n_seconds") >= width)
    rows = fits.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n_seconds") - width, F.lit(step).cast("long"))).alias("win_idx", "start_sec"))
    return rows.withColumn("win_idx", F.col("win_idx").cast("long")).withColumn("end_sec", F.col("start_sec") + width)


def exclusion_zones(events: DataFrame, recordings: DataFrame, after: int) -> DataFrame:
    """[onset, min(offset + after, end of the recording)) of each event."""
    e = events.join(recordings.select(*KEYS, "n_seconds"), KEYS)
    return e.select(*KEYS, F.col("onset").alias("z_start"), F.least(F.col("offset") + after, F.col("n_seconds")).alias("z_end"))


def lead_zones(events: DataFrame, lead: int, horizon: int) -> DataFrame:
    """[onset - lead, onset - horizon) of each event with onset >= lead; overlapping and touching zones are united."""
    z = events.where(F.col("onset") >= lead).select(*KEYS, (F.col("onset") - lead).alias("z_start"), (F.col("onset") - horizon).alias("z_end"))
    w = Window.partitionBy(*KEYS).orderBy("z_start", "z_end")
    before = F.max("z_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    z = z.withColumn("_new", F.coalesce((F.col("z_start") > before).cast("int"), F.lit(1)))
    z = z.withColumn("_island", F.sum("_new").over(w))
    return z.groupBy(*KEYS, "_island").agg(F.min("z_start").alias("z_start"), F.max("z_end").alias("z_end")).drop("_island")


def label_windows(windows: DataFrame, events: DataFrame, recordings: DataFrame, lead: int, horizon: int, after: int, exclude_gap: bool = False, bucket: int = BUCKET) -> DataFrame:
    """windows with `label`: -1 where it overlaps an exclusion zone or partly a lead zone, 1 inside a lead zone, else 0.

    With exclude_gap, windows that overlap [onset - horizon, onset) are -1 too, instead of 0.
    """
    zones = exclusion_zones(events, recordings, after).withColumn("kind", F.lit("x")).unionByName(lead_zones(events, lead, horizon).withColumn("kind", F.lit("l")))
    if exclude_gap:
        zones = zones.unionByName(events.select(*KEYS, F.greatest(F.col("onset") - horizon, F.lit(0)).alias("z_start"), F.col("onset").alias("z_end"), F.lit("x").alias("kind")))
    w = windows.select(*KEYS, "win_idx", "start_sec", "end_sec", F.explode(buckets(F.col("start_sec"), F.col("end_sec"), bucket)).alias("_b")).alias("w")
    z = zones.select("*", F.explode(buckets(F.col("z_start"), F.col("z_end"), bucket)).alias("_b")).alias("z")
    on = [F.col(f"w.{k}") == F.col(f"z.{k}") for k in (*KEYS, "_b")] + [F.col("start_sec") < F.col("z_end"), F.col("end_sec") > F.col("z_start")]
    inside = (F.col("kind") == "l") & (F.col("start_sec") >= F.col("z_start")) & (F.col("end_sec") <= F.col("z_end"))
    hits = w.join(z, on).groupBy(*[F.col(f"w.{k}") for k in KEYS], "win_idx").agg(F.max((F.col("kind") == "x").cast("int")).alias("_x"), F.max(inside.cast("int")).alias("_in"))
    out = windows.join(hits, [*KEYS, "win_idx"], "left")
    return out.withColumn("label", F.when(F.col("_x").isNull(), 0).when((F.col("_x") == 0) & (F.col("_in") == 1), 1).otherwise(-1)).drop("_x", "_in")


def cap_negatives(df: DataFrame, by: list[str], ratio: int = 5, most: int = 5000, key: str = "seq", label: str = "label", seed: str = "cap") -> DataFrame:
    """All positives, and of the negatives of each group min(n0, ratio * n1, most) in hash order."""
    w = Window.partitionBy(*by)
    bound = F.least(F.lit(ratio) * F.sum((F.col(label) == 1).cast("long")).over(w), F.lit(most))
    order = Window.partitionBy(*by, label).orderBy(hash_order(seed, *[F.col(b) for b in by], F.col(key)), key)
    return df.withColumn("_cap", bound).withColumn("_n", F.row_number().over(order)).where((F.col(label) == 1) | ((F.col(label) == 0) & (F.col("_n") <= F.col("_cap")))).drop("_cap", "_n")


def sample_per_class(df: DataFrame, by: list[str], n: int, key: str = "seq", label: str = "label", seed: str = "sample") -> DataFrame:
    """At most n rows of each class of a group, in hash order."""
    order = Window.partitionBy(*by, label).orderBy(hash_order(seed, *[F.col(b) for b in by], F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def usable_subjects(df: DataFrame, by: list[str], least: int = 1, label: str = "label") -> DataFrame:
    """Rows of groups that have both classes and at least `least` positives."""
    good = df.groupBy(*by).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n")).where((F.col("p") >= least) & (F.col("n") > 0))
    return df.join(good.select(*by), by, "left_semi")


def clean_recordings(recordings: DataFrame, events: DataFrame, before: int, after: int, bucket: int = BUCKET) -> DataFrame:
    """Every recording with `reason` (null: clean) and `gap_hours` to the event that excludes it, the first by onset.

    A recording is clean without an event in it, and before seconds or more before each onset of its subject and
    after seconds or more past each offset. Subjects without events have clean recordings only.
    """
    r, e = recordings.alias("r"), events.alias("e")
    own = F.col("r.recording_id") == F.col("e.recording_id")
    to_next, to_last = F.col("e.abs_onset") - F.col("r.abs_end"), F.col("r.abs_start") - F.col("e.abs_offset")
    near = ((F.col("e.abs_onset") >= F.col("r.abs_end")) & (to_next < before)) | ((F.col("e.abs_onset") < F.col("r.abs_end")) & (to_last < after))
    reason = F.when(own, "has_event").when(F.col("e.abs_onset") >= F.col("r.abs_end"), "before_event").otherwise("after_event")
    gap = F.when(own, F.lit(0)).when(F.col("e.abs_onset") >= F.col("r.abs_end"), to_next).otherwise(to_last) / 3600.0
    hit = ["r.subject_id", "r.recording_id", F.struct((~own).alias("far"), F.col("e.abs_onset").alias("o"), F.col("e.event_idx").alias("k"), reason.alias("reason"), gap.alias("gap")).alias("h")]
    within = r.join(e, (F.col("r.subject_id") == F.col("e.subject_id")) & own).select(*hit)
    reach = recordings.withColumn("_b", F.explode(buckets(F.col("abs_start") - after, F.col("abs_end") + before, bucket))).alias("r")
    at = events.withColumn("_b", F.explode(buckets(F.col("abs_onset"), F.col("abs_offset"), bucket))).alias("e")
    around = reach.join(at, (F.col("r.subject_id") == F.col("e.subject_id")) & (F.col("r._b") == F.col("e._b")) & near).select(*hit)
    hits = within.unionByName(around)
    first = hits.groupBy(*KEYS).agg(F.min("h").alias("h"))
    return recordings.join(first, KEYS, "left").select(*[recordings[c] for c in recordings.columns], F.col("h.reason").alias("reason"), F.col("h.gap").alias("gap_hours"))


def far_from_events(windows: DataFrame, events: DataFrame, buffer: int, bucket: int = BUCKET) -> DataFrame:
    """Positive windows, and others at least `buffer` seconds from every event of their subject; windows without a clock (abs_start null) stay."""
    w = windows.where(F.col("label") != 1).select("subject_id", "abs_start", "abs_end", F.explode(buckets(F.col("abs_start"), F.col("abs_end"), bucket)).alias("_b"))
    e = events.select(F.col("subject_id").alias("_s"), "abs_onset", "abs_offset", F.explode(buckets(F.col("abs_onset") - buffer, F.col("abs_offset") + buffer, bucket)).alias("_e"))
    met = (F.col("subject_id") == F.col("_s")) & (F.col("_b") == F.col("_e")) & (F.col("abs_start") < F.col("abs_offset") + buffer) & (F.col("abs_end") > F.col("abs_onset") - buffer)
    near = w.join(e, met, "left_semi").select(*[F.col(c).alias(f"_{c}") for c in ("subject_id", "abs_start", "abs_end")]).distinct()
    same = [F.col(c) == F.col(f"_{c}") for c in ("subject_id", "abs_start", "abs_end")]
    return windows.join(near, [*same, F.col("label") != 1], "left_anti")


def lead_only(blocked: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Rows without those of blocks whose event (the k-th reconstructable one for block k) is not a lead; groups whose counts differ stay whole."""
    w = Window.partitionBy(*by).orderBy("abs_onset", "recording_id", "event_idx")
    numbered = events.where("reconstructable").withColumn("_k", F.row_number().over(w).cast("long"))
    n_events = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_e"))
    n_blocks = blocked.groupBy(*by).agg(F.max("block").alias("_b"))
    match = n_blocks.join(n_events, by).where("_b = _e").select(*by)
    drop = numbered.where("kind <> 'lead'").join(match, by, "left_semi").select(*by, F.col("_k").alias("block"))
    return blocked.join(drop, [*by, "block"], "left_anti")


def segments(samples: DataFrame, by: list[str], order: str, value: str, width: int, step: int) -> DataFrame:
    """(by, win_idx, start, samples) of every complete window of `width` samples, one each `step` samples of a series.

    order counts the samples of a series from 0; windows that lack a sample are left out. A sample goes to the windows
    that cover it, at most width / step rounded up, so no series is gathered in one task.
    """
    at = F.col(order).cast("long")
    last = F.floor(at / step)
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - width) / step) + 1)
    covered = samples.select(*by, at.alias("_at"), F.col(value).alias("_v"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("win_idx"))
    held = covered.groupBy(*by, "win_idx").agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_s"))
    return held.where(F.size("_s") == width).select(*by, "win_idx", (F.col("win_idx") * step).alias("start"), F.transform("_s", lambda x: x["_v"]).alias("samples"))
