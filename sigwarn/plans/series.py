"""Queries on ordered rows: smoothing, blocks, relabelling, splits, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarn.functions import r6
from sigwarn.operators import ordered as o
from sigwarn.operators import windows as w
from sigwarn.plans.evaluation import block_sql
from sigwarn.plans.labelling import GAP
from sigwarn.registry import query
from sigwarn.sources.tables import CELLS, SCORED, matrices, scored

BY = ["subject_id"]
LEVEL = f"{SCORED}, lv AS (SELECT subject_id, seq, event_id, t_us, label, prob FROM scored WHERE model = 'level')"
BLOCKS = f"{LEVEL}, {block_sql('lv', 'ab', 'subject_id')}"


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("model = 'level'").drop("model")


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.blocks(level(spark, sf_dir), BY, place="seq")


@query(f"WITH {LEVEL} SELECT subject_id, seq, round(CASE WHEN count(*) OVER (PARTITION BY subject_id) < 10 THEN prob ELSE sum(prob) OVER (PARTITION BY subject_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 END, 6) AS smoothed FROM lv")
def e2_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.smooth(level(spark, sf_dir), BY, place="seq").select("subject_id", "seq", r6(F.col("smoothed")).alias("smoothed"))


@query(f"WITH {LEVEL}, s AS (SELECT subject_id, seq, sum(prob) OVER (PARTITION BY subject_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10 AS v FROM lv) SELECT subject_id, seq, round(v, 6) AS smoothed FROM s WHERE seq >= 9")
def e3_smooth_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.smooth_causal(level(spark, sf_dir), BY, place="seq").select("subject_id", "seq", r6(F.col("smoothed")).alias("smoothed"))


@query(f"WITH {BLOCKS} SELECT subject_id, block, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows FROM ab WHERE block IS NOT NULL GROUP BY ALL")
def e5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked(spark, sf_dir).where("block is not null").groupBy("subject_id", "block").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("rows"))


@query(f"WITH {BLOCKS} SELECT subject_id, seq, CASE WHEN block IS NULL THEN label WHEN block_len - pos < 1 THEN 1 ELSE 0 END AS label FROM ab")
def e7_relabel_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.relabel_last(blocked(spark, sf_dir), 1).select("subject_id", "seq", "label")


@query(f"WITH {BLOCKS} SELECT subject_id, seq, CASE WHEN block IS NULL THEN label WHEN block_len - pos >= 1 THEN 1 ELSE 0 END AS label FROM ab")
def e8_trim_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.trim_tail(blocked(spark, sf_dir), 1).select("subject_id", "seq", "label")


@query(f"WITH {BLOCKS} SELECT subject_id, seq, CASE WHEN pos <= block_len // 3 THEN 'early' WHEN pos <= 2 * (block_len // 3) THEN 'middle' ELSE 'late' END AS third FROM ab WHERE block IS NOT NULL")
def e9_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.thirds(blocked(spark, sf_dir)).where("block is not null").select("subject_id", "seq", "third")


@query(f"WITH {LEVEL}, n AS (SELECT *, row_number() OVER (PARTITION BY subject_id, label ORDER BY seq) AS k, count(*) OVER (PARTITION BY subject_id, label) AS n FROM lv) SELECT subject_id, seq, CASE WHEN k <= ceil(round(n * 0.8::DOUBLE, 9)) THEN 'train' ELSE 'val' END AS part FROM n")
def e10_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.chronological_split(level(spark, sf_dir), BY).select("subject_id", "seq", "part")


@query(f"WITH {LEVEL}, n AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n FROM lv) SELECT subject_id, seq, CASE WHEN seq + 1 <= floor(round(n * 0.8::DOUBLE, 9)) THEN 'train' ELSE 'test' END AS part FROM n")
def e11_position_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.position_split(level(spark, sf_dir), BY).select("subject_id", "seq", "part")


@query(f"WITH {LEVEL}, n AS (SELECT *, sum(label) OVER (PARTITION BY subject_id) AS t, sum(label) OVER (PARTITION BY subject_id ORDER BY seq DESC) AS b FROM lv), f AS (SELECT *, max(CASE WHEN label = 1 AND b = least(greatest(floor(round(t * 0.3::DOUBLE, 9)), 2), t - 1) THEN seq END) OVER (PARTITION BY subject_id) AS s FROM n) SELECT subject_id, seq, CASE WHEN seq >= s THEN 'test' ELSE 'train' END AS part FROM f")
def e12_late_positive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.split_at_late_positive(level(spark, sf_dir), BY).select("subject_id", "seq", "part")


@query(f"WITH {LEVEL}, n AS (SELECT *, seq + 1 AS k, count(*) OVER (PARTITION BY subject_id) AS n FROM lv), f AS (SELECT n.*, t.fold, t.s FROM n, (VALUES (0, 0.4::DOUBLE), (1, 0.6::DOUBLE), (2, 0.8::DOUBLE)) AS t(fold, s)), p AS (SELECT subject_id, seq, fold, CASE WHEN k <= floor(round(n * s, 9)) THEN 'train' WHEN k <= floor(round(n * (s + 0.2::DOUBLE), 9)) THEN 'test' END AS part FROM f) SELECT subject_id, fold, part, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq FROM p WHERE part IS NOT NULL GROUP BY ALL")
def e13_expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.expanding_folds(level(spark, sf_dir), BY).groupBy("subject_id", "fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {LEVEL}, n AS (SELECT *, row_number() OVER (PARTITION BY subject_id, label ORDER BY md5('split|' || subject_id || '|' || seq), seq) AS k, count(*) OVER (PARTITION BY subject_id, label) AS n FROM lv) SELECT subject_id, seq, CASE WHEN k <= floor(round(n * 0.7::DOUBLE, 9)) THEN 'train' WHEN k <= floor(round(n * 0.8::DOUBLE, 9)) THEN 'val' ELSE 'test' END AS part FROM n")
def e16_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.stratified_split(level(spark, sf_dir), BY, {"train": 0.7, "val": 0.1, "test": 0.2}).select("subject_id", "seq", "part")


@query(f"WITH {CELLS}, m AS (SELECT subject_id, label, i, j, avg(a) AS a FROM cells GROUP BY ALL) SELECT x.subject_id, round(avg(abs(x.a - y.a)), 6) AS mean_abs_diff FROM m x JOIN m y ON x.subject_id = y.subject_id AND x.i = y.i AND x.j = y.j AND x.label = 1 AND y.label = 0 GROUP BY 1")
def d20_class_mean_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = matrices(spark, sf_dir).select("subject_id", "label", F.posexplode("a").alias("k", "a"))
    mean = cells.groupBy("subject_id", "k").agg(F.avg(F.when(F.col("label") == 1, F.col("a"))).alias("x"), F.avg(F.when(F.col("label") == 0, F.col("a"))).alias("y"))
    return mean.where("x is not null and y is not null").groupBy("subject_id").agg(r6(F.avg(F.abs(F.col("x") - F.col("y")))).alias("mean_abs_diff"))


@query(f"WITH {CELLS}, f AS (SELECT seq, i, sum(abs(a)) AS f FROM cells WHERE i <> j GROUP BY ALL), t AS (SELECT seq, j AS i, sum(abs(a)) AS t FROM cells WHERE i <> j GROUP BY ALL) SELECT seq, i::BIGINT AS channel, round(t - f, 6) AS net_flow FROM f JOIN t USING (seq, i)")
def i10_net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = matrices(spark, sf_dir).select("seq", "n", F.posexplode("a").alias("k", "a")).withColumn("i", F.floor(F.col("k") / F.col("n"))).withColumn("j", F.col("k") % F.col("n")).where("i <> j")
    ends = cells.select("seq", F.inline(F.array(F.struct(F.col("i").cast("long").alias("channel"), (-F.abs("a")).alias("v")), F.struct(F.col("j").cast("long").alias("channel"), F.abs("a").alias("v")))))
    return ends.groupBy("seq", "channel").agg(r6(F.sum("v")).alias("net_flow"))


@query(f"WITH {CELLS} SELECT x.seq, round(avg(abs(x.a - y.a)), 6) AS mean_asymmetry FROM cells x JOIN cells y ON x.seq = y.seq AND x.i = y.j AND x.j = y.i AND x.i < x.j GROUP BY x.seq")
def i11_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.floor(k / 8) < k % 8)
    differ = F.transform(pairs, lambda k: F.abs(F.get("a", k) - F.get("a", (k % 8) * 8 + F.floor(k / 8).cast("int"))))
    return matrices(spark, sf_dir).select("seq", r6(F.aggregate(differ, F.lit(0.0), lambda s, x: s + x) / F.size(differ)).alias("mean_asymmetry"))


@query("WITH e AS (SELECT vec_id AS seq, embedding[1:64] AS e FROM embeddings), s AS (SELECT seq, unnest(e)::DOUBLE AS x FROM e), m AS (SELECT seq, avg(x) AS m, stddev_pop(x) AS d FROM s GROUP BY 1) SELECT seq, round(m, 6) AS mean, round((max(x) - m) / (d + 1e-8), 6) AS top_z FROM s JOIN m USING (seq) GROUP BY seq, m, d")
def h2_z_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n = F.col("a"), F.size("a")
    rows = matrices(spark, sf_dir).withColumn("m", F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n)
    rows = rows.withColumn("d", F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / n))
    return rows.select("seq", r6(F.col("m")).alias("mean"), r6((F.array_max(a) - F.col("m")) / (F.col("d") + 1e-8)).alias("top_z"))


def block_events(blocked: DataFrame) -> DataFrame:
    """Blocks as events: (subject_id, recording_id, event_idx, onset, abs_onset, abs_offset), seconds."""
    second = lambda c: F.floor(c / F.lit(1_000_000)).cast("long")
    b = blocked.where("block is not null").groupBy("subject_id", F.col("block").alias("event_idx")).agg(second(F.min("t_us")).alias("abs_onset"), second(F.max("t_us")).alias("abs_offset"))
    return b.withColumn("recording_id", F.floor(F.col("abs_onset") / 86_400).cast("long")).withColumn("onset", F.col("abs_onset") - F.col("recording_id") * 86_400)


@query(f"WITH {BLOCKS}, b AS (SELECT subject_id, block, min(t_us) // 1000000 AS a, max(t_us) // 1000000 AS z FROM ab WHERE block IS NOT NULL GROUP BY ALL), k AS (SELECT subject_id, block, a - lag(z) OVER (PARTITION BY subject_id ORDER BY a, block) AS since FROM b) SELECT subject_id, seq, ab.label FROM ab LEFT JOIN k USING (subject_id, block) WHERE since IS NULL OR since >= {GAP}")
def c4_lead_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocked(spark, sf_dir)
    return w.lead_only(rows, o.classify_leads(block_events(rows), BY, GAP, 0), BY).select("subject_id", "seq", "label")


@query(f"WITH {LEVEL}, p AS (SELECT subject_id, (t_us // 1000000 + 43200) // 86400 AS rec, min(t_us) // 1000000 % 86400 AS s, max(t_us) // 1000000 % 86400 AS e FROM lv GROUP BY ALL), q AS (SELECT subject_id, rec, s, CASE WHEN e < s THEN e + 86400 ELSE e END AS e FROM p), r AS (SELECT *, coalesce((s < lag(e) OVER (PARTITION BY subject_id ORDER BY rec) - 3600)::INTEGER, 0) AS roll FROM q) SELECT subject_id, rec, (s + 86400 * sum(roll) OVER v)::BIGINT AS abs_start, (e + 86400 * sum(roll) OVER v)::BIGINT AS abs_end FROM r WINDOW v AS (PARTITION BY subject_id ORDER BY rec)")
def e1_rebuild_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings from noon to noon that only tell the time of day of their start and end."""
    second = F.floor(F.col("t_us") / 1_000_000).cast("long")
    clock = lambda c: F.format_string("%02d:%02d:%02d", F.floor(c % 86_400 / 3600), F.floor(c % 3600 / 60), c % 60)
    spans = level(spark, sf_dir).groupBy("subject_id", F.floor((second + 43_200) / 86_400).cast("long").alias("rec")).agg(F.min(second).alias("a"), F.max(second).alias("z"))
    told = spans.select("subject_id", "rec", clock(F.col("a")).alias("start_clock"), clock(F.col("z")).alias("end_clock"))
    return o.rebuild_clock(told, BY, "rec").select("subject_id", "rec", "abs_start", "abs_end")
