"""Queries on descriptors of matrices. Embeddings of 64 numbers are read as 8 x 8 matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarn.functions import r6
from sigwarn.operators import graphs as g
from sigwarn.registry import query
from sigwarn.sources.tables import CELLS, matrices

N = 8
CHANNELS = [f"ch{k}" for k in range(N)]


def described(spark: SparkSession, sf_dir: str, normalise: bool = True) -> DataFrame:
    return matrices(spark, sf_dir).select("seq", g.descriptors(F.col("a"), normalise).alias("d"))


NORMED = f"{CELLS}, nm AS (SELECT seq, sqrt(sum(a * a)) AS f FROM cells GROUP BY 1), nc AS (SELECT seq, i, j, a / CASE WHEN f > 1e-10 THEN f ELSE 1 END AS a FROM cells JOIN nm USING (seq))"
DEGREES = "dg AS (SELECT seq, c AS ch, sum(fi) AS into_, sum(fo) AS out_ FROM (SELECT seq, i AS c, a AS fi, 0 AS fo FROM nc WHERE i <> j UNION ALL SELECT seq, j, 0, a FROM nc WHERE i <> j) GROUP BY ALL)"


@query(f"""WITH {NORMED}, {DEGREES}, sc AS (SELECT seq, avg(a) AS mean_off, stddev_pop(a) AS std_off, max(a) AS max_off, min(a) AS min_off FROM nc WHERE i <> j GROUP BY 1),
de AS (SELECT seq, avg(CASE WHEN a > 0.5 * greatest(max_off, 1e-12) THEN 1.0 ELSE 0.0 END) AS density FROM nc JOIN sc USING (seq) WHERE i <> j GROUP BY 1),
sy AS (SELECT x.seq, avg(abs(x.a - y.a)) AS mean_asym, stddev_pop(abs(x.a - y.a)) AS std_asym FROM nc x JOIN nc y ON x.seq = y.seq AND x.i = y.j AND x.j = y.i AND x.i < x.j GROUP BY 1)
SELECT seq, 'in_deg_ch' || ch AS feature, round(into_, 5) AS value FROM dg UNION ALL SELECT seq, 'out_deg_ch' || ch, round(out_, 5) FROM dg UNION ALL SELECT seq, 'net_flow_ch' || ch, round(out_ - into_, 5) FROM dg
UNION ALL SELECT seq, 'mean_off', round(mean_off, 5) FROM sc UNION ALL SELECT seq, 'std_off', round(std_off, 5) FROM sc UNION ALL SELECT seq, 'max_off', round(max_off, 5) FROM sc UNION ALL SELECT seq, 'min_off', round(min_off, 5) FROM sc
UNION ALL SELECT seq, 'density', round(density, 5) FROM de UNION ALL SELECT seq, 'mean_asym', round(mean_asym, 5) FROM sy UNION ALL SELECT seq, 'std_asym', round(std_asym, 5) FROM sy""")
def i9_all_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descriptors but the spectral ones, which SQL can't express; i9_spectrum has those."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in g.names(CHANNELS)]).alias("feature"), F.col("d").alias("value"))
    rows = described(spark, sf_dir).select("seq", F.inline(pairs))
    return rows.where(~F.col("feature").startswith("sv_") & (F.col("feature") != "spec_radius")).select("seq", "feature", (F.round("value", 5) + 0.0).alias("value"))


@query()
def i9_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral radius and largest singular values of each matrix as it is."""
    first = len(g.GROUPS) * N + len(g.SCALARS)
    return described(spark, sf_dir, normalise=False).select("seq", r6(F.get("d", F.lit(first - 1))).alias("spec_radius"), *[r6(F.get("d", F.lit(first + k))).alias(f"sv_{k + 1}") for k in range(g.SINGULAR)])


@query(f"WITH {NORMED}, {DEGREES} SELECT seq, 'in_deg' AS part, ch::INTEGER AS place, round(into_, 5) AS value FROM dg UNION ALL SELECT seq, 'out_deg', ch::INTEGER, round(out_, 5) FROM dg UNION ALL SELECT seq, 'net_flow', ch::INTEGER, round(out_ - into_, 5) FROM dg")
def h3_feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel groups of the vectors of descriptors."""
    parts = g.feature_groups(described(spark, sf_dir), "seq", "d", N).where(F.col("part").isin(*g.GROUPS))
    return parts.select("seq", "part", "place", (F.round("value", 5) + 0.0).alias("value"))


@query(f"WITH {CELLS} SELECT seq, round(avg(a), 6) AS mean_off FROM cells WHERE i <> j GROUP BY 1")
def i10_off_diagonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = g.off_diagonal(F.col("a"), F.col("n"))
    return matrices(spark, sf_dir).select("seq", r6(F.aggregate(off, F.lit(0.0), lambda s, x: s + x) / F.size(off)).alias("mean_off"))


@query(f"WITH {CELLS}, p AS (SELECT x.seq, x.i, x.j, abs(x.a - y.a) AS v FROM cells x JOIN cells y ON x.seq = y.seq AND x.i = y.j AND x.j = y.i AND x.i < x.j) SELECT seq, (row_number() OVER (PARTITION BY seq ORDER BY i, j) - 1)::INTEGER AS place, round(v, 6) AS value FROM p")
def i11_asymmetry_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices(spark, sf_dir).select("seq", F.posexplode(g.asymmetry(F.col("a"), F.col("n"))).alias("place", "value")).select("seq", "place", r6(F.col("value")).alias("value"))


@query(f"WITH {CELLS}, l AS (SELECT seq, (i * {N} + j)::INTEGER AS place, ln(1 + abs(a)) AS v FROM cells), s AS (SELECT seq, avg(v) AS m, stddev_pop(v) AS d FROM l GROUP BY 1) SELECT seq, place, round((v - m) / (d + 1e-8), 5) AS z FROM l JOIN s USING (seq)")
def h2_normalised_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform("a", lambda x: F.abs(x))
    return matrices(spark, sf_dir).select("seq", F.posexplode(g.z_scores(sizes)).alias("place", "z")).select("seq", "place", (F.round("z", 5) + 0.0).alias("z"))
