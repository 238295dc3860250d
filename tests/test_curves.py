import itertools
import random

import numpy as np
import pytest

from sigwarn.operators import curves, graphs, ordered, statistics


def series(spark, n=120, seed=5):
    rng = random.Random(seed)
    rows = [(s, k, rng.random(), int(rng.random() < 0.4)) for s in ("a", None, "c") for k in range(n if s != "c" else 4)]
    return spark.createDataFrame(rows, "s string, seq long, prob double, label int"), rows


def plain_alarms(probs, threshold, k, m, refractory):
    out, left = [], 0
    for i in range(len(probs)):
        fires = left == 0 and sum(p >= threshold for p in probs[max(0, i - m + 1) : i + 1]) >= k
        left = refractory if fires else max(0, left - 1)
        out.append(int(fires))
    return out


@pytest.mark.parametrize("chunk", [7, 1000])
def test_alarms_of_all_series_as_by_hand(spark, chunk):
    df, rows = series(spark)
    got = {(r["s"], r["seq"]): r["alarm"] for r in ordered.alarms(df, ["s"], 0.55, 3, 6, 5, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for s in ("a", None, "c"):
        probs = [r[2] for r in rows if r[0] == s]
        assert [got[s, k] for k in range(len(probs))] == plain_alarms(probs, 0.55, 3, 6, 5)
    assert sum(got[None, k] for k in range(120)) > 3


@pytest.mark.parametrize("chunk", [7, 1000])
def test_counts_along_the_grid(spark, chunk):
    df, rows = series(spark)
    grid = [0.2, 0.5, 0.8]
    blocked = ordered.blocks(df, ["s"])
    block = {(r["s"], r["seq"]): r["block"] for r in blocked.collect()}
    got = {(r["s"], r["threshold"]): r for r in curves.alarm_counts(blocked, ["s"], grid, 3, 6, 5, chunk=chunk).collect()}
    assert len(got) == 9
    for s, t in itertools.product(("a", None, "c"), grid):
        own = [r for r in rows if r[0] == s]
        fired = plain_alarms([r[2] for r in own], t, 3, 6, 5)
        tp, fp = (sum(f for f, r in zip(fired, own, strict=True) if r[3] == y) for y in (1, 0))
        hit = {block[s, r[1]] for f, r in zip(fired, own, strict=True) if f and r[3] == 1}
        r = got[s, t]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, sum(x[3] for x in own) - tp, sum(1 - x[3] for x in own) - fp)
        assert (r["n_events"], r["events_hit"]) == (len({b for (q, _), b in block.items() if q == s and b is not None}), len(hit))


def test_what_a_chunk_is_handed_is_not_on_its_rows(spark):
    blocked = ordered.blocks(series(spark)[0], ["s"])
    plan = curves.alarm_counts(blocked, ["s"], [0.2, 0.5], 3, 6, 5, chunk=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_exact_p_of_signed_ranks(spark):
    d = [0.3, -0.1, 0.5, 0.2, 0.0, -0.2, 0.4]
    pairs = spark.createDataFrame([(x, 0.0) for x in d] + [(None, 1.0)], "x double, y double")
    r = statistics.wilcoxon(pairs, "x", "y", split_zeros=True).first()
    order = sorted({abs(x) for x in d})
    mean_rank = {a: np.mean([i + 1 for i, v in enumerate(sorted(abs(x) for x in d)) if v == a]) for a in order}
    ranks = [mean_rank[abs(x)] for x in d if x]
    up = sum(mean_rank[abs(x)] for x in d if x > 0)
    sums = [sum(q for q, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    p = min(1.0, 2 * min(np.mean([s >= up for s in sums]), np.mean([s <= up for s in sums])))
    assert r["n"] == 7 and r["w_plus"] == up + mean_rank[0.0] / 2 and r["w_plus"] + r["w_minus"] == 28 and abs(r["p"] - p) < 1e-12
    assert statistics.wilcoxon(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "x", "y", split_zeros=True).first()["p"] is None


def test_p_of_rank_sums_is_normal(spark):
    from math import erfc, sqrt

    df = spark.createDataFrame([(1, 1, 0.1 * k) for k in range(9)] + [(1, 0, 0.07 * k) for k in range(12)], "g int, label int, prob double")
    r = statistics.mann_whitney(df, ["g"]).first()
    spread = (r["u"] - 54) / r["z"]
    assert abs(r["p"] - erfc((abs(r["u"] - 54) - 0.5) / spread / sqrt(2))) < 1e-6


def test_descriptors_of_matrices(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(4, 5, 5))
    df = spark.createDataFrame([(k, a.ravel().tolist()) for k, a in enumerate(m)] + [(9, None), (10, [1.0, 2.0]), (11, [float("nan")] * 4), (12, [0.0] * 4)], "k int, a array<double>")
    got = {r["k"]: r["d"] for r in df.select("k", graphs.descriptors(df["a"]).alias("d")).collect()}
    assert got[9] is None and got[10] is None and got[11] is None and np.allclose(got[12], 0)
    names = graphs.names([str(c) for c in range(5)])
    assert len(names) == len(got[0]) == 3 * 5 + 13
    for k, a in enumerate(m):
        a = a / np.linalg.norm(a)
        d = dict(zip(names, got[k], strict=True))
        off = a[~np.eye(5, dtype=bool)]
        assert np.allclose([d[f"in_deg_{c}"] for c in range(5)], a.sum(1) - np.diag(a)) and np.allclose([d[f"net_flow_{c}"] for c in range(5)], a.sum(0) - a.sum(1))
        assert np.allclose([d["mean_off"], d["std_off"], d["max_off"], d["min_off"]], [off.mean(), off.std(), off.max(), off.min()])
        assert np.isclose(d["spec_radius"], max(abs(np.linalg.eigvals(a)))) and np.allclose([d[f"sv_{i}"] for i in range(1, 6)], np.linalg.svd(a)[1])
        assert np.isclose(d["density"], np.mean(off > 0.5 * max(off.max(), 1e-12)))
