import numpy as np
import pytest

from pyspark.sql import functions as F

from sigwarn import registry
from sigwarn.operators import autoregression as v
from sigwarn.operators import signals as s
from sigwarn.plans import signals as plans

RNG = np.random.default_rng(5)
X = RNG.normal(size=(4, 3, 256)).cumsum(axis=2) * 0.1 + RNG.normal(size=(4, 3, 256))


def test_autoregression_finds_its_coefficients():
    a = np.array([[0.5, 0.2], [0.0, -0.3]])
    x = np.zeros((1, 2, 20000))
    for t in range(1, 20000):
        x[0, :, t] = a @ x[0, :, t - 1] + RNG.normal(size=2)
    coef, cov = v.autoregression(x, 1)
    assert np.abs(coef[0] - a).max() < 0.03 and np.abs(cov[0] - np.eye(2)).max() < 0.05
    assert np.isnan(v.autoregression(X[:, :, :8], 3)[0]).all()


def test_spectral_views_by_plain_loops():
    coef = v.autoregression(X, 2)[0]
    pdc, dtf = s.directed_coherence(coef, 64, {"b": (4, 8)}), s.directed_transfer(coef, 64, {"b": (4, 8)})
    want_p, want_d = np.zeros((3, 3)), np.zeros((3, 3))
    at = np.linspace(4, 8, 16, endpoint=False)
    for f in at:
        h = np.eye(3) - sum(coef[0][:, 3 * k : 3 * k + 3] * np.exp(-2j * np.pi * f * (k + 1) / 64) for k in range(2))
        g = np.linalg.inv(h)
        for i in range(3):
            for j in range(3):
                want_p[i, j] += abs(h[i, j]) ** 2 / sum(abs(h[:, j]) ** 2) / 16
                want_d[i, j] += abs(g[i, j]) ** 2 / sum(abs(g[i]) ** 2) / 16
    assert np.allclose(pdc[0, 0], want_p) and np.allclose(dtf[0, 0], want_d)
    assert np.allclose(pdc.sum(axis=2), 1) and np.allclose(dtf.sum(axis=3), 1)


def test_filter_keeps_the_band_only():
    t = np.arange(64 * 60) / 64
    inside, outside = np.sin(2 * np.pi * 8 * t), np.sin(2 * np.pi * 0.02 * t)
    got = s.band_pass(inside + 5 * outside, 64, 2, 20)
    assert np.abs(got - inside)[320:-320].max() < 0.02


def test_recordings_are_filtered_as_a_whole(spark):
    n, gone = 64 * 300 + 10, {0, 5, 6000, 6001}
    whole = {k: RNG.normal(size=(2, n)).cumsum(axis=1) * 0.1 + RNG.normal(size=(2, n)) for k in (1, 2)}
    rows = [(k, 2 * t + c, None if t in gone and c == 0 else float(x[c, t])) for k, x in whole.items() for c in range(2) for t in range(n)]
    df = spark.createDataFrame(rows, "rec int, o long, v double").repartition(3)
    got = {(r["rec"], r["win"]): r["features"] for r in s.filter_recordings(df, ["rec"], "o", "v", 2, 64, 64, least=2048).collect()}
    assert sorted(got) == [(k, w) for k in (1, 2) for w in range(301)]
    for k, x in whole.items():
        for c in range(2):
            have = [e for w in range(301) for e in got[k, w][64 * c : 64 * c + 64]]
            kept = [t for t in range(n) if c or t not in gone]
            assert [t for t, e in enumerate(have) if e is not None] == kept
            line = np.arange(kept[0], n)
            want = s.band_pass(np.interp(line, kept, x[c, kept]), 64, periods=s.FADED)
            assert np.abs(np.array([have[t] for t in kept]) - want[np.array(kept) - line[0]]).max() < 1e-6


def test_first_query_keeps_partial_windows(spark):
    rows = registry.QUERIES["i1_band_pass"](spark, "/root/testdata/sf0.001").collect()
    assert sum(e is not None for r in rows for e in r["features"]) == 1000 and len(rows) == 6


def test_power_and_coherence():
    t = np.arange(256) / 64
    x = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 10 * t + 1), RNG.normal(size=256)])[None]
    at, p = s.power_density(x, 64, 64)
    assert at[p[0, 0].argmax()] == 10 and abs(np.trapezoid(p[0, 0], at) - 0.5) < 0.01
    c = s.coherence(X, 64)
    assert np.allclose(np.einsum("wii->wi", c), 1) and (c <= 1 + 1e-9).all()
    assert np.allclose(s.band_power(X, 64).mean(axis=1), 0, atol=1e-9)


def test_log_spectrogram_by_plain_loops():
    got = s.log_spectrogram(X, 64)
    assert got.shape == (4, 3, 30, 7)
    ramp = [0.5 * (1 - np.cos(np.pi * n / 8)) for n in range(8)]
    taper = np.array([*ramp, *[1.0] * 49, *ramp[:0:-1]])
    for segment in (0, 3, 6):
        part = X[1, 2, 32 * segment : 32 * segment + 64]
        part = (part - part.mean()) * taper
        for f in (1, 7, 30):
            wave = sum(part[n] * np.exp(-2j * np.pi * f * n / 64) for n in range(64))
            assert np.isclose(got[1, 2, f - 1, segment], np.log1p(2 * abs(wave) ** 2 / (64 * (taper**2).sum())))


def test_signal_queries_run(spark):
    names = [n for n in registry.QUERIES if n in ("i1_band_pass", "i6_directed_coherence", "i14_band_power", "i15_spectrogram", "i4_signed_views", "f3_best_order")]
    for name in names:
        rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert rows and all(r[-1] is not None for r in rows), name


def plain_model(x, p, ridge=1e-10):
    """One window by least squares on stacked lags."""
    x = x - x.mean(axis=1, keepdims=True)
    n, length = x.shape
    now, past = x[:, p:], np.concatenate([x[:, p - k : length - k] for k in range(1, p + 1)])
    coef = now @ past.T @ np.linalg.inv(past @ past.T + ridge * (length - p) * np.eye(n * p))
    rest = now - coef @ past
    return coef, rest @ rest.T / (length - p)


@pytest.mark.parametrize("scale", [1e-5, 1.0, 1e6])
def test_all_orders_from_one_pass(scale):
    for fit in v.fits(X * scale, [1, 2, 3, 5, 7, 10]):
        assert fit.valid.all()
        for k in range(len(X)):
            coef, cov = plain_model(X[k] * scale, fit.order)
            assert np.allclose(fit.coef[k], coef, atol=1e-7) and np.allclose(fit.cov[k], cov, rtol=1e-7, atol=1e-9 * scale**2)


@pytest.mark.parametrize("scale", [1e-5, 1.0, 1e6, 1e12])
def test_dependent_windows_have_no_model_and_harm_no_other(scale):
    doubled, flat, tripled, holes, lagged = (X[0].copy() * scale for _ in range(5))
    doubled[2], flat[1], tripled[2] = doubled[0], 7.5 * scale, -3 * tripled[1] + 4 * scale
    holes[0, 9], lagged[1, 1:] = np.nan, lagged[0, :-1]
    lagged[1, 0] = 0
    batch = np.stack([doubled, X[1] * scale, flat, tripled, holes, X[2] * scale, np.zeros_like(flat), np.full_like(flat, 3 * scale), lagged])
    for fit in v.fits(batch, [1, 2, 4]):
        assert fit.valid.tolist()[:8] == [False, True, False, False, False, True, False, False]
        assert np.allclose(fit.coef[1], plain_model(X[1] * scale, fit.order)[0], atol=1e-7)
        assert np.isnan(fit.coef[~fit.valid]).all() and np.isnan(fit.cov[~fit.valid]).all()
    for helper in (v.granger, v.signed_views, v.autoregression):
        out = helper(batch, 2)
        assert np.isfinite(out[0][1] if isinstance(out, tuple) else out[1]).all()
    sweep = v.order_criteria(batch, [1, 2, 90])
    assert np.isfinite(sweep[1, :2]).all() and np.isnan(sweep[0]).all() and np.isnan(sweep[:, 2]).all()
    for view in (s.directed_coherence, s.directed_transfer, s.transfer_magnitude):
        got = view(v.autoregression(batch, 2)[0], 64)
        assert np.isfinite(got[1]).all() and np.isnan(got[0]).all()


def test_test_of_products_as_they_are():
    """Without scaling, what is small beside the ridge passes and what is large doesn't."""
    doubled = np.stack([X[0], X[0]])
    doubled[:, 2] = doubled[:, 0]
    doubled[1] *= 1e6
    assert next(v.fits(doubled, [2], scaled_test=False)).valid.tolist() == [True, False]
    assert not next(v.fits(doubled, [2])).valid.any()


def test_a_transfer_without_inverse_is_marked():
    coef = np.zeros((2, 2, 2))
    coef[0] = np.eye(2)
    got = s.transfer_magnitude(coef, 64, {"b": (0, 4)})
    assert np.isnan(got[0]).any() and np.isfinite(got[1]).all()


def test_a_bad_window_is_a_row_without_numbers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 64, 3)) * 1e6
    x[1, :, 2] = x[1, :, 0]
    rows = [(k, float(value)) for k, value in enumerate(x.ravel())]
    rows[3 * 64 * 2 + 5] = (3 * 64 * 2 + 5, None)
    rows.append((3 * 64 * 3 + 1, 0.5))
    df = spark.createDataFrame(rows[: 3 * 64 * 5 - 7] + rows[-1:], "o long, v double").repartition(3)
    got = {r["win"]: r for r in s.apply(s.windows(df, [], "o", "v", 3, 64), lambda b: v.autoregression(b, 2)[0], 3, 64).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and [got[k]["valid"] for k in range(5)] == [True, False, False, False, False]
    assert np.allclose(got[0]["features"], plain_model(x[0].T, 2)[0].ravel(), atol=1e-7) and got[1]["features"] is None


def test_best_and_modal_orders(spark):
    rows = [(1, 0, 1, 5.0, 1.0), (1, 0, 2, 4.0, 2.0), (1, 1, 1, 3.0, 3.0), (1, 1, 2, 3.0, 2.0), (2, 0, 2, 1.0, 1.0), (3, 0, 3, 1.0, 1.0)]
    best = plans.best_orders(spark.createDataFrame(rows, "subject_id int, label int, p int, aic double, bic double"))
    assert sorted(map(tuple, best.collect())) == [(1, 0, 2, 1), (1, 1, 1, 2), (2, 0, 2, 2), (3, 0, 3, 3)]
    assert sorted(map(tuple, plans.modal_orders(best).collect())) == [(0, 3, 2, 1), (1, 1, 1, 2)]


def test_helpers_get_windows_in_blocks_of_bounded_size(spark):
    n = 2000

    def sizes(x):
        return np.full((len(x), 1), x.nbytes)

    df = spark.range(n, numPartitions=1).select(F.col("id").alias("win"), F.array_repeat(F.lit(1.0), 192).alias("x"))
    got = [r["features"][0] for r in s.apply(df, sizes, 3, 64).collect()]
    assert len(got) == n and max(got) <= 1 << 20
