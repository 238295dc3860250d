"""Numbers of signal windows: small NumPy helpers on batches of windows, and the Spark job that applies them.

A batch x has the axes window, channel, sample. Spark cuts the signal into windows and deals them out; a helper only
sees the windows of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwarn.operators.autoregression import lags

#: The bands of the spectral features, in Hz.
BANDS = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "broadband": (0.5, 30)}


#: Samples of windows that a helper gets at once, so that its temporary arrays stay small.
BLOCK_SAMPLES = 1 << 17


def windows(df: DataFrame, by: list[str], order: str, value: str, channels: int, length: int, *more: Column) -> DataFrame:
    """(by, win, x, more): consecutive windows of interleaved samples; sample `order` belongs to channel order % channels.

    x is null where a window lacks a sample, has a null one or has one twice. `more` are aggregates of its rows.
    """
    size = channels * length
    grouped = df.where(F.col(order).isNotNull()).groupBy(*by, F.floor(F.col(order) / size).alias("win"))
    cut = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"), *more)
    full = (F.size("s") == size) & (F.size(F.array_distinct("s.o")) == size) & ~F.exists("s", lambda e: e["v"].isNull())
    return cut.withColumn("x", F.when(full, F.col("s.v"))).drop("s")


def apply(df: DataFrame, helper: Callable[[np.ndarray], np.ndarray], channels: int, length: int, out: str = "features", whole: bool = True) -> DataFrame:
    """The rows of windows() with helper's numbers instead of x, and `valid`.

    A window without x, or of whose numbers one isn't finite, isn't valid and has null for them. With whole=False a number
    that isn't finite is null by itself, and a window with any number is valid.
    """
    keys = [c for c in df.columns if c != "x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields) + f", `{out}` array<double>, valid boolean"
    block = max(1, BLOCK_SAMPLES // (channels * length))

    def numbers(column: list) -> list:
        got = [None] * len(column)
        some = [k for k, x in enumerate(column) if x is not None]
        for start in range(0, len(some), block):
            at = some[start : start + block]
            x = np.stack([column[k] for k in at]).reshape(-1, length, channels).transpose(0, 2, 1)
            y = np.asarray(helper(x), dtype=float).reshape(len(at), -1)
            finite = np.isfinite(y)
            for k, row, ok in zip(at, y, finite, strict=True):
                if ok.all():
                    got[k] = row
                elif not whole and ok.any():
                    got[k] = [v if f else None for v, f in zip(row.tolist(), ok, strict=True)]
        return got

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = numbers(part["x"].to_list())
            yield part[keys].assign(**{out: pd.Series(got, index=part.index, dtype=object), "valid": pd.Series([g is not None for g in got], index=part.index, dtype=bool)})

    return df.mapInPandas(run, schema)


def _inverse(h: np.ndarray) -> np.ndarray:
    """Inverses of a batch of matrices; NaN where there is none."""
    try:
        return np.linalg.inv(h)
    except np.linalg.LinAlgError:
        flat, out = h.reshape(-1, *h.shape[-2:]), np.full((h[..., 0, 0].size, *h.shape[-2:]), np.nan + 0j)
        regular = np.abs(np.linalg.det(flat)) > 0
        out[regular] = np.linalg.inv(flat[regular])
        return out.reshape(h.shape)


def _per_band(coef: np.ndarray, fs: float, bands: dict, per_hz: float, view: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean over each band's frequencies of view(I - sum of coefficients turned by lag and frequency); axes window, band, to, from."""
    a, n, out = lags(coef), coef.shape[1], []
    for low, high in bands.values():
        at = np.linspace(low, high, max(4, int((high - low) * per_hz)), endpoint=False)
        turn = np.exp(-2j * np.pi * np.outer(at, np.arange(1, a.shape[1] + 1)) / fs)
        out.append(view(np.eye(n) - np.einsum("fk,wkij->wfij", turn, a)).mean(axis=1))
    return np.stack(out, axis=1)


def directed_coherence(coef: np.ndarray, fs: float, bands: dict = BANDS, per_hz: float = 4.0) -> np.ndarray:
    """Partial directed coherence, squared; its columns sum to 1."""

    def view(h: np.ndarray) -> np.ndarray:
        power = np.abs(h) ** 2
        return power / np.maximum(power.sum(axis=-2, keepdims=True), 1e-30)

    return _per_band(coef, fs, bands, per_hz, view)


def directed_transfer(coef: np.ndarray, fs: float, bands: dict = BANDS, per_hz: float = 4.0) -> np.ndarray:
    """Directed transfer function, squared; its rows sum to 1."""

    def view(h: np.ndarray) -> np.ndarray:
        power = np.abs(_inverse(h)) ** 2
        return power / np.maximum(power.sum(axis=-1, keepdims=True), 1e-30)

    return _per_band(coef, fs, bands, per_hz, view)


def transfer_magnitude(coef: np.ndarray, fs: float, bands: dict = BANDS, per_hz: float = 4.0) -> np.ndarray:
    return _per_band(coef, fs, bands, per_hz, lambda h: np.abs(_inverse(h)))


def spectra(x: np.ndarray, segment: int, level: bool = True, weight: np.ndarray | None = None) -> np.ndarray:
    """Weighted (by default Hann) spectra of half-overlapping segments, each without its mean; axes window, channel, segment, frequency."""
    cut = np.lib.stride_tricks.sliding_window_view(x, segment, axis=2)[:, :, :: segment // 2]
    cut = cut - cut.mean(axis=-1, keepdims=True) if level else cut
    return np.fft.rfft(cut * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment) if weight is None else weight), axis=-1)


def power_density(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean one-sided power densities over segments."""
    weight = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)) ** 2
    p = (np.abs(spectra(x, segment)) ** 2).mean(axis=2) / (fs * weight.sum())
    p[..., 1 : (segment + 1) // 2] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), p


def band_power(x: np.ndarray, fs: float, bands: dict = BANDS, segment: int = 256) -> np.ndarray:
    """log(1 + power) of each band and channel, as z-scores within the window."""
    at, p = power_density(x, fs, min(segment, x.shape[2]))
    parts = [np.trapezoid(p[..., (at >= low) & (at <= high)], at[(at >= low) & (at <= high)], axis=-1) for low, high in bands.values()]
    v = np.log1p(np.concatenate(parts, axis=1))
    return (v - v.mean(axis=1, keepdims=True)) / (v.std(axis=1, keepdims=True) + 1e-8)


def coherence(x: np.ndarray, segment: int = 256) -> np.ndarray:
    """Magnitude-squared coherence of every two channels, averaged over frequencies."""
    s = spectra(x, min(segment, x.shape[2]))
    cross = np.einsum("wisf,wjsf->wijf", s, s.conj()) / s.shape[2]
    own = np.einsum("wiif->wif", cross).real
    return (np.abs(cross) ** 2 / np.maximum(own[:, :, None] * own[:, None], 1e-30)).mean(axis=-1)


def log_spectrogram(x: np.ndarray, fs: int, low: float = 0.5, high: float = 30, tapered: float = 0.25) -> np.ndarray:
    """log(1 + power density) of half-overlapping one-second segments in a band, a share of each tapered by cosines; axes window, channel, frequency, segment."""
    at, place = np.fft.rfftfreq(fs, 1 / fs), np.arange(fs)
    weight = 0.5 - 0.5 * np.cos(np.pi * np.minimum(1, np.minimum(place, fs - place) / (tapered * fs / 2)))
    p = np.abs(spectra(x, fs, weight=weight)) ** 2 / (fs * (weight**2).sum())
    p[..., 1 : (fs + 1) // 2] *= 2
    return np.log1p(p[..., (at >= low) & (at <= high)]).transpose(0, 1, 3, 2)


def band_pass(x: np.ndarray, fs: float, low: float = 0.5, high: float = 30, order: int = 4, periods: float = 3) -> np.ndarray:
    """Zero-phase Butterworth band-pass along the last axis: oddly extended at both ends by periods of low, weighted by the squared response."""
    pad = min(x.shape[-1] - 1, int(periods * fs / low))
    head = 2 * x[..., :1] - x[..., pad:0:-1]
    tail = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    long = np.concatenate([head, x, tail], axis=-1)
    warp = lambda f: np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-9)) / fs)
    at, a, b = warp(np.fft.rfftfreq(long.shape[-1], 1 / fs)), warp(low), warp(high)
    gain = 1 / (1 + ((at**2 - a * b) / np.maximum(at * (b - a), 1e-30)) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(long, axis=-1) * gain, long.shape[-1], axis=-1)[..., pad : pad + x.shape[-1]]


#: Periods of the lower cut-off after which the filter's response has faded: the margin of chunks.
FADED = 16


def filter_recordings(df: DataFrame, by: list[str], order: str, value: str, channels: int, length: int, fs: float, low: float = 0.5, high: float = 30, least: int = 8192) -> DataFrame:
    """(by, win, features): each channel of a recording (by) filtered as a whole, then cut into windows of length samples, channel after channel.

    Sample `order` belongs to channel order % channels. Channels are filtered in chunks of at least `least` samples whose
    margins are cut off again. Missing, null and non-finite samples are bridged by straight lines for the filter and
    stay null in features; a gap of more than a margin ends the recording and starts another. Windows with at least
    one sample stay. Of repeated samples the smallest value counts.
    """
    margin = int(FADED * fs / low)
    core = -(-max(least, margin) // length) * length
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col(order).isNotNull())
    rows = rows.select(*by, F.pmod(F.col(order), F.lit(channels)).cast("int").alias("channel"), F.floor(F.col(order) / channels).alias("at"), v.alias("v"))
    own, place = F.floor(F.col("at") / core), F.pmod(F.col("at"), F.lit(core))
    near = F.array_compact(F.array(own, F.when(place < margin, own - 1), F.when(place >= core - margin, own + 1)))
    grouped = rows.select("*", F.explode(near).alias("chunk")).groupBy(*by, "channel", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s"))
    chunks = grouped.select(*by, "channel", "chunk", F.col("s.at").alias("at"), F.col("s.v").alias("v"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*by, "channel").schema.fields) + ", win long, x array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False, name=None):
                *keys, chunk, at, v = row
                at, first = np.unique(np.asarray(at), return_index=True)
                v, start = np.asarray(v)[first], chunk * core
                y = np.full(core, np.nan)
                for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > margin) + 1):
                    line = np.arange(at[k[0]], at[k[-1]] + 1)
                    held = band_pass(np.interp(line, at[k], v[k]), fs, low, high, periods=FADED) if len(line) > 1 else np.zeros(1)
                    inside = (at[k] >= start) & (at[k] < start + core)
                    y[at[k][inside] - start] = held[at[k][inside] - line[0]]
                for w, x in enumerate(y.reshape(-1, length)):
                    some = np.isfinite(x)
                    if some.any():
                        out.append((*keys, start // length + w, x if some.all() else [e if e == e else None for e in x.tolist()]))
            yield pd.DataFrame(out, columns=[*by, "channel", "win", "x"])

    cut = chunks.mapInPandas(run, schema).groupBy(*by, "win").agg(F.map_from_entries(F.collect_list(F.struct("channel", "x"))).alias("m"))
    blank = F.array_repeat(F.lit(None).cast("double"), length)
    return cut.select(*by, "win", F.flatten(F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), blank) for c in range(channels)])).alias("features"))
