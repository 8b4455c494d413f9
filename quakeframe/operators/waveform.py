"""Waveforms: cross-correlation by sliding Pearson coefficients, transforms of components, resampling and filters.

Traces are rows with ``samples`` (array of double), ``start_us`` and ``sfreq``. What needs a loop over samples is done with numpy in Arrow
batches; what is one expression per sample stays in Spark's array functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Samples of long traces that are correlated at once.
AT_ONCE = 1 << 19


def sliding_pearson(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Pearson coefficient at each shift, of two traces or of rows of them; NaN where a window, or the short trace, is constant.

    Sums and squares of windows are differences of running sums, and products come from one Fourier transform, so memory and time grow with
    the long trace, not with windows. A window that is next to nothing beside the rest of its trace loses digits that way, and is
    worked out by itself."""
    s, x = np.atleast_2d(np.asarray(short, float)), np.atleast_2d(np.asarray(long, float))
    n, m = s.shape[1], x.shape[1]
    shifts = m - n + 1
    s, x = s - s.mean(axis=1, keepdims=True), x - x.mean(axis=1, keepdims=True)
    one, two, steps = np.zeros((len(x), m + 1)), np.zeros((len(x), m + 1)), np.zeros((len(x), m), np.int64)
    np.cumsum(x, axis=1, out=one[:, 1:])
    np.cumsum(x * x, axis=1, out=two[:, 1:])
    np.cumsum(x[:, 1:] != x[:, :-1], axis=1, out=steps[:, 1:])
    total = one[:, n:] - one[:, :-n]
    energy = two[:, n:] - two[:, :-n] - total * total / n
    flat = steps[:, n - 1 :] == steps[:, :shifts]
    size = 1 << max(1, (m - 1).bit_length())
    top = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(s, size)), size)[:, :shifts]
    rows, at = np.nonzero(~flat & (energy < 1e-5 * two[:, -1:]))
    for lo in range(0, len(rows), step := max(1, (1 << 18) // n)):
        i, k = rows[lo : lo + step], at[lo : lo + step]
        w = x[i[:, None], k[:, None] + np.arange(n)]
        w = w - w.mean(axis=1, keepdims=True)
        energy[i, k], top[i, k] = (w * w).sum(axis=1), (w * s[i]).sum(axis=1)
    own = (s * s).sum(axis=1, keepdims=True)
    known = ~flat & (np.ptp(np.atleast_2d(short), axis=1, keepdims=True) > 0) & (energy > 0)
    out = np.where(known, top / np.sqrt(np.where(known, own * energy, 1.0)), np.nan)
    return out[0] if np.ndim(short) == 1 else out


def best_lags(short: np.ndarray, long: np.ndarray, sfreq: np.ndarray, max_delay: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, lags in s) of rows of traces of one length each; NaN where there are none. Coefficients that differ by less than 1e-12 count
    as equal, and the first of equals wins."""
    room = (long.shape[1] - short.shape[1]) // 2
    delays = np.minimum((max_delay * sfreq).astype(np.int64), room)
    best, lags = np.full(len(short), np.nan), np.full(len(short), np.nan)
    for delay in np.unique(delays):
        own = np.flatnonzero(delays == delay)
        cc = sliding_pearson(short[own], long[own, room - delay : room + delay + short.shape[1]])
        known = np.isfinite(cc).any(axis=1)
        k = np.argmax(np.where(np.isfinite(cc), np.round(np.abs(cc), 12), -1.0), axis=1)
        best[own[known]], lags[own[known]] = cc[known, k[known]], (k[known] - delay) / sfreq[own[known]]
    return best, lags


def best_lag(a: np.ndarray, b: np.ndarray, sfreq: float, max_delay: float) -> tuple[float | None, float | None]:
    """(coefficient, lag in s) of the shift with the greatest absolute coefficient within ``max_delay``; the first of equals. The middle of
    the shorter trace meets the middle of the longer one at lag 0."""
    swap = len(a) > len(b)
    short, long = (b, a) if swap else (a, b)
    if not len(short):
        return None, None
    best, lags = best_lags(short[None], long[None], np.array([sfreq]), max_delay)
    if np.isnan(best[0]):
        return None, None
    return float(best[0]), float(-lags[0] if swap else lags[0])


def lags_of(one: list, two: list, sfreq: np.ndarray, max_delay: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_lag`` of each pair of traces, NaN where there is none; pairs of equal lengths are worked out together. None counts as no samples."""
    best, lags, delays = np.full(len(one), np.nan), np.full(len(one), np.nan), np.broadcast_to(max_delay, len(one))
    n = np.array([(0 if x is None else len(x), 0 if y is None else len(y)) for x, y in zip(one, two, strict=True)]).reshape(-1, 2)
    for a, b in np.unique(n, axis=0):
        at = np.flatnonzero((n[:, 0] == a) & (n[:, 1] == b)) if min(a, b) else []
        for lo in range(0, len(at), step := max(1, AT_ONCE // max(a, b))):
            i = at[lo : lo + step]
            x, y = (np.stack([side[k] for k in i]).astype(float) for side in (one, two))
            best[i], found = best_lags(*((y, x) if a > b else (x, y)), sfreq[i], delays[i])
            lags[i] = -found if a > b else found
    return best, lags


def cross_correlate(pairs: DataFrame, max_delay: float) -> DataFrame:
    """pairs (keys..., samples1, samples2, sfreq) with valid, coefficient and lag in place of the samples."""
    keys = [c for c in pairs.columns if c not in ("samples1", "samples2", "sfreq")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best, lags = lags_of(b.samples1.to_list(), b.samples2.to_list(), b.sfreq.to_numpy(float), max_delay)
            out = b[keys].copy()
            out["valid"] = ~np.isnan(best)
            out["coefficient"] = pd.array(np.where(np.isnan(best), None, best), "Float64")
            out["lag"] = pd.array(np.where(np.isnan(lags), None, lags), "Float64")
            yield out

    return pairs.mapInPandas(run, f"{schema}, valid boolean, coefficient double, lag double")


def pearson(a: Column, b: Column) -> Column:
    """Pearson coefficient of two arrays of equal length as one expression; NULL if either is constant."""
    n = F.size(a).cast("double")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    ab, aa, bb = F.zip_with(a, b, lambda x, y: x * y), F.transform(a, lambda x: x * x), F.transform(b, lambda x: x * x)
    below = F.sqrt(n * total(aa) - total(a) * total(a)) * F.sqrt(n * total(bb) - total(b) * total(b))
    return F.try_divide(n * total(ab) - total(a) * total(b), below)


def xcorr_window(pick_us: Column, start_s: float, end_s: float, travel_time: Column, scaling: float, delay_s: float = 0.0) -> tuple[Column, Column]:
    """Start and end (microseconds) of the window around a pick; it grows with the travel time, and by ``delay_s`` on both sides."""
    length = end_s - start_s
    grown = F.lit(1.0) + travel_time * scaling / length
    start = pick_us + F.round((start_s * grown - delay_s) * 1e6).cast("bigint")
    return start, start + F.round((length * grown + 2 * delay_s) * 1e6).cast("bigint")


def sliced(samples: Column, trace_start_us: Column, sfreq: Column, start_us: Column, end_us: Column) -> Column:
    """Samples of a closed window, from the one at or before its start to the one at or after its end; NULL if the trace
    doesn't hold them."""
    lo = F.floor((start_us - trace_start_us) * sfreq / 1e6)
    hi = F.ceil((end_us - trace_start_us) * sfreq / 1e6)
    return F.when((lo >= 0) & (hi < F.size(samples)) & (hi >= lo), F.slice(samples, (lo + 1).cast("int"), (hi - lo + 1).cast("int")))


def demeaned(samples: Column) -> Column:
    mean = F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + v) / F.size(samples)
    return F.transform(samples, lambda v: v - mean)


def l2_norm(h1: Column, h2: Column) -> Column:
    """Length of the horizontal motion, on the common samples."""
    h1, h2 = common(h1, h2)
    return F.zip_with(h1, h2, lambda a, b: F.sqrt(a * a + b * b))


def common(a: Column, b: Column) -> tuple[Column, Column]:
    """Both without what the longer has more at its end."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def radial_transverse(north: Column, east: Column, back_azimuth: Column) -> tuple[Column, Column]:
    """Motion away from the source and to the right of that, from north and east components; back azimuth in degrees."""
    c, s = F.cos(F.radians(back_azimuth)), F.sin(F.radians(back_azimuth))
    north, east = common(north, east)
    return F.zip_with(north, east, lambda n, e: -n * c - e * s), F.zip_with(north, east, lambda n, e: n * s - e * c)


def resample(samples: np.ndarray, sfreq: float, to: float, width: float = 5.98) -> np.ndarray:
    """Samples at another rate, by a sinc low pass under a Hann window; floor(n * to / sfreq) of them."""
    if to <= 0 or to == sfreq:
        return samples
    cut = min(sfreq, to) / 2
    half = int(np.ceil(width * sfreq / (0.1 * cut))) // 2
    x = np.arange(int(len(samples) * to / sfreq)) * sfreq / to
    k = np.floor(x).astype(np.int64)[:, None] + np.arange(-half, half)
    d = k - x[:, None]
    hann = np.sin(np.pi * (0.5 + d / (2 * half))) ** 2
    gain = 2 * cut / sfreq
    inside = (k >= 0) & (k < len(samples))
    taken = np.asarray(samples)[np.clip(k, 0, len(samples) - 1)]
    return (np.where(inside, taken, 0.0) * gain * hann * np.sinc(gain * d)).sum(axis=1)


def resampled(traces: DataFrame, to: float) -> DataFrame:
    """Traces (..., sfreq, samples) at one rate."""
    names = traces.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(samples=[resample(np.asarray(s, float), f, to) for s, f in zip(b.samples, b.sfreq, strict=True)], sfreq=float(to))
            yield b[names]

    return traces.mapInPandas(run, traces.schema)
