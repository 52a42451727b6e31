"""Spectral and wavelet operators: NumPy on one segment at a time, grouped by Spark.

A segment is a bounded slice of a record (36 hours at one minute are 2160 samples), so a group
always fits a task; the work grows with the number of segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.bands import BANDS, REJECT_BELOW_S, REJECT_FROM_S

OMEGA0 = 10.0
#: Fixed values of the detector's defaults.
FWER = 0.01
MIN_Q = 3.0
MIN_STOKES_D = 0.7
MAX_PAR_FRACTION = 0.5
SEARCH_S = (600.0, 9600.0)
NOISE_FROM_S = 300.0
MAD_TO_SIGMA = 1.4826
#: Prominence, as a share of a ridge's maximum, from which a second maximum is a packet of its own: half power in amplitude.
HALF_POWER = 1 - 1 / math.sqrt(2)


def per_segment(df: DataFrame, key: str, order: str, values: list[str], f: Callable[..., pd.DataFrame], schema: str, kind: str = "bigint") -> DataFrame:
    """``f`` on each segment's ordered series; its frame gains the segment's key. Rows without a key are left out.

    Segments are dealt by key and sorted, and each task walks its rows batch by batch, holding
    back the last segment of a batch until it is whole. That spares the cost of a call per
    group where segments are many and short.
    """

    def done(pdf: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        series, keys, out = [pdf[v].to_numpy(float) for v in values], pdf[key].to_numpy(), []
        for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            part = f(*[x[a:b] for x in series])
            if len(part):
                part.insert(0, key, keys[a])
                out.append(part)
        if out:
            yield pd.concat(out, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            keys = b[key].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if len(cuts):
                yield from done(b.iloc[: cuts[-1]], cuts[:-1])
            rest = b.iloc[cuts[-1] if len(cuts) else 0 :]
        if rest is not None and len(rest):
            yield from done(rest, np.empty(0, int))

    rows = df.select(key, order, *values).filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(run, f"{key} {kind}, {schema}")


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def spectra(x: np.ndarray, dt: float, n: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided density of each window); no detrending, periodic Hann."""
    w, step = hann(n), n - overlap
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::step] if len(x) >= n else np.empty((0, n))
    p = np.abs(np.fft.rfft(frames * w, axis=1)) ** 2 * (dt / np.sum(w * w))
    p[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, dt), p


def welch(x: np.ndarray, dt: float, n: int | None = None, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    n = min(n or len(x), len(x))
    f, p = spectra(x, dt, n, n // 2 if overlap is None else overlap)
    return f, p.mean(axis=0)


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends, continued past them."""
    n, h = len(x), np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    d = np.diff(y) / h
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        r[k] = 6 * (d[k] - d[k - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    u = at - x[k]
    return y[k] + u * (d[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + u**2 * m[k] / 2 + u**3 * (m[k + 1] - m[k]) / (6 * h[k])


def savgol(y: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares polynomial smoothing; past the ends the end values are repeated."""
    h = window // 2
    basis = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    kernel = np.linalg.pinv(basis)[0]
    return np.convolve(np.pad(y, h, mode="edge"), kernel[::-1], mode="valid")


def background(f: np.ndarray, p: np.ndarray, window: int = 101, order: int = 3, band: tuple[float, float] = (1 / 10800, 1 / 1800), rounds: int = 100) -> np.ndarray:
    """Smooth log-log background, levelled until half of the band's points lie above it."""
    lf, lp = np.log(np.where(f > 0, f, 1e-10)), np.log(np.where(p > 0, p, 1e-30))
    x = np.linspace(lf[0], lf[-1], window * 3)
    y = spline(lf, lp, x)
    bg = savgol(y, window, order)
    lo, hi = np.searchsorted(f, band)
    inside, n = slice(lo, max(hi, lo + 1)), max(hi - lo, 1)
    step = abs(float(np.median(y[inside]) - np.median(bg[inside]))) / 10
    for _ in range(rounds):
        gap = 0.5 - np.count_nonzero(y[inside] > bg[inside]) / n
        if abs(gap) < 0.01:
            break
        bg, step = bg + (-step if gap > 0 else step), step * 0.95
    return np.exp(spline(x, bg, lf))


@lru_cache(maxsize=4)
def _kernels(n: int, dt: float, n_freqs: int, f_min: float, omega0: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Frequencies, and for each padded size the rows of that size, their wavelets' spectra and first samples.

    They depend on the length of a series only, so segments of one length share them.
    """
    f, by_size = np.linspace(f_min, 0.5 / dt, n_freqs), {}
    for k, s in enumerate((omega0 + math.sqrt(2 + omega0**2)) / (4 * np.pi * f * dt)):
        m = max(3, min(int(10 * s) * 2 + 1, n))
        t = (np.arange(m) - (m - 1) / 2) / s
        w = np.pi**-0.25 * np.exp(1j * omega0 * t - t**2 / 2) / math.sqrt(s)
        size = 1 << (n + m - 2).bit_length()
        by_size.setdefault(size, []).append((k, np.fft.fft(np.conj(w[::-1]), size), (m - 1) // 2))
    return f, [(size, np.array([r[0] for r in rows]), np.stack([r[1] for r in rows]), np.array([r[2] for r in rows])) for size, rows in by_size.items()]


def morlet(x: np.ndarray, dt: float = 60.0, n_freqs: int = 300, f_min: float = 1 / 14400, omega0: float = OMEGA0) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, complex coefficients) on a linear frequency grid up to Nyquist.

    The series is transformed once for each padded size, not once for each row.
    """
    n = len(x)
    f, sizes = _kernels(n, dt, n_freqs, f_min, omega0)
    out = np.empty((n_freqs, n), complex)
    for size, rows, spectra_of, first in sizes:
        full = np.fft.ifft(np.fft.fft(x, size) * spectra_of, axis=1)
        out[rows] = np.take_along_axis(full, first[:, None] + np.arange(n), axis=1)
    return f, out


def coi(f: np.ndarray, n: int, dt: float, factor: float = math.sqrt(2) * OMEGA0 / (2 * math.pi)) -> np.ndarray:
    """Cells away from the edges by ``factor`` periods."""
    edge = np.minimum(np.ceil(factor / f / dt).astype(int), (n - 1) // 2)
    i = np.arange(n)
    return (i >= edge[:, None]) & (i < n - edge[:, None])


def lag1(x: np.ndarray) -> float:
    d = x - x.mean()
    power = float(d @ d)
    return min(0.99, max(-0.99, float(d[1:] @ d[:-1]) / power)) if power > 0 else 0.0


def noise_rows(f: np.ndarray) -> np.ndarray:
    p = 1 / f
    return np.flatnonzero(((p >= NOISE_FROM_S) & (p < REJECT_BELOW_S)) | ((p >= SEARCH_S[1]) & (p < REJECT_FROM_S)))


def red_noise(power: np.ndarray, f: np.ndarray, x: np.ndarray, dt: float) -> np.ndarray:
    """Expected squared amplitude of each row under AR(1) noise, levelled on the noise rows by their medians."""
    a = lag1(x)
    shape = (1 - a * a) / (1 + a * a - 2 * a * np.cos(2 * np.pi * f * dt))
    rows = noise_rows(f)
    if not len(rows):  # levelled on all rows, in the shape of the noise
        return shape * (float(np.median(power)) / math.log(2) / float(np.median(shape)))
    return shape * float(np.median(np.median(power[rows], axis=1) / math.log(2) / shape[rows]))


def cells(f: np.ndarray, n: int, dt: float) -> float:
    """Number of independent cells of a transform."""
    lo, hi = float(f[f > 0].min()), float(f.max())
    span = math.log(hi / lo)
    return max(1.0, OMEGA0 / (2 * math.pi) * span * n * dt * (hi - lo) / span)


def sigma_for(f: np.ndarray, n: int, dt: float, alpha: float = FWER) -> float:
    return NormalDist().inv_cdf(1 - alpha / cells(f, n, dt))


def mask_chi2(amp: np.ndarray, f: np.ndarray, x: np.ndarray, dt: float, alpha: float | None = None) -> np.ndarray:
    """Squared amplitudes above the red-noise level's upper quantile, Bonferroni-corrected by default."""
    alpha = FWER / cells(f, amp.shape[1], dt) if alpha is None else alpha
    return amp**2 > (red_noise(amp**2, f, x, dt) * -math.log(alpha))[:, None]


def mask_fdr(amp: np.ndarray, f: np.ndarray, x: np.ndarray, dt: float, q: float = FWER) -> np.ndarray:
    """Cells whose p-values pass the step-up rule that holds under any dependence."""
    p = np.exp(-(amp**2) / red_noise(amp**2, f, x, dt)[:, None]).ravel()
    order = np.sort(p)
    m = len(p)
    ok = np.flatnonzero(order <= np.arange(1, m + 1) * q / (m * np.sum(1 / np.arange(1, m + 1))))
    return (p <= order[ok[-1]]).reshape(amp.shape) if len(ok) else np.zeros(amp.shape, bool)


def _by_log_period(f: np.ndarray, periods: np.ndarray, level: np.ndarray) -> np.ndarray:
    order = np.argsort(periods)
    return np.interp(np.log10(1 / f), np.log10(periods[order]), level[order])


def mask_mad(amp: np.ndarray, f: np.ndarray, n_sigma: float) -> np.ndarray:
    """Amplitudes above median and spread of the noise rows, carried to all rows over log period."""
    rows = noise_rows(f)
    part = amp[rows] if len(rows) else amp.reshape(1, -1)
    med = np.median(part, axis=1)
    level = med + n_sigma * MAD_TO_SIGMA * np.median(np.abs(part - med[:, None]), axis=1)
    return amp > (_by_log_period(f, 1 / f[rows], level)[:, None] if len(rows) else level[0])


def sigma_at(amp: np.ndarray, f: np.ndarray, period: float, first: int, last: int) -> float | None:
    """Deviations of the greatest amplitude at a period within samples first..last over the noise rows' level there; None without noise."""
    rows = noise_rows(f)
    if not len(rows):
        return None
    med = np.median(amp[rows], axis=1)
    mad = np.median(np.abs(amp[rows] - med[:, None]), axis=1)
    order = np.argsort(1 / f[rows])
    level, spread = (float(np.interp(math.log10(period), np.log10(1 / f[rows])[order], v[order])) for v in (med, mad))
    top = float(amp[int(np.argmin(np.abs(1 / f - period))), first : last + 1].max())
    return (top - level) / (MAD_TO_SIGMA * spread) if spread > 0 else None


def mask_pooled(amp: np.ndarray, f: np.ndarray, archive: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], region: str, n_sigma: float) -> np.ndarray:
    """Amplitudes above a region's archived median and spread (periods, medians, MADs); KeyError for an unknown region."""
    periods, med, mad = archive[region]
    return amp > _by_log_period(f, periods, med + n_sigma * MAD_TO_SIGMA * mad)[:, None]


def labels(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a mask, numbered from 1 in reading order, by union of row runs."""
    parent: list[int] = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    before: list[tuple[int, int, int]] = []
    runs: list[tuple[int, int, int, int]] = []
    for r, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            n = len(parent)
            parent.append(n)
            for c, d, k in before:
                if c <= b and d >= a:
                    x, y = find(n), find(k)
                    parent[max(x, y)] = min(x, y)
            now.append((a, b, n))
            runs.append((r, a, b, n))
        before = now
    out, number = np.zeros(mask.shape, np.int32), {}
    for r, a, b, n in runs:
        out[r, a:b] = number.setdefault(find(n), len(number) + 1)
    return out


def vertex(amp: np.ndarray, f: np.ndarray, r: int, t: int) -> float:
    """Period at the vertex of the parabola through three rows' log amplitude, in rows and log period.

    A vertex more than half a row away belongs to another row; then, and at the grid's edge, the
    row's own period stands.
    """
    if not 0 < r < len(f) - 1 or not (amp[r - 1 : r + 2, t] > 0).all():
        return float(1 / f[r])
    below, here, above = np.log(amp[r - 1 : r + 2, t])
    bend = below - 2 * here + above
    step = 0.5 * (below - above) / bend if bend else 1.0
    if abs(step) > 0.5:
        return float(1 / f[r])
    towards = r + 1 if step >= 0 else r - 1
    return float(math.exp(-math.log(f[r]) - abs(step) * math.log(f[towards] / f[r])))


def prominent(x: np.ndarray, least: float) -> list[int]:
    """Places of the inner maxima of ``x`` that stand out by ``least``: above the higher of the two minima that part them from higher values."""
    rising = np.flatnonzero(np.diff(x) > 0) + 1
    out = []
    for i in rising.tolist():
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if j + 1 == len(x) or x[j + 1] > x[i]:
            continue  # no maximum, or one at the end
        left = np.flatnonzero(x[:i] > x[i])
        right = np.flatnonzero(x[j + 1 :] > x[i])
        before = x[(left[-1] if len(left) else 0) : i].min()
        after = x[j + 1 : (j + 1 + right[0] if len(right) else len(x))].min()
        if x[i] - max(before, after) >= least:
            out.append((i + j) // 2)
    return out


def ridges(amp: np.ndarray, f: np.ndarray, mask: np.ndarray, dt: float, min_s: float = 7200.0, min_pixels: int = 10, edge: np.ndarray | None = None, split: bool = True) -> list[dict]:
    """Connected significant regions of the search band as peaks with times, period and widths; fused ones are split."""
    period = 1 / f
    rows = (period >= SEARCH_S[0]) & (period < SEARCH_S[1])
    mask = mask & rows[:, None]
    mask = mask & edge if edge is not None else mask
    found, lab = [], labels(np.ascontiguousarray(mask))
    for k in range(1, int(lab.max(initial=0)) + 1):
        r, t = np.nonzero(lab == k)
        if len(r) < min_pixels or t.max() - t.min() + 1 < math.ceil(min_s / dt):
            continue
        top = int(np.argmax(amp[r, t]))
        pr, pt = int(r[top]), int(t[top])
        above = period[rows][amp[rows, pt] >= amp[rows, pt].max() / 2]
        found.append({"i0": int(t.min()), "i1": int(t.max()), "i": pt, "row": pr, "period": vertex(amp, f, pr, pt), "power": float(amp[pr, pt]), "fwhm": float(above.max() - above.min()), "pixels": len(r)})
    found = [x for r in found for x in split_ridge(amp, r, dt, min_s)] if split else found
    return sorted(found, key=lambda x: x["i"])


def split_ridge(amp: np.ndarray, ridge: dict, dt: float, min_s: float = 7200.0) -> list[dict]:
    """A ridge cut at the minima between those maxima of its row that stand out by half power; parts that are too short go."""
    a = ridge["i0"]
    row = amp[ridge["row"], a : ridge["i1"] + 1]
    tops = prominent(row, HALF_POWER * float(row.max()))
    if len(tops) < 2:
        return [ridge]
    cuts = [0, *(i + int(np.argmin(row[i : j + 1])) for i, j in zip(tops, tops[1:], strict=False)), len(row) - 1]
    parts = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi - lo + 1 >= math.ceil(min_s / dt):
            top = lo + int(np.argmax(row[lo : hi + 1]))
            parts.append(ridge | {"i0": a + lo, "i1": a + hi, "i": a + top, "power": float(row[top])})
    return parts or [ridge]


def band_name(period: float) -> str | None:
    return next((n for n, lo, hi, _ in BANDS if lo * 60 <= period < hi * 60), None)


def stokes(z1: np.ndarray, z2: np.ndarray) -> tuple[float, float, float, float]:
    a, b, ab = float(np.mean(np.abs(z1) ** 2)), float(np.mean(np.abs(z2) ** 2)), complex(np.mean(z1 * np.conj(z2)))
    return a + b, a - b, 2 * ab.real, 2 * ab.imag


def geometry(i: float, q: float, u: float, v: float) -> tuple[float, float, float]:
    p = math.sqrt(q * q + u * u + v * v)
    if p <= 0 or i <= 0:
        return 0.0, 0.0, 0.0
    return math.tan(0.5 * math.asin(max(-1.0, min(1.0, v / p)))), math.degrees(0.5 * math.atan2(u, q)), p / i


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: one-sided spectrum, doubled."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def tukey(n: int, alpha: float = 0.25) -> np.ndarray:
    x = np.arange(n) / max(n - 1, 1)
    edge = np.minimum(x, 1 - x)
    return np.where(edge < alpha / 2, 0.5 * (1 - np.cos(2 * np.pi * edge / alpha)), 1.0)


def bandpass(x: np.ndarray, lo: float, hi: float, dt: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band-pass: the squared response applied to the edge-padded spectrum."""
    pad = min(len(x) - 1, int(3 / (lo * dt)))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    f = np.fft.rfftfreq(len(y), dt)
    with np.errstate(divide="ignore"):
        w = np.tan(np.pi * np.minimum(f, 0.4999 / dt) * dt)
        a, b = math.tan(math.pi * lo * dt), math.tan(math.pi * hi * dt)
        g = 1 / (1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order))
    g[0] = 0
    return np.fft.irfft(np.fft.rfft(y) * g, len(y))[pad : pad + len(x)]


def prewhiten(x: np.ndarray) -> np.ndarray:
    a = lag1(x)
    return np.concatenate([[x[0] * math.sqrt(1 - a * a)], x[1:] - a * x[:-1]])


def matched(x: np.ndarray, period: float, cycles: float, dt: float) -> np.ndarray:
    """Signal-to-noise series of a Gaussian-windowed oscillation in a whitened series."""
    n = min(len(x), int(2 * cycles * period / dt) | 1)
    t = (np.arange(n) - n // 2) * dt
    template = np.exp(2j * np.pi * t / period - 0.5 * (t / (cycles * period / 2.355)) ** 2)
    template /= math.sqrt(float(np.sum(np.abs(template) ** 2)))
    y = prewhiten(x - x.mean())
    return np.abs(np.convolve(y, np.conj(template[::-1]), mode="same")) / (y.std() or 1.0)


def wavelet_coherence(w1: np.ndarray, w2: np.ndarray, f: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Coherence and mean phase of two transforms, smoothed in time over a cycle."""

    def smooth(z: np.ndarray) -> np.ndarray:
        out = np.empty_like(z)
        for k, row in enumerate(z):
            m = min(len(row), max(3, int(1 / (f[k] * dt)) | 1))
            out[k] = np.convolve(row, np.ones(m) / m, mode="same")
        return out

    cross = smooth(w1 * np.conj(w2))
    a, b = smooth(np.abs(w1) ** 2), smooth(np.abs(w2) ** 2)
    return np.clip(np.abs(cross) ** 2 / np.maximum(a * b, 1e-300), 0, 1), np.angle(cross)


def phase_shift(x: np.ndarray, y: np.ndarray, dt: float, period: float) -> tuple[float, float]:
    """(delay in seconds, phase in degrees) at the lag of greatest correlation over all lags."""
    u, v = x - x.mean(), y - y.mean()
    size = 1 << (2 * len(u) - 2).bit_length()
    full = np.fft.irfft(np.fft.rfft(u, size) * np.conj(np.fft.rfft(v, size)), size)
    r = np.concatenate([full[size - len(u) + 1 :], full[: len(u)]])
    delay = (int(np.argmax(r)) - (len(u) - 1)) * dt
    return delay, (delay * 360.0 / period) % 360.0  # whole degrees stay whole


def running_phase(x: np.ndarray, y: np.ndarray, window: int, step: int, period: float) -> list[tuple[int, float]]:
    """(first sample, phase in degrees) of the lag of greatest correlation in sliding windows."""
    out = []
    for a in range(0, len(x) - window + 1, step):
        u, v = x[a : a + window] - x[a : a + window].mean(), y[a : a + window] - y[a : a + window].mean()
        lag = int(np.argmax(np.correlate(u, v, mode="full"))) - (window - 1)
        out.append((a, (lag / period * 360.0) % 360.0))
    return out


def detect(b_par: np.ndarray, b1: np.ndarray, b2: np.ndarray, dt: float = 60.0, n_freqs: int = 300, method: str = "chi2", min_q: float = MIN_Q, min_d: float = MIN_STOKES_D, max_par: float = MAX_PAR_FRACTION, archive: dict | None = None, region: str | None = None) -> list[dict]:
    """Wave packets of one segment in the mean-field-aligned frame, past the three physical gates."""
    f, wp = morlet(b_par, dt, n_freqs)
    (_, w1), (_, w2) = morlet(b1, dt, n_freqs), morlet(b2, dt, n_freqs)
    edge, n, peaks = coi(f, len(b1), dt), len(b1), []
    for x, w in ((b1, w1), (b2, w2)):
        amp = np.abs(w)
        if method == "chi2":
            mask = mask_chi2(amp, f, x, dt)
        elif method == "fdr":
            mask = mask_fdr(amp, f, x, dt)
        elif method == "mad":
            mask = mask_mad(amp, f, sigma_for(f, n, dt))
        elif method == "pooled":
            if archive is None or region is None:
                raise ValueError("the pooled method needs an archive and a region")
            mask = mask_pooled(amp, f, archive, region, sigma_for(f, n, dt))
        else:
            raise ValueError(f"unknown method: {method!r}")
        peaks += ridges(amp, f, mask, dt, edge=edge)
    kept: list[dict] = []
    for p in sorted(peaks, key=lambda p: p["i"]):  # within a segment the earlier of two close peaks stays
        if not any((p["i"] - k["i"]) * dt < 7200.0 and abs(math.log2(p["period"] / k["period"])) < 0.5 for k in kept):
            kept.append(p)
    out = []
    for p in kept:
        q = p["period"] / p["fwhm"] if p["fwhm"] > 0 else None
        band, sl = band_name(p["period"]), slice(p["i0"], p["i1"] + 1)
        if band is None or q is None or q < min_q or p["i1"] <= p["i0"]:
            continue
        r = int(np.argmin(np.abs(f - 1 / p["period"])))
        real = np.stack([w[r, sl].real for w in (wp, w1, w2)], axis=1)
        values, vectors = np.linalg.eigh(np.cov(real, rowvar=False))
        par = float(vectors[0, 2] ** 2) if values[2] > 0 and len(real) >= 3 else 0.0
        near = (f >= 1 / p["period"] / math.sqrt(2)) & (f < 1 / p["period"] * math.sqrt(2))
        s = stokes(w1[near, sl].ravel(), w2[near, sl].ravel())
        ell, incl, d = geometry(*s)
        if par > max_par or d < min_d:
            continue
        rms = np.sqrt(np.mean(real**2, axis=0))
        out.append({"i0": p["i0"], "i1": p["i1"], "i": p["i"], "period_sec": p["period"], "fwhm_sec": p["fwhm"], "power": p["power"], "band": band, "q": q, "par_frac": par, "stokes_d": d, "ellipticity": ell, "inclination": incl, "amp_par": rms[0], "amp1": rms[1], "amp2": rms[2]})
    return out


EVENT_SCHEMA = "i0 bigint, i1 bigint, i bigint, period_sec double, fwhm_sec double, power double, band string, q double, par_frac double, stokes_d double, ellipticity double, inclination double, amp_par double, amp1 double, amp2 double"
EVENT_NAMES = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
