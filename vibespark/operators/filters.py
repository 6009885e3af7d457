"""Zero-phase filters designed from analog prototypes, tapers, noise and resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, in_order, known, spacing
from .spectral import tukey

SIGNAL = "series_id string, axis string, i long, t double, v double"


def band(low: float | None, high: float | None) -> tuple[str | None, list[float]]:
    """Kind of filter that two cutoffs make, and its corner frequencies."""
    given = [f for f in (low, high) if f is not None]
    kind = {(True, True): "bandpass", (True, False): "highpass", (False, True): "lowpass", (False, False): None}[(low is not None, high is not None)]
    return kind, given


# ---- analog prototypes: zeros, poles, gain of a low-pass with cutoff 1 rad/s ---------------------------------------


def _buttap(n: int):
    m = np.arange(-n + 1, n, 2)
    return np.array([]), -np.exp(1j * np.pi * m / (2 * n)), 1.0


def _cheb1ap(n: int, rp: float):
    eps = math.sqrt(10 ** (rp / 10) - 1)
    mu = math.asinh(1 / eps) / n
    p = -np.sinh(mu + 1j * np.pi * np.arange(-n + 1, n, 2) / (2 * n))
    k = np.prod(-p).real
    return np.array([]), p, k / math.sqrt(1 + eps * eps) if n % 2 == 0 else k


def _cheb2ap(n: int, rs: float):
    de = 1 / math.sqrt(10 ** (rs / 10) - 1)
    mu = math.asinh(1 / de) / n
    m = np.arange(-n + 1, n, 2)
    z = 1j / np.sin(m[m != 0] * np.pi / (2 * n))
    p = 1 / -np.sinh(mu + 1j * np.pi * m / (2 * n))
    return z, p, (np.prod(-p) / np.prod(-z)).real


def _besselap(n: int, norm: str):
    """Roots of the reverse Bessel polynomial, scaled to the norm asked for."""
    c = [math.factorial(2 * n - k) / (2 ** (n - k) * math.factorial(k) * math.factorial(n - k)) for k in range(n + 1)]
    p = np.roots(c[::-1])
    if norm == "delay":
        scale = 1.0
    elif norm == "phase":
        scale = c[0] ** (1 / n)
    elif norm == "mag":
        lo, hi = 1e-3, 1e3
        for _ in range(200):
            mid = math.sqrt(lo * hi)
            gain = abs(c[0] / np.prod(1j * mid - p))
            lo, hi = (mid, hi) if gain > math.sqrt(0.5) else (lo, mid)
        scale = lo
    else:
        raise ValueError("norm is phase, delay or mag")
    p = p / scale
    return np.array([]), p, np.prod(-p).real


def _agm_k(m: float) -> float:
    """Complete elliptic integral of the first kind of parameter m."""
    a, b = 1.0, math.sqrt(1 - m)
    while abs(a - b) > 1e-15 * a:
        a, b = (a + b) / 2, math.sqrt(a * b)
    return math.pi / (2 * a)


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-14 and len(out) < 12:
        kp = math.sqrt(max(1 - k * k, 0.0))
        k = (k / (1 + kp)) ** 2
        out.append(k)
    return out


def _cd_sn(u, k: float, sine: bool):
    """cd or sn of u in units of the quarter period, by descending Landen steps."""
    steps = _landen(k)
    w = np.sin(np.asarray(u) * np.pi / 2) if sine else np.cos(np.asarray(u) * np.pi / 2)
    for v in reversed(steps):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _arc_sn(w: complex, k: float) -> complex:
    for v in _landen(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - k * k * w * w)))
        k = v
    return 2 / np.pi * np.arcsin(w)


def _ellipap(n: int, rp: float, rs: float):
    """Elliptic prototype: the modulus solves the degree equation; zeros and poles are Jacobi functions of it."""
    eps = math.sqrt(10 ** (rp / 10) - 1)
    if n == 1:
        return np.array([]), np.array([-1 / eps]), 1 / eps
    k1 = eps / math.sqrt(10 ** (rs / 10) - 1)
    half = n // 2
    u = (2 * np.arange(1, half + 1) - 1) / n
    k1p = math.sqrt(1 - k1 * k1)
    kp = k1p**n * np.prod(_cd_sn(1 - u, k1p, False).real) ** 4  # sn(u) of the complementary modulus
    k = math.sqrt(1 - kp * kp)
    zeta = _cd_sn(u, k, False)
    z = 1j / (k * zeta)
    v0 = (-1j * _arc_sn(1j / eps, k1) / n).real
    p = 1j * _cd_sn(u - 1j * v0, k, False)
    z, p = np.concatenate([z, z.conj()]), np.concatenate([p, p.conj()])
    if n % 2:
        p = np.append(p, (1j * _cd_sn(1j * v0, k, True)).real)
    g = (np.prod(-p) / np.prod(-z)).real
    return z, p, g / math.sqrt(1 + eps * eps) if n % 2 == 0 else g


def prototype(family: str, order: int, rp: float = 3.0, rs: float = 30.0, norm: str = "mag"):
    made = {"butterworth": lambda: _buttap(order), "bessel": lambda: _besselap(order, norm), "cheby1": lambda: _cheb1ap(order, rp), "cheby2": lambda: _cheb2ap(order, rs), "ellip": lambda: _ellipap(order, rp, rs)}
    if family not in made:
        raise ValueError(f"unknown filter {family}")
    return made[family]()


def sections(family: str, order: int, kind: str, corners: list[float], rate: float, **options) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital filter: prototype, band transform, bilinear transform."""
    z, p, k = prototype(family, order, **options)
    if any(not 0 < f < rate / 2 for f in corners):
        raise ValueError("cutoffs lie between 0 and half the sample rate")
    warped = [4 * math.tan(math.pi * f / rate) for f in corners]  # with a sample rate of 2
    extra = len(p) - len(z)
    if kind == "lowpass":
        w = warped[0]
        k, z, p = k * w**extra, z * w, p * w
    elif kind == "highpass":
        w = warped[0]
        k *= (np.prod(-z) / np.prod(-p)).real
        z, p = np.concatenate([w / z, np.zeros(extra)]), w / p
    else:
        bw, w0 = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        k *= bw**extra
        split = lambda r: np.concatenate([r * bw / 2 + np.sqrt((r * bw / 2) ** 2 - w0 * w0 + 0j), r * bw / 2 - np.sqrt((r * bw / 2) ** 2 - w0 * w0 + 0j)])
        z, p = np.concatenate([split(z + 0j), np.zeros(extra)]), split(p)
    k *= (np.prod(4 - z) / np.prod(4 - p)).real
    zd, pd = (4 + z) / (4 - z), (4 + p) / (4 - p)
    zd = np.concatenate([zd, -np.ones(len(pd) - len(zd))])
    return _paired(zd, pd, k)


def _couples(roots: np.ndarray) -> list[np.ndarray]:
    """Roots as conjugate pairs and pairs of real ones."""
    up = sorted((r for r in roots if r.imag > 1e-9 * max(abs(r), 1)), key=lambda r: abs(abs(r) - 1))
    real = sorted((r.real for r in roots if abs(r.imag) <= 1e-9 * max(abs(r), 1)), key=lambda r: abs(abs(r) - 1))
    out = [np.array([r, r.conjugate()]) for r in up]
    return out + [np.array(real[j : j + 2]) for j in range(0, len(real), 2)]


def _paired(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    poles, zeros = _couples(p), _couples(z)
    rows = []
    for pole in poles:
        near = min(range(len(zeros)), key=lambda j: abs(zeros[j][0] - pole[0])) if zeros else None
        zero = zeros.pop(near) if near is not None else np.array([])
        b, a = np.poly(zero).real, np.poly(pole).real
        rows.append(np.concatenate([b, np.zeros(3 - len(b)), a, np.zeros(3 - len(a))]))
    rows = rows[::-1]
    rows[0][:3] *= k
    return np.array(rows)


def _sos(x: np.ndarray, sos: np.ndarray, state: np.ndarray) -> np.ndarray:
    """x through the sections, each from its state."""
    from .shock import filtered

    for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sos, state, strict=True):
        y = filtered(x, b0, b1, b2, a1, a2)[0]
        if s1 or s2:  # the free response of the state is that of a filter with the state as its taps
            impulse = np.zeros(len(x))
            impulse[0] = 1.0
            y = y + filtered(impulse, s1, s2, 0.0, a1, a2)[0]
        x = y
    return x


def _steady(sos: np.ndarray) -> np.ndarray:
    """State of each section under a step that has settled."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        y = gain
        out.append((level * (y - b0), level * (b2 - a2 * y)))
        level *= gain
    return np.array(out)


def _sos_many(x: np.ndarray, sos: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Rows of x through the sections, each row settled at its level; a step for all rows at a time."""
    for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sos, _steady(sos), strict=True):
        y, z1, z2 = np.empty_like(x), s1 * level, s2 * level
        for j in range(x.shape[0]):
            v = x[j]
            y[j] = b0 * v + z1
            z1, z2 = b1 * v - a1 * y[j] + z2, b2 * v - a2 * y[j]
        x = y
    return x


def zero_phase_many(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """zero_phase of each row of a matrix; for many short rows."""
    pad = _padding(x.shape[1], sos)
    x = np.ascontiguousarray(x.T)
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _sos_many(e, sos, e[0])
    return _sos_many(y[::-1].copy(), sos, y[-1])[::-1][pad:-pad].T


def _padding(n: int, sos: np.ndarray) -> int:
    taps = 2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    if n <= 3 * taps:
        raise ValueError(f"the series is not longer than the padding of {3 * taps} samples")
    return 3 * taps


def zero_phase(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Forward and backward through the sections, after an odd extension at both ends."""
    pad = _padding(len(x), sos)
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    zi = _steady(sos)
    y = _sos(e, sos, zi * e[0])
    y = _sos(y[::-1].copy(), sos, zi * y[-1])[::-1]
    return y[pad:-pad]


def filter_signal(sig: DataFrame, family: str = "butterworth", low_cutoff: float | None = 1.0, high_cutoff: float | None = None, half_order: int = 3, tukey_percent: float = 0.0, **options) -> DataFrame:
    """sig through a zero-phase filter (passed forward and backward) and a Tukey taper, axis by axis.

    The recursion runs over the whole axis in order, so an axis of a series is one task's array; short ones of a length
    are filtered together.
    """
    kind, corners = band(low_cutoff, high_cutoff)
    if kind is None:
        return taper(sig, tukey_percent)
    prototype(family, half_order, **options)

    def run(table, starts):
        import pyarrow as pa

        at = np.asarray(starts)
        x, dt = np.nan_to_num(table.column("v").to_numpy()), table.column("dt").to_numpy()[at[:-1]]
        size, y = np.diff(at), np.empty(len(x))
        kinds, of = np.unique(np.stack([size, np.nan_to_num(dt)], axis=1), axis=0, return_inverse=True)
        for k, (n, step) in enumerate(kinds):
            mine, n = at[:-1][of.ravel() == k], int(n)
            sos = sections(family, half_order, kind, corners, 1 / step, **options)
            w = tukey(n, tukey_percent)
            if len(mine) < 8:
                for a in mine:
                    y[a : a + n] = zero_phase(x[a : a + n], sos) * w
            else:
                rows = mine[:, None] + np.arange(n)
                y[rows] = zero_phase_many(x[rows], sos) * w
        return table.select([*KEYS, "i", "t"]).append_column("v", pa.array(y))

    d = sig.join(known(spacing(sig).select("series_id", "dt")), "series_id").select(*KEYS, "i", "t", "v", "dt")
    return in_order(d, KEYS, ["i"], run, SIGNAL)


def butterworth(sig, low_cutoff=1.0, high_cutoff=None, half_order=3, tukey_percent=0.0) -> DataFrame:
    return filter_signal(sig, "butterworth", low_cutoff, high_cutoff, half_order, tukey_percent)


def bessel(sig, low_cutoff=1.0, high_cutoff=None, half_order=3, tukey_percent=0.0, norm="mag") -> DataFrame:
    return filter_signal(sig, "bessel", low_cutoff, high_cutoff, half_order, tukey_percent, norm=norm)


def cheby1(sig, low_cutoff=1.0, high_cutoff=None, half_order=3, tukey_percent=0.0, rp=3.0) -> DataFrame:
    return filter_signal(sig, "cheby1", low_cutoff, high_cutoff, half_order, tukey_percent, rp=rp)


def cheby2(sig, low_cutoff=1.0, high_cutoff=None, half_order=3, tukey_percent=0.0, rs=30.0) -> DataFrame:
    return filter_signal(sig, "cheby2", low_cutoff, high_cutoff, half_order, tukey_percent, rs=rs)


def ellip(sig, low_cutoff=1.0, high_cutoff=None, half_order=3, tukey_percent=0.0, rp=3.0, rs=30.0) -> DataFrame:
    return filter_signal(sig, "ellip", low_cutoff, high_cutoff, half_order, tukey_percent, rp=rp, rs=rs)


def taper(sig: DataFrame, alpha: float) -> DataFrame:
    """sig times a Tukey window over its rows, inside the JVM."""
    if alpha <= 0:
        return sig
    a = min(alpha, 1.0)
    d = sig.join(spacing(sig).select("series_id", "n"), "series_id")
    x = F.try_divide(F.least(F.col("i"), F.col("n") - 1 - F.col("i")), F.col("n") - 1)
    w = F.when(x < a / 2, 0.5 * (1 - F.cos(2 * math.pi * x / a))).otherwise(1.0)
    return d.withColumn("v", F.col("v") * w).select(*KEYS, "i", "t", "v")


def band_limited_noise(spark, min_freq: float = 0.0, max_freq: float | None = None, duration: float = 1.0, sample_rate: float = 1000.0, norm: str = "peak", seed: int = 0) -> DataFrame:
    """One series of noise with random phases between two frequencies, its peak or RMS being 1."""
    if norm not in ("peak", "rms"):
        raise ValueError("norm is peak or rms")
    n = int(duration * sample_rate)
    f = np.fft.rfftfreq(n, 1 / sample_rate)
    on = (f >= min_freq) & (f <= (sample_rate / 2 if max_freq is None else max_freq))
    phase = np.random.Generator(np.random.PCG64(seed)).uniform(0, 2 * np.pi, len(f))
    x = np.fft.irfft(np.where(on, np.exp(1j * phase), 0), n)
    x = x / ((np.abs(x).max() if norm == "peak" else np.sqrt((x * x).mean())) or 1.0)
    rows = [("noise", "v", k, k / sample_rate, float(v)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, SIGNAL)


def resample(sig: DataFrame, sample_rate: float | None = None) -> DataFrame:
    """sig at another rate by cropping or padding its transform; without a rate, at its own number of rows, evenly spaced."""

    def run(table):
        import pyarrow as pa

        order = np.argsort(np.array(table.column("i")))
        x, t = np.nan_to_num(np.array(table.column("v"), float)[order]), np.array(table.column("t"), float)[order]
        n, dt = len(x), table.column("dt")[0].as_py() or 1.0
        num = n if sample_rate is None else max(int(round(n * dt * sample_rate)), 1)
        f, m = np.fft.rfft(x), min(num, n)
        g = np.zeros(num // 2 + 1, complex)
        g[: m // 2 + 1] = f[: m // 2 + 1]
        if m % 2 == 0 and num != n:
            g[m // 2] *= 2 if num < n else 0.5
        y = np.fft.irfft(g, num) * num / n
        step = (t[1] - t[0] if n > 1 else dt) * n / num if sample_rate is not None else dt
        keys = [pa.array([table.column(k)[0].as_py()] * num, pa.string()) for k in KEYS]
        return pa.table([*keys, pa.array(np.arange(num)), pa.array(t[0] + step * np.arange(num)), pa.array(y)], names=[*KEYS, "i", "t", "v"])

    d = sig.join(spacing(sig).select("series_id", "dt"), "series_id").select(*KEYS, "i", "t", "v", "dt")
    return d.groupBy(*KEYS).applyInArrow(run, SIGNAL)
