"""Spectra: Fourier transforms, Welch, spectrograms, re-binning, vibration criterion curves.

Spectra are long: (series_id, axis, freq, value). Work is dealt by segment, not by series: a segment's samples make one
array of bounded length, transformed by NumPy in Arrow batches, so a series of any length spreads over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS, axes_of, in_order, spacing
from .windows import slice_centres, sliced

SCALINGS = ("density", "spectrum", "parseval", "unit", "rms")


def window_values(name: str, n: int, alpha: float = 0.1) -> np.ndarray:
    """Periodic Hann, boxcar, or a symmetric Tukey window."""
    k = np.arange(n)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * k / n)
    if name in ("boxcar", "rectangular"):
        return np.ones(n)
    if name == "tukey":
        return tukey(n, alpha)
    raise ValueError(f"unknown window {name}")


def tukey(n: int, alpha: float) -> np.ndarray:
    """Symmetric tapered cosine window."""
    if alpha <= 0 or n < 2:
        return np.ones(n)
    x = np.minimum(np.arange(n), n - 1 - np.arange(n)) / (n - 1)
    a = min(alpha, 1.0)
    return np.where(x < a / 2, 0.5 * (1 - np.cos(2 * np.pi * x / a)), 1.0)


def median_bias(n: int) -> float:
    """Expected median of n chi-squared periodograms over their mean."""
    k = 2 * np.arange(1, (n - 1) // 2 + 1)
    return float(1 + (1 / (k + 1) - 1 / k).sum())


def next_fast_len(n: int, real: bool = True) -> int:
    """Smallest length not below n whose prime factors are at most 5 (real) or 11."""
    primes = (2, 3, 5) if real else (2, 3, 5, 7, 11)
    while True:
        m = n
        for p in primes:
            while m % p == 0:
                m //= p
        if m <= 1:
            return n
        n += 1


#: Samples that the segments of one block begin in; a block's spectra are made by one call.
BLOCK = 1 << 15


def _shaped(axes: DataFrame, nperseg: int | None = None, bin_width: float | None = None, overlap: float = 0.5) -> DataFrame:
    """Axes with a spacing, and length and hop of their segments: the length by rows, or by bin width per series."""
    n = F.lit(nperseg) if nperseg else F.floor(F.round(1 / F.col("dt") / bin_width, 9))
    d = axes.filter("dt > 0").withColumn("nperseg", F.least(F.greatest(n, F.lit(1)), F.col("n")).cast("int"))
    return d.withColumn("hop", F.greatest(F.col("nperseg") - F.floor(F.col("nperseg") * overlap), F.lit(1)).cast("long"))


def _blocks(sig: DataFrame, axes: DataFrame) -> DataFrame:
    """Rows of whole segments with the block of segments they are in; the ends of blocks are in two."""
    d = sig.join(axes, list(KEYS))
    first = F.greatest(F.ceil((F.col("i") - F.col("nperseg") + 1) / F.col("hop")), F.lit(0))
    last = F.least(F.floor(F.col("i") / F.col("hop")), F.floor((F.col("n") - F.col("nperseg")) / F.col("hop")))
    per = F.greatest(F.floor(F.lit(BLOCK) / F.col("hop")), F.lit(1))
    d = d.filter(first <= last).withColumn("_b", F.explode(F.sequence(F.floor(first / per), F.floor(last / per))))
    return d.select("_g", "_b", "i", "t", F.coalesce("v", F.lit(0.0)).alias("v"), "nperseg", "hop")


def _spectra(x: np.ndarray, dt: float, window: str, detrend: str | None, scaling: str) -> np.ndarray:
    """One-sided periodograms of rows of samples."""
    n = x.shape[1]
    w = window_values(window, n)
    twice = np.full(n // 2 + 1, 2.0)
    twice[0] = 1
    if n % 2 == 0:
        twice[-1] = 1
    if detrend == "linear" and n > 1:
        k = np.arange(n)
        slope, level = np.polyfit(k, x.T, 1)
        x = x - slope[:, None] * k - level[:, None]
    elif detrend in ("constant", "linear"):
        x = x - x.mean(axis=1, keepdims=True)
    return np.abs(np.fft.rfft(x * w, axis=1)) ** 2 * twice * (dt / (w * w).sum() if scaling == "density" else 1 / w.sum() ** 2)


def _each_block(table, starts, window: str, detrend: str | None, scaling: str) -> Iterator[tuple]:
    """(rows of first samples, rows from segment to segment, hop, power by block, segment and bin) for runs of blocks of one shape; dt as 1."""
    v = table.column("v").to_numpy()
    at = np.asarray(starts)
    n, hop = (table.column(c).to_numpy()[at[:-1]] for c in ("nperseg", "hop"))
    kinds, of = np.unique(np.stack([np.diff(at), n, hop], axis=1), axis=0, return_inverse=True)
    for k, (length, m, h) in enumerate(kinds.tolist()):
        m = min(m, length)
        gap = min(h, m)  # rows between segments are not in the block
        mine = at[:-1][of.ravel() == k]
        some = max((1 << 20) // length, 1)
        for lo in range(0, len(mine), some):
            part = mine[lo : lo + some]
            x = v[part[0] : part[0] + length][None] if len(part) == 1 else v[part[:, None] + np.arange(length)]
            x = np.lib.stride_tricks.sliding_window_view(x, m, axis=1)[:, ::gap]
            step = max((1 << 20) // (m * len(part)), 1)
            made = [_spectra(x[:, j : j + step].reshape(-1, m), 1.0, window, detrend, scaling).reshape(len(part), -1, m // 2 + 1) for j in range(0, x.shape[1], step)]
            yield part, gap, h, np.concatenate(made, axis=1)


def _lists(values: np.ndarray, size: int):
    """An Arrow array of lists of one size."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // size + 1) * size, pa.int32()), pa.array(values))


def periodograms(sig: DataFrame, axes: DataFrame, window: str = "hann", detrend: str | None = "constant", scaling: str = "density") -> DataFrame:
    """One-sided periodogram of each segment: (series_id, axis, seg, t, df, power array)."""

    def run(table, starts):
        import pyarrow as pa

        out = []
        g, i, t = (table.column(c).to_numpy() for c in ("_g", "i", "t"))
        for rows, gap, hop, p in _each_block(table, starts, window, detrend, scaling):
            at = (rows[:, None] + gap * np.arange(p.shape[1])).ravel()
            out.append(pa.table([pa.array(g[at]), pa.array(i[at] // hop), pa.array(t[at]), _lists(p.ravel(), p.shape[2])], names=["_g", "seg", "t0", "p"]))
        return pa.concat_tables(out)

    d = in_order(_blocks(sig, axes), ["_g", "_b"], ["i"], run, "_g long, seg long, t0 double, p array<double>").join(axes, "_g")
    power = F.transform("p", lambda x: x * F.col("dt")) if scaling == "density" else F.col("p")
    return d.select(*KEYS, "seg", (F.col("t0") + F.col("nperseg") * F.col("dt") / 2).alias("t"), (1 / (F.col("nperseg") * F.col("dt"))).alias("df"), power.alias("power"))


def _averages(rows: DataFrame, window: str, detrend: str | None, scaling: str) -> DataFrame:
    """Mean over the segments: (_g, k, value), added up block by block."""

    def run(table, starts):
        import pyarrow as pa

        out = []
        g = table.column("_g").to_numpy()
        for rows, _, _, p in _each_block(table, starts, window, detrend, scaling):
            out.append(pa.table([pa.array(g[rows]), pa.array(np.full(len(rows), p.shape[1])), _lists(p.sum(axis=1).ravel(), p.shape[2])], names=["_g", "_n", "p"]))
        return pa.concat_tables(out)

    d = in_order(rows.drop("t"), ["_g", "_b"], ["i"], run, "_g long, _n long, p array<double>")
    return d.select("_g", "_n", F.posexplode("p").alias("k", "p")).groupBy("_g", "k").agg((F.sum("p") / F.sum("_n")).alias("value"))


def _medians(rows: DataFrame, window: str, detrend: str | None, scaling: str) -> DataFrame:
    """Median over the segments less its bias: (_g, k, value).

    A block gives the values of each bin as one array; a bin's arrays, 8 bytes a segment, meet in one task.
    """

    def run(table, starts):
        import pyarrow as pa

        out = []
        g = table.column("_g").to_numpy()
        for rows, _, _, p in _each_block(table, starts, window, detrend, scaling):
            bins = p.shape[2]
            values = _lists(np.ascontiguousarray(p.transpose(0, 2, 1)).ravel(), p.shape[1])
            out.append(pa.table([pa.array(np.repeat(g[rows], bins)), pa.array(np.tile(np.arange(bins, dtype=np.int32), len(rows))), values], names=["_g", "k", "p"]))
        return pa.concat_tables(out)

    def middle(table, starts):
        import pyarrow as pa

        p = table.column("p").combine_chunks()
        flat, at = p.flatten().to_numpy(), np.append(0, np.cumsum(p.value_lengths().to_numpy()))[np.asarray(starts)]
        value = [np.median(flat[lo:hi]) / (median_bias(hi - lo) if hi - lo > 2 else 1.0) for lo, hi in zip(at, at[1:], strict=False)]
        return table.select(["_g", "k"]).take(pa.array(starts[:-1])).append_column("value", pa.array(value, pa.float64()))

    d = in_order(rows.drop("t"), ["_g", "_b"], ["i"], run, "_g long, k int, p array<double>")
    return in_order(d, ["_g", "k"], [], middle, "_g long, k int, value double")


def _scaled(value: Column, df: Column, scaling: str | None) -> Column:
    if scaling == "parseval":
        return value * df
    if scaling == "unit":
        return F.sqrt(2 * df * value)
    if scaling == "rms":
        return F.sqrt(value * df)
    return value


def welch(sig: DataFrame, bin_width: float | None = 1.0, scaling: str | None = None, window: str = "hann", average: str = "mean", nperseg: int | None = None, overlap: float = 0.5, detrend: str | None = "constant", sp: DataFrame | None = None) -> DataFrame:
    """Welch's periodogram: (series_id, axis, freq, value).

    scaling: density (default), spectrum, parseval (times the bin width, sums to the mean square), unit (amplitude of
    a sine) or rms. average: mean, or median over segments less its bias. sp: (series_id, axis, n, dt), if known.
    """
    if scaling not in (None, *SCALINGS):
        raise ValueError(f"scaling is one of {SCALINGS}")
    axes = _shaped(axes_of(sig) if sp is None else sp, nperseg, bin_width, overlap)
    made = _medians if average == "median" else _averages
    g = made(_blocks(sig, axes), window, detrend, "spectrum" if scaling == "spectrum" else "density").join(axes, "_g")
    g = g.withColumn("df", 1 / (F.col("nperseg") * F.col("dt")))
    if scaling != "spectrum":
        g = g.withColumn("value", F.col("value") * F.col("dt"))
    return g.select(*KEYS, (F.col("k") * F.col("df")).alias("freq"), _scaled(F.col("value"), F.col("df"), scaling).alias("value"))


def aggregate_fft(sig: DataFrame, bin_width: float = 1.0, **options) -> DataFrame:
    return welch(sig, bin_width, "unit", "boxcar", **options)


def add_spectrum_resultant(spec: DataFrame, how: str = "sum", keys: Sequence[str] = ("series_id", "freq"), name: str = "Resultant") -> DataFrame:
    """spec and one more axis: the plain sum of the axes (power) or the root of the sum of squares (amplitude)."""
    total = F.sum("value") if how == "sum" else F.sqrt(F.sum(F.col("value") * F.col("value")))
    r = spec.groupBy(*keys).agg(total.alias("value")).withColumn("axis", F.lit(name))
    return spec.unionByName(r.select(spec.columns))


# ---- re-binning --------------------------------------------------------------------------------------------------


def rebinned(spec: DataFrame, lo: Sequence[float], hi: Sequence[float], centres: Sequence[float], agg: str | Callable = "mean", extra: Sequence[str] = ()) -> DataFrame:
    """spec in bins [lo, hi), the last one closed: mean or sum of each bin, 0 where it is empty; freq is the bin's centre.

    agg may be a function of a Column. A frequency finds its bin by binary counting of edges (a literal array), then
    groups by equality; the bins, a list the caller states, are broadcast to fill the empty ones.
    """
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    edges = F.array(*[F.lit(float(x)) for x in lo])
    at = F.size(F.filter(edges, lambda e: e <= F.col("freq"))) - 1
    stop = F.element_at(F.array(*[F.lit(float(x)) for x in hi]), (at + 1).cast("int"))
    inside = (at >= 0) & ((F.col("freq") < F.when(at >= 0, stop)) | ((at == len(lo) - 1) & (F.col("freq") <= float(hi[-1]))))
    how = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}.get(agg, agg) if isinstance(agg, str) else agg
    keys = [*KEYS, *extra]
    d = spec.filter(inside).withColumn("_b", at).groupBy(*keys, "_b").agg(how(F.col("value")).alias("value"))
    bins = spec.sparkSession.createDataFrame([(k, float(c)) for k, c in enumerate(centres)], "_b int, freq double")
    grid = spec.select(*keys).distinct().crossJoin(F.broadcast(bins))
    return grid.join(d, [*keys, "_b"], "left").select(*keys, "freq", F.coalesce("value", F.lit(0.0)).alias("value"))


def histogram(values: DataFrame, edges: Sequence[float], value: str = "v", weight: str | None = None) -> DataFrame:
    """(series_id, axis, lo, hi, n): counts, or sums of weights, of values in bins [a, b), the last one closed; others are left out."""
    e = [float(x) for x in edges]
    w = F.col(weight) if weight else F.lit(1.0)
    d = rebinned(values.select(*KEYS, F.col(value).alias("freq"), w.alias("value")), e[:-1], e[1:], range(len(e) - 1), "sum")
    at = F.col("freq").cast("int") + 1
    lo, hi = (F.element_at(F.array(*[F.lit(x) for x in part]), at) for part in (e[:-1], e[1:]))
    return d.select(*KEYS, lo.alias("lo"), hi.alias("hi"), F.col("value").alias("n"))


def to_jagged(spec: DataFrame, freq_splits: Sequence[float], agg: str | Callable = "mean", extra: Sequence[str] = ()) -> DataFrame:
    f = list(freq_splits)
    if len(f) < 2 or any(b < a for a, b in zip(f, f[1:], strict=False)):
        raise ValueError("two edges at least, not decreasing")
    return rebinned(spec, f[:-1], f[1:], [(a + b) / 2 for a, b in zip(f, f[1:], strict=False)], agg, extra)


def octave_bins(fstart: float, octave_bins: float, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower edges, upper edges and centres of bins from fstart on, up to the one that holds top."""
    last = max(0, math.floor((math.log2(top) - math.log2(fstart)) * octave_bins + 0.5)) if top > 0 else 0
    k = np.arange(last + 1)
    c = fstart * 2.0 ** (k / octave_bins)
    half = 2.0 ** (0.5 / octave_bins)
    edges = np.append(c / half, c[-1] * half)
    return edges[:-1], edges[1:], c


def to_octave(spec: DataFrame, fstart: float = 1.0, bins: float = 12.0, agg: str | Callable = "mean", extra: Sequence[str] = (), top: float | None = None) -> DataFrame:
    """spec in octave-aligned bins. top: highest frequency, else found by one aggregate."""
    top = top or spec.agg(F.max("freq")).first()[0] or fstart
    lo, hi, c = octave_bins(fstart, bins, top)
    return rebinned(spec, lo, hi, c, agg, extra)


def aligned_bin_width(fstart: float = 1.0, octave_bins: float = 12.0, least: float = 5.0) -> float:
    """Width of spectrum bins of which a whole number reaches up to fstart and an octave bin there holds about ``least``.

    An octave bin is 2 sinh(log(2) / (2 octave_bins)) of its centre wide.
    """
    bandwidth = 2 * math.sinh(math.log(2) / (2 * octave_bins))
    return fstart / math.floor(least / bandwidth)


def binned_power(spectra: DataFrame, fstart: float, octave: float, agg: str, top: float) -> DataFrame:
    """Octave bins of periodograms: (series_id, axis, timestamp, freq, df, value), summed or averaged where the arrays
    are, so that only bins become rows; as to_octave makes them of the exploded spectra."""
    lo, hi, centres = octave_bins(fstart, octave, top)

    def run(batches) -> Iterator:
        import pyarrow as pa

        kept: dict[tuple[int, float], tuple] = {}
        for b in batches:
            power, out = b.column("power"), []
            flat, at = power.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(power.value_lengths().to_numpy(zero_copy_only=False)))
            for k, df in enumerate(b.column("df").to_pylist()):
                one = flat[at[k] : at[k + 1]]
                if (len(one), df) not in kept:
                    f = np.arange(len(one)) * df
                    place = np.searchsorted(lo, f, "right") - 1
                    inside = (place >= 0) & ((f < hi[place]) | ((place == len(lo) - 1) & (f <= hi[-1])))
                    n = np.bincount(place[inside], minlength=len(lo))
                    kept[len(one), df] = inside, place[inside], n if agg == "mean" else np.ones(len(lo))
                inside, place, n = kept[len(one), df]
                out.append(np.bincount(place, weights=one[inside], minlength=len(lo)) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*KEYS, "t", "df")], pa.array(out, pa.list_(pa.float64()))], [*KEYS, "timestamp", "df", "value"])

    d = spectra.select(*KEYS, "t", "df", "power").mapInArrow(run, "series_id string, axis string, timestamp double, df double, value array<double>")
    d = d.select(*KEYS, "timestamp", "df", F.posexplode("value").alias("k", "value"))
    return d.select(*KEYS, "timestamp", F.element_at(F.array(*[F.lit(float(c)) for c in centres]), F.col("k") + 1).alias("freq"), "df", "value")


def differentiate(spec: DataFrame, n: float = 1.0) -> DataFrame:
    """A power spectrum times (2 pi f) ** 2n: of the n-th derivative, or integral; 0 at f = 0 for n < 0."""
    w = 2 * math.pi * F.col("freq")
    factor = F.when((F.col("freq") == 0) & F.lit(n < 0), 0.0).otherwise(F.pow(F.when(F.col("freq") != 0, w).otherwise(F.lit(0.0 if n > 0 else 1.0)), F.lit(2.0 * n)))
    return spec.withColumn("value", F.col("value") * factor)


def vc_curves(psd: DataFrame, fstart: float = 1.0, bins: float = 12.0) -> DataFrame:
    """Velocity RMS in octave bins from an acceleration PSD."""
    f = psd.groupBy("series_id").agg(F.min(F.when(F.col("freq") > 0, F.col("freq"))).alias("df"))
    d = to_octave(differentiate(psd, -1.0), fstart, bins, "sum")
    return d.join(f, "series_id").select(*KEYS, "freq", F.sqrt(F.col("value") * F.col("df")).alias("value"))


# ---- over time ---------------------------------------------------------------------------------------------------


def spectrogram(sig: DataFrame, num_slices: int = 100, scaling: str | None = None, bin_width: float = 1.0, octave: float | None = None, fstart: float = 1.0, agg: str = "mean", freq_splits: Sequence[float] | None = None, add_resultant: bool = True, window: str = "boxcar") -> DataFrame:
    """(series_id, axis, freq, timestamp, value): spectra of segments whose hop makes about num_slices of them."""
    sp = axes_of(sig).filter("dt > 0")
    n = F.least(F.greatest(F.floor(F.round(1 / F.col("dt") / bin_width, 9)), F.lit(1)), F.col("n"))
    hop = F.greatest(F.floor((F.col("n") - n) / max(num_slices - 1, 1)), F.lit(1))
    shape = sp.select("*", n.cast("int").alias("nperseg"), hop.cast("long").alias("hop"))
    p = periodograms(sig, shape, window, "constant", "spectrum" if scaling == "spectrum" else "density")
    if octave and freq_splits is None and agg in ("sum", "mean"):
        top = shape.agg(F.max(F.floor(F.col("nperseg") / 2) / (F.col("nperseg") * F.col("dt")))).first()[0] or fstart
        return _over_time(binned_power(p, fstart, octave, agg, top), scaling, None, fstart, agg, None, add_resultant)
    s = p.select(*KEYS, F.col("t").alias("timestamp"), "df", F.posexplode("power").alias("k", "value"))
    s = s.select(*KEYS, "timestamp", (F.col("k") * F.col("df")).alias("freq"), "df", "value")
    return _over_time(s, scaling, octave, fstart, agg, freq_splits, add_resultant)


def _over_time(s: DataFrame, scaling, octave, fstart, agg, freq_splits, add_resultant) -> DataFrame:
    if scaling in (None, "density", "spectrum") and not (octave or freq_splits is not None or add_resultant):
        return s.select(*KEYS, "freq", "timestamp", "value")  # nothing that df is needed for
    df = s.groupBy("series_id").agg(F.max("df").alias("df"))
    s = s.select(*KEYS, "timestamp", "freq", "value")
    if freq_splits is not None:
        s = to_jagged(s, freq_splits, agg, ["timestamp"])
    elif octave:
        s = to_octave(s, fstart, octave, agg, ["timestamp"])
    if add_resultant:
        s = add_spectrum_resultant(s, "sum", ("series_id", "timestamp", "freq"))
    s = s.join(df, "series_id")
    return s.select(*KEYS, "freq", "timestamp", _scaled(F.col("value"), F.col("df"), scaling).alias("value"))


def rolling_psd(sig: DataFrame, bin_width: float = 1.0, num_slices: int = 100, indexes: Sequence[int] | None = None, values: Sequence[float] | None = None, slice_width: float | None = None, scaling: str | None = None, octave: float | None = None, fstart: float = 1.0, agg: str = "mean", freq_splits: Sequence[float] | None = None, add_resultant: bool = True, window: str = "hann") -> DataFrame:
    """Spectra over time: by the one-pass spectrogram, or for stated slices, each by Welch."""
    if indexes is None and values is None and slice_width is None:
        return spectrogram(sig, num_slices, scaling, bin_width, octave, fstart, agg, freq_splits, add_resultant, window)
    keyed = _as_series(sig, slice_centres(sig, num_slices, indexes, values, slice_width))
    s = welch(keyed, bin_width, "spectrum" if scaling == "spectrum" else None, window).localCheckpoint()
    df = s.groupBy("series_id").agg(F.min(F.when(F.col("freq") > 0, F.col("freq"))).alias("df"))
    s = _from_series(s.join(df, "series_id"))
    return _over_time(s, scaling, octave, fstart, agg, freq_splits, add_resultant)


def _as_series(sig: DataFrame, centres: DataFrame) -> DataFrame:
    """Slices as series of their own: the slice number joins the series id, rows are counted anew."""
    c = centres.withColumn("_key", F.to_json(F.struct("series_id", "slice", "slice_t")))
    d = sliced(sig, c, extra=("_key", "_lo"))
    return d.select(F.col("_key").alias("series_id"), "axis", (F.col("i") - F.col("_lo")).alias("i"), "t", "v")


def _from_series(s: DataFrame) -> DataFrame:
    key = F.from_json("series_id", "series_id string, slice long, slice_t double")
    return s.withColumn("_k", key).withColumn("series_id", F.col("_k.series_id")).withColumn("timestamp", F.col("_k.slice_t")).drop("_k")


def rolling_fft(sig: DataFrame, bin_width: float = 1.0, num_slices: int = 100, indexes: Sequence[int] | None = None, values: Sequence[float] | None = None, slice_width: float | None = None, add_resultant: bool = True) -> DataFrame:
    """Amplitude spectra over time; the resultant is the root of the sum of squares."""
    s = rolling_psd(sig, bin_width, num_slices, indexes, values, slice_width, "unit", add_resultant=False, window="boxcar")
    return add_spectrum_resultant(s, "l2", ("series_id", "timestamp", "freq")) if add_resultant else s


def octave_spectrogram(sig: DataFrame, window: float, bins_per_octave: float = 3, freq_start: float = 20.0, max_freq: float = math.inf, db_scale: bool = True) -> DataFrame:
    """Octave spectrogram with slices of a window in seconds; value in dB of its largest if db_scale."""
    total = spacing(sig).agg(F.max(F.col("n") * F.col("dt"))).first()[0] or window
    s = spectrogram(sig, max(int(total / window), 1), None, aligned_bin_width(freq_start, bins_per_octave), bins_per_octave, freq_start, "sum", None, False, "hann").filter(F.col("freq") <= max_freq)
    return s.withColumn("value", F.when(F.col("value") > 0, 10 * F.log10("value"))) if db_scale else s


def spectrum_over_time(spec: DataFrame, kind: str = "heatmap", freq_min: float | None = None, freq_max: float | None = None, round_freq: int = 2) -> DataFrame:
    """Views of (series_id, axis, freq, timestamp, value): heatmap rows, the peak frequency of each time, or the
    max, min and median of each frequency (animation)."""
    d = spec.filter((F.col("freq") > 0) & (F.col("value") > 0))
    d = d if freq_min is None else d.filter(F.col("freq") >= freq_min)
    d = d if freq_max is None else d.filter(F.col("freq") <= freq_max)
    d = d.withColumn("freq", F.round("freq", round_freq))
    if kind == "peak":
        return d.groupBy(*KEYS, "timestamp").agg(F.max(F.struct("value", (-F.col("freq")).alias("no"))).alias("b")).select(*KEYS, "timestamp", (-F.col("b.no")).alias("freq"), F.col("b.value").alias("value"))
    if kind == "animation":
        return d.groupBy(*KEYS, "freq").agg(F.max("value").alias("max"), F.min("value").alias("min"), F.percentile("value", F.lit(0.5)).alias("median"))
    if kind == "heatmap":
        return d.groupBy(*KEYS, "freq", "timestamp").agg(F.avg("value").alias("value"))
    raise ValueError("kind is heatmap, peak or animation")


# ---- transforms of whole series ----------------------------------------------------------------------------------


def _whole(sig: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(x, dt) -> columns after series_id and axis, for each axis of each series."""

    def run(table):
        import pyarrow as pa

        order = np.argsort(np.array(table.column("i")))
        x = np.nan_to_num(np.array(table.column("v"), float)[order])
        out = kernel(x, table.column("dt")[0].as_py() or 1.0)
        n = len(out[0])
        keys = [pa.array([table.column(k)[0].as_py()] * n, pa.string()) for k in KEYS]
        return pa.table([*keys, *map(pa.array, out)], names=[*KEYS, *[c.split()[0] for c in schema.split(", ")]])

    d = sig.join(spacing(sig).select("series_id", "dt"), "series_id").select(*KEYS, "i", "v", "dt")
    return d.groupBy(*KEYS).applyInArrow(run, f"series_id string, axis string, {schema}")


def _norm(n: int, norm: str | None, output: str) -> float:
    if output == "angle" or norm == "forward":
        return 1.0 / n
    if norm in (None, "unit"):
        return 2.0 / n
    if norm == "ortho":
        return 1.0 / math.sqrt(n)
    if norm == "backward":
        return 1.0
    raise ValueError("norm is unit, forward, ortho or backward")


def _transform(sig: DataFrame, real: bool, output: str | None, nfft: int | None, norm: str | None, optimize: bool) -> DataFrame:
    output = output or "magnitude"
    if output not in ("magnitude", "angle", "complex"):
        raise ValueError("output is magnitude, angle or complex")
    _norm(1, norm, output)

    def kernel(x, dt):
        n = nfft or len(x)
        if optimize:
            n = next_fast_len(n, real)
        f = (np.fft.rfft(x, n) if real else np.fft.fftshift(np.fft.fft(x, n))) * _norm(n, norm, output)
        freq = np.fft.rfftfreq(n, dt) if real else np.fft.fftshift(np.fft.fftfreq(n, dt))
        if output == "complex":
            return [freq, f.real.copy(), f.imag.copy()]
        return [freq, np.abs(f) if output == "magnitude" else np.angle(f)]

    return _whole(sig, kernel, "freq double, re double, im double" if output == "complex" else "freq double, value double")


def fft(sig: DataFrame, output: str | None = None, nfft: int | None = None, norm: str | None = None, optimize: bool = True) -> DataFrame:
    """Two-sided transform, zero frequency in the middle: magnitude, angle, or re and im."""
    return _transform(sig, False, output, nfft, norm, optimize)


def rfft(sig: DataFrame, output: str | None = None, nfft: int | None = None, norm: str | None = None, optimize: bool = True) -> DataFrame:
    """One-sided transform."""
    return _transform(sig, True, output, nfft, norm, optimize)


def _trig(sig: DataFrame, sine: bool, nfft: int | None, norm: str | None) -> DataFrame:
    def kernel(x, dt):
        n = nfft or len(x)
        x = np.concatenate([x[:n], np.zeros(max(n - len(x), 0))])
        # by the FFT of the sequence reordered to even places, then odd ones backward
        y = x * (-1.0) ** np.arange(n) if sine else x
        f = np.fft.fft(np.concatenate([y[0::2], y[1::2][::-1]])) * np.exp(-0.5j * np.pi * np.arange(n) / n)
        c = 2 * f.real
        c = c[::-1].copy() if sine else c
        if norm in (None, "unit"):
            c /= n
        elif norm == "forward":
            c /= 2 * n
        elif norm == "ortho":
            c *= math.sqrt(1 / (2 * n))
            c[-1 if sine else 0] /= math.sqrt(2)
        return [np.linspace(0, 0.5 / dt, n), c]

    _norm(1, norm, "magnitude")
    return _whole(sig, kernel, "freq double, value double")


def dct(sig: DataFrame, nfft: int | None = None, norm: str | None = None) -> DataFrame:
    """Cosine transform, type 2."""
    return _trig(sig, False, nfft, norm)


def dst(sig: DataFrame, nfft: int | None = None, norm: str | None = None) -> DataFrame:
    """Sine transform, type 2."""
    return _trig(sig, True, nfft, norm)


def transfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root of the ratio of two PSDs, by axis and frequency."""
    r = b.select(*KEYS, "freq", F.col("value").alias("_b"))
    return a.join(r, [*KEYS, "freq"]).select(*KEYS, "freq", F.sqrt(F.try_divide("value", "_b")).alias("value"))


def cumulative_rms(psd: DataFrame) -> DataFrame:
    """Root of the running sum of PSD times bin width."""
    f = psd.groupBy("series_id").agg(F.min(F.when(F.col("freq") > 0, F.col("freq"))).alias("df"))
    w = Window.partitionBy(*KEYS).orderBy("freq").rowsBetween(Window.unboundedPreceding, 0)
    return psd.join(f, "series_id").select(*KEYS, "freq", F.sqrt(F.sum(F.col("value") * F.col("df")).over(w)).alias("value"))
