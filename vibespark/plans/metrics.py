"""Vibration and shock metrics of signals, whole or slice by slice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import factor
from ..model import KEYS, axes_of, known
from ..operators.filters import filter_signal, taper
from ..operators.motion import extremes, tapering
from ..operators.shock import shock_spectrum
from ..operators.spectral import welch
from ..operators.stats import medians, near_median, offsets, remove_offset
from ..operators.windows import integrals, slice_centres

COLUMNS = ("series_id", "axis", "value", "calculation", "units")


def shock_vibe_metrics(sig: DataFrame, tukey_percent: float = 0.1, highpass_cutoff: float | None = None, accel_units: str = "gravity", disp_units: str = "in", freq_splits: Sequence[float | None] = (0, 65, 300, 1500, None), detrend: str | None = "median", zero: str = "start", include_integration: bool = True, include_pseudo_velocity: bool = False, damp: float = 0.05, init_freq: float = 1.0, bins_per_octave: float = 12.0, include_resultant: bool = False, bin_width: float = 1.0) -> DataFrame:
    """(series_id, axis, value, calculation, units): peaks, RMS, peak frequency, RMS by band, and pseudo-velocity.

    The signal is freed of its offset, filtered and tapered; each integration conditions its input again. RMS leaves out
    the tapered ends. The resultant has the norm of the axes at each time; its bands are the sums of the axes' bands.
    """
    k = factor(accel_units, f"{disp_units}/s^2")
    axes = axes_of(sig, **({"near": near_median()} if detrend == "median" else {}))
    level = medians(sig, axes) if detrend == "median" else offsets(sig, detrend) if detrend else axes.select(*KEYS, F.lit(0.0).alias("_level"))
    axes = known(axes.join(level.withColumnRenamed("_level", "level"), list(KEYS), "left"))
    if highpass_cutoff or zero not in ("start", None):
        prepare = lambda d: filter_signal(d, "butterworth", highpass_cutoff, None, 3, tukey_percent) if highpass_cutoff else taper(d, tukey_percent)
        base = prepare(remove_offset(sig, detrend))
        m = _measured(base, sig, k, include_integration, include_resultant, tukey_percent, zero, prepare)
    else:
        conditioned = (F.col("v") - F.col("level")) * tapering(tukey_percent)
        base = sig.join(axes, list(KEYS)).withColumn("v", conditioned).select(*KEYS, "i", "t", "v")
        m = extremes(sig, axes, conditioned, tukey_percent, tukey_percent, k if include_integration else None, include_resultant)
    of = {"Acceleration": accel_units, "Velocity": f"{disp_units}/s", "Displacement": disp_units}
    m = m.withColumn("units", F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("name")))
    m = m.withColumnsRenamed({"peak": "Peak", "rms": "RMS"}).unpivot([*KEYS, "name", "units"], ["Peak", "RMS"], "kind", "value")
    out = m.select(*KEYS, "value", F.concat_ws(" ", "name", "kind").alias("calculation"), "units")

    psd = welch(base, bin_width, "parseval", sp=axes).localCheckpoint()
    last = psd.agg(F.max("freq")).first()[0] or 0.0
    splits = [f for f in freq_splits if f is not None]
    if freq_splits[-1] is None and last > splits[-1]:
        splits.append(last)
    splits = [f for f in splits if f <= last]
    bands = list(zip(splits, splits[1:], strict=False))
    top = F.max(F.struct("value", (-F.col("freq")).alias("no")))
    made = [F.struct(F.lit("Peak Frequency").alias("calculation"), (-top["no"]).alias("value"), F.lit("Hz").alias("units"))]
    for lo, hi in bands:
        here = (F.col("freq") >= lo) & ((F.col("freq") <= hi) if hi == splits[-1] else (F.col("freq") < hi))
        rms = F.sqrt(F.sum(F.when(here, F.col("value")).otherwise(0.0)))
        made.append(F.struct(F.lit(f"RMS from {lo:g} to {hi:g}").alias("calculation"), rms.alias("value"), F.lit(accel_units).alias("units")))
    f = psd.groupBy(*KEYS).agg(F.array(*made).alias("m")).select(*KEYS, F.explode("m").alias("m")).select(*KEYS, "m.value", "m.calculation", "m.units")
    out = out.unionByName(f)
    if include_resultant and bands:
        r = f.filter(F.col("units") == accel_units).groupBy("series_id", "calculation", "units").agg(F.sum("value").alias("value"))
        out = out.unionByName(r.withColumn("axis", F.lit("Resultant")))
    if include_pseudo_velocity:
        pv = shock_spectrum(base.withColumn("v", F.col("v") * k), None, init_freq, bins_per_octave, damp, "pvss")
        best = pv.groupBy(*KEYS).agg(top.alias("b"))
        both = F.array(F.struct(F.lit("Pseudo Velocity Peak").alias("calculation"), F.col("b.value").alias("value"), F.lit(f"{disp_units}/s").alias("units")), F.struct(F.lit("Pseudo Velocity Peak Frequency").alias("calculation"), (-F.col("b.no")).alias("value"), F.lit("Hz").alias("units")))
        out = out.unionByName(best.select(*KEYS, F.explode(both).alias("m")).select(*KEYS, "m.value", "m.calculation", "m.units"))
    return out


def _measured(base: DataFrame, sig: DataFrame, k: float, integration: bool, include_resultant: bool, tukey_percent: float, zero: str | None, prepare) -> DataFrame:
    """(series_id, axis, name, peak, rms) where each step is filtered, or freed of its offset, as a whole."""
    steps = [("Acceleration", base)]
    if integration:
        v = integrals(base.withColumn("v", F.col("v") * k), 1, zero, prepare)[1]
        steps += [("Velocity", v), ("Displacement", integrals(v, 1, zero, prepare)[1])]
    every = reduce(DataFrame.unionByName, [d.select("*", F.lit(name).alias("name")) for name, d in steps])
    if include_resultant:
        norm = every.groupBy("series_id", "i", "name").agg(F.first("t").alias("t"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))
        every = every.unionByName(norm.withColumn("axis", F.lit("Resultant")))
    n = known(sig.groupBy("series_id").agg((F.max("i") + 1).alias("_n")))
    edge = F.floor(F.col("_n") * tukey_percent / 2)
    inside = (F.col("i") >= edge) & (F.col("i") < F.col("_n") - edge)
    return every.join(n, "series_id").groupBy(*KEYS, "name").agg(F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.when(inside, F.col("v") * F.col("v")))).alias("rms"))


def rolling_metrics(sig: DataFrame, num_slices: int = 100, indexes=None, index_values=None, slice_width: float | None = None, **options) -> DataFrame:
    """shock_vibe_metrics of slices, with timestamp."""
    from ..operators.spectral import _as_series, _from_series

    made = shock_vibe_metrics(_as_series(sig, slice_centres(sig, num_slices, indexes, index_values, slice_width)), **options)
    return _from_series(made).select(*COLUMNS, "timestamp")
