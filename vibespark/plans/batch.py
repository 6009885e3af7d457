"""Many recordings at once: derived channels, and a builder of result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quaternion import angular_velocity
from ..functions.units import G, to_db
from ..model import KEYS, known
from ..operators.filters import filter_signal, taper
from ..operators.joins import lookup
from ..operators.motion import integrated
from ..operators.shock import enveloping_half_sine, pulse_time_series, shock_spectrum
from ..operators.spectral import add_spectrum_resultant, to_octave, vc_curves, welch
from ..operators.stats import norm_of_axes, peak_with_resultant, pick, resultant, rms, rms_with_resultant
from ..operators.windows import integrate, peak_windows, trimmed, trimmed_by_margin
from ..sources.files import write_csv_folder

# Factors to the units of each derived channel.
ACCEL = {"g": G, "m/s²": 1.0, "m/s^2": 1.0}
PRESSURE = {"pa": 1e-3, "psi": 6.89476, "atm": 101.325, "kpa": 1.0}
TEMPERATURE = {"°c": (1.0, 0.0), "c": (1.0, 0.0), "°k": (1.0, -273.15), "k": (1.0, -273.15), "°f": (5 / 9, -160 / 9), "f": (5 / 9, -160 / 9)}
MICROPHONE = {"pa": 1.0, "a": -5.307530522779073}


@dataclass(frozen=True)
class Params:
    """How derived channels are made: highpass cutoff, times or margins (seconds) to trim, taper and zero of integrations."""

    highpass: float | None = 1.0
    start_time: float | None = None
    end_time: float | None = None
    start_margin: float | None = None
    end_margin: float | None = None
    tukey_percent: float = 0.0
    zero: str = "start"
    bin_width: float = 1.0
    window: str = "hann"
    pvss_init_freq: float = 1.0
    pvss_bins: float = 12.0
    vc_init_freq: float = 1.0
    vc_bins: float = 3.0

    def __post_init__(self):
        if self.start_time is not None and self.start_margin is not None or self.end_time is not None and self.end_margin is not None:
            raise ValueError("a time and a margin exclude each other")


def _scaled(d: DataFrame, table: dict) -> DataFrame:
    """v times the factor of its unit; an unknown unit is an error when the row is read."""
    made: Column = F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce("unit", F.lit("null")))).cast("double")
    for unit, k in table.items():
        a, b = k if isinstance(k, tuple) else (k, 0.0)
        made = F.when(F.lower("unit") == unit, F.col("v") * a + b).otherwise(made)
    return d.withColumn("v", made).select(*KEYS, "i", "t", "v")


class Channels:
    """Derived channels of recordings in one table (series_id, type, unit, axis, i, t, v), made when first asked for.

    A recording without a channel has no rows of what derives from it.
    """

    def __init__(self, signals: DataFrame, params: Params | None = None):
        self.signals, self.params = signals, params or Params()

    @classmethod
    def from_frames(cls, frames: Sequence[tuple[DataFrame, str, str]], params: Params | None = None) -> Channels:
        """Of (signal, type, unit) triples; of a type the last one counts."""
        last = {kind: d.withColumns({"type": F.lit(kind), "unit": F.lit(unit)}) for d, kind, unit in frames}
        made = list(last.values())
        out = made[0]
        for d in made[1:]:
            out = out.unionByName(d)
        return cls(out, params)

    def _of(self, kind: str) -> DataFrame:
        return self.signals.filter(F.lower("type") == kind)

    def _condition(self, d: DataFrame) -> DataFrame:
        p = self.params
        return filter_signal(d, "butterworth", p.highpass, None, 3, p.tukey_percent) if p.highpass else taper(d, p.tukey_percent)

    @cached_property
    def acceleration(self) -> DataFrame:
        p = self.params
        d = _scaled(self._of("acceleration"), ACCEL)
        d = trimmed(d, p.start_time, p.end_time)
        if p.start_margin or p.end_margin:
            d = trimmed_by_margin(d, p.start_margin or 0.0, p.end_margin or 0.0)
        if p.start_time is not None or p.start_margin:
            first = d.groupBy("series_id").agg(F.min("i").alias("_i"))
            d = d.join(first, "series_id").withColumn("i", F.col("i") - F.col("_i")).drop("_i")
        return filter_signal(d, "butterworth", p.highpass) if p.highpass else d

    @cached_property
    def motion_rms(self) -> DataFrame | None:
        """(series_id, axis, velocity, displacement): RMS by axis of one pass, where nothing is done between integrations."""
        p = self.params
        if p.highpass or p.tukey_percent > 0 or p.zero not in ("start", None):
            return None
        d = integrated(self.acceleration)
        return known(d.groupBy(*KEYS).agg(rms("first").alias("velocity"), rms("second").alias("displacement")))

    def rms_of(self, name: str, scale: float) -> DataFrame:
        """RMS of velocity or displacement, with the resultant."""
        if self.motion_rms is None:
            return rms_with_resultant(getattr(self, name), scale)
        return norm_of_axes(self.motion_rms.select(*KEYS, (F.col(name) * scale).alias("value")))

    @cached_property
    def velocity(self) -> DataFrame:
        return integrate(self._condition(self.acceleration), self.params.zero)

    @cached_property
    def displacement(self) -> DataFrame:
        return integrate(self._condition(self.velocity), self.params.zero)

    @cached_property
    def microphone(self) -> DataFrame:
        return _scaled(self._of("audio"), MICROPHONE)

    @cached_property
    def pressure(self) -> DataFrame:
        return _scaled(self._of("pressure"), PRESSURE)

    @cached_property
    def temperature(self) -> DataFrame:
        return _scaled(self._of("temperature"), TEMPERATURE)

    @cached_property
    def humidity(self) -> DataFrame:
        return _scaled(self._of("humidity"), {"rh": 1.0, "%rh": 1.0})

    @cached_property
    def gyroscope(self) -> DataFrame:
        """Degrees per second: as recorded, or from quaternions with axes W, X, Y, Z."""
        plain = _scaled(self._of("rotation"), {"dps": 1.0, "deg/s": 1.0})
        q = self._of("quaternion").groupBy("series_id", "i", "t").pivot("axis", ["W", "X", "Y", "Z"]).agg(F.first("v"))
        dt = q.groupBy("series_id").agg(F.try_divide(F.max("t") - F.min("t"), F.max("i")).alias("dt"))
        q = q.select("series_id", "i", "t", F.struct(F.col("W").alias("w"), F.col("X").alias("x"), F.col("Y").alias("y"), F.col("Z").alias("z")).alias("q"))
        w = angular_velocity(q, "q").join(dt, "series_id")
        turn = w.select("series_id", "i", "t", *[(F.degrees(F.col(f"w{a}")) / F.col("dt")).alias(a.upper()) for a in "xyz"])
        return plain.unionByName(turn.unpivot(["series_id", "i", "t"], ["X", "Y", "Z"], "axis", "v").select(*plain.columns))

    @cached_property
    def gps_position(self) -> DataFrame:
        return _scaled(self._of("gps"), {"degrees": 1.0, "deg": 1.0})

    @cached_property
    def gps_speed(self) -> DataFrame:
        return _scaled(self._of("speed"), {"m/s": 3.6, "km/h": 1.0})

    def resultant_of(self, name: str) -> DataFrame:
        return resultant(getattr(self, name)).filter("axis = 'Resultant'")

    @cached_property
    def psd(self) -> DataFrame:
        # a row per bin, which the resultant, the octaves and the curves read many times
        return welch(self.acceleration, self.params.bin_width, None, self.params.window, "median").localCheckpoint()

    @cached_property
    def pvss(self) -> DataFrame:
        p = self.params
        return shock_spectrum(self.acceleration, None, p.pvss_init_freq, p.pvss_bins, 0.05, "pvss")

    @cached_property
    def pvss_resultant(self) -> DataFrame:
        p = self.params
        return shock_spectrum(self.acceleration, None, p.pvss_init_freq, p.pvss_bins, 0.05, "pvss", aggregate_axes=True)

    @cached_property
    def vc(self) -> DataFrame:
        return vc_curves(self.psd, self.params.vc_init_freq, self.params.vc_bins)


def _mean(d: DataFrame) -> DataFrame:
    return d.groupBy(*KEYS).agg(F.avg("v").alias("value"))


def _last_fix(c: Channels) -> DataFrame:
    g = c.gps_position.groupBy("series_id", "t").pivot("axis", ["Latitude", "Longitude"]).agg(F.first("v")).filter("Latitude <> 0 AND Longitude <> 0")
    g = g.groupBy("series_id").agg(F.max_by(F.struct("Latitude", "Longitude"), "t").alias("f")).select("series_id", "f.*")
    return g.unpivot(["series_id"], ["Latitude", "Longitude"], "axis", "value")


METRICS: dict[str, Callable[[Channels], DataFrame]] = {
    "RMS Acceleration": lambda c: rms_with_resultant(c.acceleration, 1 / G),
    "RMS Velocity": lambda c: c.rms_of("velocity", 1e3),
    "RMS Displacement": lambda c: c.rms_of("displacement", 1e3),
    "Peak Absolute Acceleration": lambda c: peak_with_resultant(c.acceleration, 1 / G),
    "Peak Pseudo Velocity Shock Spectrum": lambda c: c.pvss.unionByName(c.pvss_resultant).groupBy(*KEYS).agg((F.max("value") * 1e3).alias("value")),
    "GPS Position": _last_fix,
    "GPS Speed": lambda c: c.gps_speed.filter("v <> 0").groupBy(*KEYS).agg(F.avg("v").alias("value")),
    "RMS Angular Velocity": lambda c: rms_with_resultant(c.gyroscope),
    "RMS Microphone": lambda c: c.microphone.groupBy(*KEYS).agg(rms().alias("value")),
    "RMS Microphone Decibels": lambda c: c.microphone.groupBy(*KEYS).agg(to_db(rms(), "SPL").alias("value")),
    "Average Temperature": lambda c: _mean(c.temperature),
    "Average Pressure": lambda c: _mean(c.pressure),
    "Average Relative Humidity": lambda c: _mean(c.humidity),
}
DEFAULT_EXCLUDE = ("RMS Microphone",)


class Result(dict):
    """Result tables by name, in order."""

    def to_csv_folder(self, folder: str) -> None:
        write_csv_folder(self, folder)


@dataclass(frozen=True)
class Builder:
    """Queues result tables; ``aggregate`` makes them for all recordings at once, keyed by series_id."""

    params: Params = field(default_factory=Params)
    queue: tuple[tuple[str, Callable[[Channels], DataFrame]], ...] = ()

    def _with(self, name: str, fn: Callable[[Channels], DataFrame], once: bool = False, **params) -> Builder:
        if once and any(n == name for n, _ in self.queue):
            raise RuntimeError(f"{name} is queued already")
        return replace(self, queue=(*self.queue, (name, fn)), params=replace(self.params, **params))

    def add_psd(self, bin_width: float | None = None, octave_start: float | None = None, bins_per_octave: float | None = None, window: str | None = None) -> Builder:
        """Power spectral density in g^2/Hz, with the sum of the axes as Resultant."""
        if bin_width is None and bins_per_octave is None:
            raise ValueError("give a bin width or bins per octave")
        if window and window != self.params.window and any(n == "psd" for n, _ in self.queue):
            raise ValueError("all spectra share one window")

        def make(c: Channels) -> DataFrame:
            d = add_spectrum_resultant(c.psd)
            d = to_octave(d, octave_start or 1.0, bins_per_octave) if bins_per_octave else d
            return d.withColumn("value", F.col("value") / (G * G))

        changed = {"bin_width": bin_width or self.params.bin_width, "window": window or self.params.window}
        return self._with("psd", make, **changed)

    def add_pvss(self, init_freq: float = 1.0, bins_per_octave: float = 3.0) -> Builder:
        return self._with("pvss", lambda c: c.pvss.unionByName(c.pvss_resultant).withColumn("value", F.col("value") * 1e3), True, pvss_init_freq=init_freq, pvss_bins=bins_per_octave)

    def add_pvss_halfsine_envelope(self, tstart=None, tstop=None, dt=None, tpulse: float = 0.0) -> Builder:
        return self._with("halfsine", lambda c: pulse_time_series(enveloping_half_sine(c.pvss, 0.05), tstart, tstop, dt, tpulse).select(*KEYS, F.col("t").alias("timestamp"), F.col("v").alias("value")))

    def add_metrics(self, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Builder:
        names = pick(list(METRICS), include, exclude or (() if include else DEFAULT_EXCLUDE))

        def make(c: Channels) -> DataFrame:
            out = None
            for n in names:
                d = METRICS[n](c).select(F.col("series_id"), F.lit(n).alias("calculation"), "axis", "value")
                out = d if out is None else out.unionByName(d)
            return out

        return self._with("metrics", make)

    def add_peaks(self, margin: int = 1000) -> Builder:
        return self._with("peaks", lambda c: peak_windows(c.acceleration.withColumn("v", F.col("v") / G), margin).select(*KEYS, F.col("peak_t").alias("peak time"), F.col("offset_s").alias("peak offset"), F.col("v").alias("value")))

    def add_vc_curves(self, init_freq: float = 1.0, bins_per_octave: float = 3.0) -> Builder:
        return self._with("vc_curves", lambda c: add_spectrum_resultant(c.vc.withColumn("value", F.col("value") * 1e6), "l2"), True, vc_init_freq=init_freq, vc_bins=bins_per_octave)

    def aggregate(self, signals: DataFrame, meta: DataFrame | None = None) -> Result:
        """Result tables over all recordings, each with the columns of meta (a row per series_id), which comes first."""
        c = Channels(signals, self.params)
        out = Result()
        if meta is not None:
            out["meta"] = meta
        for name, fn in self.queue:
            d = fn(c)
            out[name] = d if meta is None else lookup(d, meta, ["series_id"])
        return out


def recording_meta(recordings: DataFrame, utc: str = "utc", first_us: str = "first_us", serial: str = "serial") -> DataFrame:
    """(series_id, serial number, start time) of a table of recordings."""
    return recordings.select("series_id", F.col(serial).alias("serial number"), F.timestamp_micros((F.col(utc) * 1_000_000 + F.coalesce(first_us, F.lit(0))).cast("long")).alias("start time"))
