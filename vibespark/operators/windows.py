"""Frames over signals: rolling metrics, integration, envelopes, peaks, slices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHUNK, KEYS, axes_of, chunk_window, haloed, in_order, known, running_sum, spacing
from .motion import integrated
from .stats import remove_offset, resultant

_OUT = ("series_id", "axis", "i", "t", "v")


def rolling(sig: DataFrame, n: int, how: str = "rms", full: bool = True) -> DataFrame:
    """Trailing frame of n rows: rms, mean, std, absmax, min or max in v; null until the frame is full, if ``full``."""
    if n < 1:
        raise ValueError("a frame has at least one row")
    w, v = chunk_window(rows=(-(n - 1), 0)), F.col("v")
    made = {
        "rms": F.sqrt(F.avg(v * v).over(w)), "mean": F.avg(v).over(w), "std": F.stddev_samp(v).over(w),
        "absmax": F.max(F.abs(v)).over(w), "min": F.min(v).over(w), "max": F.max(v).over(w),
    }[how]
    value = F.when(F.count(v).over(w) == n, made) if full else made
    return haloed(sig, n - 1).withColumn("_v", value).filter("core").withColumn("v", F.col("_v")).select(*_OUT)


def rolling_mean_removed(sig: DataFrame, duration: float | None = 5.0) -> DataFrame:
    """sig less its centred rolling mean over duration (an odd number of rows); None: less its mean."""
    if duration is None:
        return remove_offset(sig, "mean")
    # the odd count int(ceil(duration / dt // 2 * 2 + 1)), halved
    half = F.floor(F.ceil(F.floor(F.lit(duration) / F.col("dt") / 2) * 2 + 1) / 2).cast("long")
    axes = axes_of(sig).withColumn("half", half).filter("half IS NOT NULL")
    wide = axes.filter(F.col("half") > CHUNK)
    if wide.isEmpty():
        return _near_mean_removed(sig, axes)
    near = _near_mean_removed(sig, axes.filter(F.col("half") <= CHUNK))
    return near.unionByName(_far_mean_removed(sig.join(wide.select(*KEYS), list(KEYS), "left_semi"), wide))


def _near_mean_removed(sig: DataFrame, axes: DataFrame, size: int = CHUNK) -> DataFrame:
    """sig less the mean of up to half rows on both sides, half at most a chunk: chunks with the rows around them."""
    d = sig.join(axes, list(KEYS))
    first, last = (F.floor(F.greatest(F.col("i") + k * F.col("half"), F.lit(0)) / size) for k in (-1, 1))
    d = d.withColumn("_c", F.explode(F.sequence(first, last)))
    d = d.select("_g", "_c", "i", "t", "v", F.when(F.floor(F.col("i") / size) == F.col("_c"), F.col("half")).alias("half"))

    def run(table, starts):
        import numpy as np
        import pyarrow as pa

        v, half = table.column("v").to_numpy(), table.column("half").to_numpy(zero_copy_only=False)
        keep, out = [], []
        for a, b in zip(starts, starts[1:], strict=False):
            own = np.flatnonzero(~np.isnan(half[a:b].astype(float)))
            if not len(own):
                continue
            x = np.nan_to_num(v[a:b])
            level, h = x.mean(), int(half[a + own[0]])
            total = np.append(0.0, np.cumsum(x - level))
            lo, hi = np.maximum(own - h, 0), np.minimum(own + h + 1, b - a)
            keep.append(a + own)
            out.append(v[a + own] - (level + (total[hi] - total[lo]) / (hi - lo)))
        if not keep:
            return None
        return table.select(["_g", "i", "t"]).take(pa.array(np.concatenate(keep))).append_column("v", pa.array(np.concatenate(out), from_pandas=True))

    return in_order(d, ["_g", "_c"], ["i"], run, "_g long, i long, t double, v double").join(axes.select(*KEYS, "_g"), "_g").select(*_OUT)


def _far_mean_removed(sig: DataFrame, axes: DataFrame) -> DataFrame:
    """The same for any half, by running sums met at both ends of the frame."""
    sums = running_sum(sig, F.coalesce("v", F.lit(0.0)), "_sum")
    at = sums.select(*KEYS, F.col("i").alias("_j"), F.col("_sum").alias("_s"))
    d = sums.join(axes.select(*KEYS, "half", (F.col("n") - 1).alias("_top")), list(KEYS))
    d = d.withColumns({"_hi": F.least(F.col("i") + F.col("half"), F.col("_top")), "_lo": F.col("i") - F.col("half") - 1})
    hi = at.select(*KEYS, F.col("_j").alias("_hi"), F.col("_s").alias("_shi"))
    lo = at.select(*KEYS, F.col("_j").alias("_lo"), F.col("_s").alias("_slo"))
    d = d.join(hi, [*KEYS, "_hi"]).join(lo, [*KEYS, "_lo"], "left")
    n = F.col("_hi") - F.greatest("_lo", F.lit(-1))
    return d.withColumn("v", F.col("v") - (F.col("_shi") - F.coalesce("_slo", F.lit(0.0))) / n).select(*_OUT)


def integrate(sig: DataFrame, zero: str | None = "start") -> DataFrame:
    """Cumulative trapezoid from 0 with the average spacing, less its mean or median unless zero is start."""
    d = integrated(sig).withColumn("v", F.col("first")).select(*_OUT)
    return d if zero in ("start", None) else remove_offset(d, zero)


def iter_integrals(sig: DataFrame, zero: str = "start", condition=None) -> Iterator[DataFrame]:
    """sig, its integral, the integral of that, and so on; condition is applied before each integration."""
    while True:
        yield sig
        sig = integrate(condition(sig) if condition else sig, zero)


def integrals(sig: DataFrame, n: int = 1, zero: str = "start", condition=None) -> list[DataFrame]:
    if n == 2 and zero in ("start", None) and condition is None:
        both = integrated(sig)
        return [sig, *[both.withColumn("v", F.col(c)).select(*_OUT) for c in ("first", "second")]]
    made = iter_integrals(sig, zero, condition)
    return [next(made) for _ in range(n + 1)]


def envelope(sig: DataFrame, points: int = 250, least: int = 1) -> DataFrame:
    """Min and max of the trailing window of round((n - 1) / points) rows, at every (window - 1)-th row.

    Columns: series_id, axis, i, t, lo, hi. Axes with fewer than ``least`` values are dropped.
    """
    w = sig.groupBy("series_id").agg(F.greatest(F.round(F.max("i") / points), F.lit(1)).cast("long").alias("w"))
    some = sig.groupBy(*KEYS).agg(F.count("v").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    stride = F.greatest(F.col("w") - 1, F.lit(1))
    # a row belongs to every kept row k with k - w < i <= k and k a multiple of the stride
    d = sig.join(w, "series_id").join(some, list(KEYS), "left_semi")
    first = F.ceil(F.col("i") / stride)
    last = F.floor((F.col("i") + F.col("w") - 1) / stride)
    d = d.filter(first <= last).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("_at", F.col("_k") * stride)
    agg = d.groupBy(*KEYS, "_at").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("_n"), F.max(F.struct("i", "t")).alias("_e"), F.first("w").alias("w"))
    return agg.filter((F.col("_n") == F.col("w")) & (F.col("_e.i") == F.col("_at"))).select(*KEYS, F.col("_at").alias("i"), F.col("_e.t").alias("t"), "lo", "hi")


def rolling_metric(sig: DataFrame, points: int, how: str = "std") -> DataFrame:
    """A rolling metric with n = int(length / points) rows of one length for all series, at every n-th row; n = 0: sig."""
    longest = sig.agg(F.max("i")).first()[0]
    n = ((longest or 0) + 1) // points
    return sig if n == 0 else rolling(sig, n, how).filter(F.col("i") % n == 0)


def peak_rows(sig: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Row of the largest absolute value, the first on ties: (*by, peak_i, peak_t, peak)."""
    best = F.max(F.struct(F.abs("v").alias("a"), (-F.col("i")).alias("no"), F.col("t").alias("t")))
    return sig.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.no")).alias("peak_i"), F.col("b.t").alias("peak_t"), F.col("b.a").alias("peak"))


def around_peak(sig: DataFrame, num: int = 1000, leading_ratio: float = 0.5) -> DataFrame:
    """The num rows around the largest absolute value over all axes of a series, leading_ratio of them before it."""
    if num < 1 or not 0 <= leading_ratio <= 1:
        raise ValueError("num is positive and leading_ratio between 0 and 1")
    p = peak_rows(sig, ("series_id",))
    before = int(num * leading_ratio)
    lo, hi = F.col("peak_i") - before, F.col("peak_i") + (num - before)
    return sig.join(p, "series_id").filter((F.col("i") >= lo) & (F.col("i") < hi)).select(*_OUT)


def peak_windows(sig: DataFrame, margin: int, add_resultant: bool = True) -> DataFrame:
    """Each axis aligned on its own peak, offsets -margin .. margin + 1: (series_id, axis, peak_t, offset, offset_s, v)."""
    name = "Resultant"
    best = F.max(F.struct(F.abs("v").alias("a"), (-F.col("i")).alias("no"), F.col("t").alias("t")))
    p = axes_of(resultant(sig, name) if add_resultant else sig, b=best)
    p = p.select("series_id", F.col("axis").alias("_axis"), (-F.col("b.no")).alias("_i"), F.col("b.t").alias("peak_t"), "dt")
    whole = F.col("_axis") == name if add_resultant else F.lit(False)
    # only rows of the windows go on; those of the resultant's window from every axis
    d = sig.join(p, "series_id").filter((whole | F.col("axis").eqNullSafe(F.col("_axis"))) & (F.col("i") - F.col("_i")).between(-margin, margin + 1))
    g = d.groupBy("series_id", "_axis", "i", "_i", "peak_t", "dt").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"), F.first("v").alias("_v"))
    offset = F.col("i") - F.col("_i")
    return g.select("series_id", F.col("_axis").alias("axis"), "peak_t", offset.alias("offset"), (offset * F.col("dt")).alias("offset_s"), F.when(whole, F.col("_norm")).otherwise(F.col("_v")).alias("v"))


def local_maxima(sig: DataFrame, use_abs: bool = True) -> DataFrame:
    """Local maxima of the row-wise largest (absolute) value: (series_id, i, t, v); of a plateau its middle, never the ends."""
    value = F.max(F.abs("v") if use_abs else F.col("v"))
    d = sig.groupBy("series_id", "i").agg(F.first("t").alias("t"), value.alias("v"))
    w = Window.partitionBy("series_id").orderBy("i")
    # runs of equal values: a run higher than the runs on both sides is a maximum
    d = d.withColumn("_new", F.when(F.lag("v").over(w).eqNullSafe(F.col("v")), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(w))
    runs = d.groupBy("series_id", "_run").agg(F.first("v").alias("v"), F.min("i").alias("_a"), F.max("i").alias("_b"))
    r = Window.partitionBy("series_id").orderBy("_run")
    runs = runs.withColumns({"_l": F.lag("v").over(r), "_r": F.lead("v").over(r)}).filter("v > _l AND v > _r")
    at = runs.select("series_id", F.floor((F.col("_a") + F.col("_b")) / 2).alias("i"))
    return d.select("series_id", "i", "t", "v").join(at, ["series_id", "i"])


def find_peaks(sig: DataFrame, time_distance: float = 1.0, threshold: float | None = None, reference: str = "peak", multiplier: float = 0.1, use_abs: bool = True, add_resultant: bool = False) -> DataFrame:
    """Peaks at least a threshold high and time_distance apart, the tallest first: (series_id, i, t, v).

    threshold, or multiplier times the largest value (reference peak) or the RMS (reference rms) of the series.
    """
    if time_distance <= 0:
        raise ValueError("peaks are some time apart")
    d = resultant(sig) if add_resultant else sig
    top = local_maxima(d, use_abs)
    level = {"peak": F.max(F.abs("v") if use_abs else F.col("v")), "rms": F.sqrt(F.avg(F.col("v") * F.col("v")))}[reference]
    ref = d.groupBy("series_id").agg((level * multiplier).alias("_h") if threshold is None else F.lit(float(threshold)).alias("_h"))
    top = top.join(ref, "series_id").filter(F.col("v") >= F.col("_h")).join(spacing(sig).select("series_id", "dt"), "series_id")

    def spaced(table):
        import numpy as np

        i, v = np.array(table.column("i")), np.array(table.column("v"))
        gap = max(int(time_distance / table.column("dt")[0].as_py()), 1)
        order = np.argsort(i)
        rank = order[np.argsort(v[order], kind="stable")[::-1]]
        keep = np.ones(len(i), bool)
        sorted_i, place = i[order], np.empty(len(i), int)
        place[order] = np.arange(len(i))
        alive = np.ones(len(i), bool)
        for k in rank:
            p = place[k]
            if not alive[p]:
                continue
            lo, hi = np.searchsorted(sorted_i, [i[k] - gap + 1, i[k] + gap])
            alive[lo:hi] = False
            alive[p] = True
        keep[order] = alive
        return table.select(["series_id", "i", "t", "v"]).filter(keep)

    return top.select("series_id", "i", "t", "v", "dt").groupBy("series_id").applyInArrow(spaced, "series_id string, i long, t double, v double")


def slice_centres(sig: DataFrame, num_slices: int | None = None, indexes: Sequence[int] | None = None, values: Sequence[float] | None = None, slice_width: float | None = None) -> DataFrame:
    """(series_id, slice, centre, num, t): slice centres (even, given by row, or nearest to given times) and half width in rows.

    Without slice_width a slice is as wide as the series over the number of slices.
    """
    sp = known(spacing(sig))
    if values is not None:
        asked = sig.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "slice long, x double")
        times = sig.groupBy("series_id", "i").agg(F.first("t").alias("t"))
        near = times.crossJoin(F.broadcast(asked))  # the caller's list, stated in full
        best = near.groupBy("series_id", "slice").agg(F.min(F.struct(F.abs(F.col("t") - F.col("x")).alias("d"), "i")).alias("b"))
        c = best.select("series_id", "slice", F.col("b.i").alias("centre")).join(sp, "series_id")
        count = len(values)
    elif indexes is not None:
        c = sp.select("*", F.posexplode(F.array(*[F.lit(int(k)).cast("long") for k in indexes]))).withColumnsRenamed({"pos": "slice", "col": "centre"})
        count = len(indexes)
    else:
        count = num_slices or 100
        step = F.col("n") / count
        c = sp.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("centre", F.floor(step * (F.col("slice") + 0.5)).cast("long"))
    width = F.lit(float(slice_width)) if slice_width else F.col("n") * F.col("dt") / count
    c = c.withColumn("num", F.greatest(F.floor(width / F.col("dt") / 2), F.lit(1)).cast("long"))
    asked = known(c)
    at = sig.join(asked.select("series_id", F.col("centre").alias("i")).distinct(), ["series_id", "i"], "left_semi")
    t = at.groupBy("series_id", F.col("i").alias("centre")).agg(F.first("t").alias("slice_t"))
    return asked.join(t, ["series_id", "centre"]).select("series_id", F.col("slice").cast("long").alias("slice"), "centre", "num", "slice_t")


def sliced(sig: DataFrame, centres: DataFrame, block: int = 4096, extra: Sequence[str] = ()) -> DataFrame:
    """Samples of each slice: rows [centre - num, centre + num), clipped to the series; adds slice, slice_t and extra.

    A slice and a row meet in the blocks of rows they share, by equality, so no nested loop runs over them.
    """
    lo, hi = F.greatest(F.col("centre") - F.col("num"), F.lit(0)), F.col("centre") + F.col("num")
    c = centres.withColumns({"_lo": lo, "_hi": hi}).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
    d = sig.withColumn("_b", F.floor(F.col("i") / block)).join(known(c), ["series_id", "_b"]).filter("i >= _lo AND i < _hi")
    return d.select("series_id", "axis", "slice", "slice_t", "i", "t", "v", *extra)


def slice_metrics(sig: DataFrame, centres: DataFrame) -> DataFrame:
    d = sliced(sig, centres)
    v = F.col("v")
    return d.groupBy(*KEYS, "slice", "slice_t").agg(F.count(v).alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"))


def trimmed(sig: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows with start <= t <= end."""
    d = sig if start is None else sig.filter(F.col("t") >= start)
    return d if end is None else d.filter(F.col("t") <= end)


def trimmed_by_margin(sig: DataFrame, first: float = 0.0, last: float = 0.0) -> DataFrame:
    """sig without the samples of a duration at its ends, ceil(duration / dt) of them."""
    d = sig.join(spacing(sig), "series_id")
    lo, hi = F.ceil(F.lit(first) / F.col("dt")), F.col("n") - F.ceil(F.lit(last) / F.col("dt"))
    return d.filter((F.col("i") >= lo) & (F.col("i") < hi)).select(*_OUT)


def strip_invalid_prefix(sig: DataFrame, search: int = 1000) -> DataFrame:
    """Drops the start of a series up to two rows past its spike, if that is over twice the largest value after it."""
    head = sig.filter(F.col("i") < search).groupBy(*KEYS).agg(F.max(F.struct(F.abs("v").alias("a"), (-F.col("i")).alias("no"))).alias("h"))
    head = head.select(*KEYS, F.col("h.a").alias("_a"), (-F.col("h.no") + 2).alias("_cut"))
    d = sig.join(head, list(KEYS))
    rest = d.filter("i >= _cut").groupBy(*KEYS).agg(F.max(F.abs("v")).alias("_m"))
    return d.join(rest, list(KEYS), "left").filter(~F.coalesce((F.col("_a") > 2 * F.col("_m")) & (F.col("i") < F.col("_cut")), F.lit(False))).select(*_OUT)


def range_frame(df: DataFrame, key: str, ts: Column, value: str, width_us: int, how=F.avg) -> Column:
    """Aggregate of value over the time range (t - width, t], as a column."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(ts.cast("timestamp"))).rangeBetween(-width_us + 1, 0)
    return how(value).over(w)


def range_means(df: DataFrame, key: str, ts: Column, value: str, width_us: int, name: str = "mean") -> DataFrame:
    """df with the mean of value over (t - width, t] of its key, as range_frame, in time that does not grow with the frame.

    Time is cut into 64ths of the width, or as few equal parts as divide it. A frame is what its last part holds up to t,
    the sums of whole parts, and what its first part holds after t - width; rows go to the two parts where they count.
    """
    parts = next(n for n in (64, 60, 48, 32, 24, 16, 12, 8, 5, 4, 3, 2, 1) if width_us % n == 0)
    part = width_us // parts
    d = df.withColumn("_t", F.unix_micros(ts.cast("timestamp"))).withColumn("_c", F.floor(F.col("_t") / part))
    keys = [key, "_c"]
    totals = d.filter("_c IS NOT NULL").groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    between = Window.partitionBy(key).orderBy("_c").rangeBetween(-(parts - 1), -1)
    totals = totals.select(*keys, F.lit(2).alias("_kind"), F.sum("_s").over(between).alias("_ws"), F.sum("_n").over(between).alias("_wn"))
    v = F.col(value).cast("double")
    own = d.withColumns({"_kind": F.lit(0), "_own": v})
    gone = d.filter("_t IS NOT NULL").select(key, (F.col("_c") + parts).alias("_c"), (F.col("_t") + width_us).alias("_t"), F.lit(1).alias("_kind"), v.alias("_old"))
    every = own.unionByName(gone, allowMissingColumns=True).unionByName(totals, allowMissingColumns=True)
    group = Window.partitionBy(*keys)
    up = group.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = group.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    total = F.coalesce(F.sum("_own").over(up), zero) + F.coalesce(F.sum("_old").over(after), zero) + F.coalesce(F.max("_ws").over(group), zero)
    n = F.count("_own").over(up) + F.count("_old").over(after) + F.coalesce(F.max("_wn").over(group), F.lit(0))
    return every.withColumn(name, F.try_divide(total, n)).filter("_kind = 0").select(*df.columns, name)
