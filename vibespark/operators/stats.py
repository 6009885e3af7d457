"""Aggregates over signals: norms, RMS, peaks, metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS, known


def l2_norm(v: str = "v") -> Column:
    """Square root of the sum of squares, as an aggregate."""
    return F.sqrt(F.sum(F.col(v) * F.col(v)))


def max_abs(v: str = "v") -> Column:
    return F.greatest(F.max(v), -F.min(v))


def rms(v: str = "v") -> Column:
    return F.sqrt(F.avg(F.col(v) * F.col(v)))


def crest_factor(v: str = "v") -> Column:
    return F.try_divide(max_abs(v), F.stddev_samp(v))


def l2_of_columns(*cols: str | Column) -> Column:
    """Row-wise norm of columns."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sqrt(reduce(lambda a, b: a + b, [c * c for c in parts]))


def l2_of_array(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def resultant(sig: DataFrame, name: str = "Resultant", how: str = "l2") -> DataFrame:
    """sig with one more axis: at each i, the norm (l2) or the plain sum (sum) of the axes."""
    total = F.sqrt(F.sum(F.col("v") * F.col("v"))) if how == "l2" else F.sum("v")
    r = sig.groupBy("series_id", "i").agg(F.first("t").alias("t"), total.alias("v")).withColumn("axis", F.lit(name))
    return sig.select("series_id", "axis", "i", "t", "v").unionByName(r.select("series_id", "axis", "i", "t", "v"))


def rms_with_resultant(sig: DataFrame, scale: float = 1.0) -> DataFrame:
    """RMS per axis, and Resultant: the norm of the axes' RMS."""
    return norm_of_axes(sig.groupBy(*KEYS).agg((rms() * scale).alias("value")))


def norm_of_axes(per: DataFrame) -> DataFrame:
    """(series_id, axis, value) and Resultant: the norm of the axes' values."""
    per = known(per)
    total = per.groupBy("series_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value")).withColumn("axis", F.lit("Resultant"))
    return per.unionByName(total.select("series_id", "axis", "value"))


def peak_with_resultant(sig: DataFrame, scale: float = 1.0) -> DataFrame:
    """Largest absolute value per axis and of the resultant."""
    return resultant(sig).groupBy(*KEYS).agg((max_abs() * scale).alias("value"))


def remove_offset(sig: DataFrame, how: str | None = "mean") -> DataFrame:
    """sig less its first value (start), mean or median; how None leaves it."""
    if how is None:
        return sig
    return sig.join(known(offsets(sig, how)), list(KEYS)).withColumn("v", F.col("v") - F.col("_level")).drop("_level")


def offsets(sig: DataFrame, how: str) -> DataFrame:
    """(series_id, axis, _level): first value (start), mean or median by axis."""
    if how == "median":
        return medians(sig)
    level = {"start": F.min_by("v", "i"), "mean": F.avg("v")}[how]
    return sig.groupBy(*KEYS).agg(level.alias("_level"))


def near_median() -> Column:
    """Two values that the median lies between, an aggregate."""
    return F.percentile_approx("v", [0.4997, 0.5003], 10000)


def medians(sig: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(series_id, axis, _level): exact medians. A sketch (near, by axis, if known) tells between which values a median
    lies; then the rows of each of the few values there are counted, and those below. No task holds the values of an axis."""
    near = known(sig.groupBy(*KEYS).agg(near_median().alias("near"))) if near is None else near
    near = near.select(*KEYS, F.col("near")[0].alias("_lo"), F.col("near")[1].alias("_hi"))
    d = sig.join(near, list(KEYS)).filter("v IS NOT NULL")
    at = F.when(F.col("v") < F.col("_lo"), F.col("_lo")).when(F.col("v") > F.col("_hi"), F.col("_hi")).otherwise(F.col("v"))
    side = F.when(F.col("v") < F.col("_lo"), -1).when(F.col("v") > F.col("_hi"), 1).otherwise(0)
    some = d.groupBy(*KEYS, side.alias("_side"), at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*KEYS)
    some = some.withColumns({"_end": F.sum("_n").over(w.orderBy("_side", "_at")), "_all": F.sum("_n").over(w)})
    place = lambda r: F.max(F.when((F.col("_end") - F.col("_n") <= r) & (r < F.col("_end")), F.col("_at")))
    return some.groupBy(*KEYS).agg(((place(F.floor((F.col("_all") - 1) / 2)) + place(F.floor(F.col("_all") / 2))) / 2).alias("_level"))


def rms_inside(sig: DataFrame, skip: float) -> DataFrame:
    """RMS per axis without the first and last share ``skip / 2`` of samples (where a taper bends them)."""
    n = F.max("i").over(Window.partitionBy("series_id")) + 1
    edge = F.floor(n * skip / 2)
    d = sig.withColumns({"_n": n, "_e": edge}).filter((F.col("i") >= F.col("_e")) & (F.col("i") < F.col("_n") - F.col("_e")))
    return d.groupBy(*KEYS).agg(rms().alias("value"))


def describe(sig: DataFrame) -> DataFrame:
    return sig.groupBy(*KEYS).agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
        *[F.percentile("v", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max("v").alias("max"),
    )


def last_fix(gps: DataFrame, lat: str = "lat", lon: str = "lon", at: str = "t", by: str = "series_id") -> DataFrame:
    """Last position whose coordinates are both non-zero (zero: no lock)."""
    ok = (F.col(lat) != 0) & (F.col(lon) != 0)
    d = gps.groupBy(by).agg(F.max_by(F.when(ok, F.struct(lat, lon)), F.when(ok, F.col(at))).alias("fix"))
    return d.select(by, F.col("fix")[lat].alias(lat), F.col("fix")[lon].alias(lon))


def mean_speed_kmh(gps: DataFrame, speed: str = "speed", by: str = "series_id") -> DataFrame:
    return gps.groupBy(by).agg((F.avg(F.when(F.col(speed) != 0, F.col(speed))) * 3.6).alias("value"))


def pick(names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Names to compute: those included, or all but those excluded (not both), without regard to case."""
    if include and exclude:
        raise ValueError("give include or exclude, not both")
    low = {n.lower(): n for n in names}
    unknown = [x for x in [*include, *exclude] if x.lower() not in low]
    if unknown:
        raise ValueError(f"unknown names: {unknown}")
    if include:
        return [low[x.lower()] for x in include]
    gone = {x.lower() for x in exclude}
    return [n for n in names if n.lower() not in gone]


def count_tags(files: DataFrame, tags: str = "tags", name: str = "file_name") -> DataFrame:
    """(tag, n, files): number and quoted list of the files with each tag."""
    d = files.select(F.explode(tags).alias("tag"), name)
    quoted = F.transform(F.array_sort(F.collect_list(name)), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return d.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.array_join(quoted, ", ").alias("files"))


def first_per_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position; null and empty keys are dropped."""
    d = rows.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return d.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("_r")).select(key, "_r.*")


def aggregate_with(sig: DataFrame, fn: Callable, name: str = "value") -> DataFrame:
    """An own aggregate: fn gives a Column of v, or takes the values of a group as a NumPy array and returns a number."""
    made = None
    try:
        made = fn(F.col("v"))
    except TypeError:
        made = None
    if isinstance(made, Column):
        return sig.groupBy(*KEYS).agg(made.alias(name))

    def run(table):
        import numpy as np
        import pyarrow as pa

        ids = [table.column(k)[0].as_py() for k in KEYS]
        return pa.table([pa.array([x]) for x in ids] + [pa.array([float(fn(np.array(table.column("v"))))])], names=[*KEYS, name])

    return sig.select(*KEYS, "v").groupBy(*KEYS).applyInArrow(run, f"series_id string, axis string, {name} double")
