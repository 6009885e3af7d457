"""Joins of signals: nearest in time, intervals, alignment, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, meta: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """df with the columns of a table of one row per key; broadcast only if a count shows that it is small."""
    small = meta.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(meta) if small else meta, list(on), how)


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], t: str, values: Sequence[str], direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """left with values of the last right row at or before t (backward), the first at or after (forward), or the nearest.

    One union sorted by time within the keys: no row meets more than its neighbours. Equal times match; of nearest ties
    the earlier row wins.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("direction is backward, forward or nearest")
    pick = F.struct(F.col(t).alias("_t"), *values)
    kind = right.select(pick.alias("x")).schema["x"].dataType
    rest = [c for c in left.columns if c not in (*by, t)]
    a = left.select(*by, t, F.struct(*rest).alias("_l") if rest else F.lit(None).alias("_l"), F.lit(None).cast(kind).alias("_r"), F.lit(1).alias("_s"))
    b = right.select(*by, t, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), pick.alias("_r"), F.lit(0).alias("_s"))
    d = a.unionByName(b)
    back = Window.partitionBy(*by).orderBy(F.col(t), "_s").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(t).desc(), "_s").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_b": F.last("_r", ignorenulls=True).over(back), "_f": F.last("_r", ignorenulls=True).over(ahead)}).filter("_s = 1")
    db, df_ = F.col(t) - F.col("_b._t"), F.col("_f._t") - F.col(t)
    got = {"backward": F.col("_b"), "forward": F.col("_f"), "nearest": F.when(df_.isNull() | (db <= df_), F.col("_b")).otherwise(F.col("_f"))}[direction]
    d = d.withColumn("_g", got)
    if tolerance is not None:
        d = d.withColumn("_g", F.when(F.abs(F.col(t) - F.col("_g._t")) <= tolerance, F.col("_g")))
    return d.select(*by, t, *([f"_l.{c}" for c in rest] if rest else []), *[F.col(f"_g.{v}").alias(v) for v in values])


def aligned(frames: dict[str, DataFrame], on: Sequence[str], value: str = "value") -> DataFrame:
    """Columns of several long tables side by side, every key kept: one union and one pass instead of chained joins."""
    tagged = [d.select(*on, F.col(value).alias("_v"), F.lit(n).alias("_n")) for n, d in frames.items()]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    return every.groupBy(*on).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in frames])


def in_interval(points: DataFrame, intervals: DataFrame, t: str, lo: str, hi: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Points with the intervals [lo, hi) that hold them, by equality of time buckets of a width near the intervals'."""
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(i, [*by, "_b"]).filter((F.col(t) >= F.col(lo)) & (F.col(t) < F.col(hi))).drop("_b")


def bucket(value: Column, width: float) -> Column:
    return F.floor(value / width)
