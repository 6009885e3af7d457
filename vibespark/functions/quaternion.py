"""Quaternion algebra on struct<w,x,y,z> columns, rotations and directions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHUNK, numbered

AXES = {"roll": "x", "pitch": "y", "yaw": "z", "x": "x", "y": "y", "z": "z"}


def quat(w, x, y, z) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in (w, x, y, z)]
    return F.struct(*[c.cast("double").alias(n) for n, c in zip("wxyz", cols, strict=True)])


def mul(a: Column, b: Column) -> Column:
    """Hamilton product."""
    w, x, y, z = (a[k] for k in "wxyz")
    p, q, r, s = (b[k] for k in "wxyz")
    return quat(w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p)


def conj(a: Column) -> Column:
    return quat(a["w"], -a["x"], -a["y"], -a["z"])


def norm2(a: Column) -> Column:
    return a["w"] * a["w"] + a["x"] * a["x"] + a["y"] * a["y"] + a["z"] * a["z"]


def inv(a: Column) -> Column:
    """Conjugate over squared norm; null components for a zero quaternion."""
    n = norm2(a)
    return quat(F.try_divide(a["w"], n), F.try_divide(-a["x"], n), F.try_divide(-a["y"], n), F.try_divide(-a["z"], n))


def div(a: Column, b: Column) -> Column:
    return mul(a, inv(b))


def euler_order(mode: str) -> str:
    """Axis letters of a mode such as xyz, x-y-z or roll pitch yaw; three different ones, or the first again at the end."""
    low = mode.lower()
    names = list(low) if re.fullmatch("[xyz]{3}", low) else re.split(r"[ _-]+", low)
    if len(names) != 3 or any(n not in AXES for n in names):
        raise ValueError(f"invalid Euler mode {mode!r}")
    order = "".join(AXES[n] for n in names)
    if len(set(order)) == 3 or (order[0] == order[2] != order[1]):
        return order
    raise ValueError(f"invalid Euler mode {mode!r}")


def to_euler(q: Column, mode: str = "x-y-z") -> list[Column]:
    """Extrinsic Euler angles in radians of a quaternion, in the order of mode; in gimbal lock the third is 0."""
    order = euler_order(mode)
    i, j, k = ("xyz".index(c) for c in order)
    proper = i == k
    if proper:
        k = 3 - i - j
    sign = (i - j) * (j - k) * (k - i) / 2
    v = [q["x"], q["y"], q["z"]]
    w = q["w"]
    if proper:
        a, b, c, d = w, v[i], v[j], v[k] * sign
    else:
        a, b, c, d = w - v[j], v[i] + v[k] * sign, v[j] + w, v[k] * sign - v[i]
    second = 2 * F.atan2(F.hypot(c, d), F.hypot(a, b))
    half_sum, half_diff = F.atan2(b, a), F.atan2(d, c)
    low, high = F.abs(second) < 1e-7, F.abs(second - math.pi) < 1e-7
    first = F.when(low, 2 * half_sum).when(high, -2 * half_diff).otherwise(half_sum - half_diff)
    third = F.when(low | high, 0.0).otherwise(half_sum + half_diff)
    if not proper:
        third, second = third * sign, second - math.pi / 2
    turn = lambda x: F.when(x < -math.pi, x + 2 * math.pi).when(x > math.pi, x - 2 * math.pi).otherwise(x)
    return [turn(first), second, turn(third)]


def quaternion_to_euler(df: DataFrame, mode: str = "x-y-z", x="X", y="Y", z="Z", w="W") -> DataFrame:
    """df with the angles of its quaternion as columns named by the parts of mode."""
    names = re.split(r"[ _-]+", mode) if re.search(r"[ _-]", mode) else list(mode)
    angles = to_euler(quat(w, x, y, z), mode)
    names = [n if names.count(n) == 1 else f"{n}{k}" for k, n in enumerate(names)]
    return df.select("*", *[a.alias(n) for a, n in zip(angles, names, strict=True)])


def angular_velocity(df: DataFrame, q: str = "q", dt: float = 1.0, key: str = "series_id", order: str = "i") -> DataFrame:
    """df with wx, wy, wz: the vector part of 2 (dq/dt) / q; differences of second order, one-sided at the ends."""
    w = Window.partitionBy(key, "_chunk").orderBy("_no")

    def rate(c: str) -> Column:
        f = F.col(q)[c]
        a1, a2, b1, b2 = F.lead(f).over(w), F.lead(f, 2).over(w), F.lag(f).over(w), F.lag(f, 2).over(w)
        return F.when(b1.isNull(), (-1.5 * f + 2 * a1 - 0.5 * a2) / dt).when(a1.isNull(), (1.5 * f - 2 * b1 + 0.5 * b2) / dt).otherwise((a1 - b1) / (2 * dt))

    # chunks with two rows before and after them; i numbers the rows already
    n = df.withColumn("_no", F.col("i")) if order == "i" else numbered(df, key, [order], "_no")
    first, last = (F.floor(F.greatest(F.col("_no") + k, F.lit(0)) / CHUNK) for k in (-2, 2))
    n = n.withColumn("_chunk", F.explode(F.sequence(first, last)))
    d = n.withColumn("_dq", quat(*[rate(c) for c in "wxyz"])).filter(F.col("_chunk") == F.floor(F.col("_no") / CHUNK))
    o = div(F.col("_dq"), F.col(q))
    return d.select(*df.columns, (2 * o["x"]).alias("wx"), (2 * o["y"]).alias("wy"), (2 * o["z"]).alias("wz"))


def slerp(a: Column, b: Column, u: Column) -> Column:
    """Unit quaternion on the short arc from a to b at share u."""
    dot = a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    s = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    near = angle < 1e-9
    ka = F.when(near, 1 - u).otherwise(F.sin((1 - u) * angle) / F.sin(F.when(near, 1.0).otherwise(angle)))
    kb = s * F.when(near, u).otherwise(F.sin(u * angle) / F.sin(F.when(near, 1.0).otherwise(angle)))
    return quat(*[ka * a[c] + kb * b[c] for c in "wxyz"])


def resample_quaternions(df: DataFrame, rate: float = 6.0, q: str = "q", key: str = "series_id", t: str = "t") -> DataFrame:
    """(key, frame, t, q, and the turned unit axes) at a frame rate, between bracketing samples."""
    w = Window.partitionBy(key).orderBy(t)
    start = df.groupBy(key).agg(F.min(t).alias("_t0"))
    d = df.withColumns({"_t1": F.lead(t).over(w), "_q1": F.lead(q).over(w)}).join(start, key)
    first, last = F.ceil((F.col(t) - F.col("_t0")) * rate), F.ceil((F.coalesce("_t1", F.col(t) + 1e-9) - F.col("_t0")) * rate) - 1
    d = d.filter(first <= last).withColumn("frame", F.explode(F.sequence(first, last))).withColumn("_t", F.col("_t0") + F.col("frame") / rate)
    u = F.coalesce(F.try_divide(F.col("_t") - F.col(t), F.col("_t1") - F.col(t)), F.lit(0.0))
    d = d.withColumn("_q", slerp(F.col(q), F.coalesce("_q1", q), u))
    out = [key, "frame", F.col("_t").alias("t"), F.col("_q").alias("q")]
    for name, v in (("ex", (1, 0, 0)), ("ey", (0, 1, 0)), ("ez", (0, 0, 1))):
        r = mul(mul(F.col("_q"), quat(*[F.lit(float(c)) for c in (0, *v)])), conj(F.col("_q")))
        out.append(F.struct(r["x"].alias("x"), r["y"].alias("y"), r["z"].alias("z")).alias(name))
    return d.select(*out)


def centre_of_coordinates(lat: str = "lat", lon: str = "lon") -> Column:
    """Mean direction of points as struct<lat, lon> in degrees, an aggregate; latitude is the azimuth of the sphere here."""
    a, e = F.radians(lat), F.radians(lon)
    x, y, z = F.avg(F.cos(a) * F.cos(e)), F.avg(F.sin(a) * F.cos(e)), F.avg(F.sin(e))
    return F.struct(F.degrees(F.atan2(y, x)).alias("lat"), F.degrees(F.atan2(z, F.hypot(x, y))).alias("lon"))


def map_zoom(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, width_to_height: float = 2.0, margin: float = 1.2) -> Column:
    """Zoom level, to 2 places, at which the extent fits a map: level 1 shows 360 degrees, each further one up to 20 half as
    many, and an extent between two levels lies between them in proportion to its degrees."""
    span = F.greatest((lon_max - lon_min) * margin, (lat_max - lat_min) * margin * width_to_height)
    span = F.least(F.greatest(span, F.lit(360 / 2.0**19)), F.lit(360.0))
    level = F.floor(F.log2(F.lit(360.0) / span) + 1e-12)
    shown = F.lit(360.0) / F.pow(F.lit(2.0), level)
    return F.round(level + 1 + (shown - span) / (shown / 2), 2)
