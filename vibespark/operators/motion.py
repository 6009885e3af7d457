"""Integrals of signals chunk by chunk, each chunk starting from the motion at the end of the one before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CHUNK, KEYS, axes_of, in_order, known


def tapering(alpha: float) -> Column:
    """Tukey window at row i of n."""
    if alpha <= 0:
        return F.lit(1.0)
    a = min(alpha, 1.0)
    x = F.try_divide(F.least(F.col("i"), F.col("n") - 1 - F.col("i")), F.col("n") - 1)
    return F.when(x < a / 2, 0.5 * (1 - F.cos(2 * np.pi * x / a))).otherwise(1.0)


def _rows(sig: DataFrame, axes: DataFrame, value: Column, alpha: float, size: int, *extra: str) -> DataFrame:
    d = sig.join(axes, list(KEYS))
    w = [tapering(alpha).alias("w")] if alpha > 0 else []
    return d.select("_s", F.floor(F.col("i") / size).alias("_c"), "_g", "i", value.alias("v"), *w, *extra)


def _ends(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x))


def _steps(x: np.ndarray) -> np.ndarray:
    """Trapezoids between samples, 0 next to a missing one."""
    s = (x[1:] + x[:-1]) / 2
    return np.where(np.isnan(s), 0.0, s)


def _sum(s: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(s)])


def _parts(table, starts) -> Iterator[tuple]:
    """(first row, end, samples, window) of each axis of each chunk."""
    g, v = table.column("_g").to_numpy(), table.column("v").to_numpy()
    w = table.column("w").to_numpy() if "w" in table.column_names else None
    for lo, hi in zip(starts, starts[1:], strict=False):
        at = lo + _ends(g[lo:hi])
        for a, b in zip(at, at[1:], strict=False):
            yield a, b, v[a:b], np.ones(b - a) if w is None else w[a:b]


def _heads(rows: DataFrame) -> DataFrame:
    """(_s, _c, _g, _v, _x): first and second integral, for a spacing of 1, at the first sample of each chunk."""

    def ends(table, starts):
        import pyarrow as pa

        out = []
        for a, _, v, w in _parts(table, starts):
            u = v * w
            part = _sum(_steps(u))
            out.append((a, u[0], u[-1], part[-1], _steps(part * w).sum(), _steps(w).sum(), w[0], w[-1]))
        cols = list(zip(*out, strict=True))
        return table.select(["_s", "_c", "_g"]).take(pa.array(cols[0])).append_column("e", pa.array([list(x) for x in zip(*cols[1:], strict=True)], pa.list_(pa.float64())))

    def joined(table, starts):
        import pyarrow as pa

        e = np.array(table.column("e").to_pylist())
        out = np.zeros((len(e), 2))
        for lo, hi in zip(starts, starts[1:], strict=False):
            for k in range(lo + 1, hi):
                (v, x), (_, last, part, double, width, _, w) = out[k - 1], e[k - 1]
                x, v = x + double + v * width, v + part
                step = (last + e[k, 0]) / 2
                now = v + (0.0 if np.isnan(step) else step)
                out[k] = now, x + (v * w + now * e[k, 5]) / 2
        return table.select(["_s", "_c", "_g"]).append_column("_v", pa.array(out[:, 0])).append_column("_x", pa.array(out[:, 1]))

    d = in_order(rows, ["_s", "_c"], ["_g", "i"], ends, "_s long, _c long, _g long, e array<double>")
    return known(in_order(d, ["_g"], ["_c"], joined, "_s long, _c long, _g long, _v double, _x double"))


def _moved(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(table, [(first row, end, samples, window, first and second integral)] of each chunk) with the motion carried on."""
    d = rows.withColumns({"_v": F.lit(None).cast("double"), "_x": F.lit(None).cast("double")})
    d = d.unionByName(_heads(rows).withColumn("i", F.lit(-1).cast("long")), allowMissingColumns=True)

    def each(table, starts):
        head_v, head_x = table.column("_v").to_numpy(), table.column("_x").to_numpy()
        chunks, at = [], 0
        for a, b, v, w in _parts(table, starts):
            while a >= starts[at + 1]:
                at += 1
            while len(chunks) <= at:
                chunks.append([])
            u, w = v[1:] * w[1:], w[1:]
            first = head_v[a] + _sum(_steps(u))
            chunks[at].append((a + 1, b, v[1:], w, first, head_x[a] + _sum(_steps(first * w))))
        return run(table, chunks)

    return in_order(d, ["_s", "_c"], ["_g", "i"], each, schema)


def integrated(sig: DataFrame, size: int = CHUNK) -> DataFrame:
    """sig with first and second, its integrals from 0 by trapezoids of the average spacing: two readings of sig."""
    axes = axes_of(sig)

    def run(table, chunks):
        import pyarrow as pa

        parts = [p for c in chunks for p in c]
        at = pa.array(np.concatenate([np.arange(a, b) for a, b, *_ in parts]))
        made = table.select(["_g", "i", "t", "v"]).take(at)
        return made.append_column("first", pa.array(np.concatenate([p[4] for p in parts]))).append_column("second", pa.array(np.concatenate([p[5] for p in parts])))

    d = _moved(_rows(sig, axes, F.col("v"), 0.0, size, "t"), run, "_g long, i long, t double, v double, first double, second double").join(axes, "_g")
    dt = F.coalesce("dt", F.lit(0.0))
    return d.select(*KEYS, "i", "t", "v", (F.col("first") * dt).alias("first"), (F.col("second") * dt * dt).alias("second"))


def extremes(sig: DataFrame, axes: DataFrame, value: Column, alpha: float, skip: float, scale: float | None, resultant: bool, size: int = CHUNK) -> DataFrame:
    """(series_id, axis, name, peak, rms) of a value and, if scaled, of its integrals, tapered before each integration.

    Names: Acceleration, Velocity, Displacement. The RMS leaves out a share skip of the rows, half of it at each end.
    Resultant: of the norm of the axes at each row. The value is a column of sig and axes.
    """
    edge = F.floor(F.col("n") * skip / 2)
    inside = ((F.col("i") >= edge) & (F.col("i") < F.col("n") - edge)).alias("inside")
    rows = sig.join(axes, list(KEYS)).select("_s", F.floor(F.col("i") / size).alias("_c"), "_g", "i", value.alias("v"), tapering(alpha).alias("w"), inside, F.coalesce("dt", F.lit(0.0)).alias("dt"))

    def run(table, chunks):
        import pyarrow as pa

        out = []
        g, s, i, keep = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_s", "i", "inside"))
        dts = table.column("dt").to_numpy()
        for parts in chunks:
            if not parts:
                continue
            low = min(i[a] for a, *_ in parts)
            top = max(i[b - 1] for _, b, *_ in parts) - low + 1
            norms: dict = {}
            for a, b, v, _, first, second in parts:
                ok = keep[a:b].astype(bool)
                dt = dts[a]
                made = [("Acceleration", v)]
                if scale is not None:
                    made += [("Velocity", first * (scale * dt)), ("Displacement", second * (scale * dt * dt))]
                for name, x in made:
                    here = ~np.isnan(x)
                    x2 = np.where(here, x * x, 0.0)
                    n = int((here & ok).sum())
                    out.append((s[a], g[a], name, float(np.sqrt(x2.max())) if here.any() else None, float(x2[ok].sum()), n))
                    if resultant:
                        total, there, use = norms.setdefault(name, (np.zeros(top), np.zeros(top, bool), np.zeros(top, bool)))
                        at = i[a:b] - low
                        total[at] += x2
                        there[at] |= here
                        use[at] |= ok
            for name, (total, there, use) in norms.items():
                out.append((s[parts[0][0]], None, name, float(np.sqrt(total.max())) if there.any() else None, float(total[there & use].sum()), int((there & use).sum())))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_s", "_g", "name", "peak", "x2", "cnt"])

    def still(table, starts):
        parts = iter(_parts(table, starts))
        chunks: list = [[] for _ in starts[:-1]]
        at = 0
        for a, b, v, w in parts:
            while a >= starts[at + 1]:
                at += 1
            chunks[at].append((a, b, v, w, None, None))
        return run(table, chunks)

    schema = "_s long, _g long, name string, peak double, x2 double, cnt long"
    if scale is None:
        made = in_order(rows, ["_s", "_c"], ["_g", "i"], still, schema)
    else:
        made = _moved(rows, run, schema)
    made = made.groupBy("_s", "_g", "name").agg(F.max("peak").alias("peak"), F.sqrt(F.try_divide(F.sum("x2"), F.sum("cnt"))).alias("rms"))
    named = made.filter("_g IS NOT NULL").join(axes.select(*KEYS, "_g"), "_g").select(*KEYS, "name", "peak", "rms")
    whole = made.filter("_g IS NULL").join(axes.filter("_g = _s").select("series_id", F.col("_g").alias("_s")), "_s").select("series_id", F.lit("Resultant").alias("axis"), "name", "peak", "rms")
    return named.unionByName(whole)
