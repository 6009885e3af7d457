"""Registered queries of filters, spectra over time, shock spectra, batch channels and sentences, with their SQL.

The SQL takes other ways than the operators: filters as second-order sections of closed-form prototypes, shock spectra by
the exact motion of an oscillator under straight lines between samples, transforms as plain sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import quaternion as qn
from .operators import filters, multivariate, shock, spectral
from .plans import batch
from .roster import PK, R6, SIG, TRI, _events, _packed, _recordings, _t, _tri, query
from .sources import catalog, logs

# ---- filters -----------------------------------------------------------------------------------------------------


def _zero_phase(n: tuple[str, str], d: tuple[str, str, str], freq: float, highpass: bool) -> str:
    """SQL of a second-order filter, forward and backward after an odd extension by nine samples, over packed recordings.

    (n2 s^2 + n0) / (d2 s^2 + d1 s + d0) is the prototype with cutoff 1 rad/s; a high pass has 1/s for s.
    """
    n2, n0 = n[::-1] if highpass else n
    d2, d1, d0 = d[::-1] if highpass else d
    run = lambda name, src: f"""{name} AS (SELECT series_id, 0 AS j, b0 * v + (g - b0) * v AS y, b1 * v - a1 * g * v + (b2 - a2 * g) * v AS z1, b2 * v - a2 * g * v AS z2 FROM {src}, k WHERE j = 0
UNION ALL SELECT r.series_id, r.j + 1, b0 * v + z1, b1 * v - a1 * (b0 * v + z1) + z2, b2 * v - a2 * (b0 * v + z1) FROM {name} r JOIN {src} x ON x.series_id = r.series_id AND x.j = r.j + 1, k)"""  # noqa: E731
    return f"""WITH RECURSIVE {PK}, o AS (SELECT CAST({n2} AS DOUBLE) AS n2, CAST({n0} AS DOUBLE) AS n0, CAST({d2} AS DOUBLE) AS d2, CAST({d1} AS DOUBLE) AS d1, CAST({d0} AS DOUBLE) AS d0, 1 / tan(pi() * {freq} / 64) AS c),
k0 AS (SELECT (n2*c*c + n0) / a AS b0, 2 * (n0 - n2*c*c) / a AS b1, (n2*c*c + n0) / a AS b2, 2 * (d0 - d2*c*c) / a AS a1, (d2*c*c - d1*c + d0) / a AS a2 FROM (SELECT *, d2*c*c + d1*c + d0 AS a FROM o)),
k AS (SELECT *, (b0 + b1 + b2) / (1 + a1 + a2) AS g FROM k0), ends AS (SELECT series_id, min_by(v, i) AS v0, max_by(v, i) AS v1 FROM pk GROUP BY 1),
e AS (SELECT series_id, i + 9 AS j, v FROM pk UNION ALL SELECT series_id, 9 - i, 2 * v0 - v FROM pk JOIN ends USING (series_id) WHERE i BETWEEN 1 AND 9
UNION ALL SELECT series_id, 63 + 9 + (63 - i), 2 * v1 - v FROM pk JOIN ends USING (series_id) WHERE i BETWEEN 54 AND 62),
{run("f", "e")}, back AS (SELECT series_id, 81 - j AS j, y AS v FROM f), {run("b", "back")}
SELECT series_id, CAST(81 - j - 9 AS BIGINT) AS i, round(y, 6) + 0.0 AS v FROM b WHERE 81 - j - 9 BETWEEN 0 AND 63"""


_E = "sqrt(pow(10, 0.3) - 1)"  # ripple of 3 dB
_S = "(1 / sqrt(pow(10, 3.0) - 1))"  # stop band of 30 dB
_T = f"((1 / {_S} / {_E} - 1) / (1 / {_S} / {_E} + 1))"
_V = lambda d: d.select("series_id", "i", R6("v").alias("v"))


@query(_zero_phase(("0", "1"), ("1", "sqrt(2)", "1"), 4.0, True))
def butterworth_highpass(spark, sf):
    return _V(filters.butterworth(_packed(spark, sf), 4.0, None, 2))


@query(_zero_phase(("0", "3"), ("(sqrt(45) - 3) / 2", "3 * sqrt((sqrt(45) - 3) / 2)", "3"), 6.0, False))
def bessel_lowpass(spark, sf):
    return _V(filters.bessel(_packed(spark, sf), None, 6.0, 2))


@query(_zero_phase(("0", "1"), (f"2 * {_E}", f"sqrt(4 * {_E} * sqrt(1 + {_E} * {_E}) - 4 * {_E} * {_E})", f"sqrt(1 + {_E} * {_E})"), 8.0, False))
def cheby1_lowpass(spark, sf):
    return _V(filters.cheby1(_packed(spark, sf), None, 8.0, 2))


@query(_zero_phase((_S, f"2 * {_S}"), (f"sqrt(1 + {_S} * {_S})", f"sqrt(4 * {_S} * sqrt(1 + {_S} * {_S}) - 4 * {_S} * {_S})", f"2 * {_S}"), 3.0, True))
def cheby2_highpass(spark, sf):
    return _V(filters.cheby2(_packed(spark, sf), 3.0, None, 2))


_ED2, _ED0 = f"sqrt(pow(1 - {_T}, 2) + pow({_E} * (1 + {_T}), 2))", f"sqrt(1 + {_E} * {_E})"


@query(_zero_phase((f"1 - {_T}", "1"), (_ED2, f"sqrt(2 * {_ED2} * {_ED0} - 2 * (1 - {_T}) - 2 * {_E} * {_E} * (1 + {_T}))", _ED0), 9.0, False))
def ellip_lowpass(spark, sf):
    return _V(filters.ellip(_packed(spark, sf), None, 9.0, 2))


@query(f"""WITH {SIG}, n AS (SELECT series_id, max(i) + 1 AS n FROM sig GROUP BY 1), x AS (SELECT *, least(i, n - 1 - i) / nullif(n - 1, 0) AS x FROM sig JOIN n USING (series_id))
SELECT series_id, i, round(v * CASE WHEN x < 0.2 THEN 0.5 * (1 - cos(2 * pi() * x / 0.4)) ELSE 1 END, 6) + 0.0 AS v FROM x""")
def tukey_taper(spark, sf):
    return _V(filters.taper(_events(spark, sf), 0.4))


@query(f"""WITH {PK}, k AS (SELECT m, n, (1 + list_sum(list_transform(range(1, 32), lambda q: 2 * cos(2 * pi() * q * (m / 96.0 - n / 64.0)))) + cos(2 * pi() * 32 * m / 96.0) * cos(pi() * n)) / 64 AS w FROM range(96) a(m), range(64) b(n))
SELECT series_id, CAST(m AS BIGINT) AS i, round(m / 96.0, 6) AS t, round(sum(v * w), 5) + 0.0 AS v FROM pk JOIN k ON i = n GROUP BY series_id, m""")
def resample_up(spark, sf):
    return filters.resample(_packed(spark, sf), 96.0).select("series_id", "i", R6("t").alias("t"), R6("v", 5).alias("v"))


# ---- spectra over time -------------------------------------------------------------------------------------------

_BOTH = "(VALUES ('v'), ('Resultant')) x(axis)"


@query(f"""WITH {PK}, g AS (SELECT series_id, s, i - s * 16 AS j, v FROM pk, range(4) r(s) WHERE i >= s * 16 AND i < s * 16 + 16), m AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id, s) AS x FROM g), k AS (SELECT k FROM range(9) r(k)),
f AS (SELECT series_id, s, k, sum(x * cos(2 * pi() * k * j / 16)) AS re, sum(x * sin(2 * pi() * k * j / 16)) AS im FROM m, k GROUP BY 1, 2, 3)
SELECT series_id, axis, CAST(k * 4 AS DOUBLE) AS freq, round(CAST(s AS DOUBLE) / 4 + 0.125, 6) AS timestamp, round(sqrt(2 * 4 * (re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / 64 / 16), 6) + 0.0 AS value FROM f, {_BOTH}""")
def rolling_fft(spark, sf):
    d = spectral.rolling_fft(_packed(spark, sf), 4.0, 4)
    return d.select("series_id", "axis", R6("freq").alias("freq"), R6("timestamp").alias("timestamp"), R6("value").alias("value"))


@query(f"""WITH {PK}, c AS (SELECT s, greatest(s * 16 + 8 - 16, 0) AS lo, least(s * 16 + 8 + 16, 64) AS hi FROM range(4) r(s)), w AS (SELECT s, q, lo + q * 8 AS a FROM c, range(4) r(q) WHERE lo + q * 8 + 16 <= hi),
g AS (SELECT series_id, s, q, i - a AS j, v - avg(v) OVER (PARTITION BY series_id, s, q) AS x FROM pk JOIN w ON i >= a AND i < a + 16), k AS (SELECT k FROM range(9) r(k)),
f AS (SELECT series_id, s, q, k, sum(x * h * cos(2 * pi() * k * j / 16)) AS re, sum(x * h * sin(2 * pi() * k * j / 16)) AS im FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS h FROM g), k GROUP BY 1, 2, 3, 4),
p AS (SELECT series_id, s, k * 4 AS freq, avg((re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / 64 / 6) AS p FROM f GROUP BY 1, 2, 3),
b AS (SELECT n, pow(2, n / 3.0) AS c FROM range(16) r(n)), cells AS (SELECT DISTINCT series_id, s FROM p)
SELECT cells.series_id, axis, round(c, 6) AS freq, round((cells.s * 16 + 8) / 64.0, 6) AS timestamp, round(coalesce(avg(p.p), 0), 6) + 0.0 AS value FROM cells CROSS JOIN b CROSS JOIN {_BOTH}
LEFT JOIN p ON p.series_id = cells.series_id AND p.s = cells.s AND p.freq >= c / pow(2, 1 / 6.0) AND p.freq < c * pow(2, 1 / 6.0) GROUP BY 1, 2, 3, 4""")
def rolling_psd(spark, sf):
    d = spectral.rolling_psd(_packed(spark, sf), 4.0, 4, slice_width=0.5, octave=3.0)
    return d.select("series_id", "axis", R6("freq").alias("freq"), R6("timestamp").alias("timestamp"), R6(F.coalesce("value", F.lit(0.0))).alias("value"))


@query(f"""WITH {PK}, g AS (SELECT series_id, s, i - s * 8 AS j, v - avg(v) OVER (PARTITION BY series_id, s) AS x FROM pk JOIN range(2) r(s) ON i >= s * 8 AND i < s * 8 + 56), k AS (SELECT k FROM range(29) r(k)),
f AS (SELECT series_id, s, k, sum(x * h * cos(2 * pi() * k * j / 56)) AS re, sum(x * h * sin(2 * pi() * k * j / 56)) AS im FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 56) AS h FROM g), k GROUP BY 1, 2, 3),
p AS (SELECT series_id, s, k * 64 / 56.0 AS freq, (re * re + im * im) * CASE WHEN k IN (0, 28) THEN 1 ELSE 2 END / 64 / 21 AS p FROM f), b AS (SELECT 8 * pow(2, n) AS c FROM range(3) r(n))
SELECT series_id, CAST(c AS DOUBLE) AS freq, round(s / 8.0 + 56 / 128.0, 6) AS timestamp, round(10 * log10(sum(p)), 5) AS value FROM p JOIN b ON freq >= c / sqrt(2) AND freq < c * sqrt(2) GROUP BY 1, 2, 3""")
def octave_spectrogram(spark, sf):
    d = spectral.octave_spectrogram(_packed(spark, sf), 0.5, 1, 8.0)
    return d.select("series_id", R6("freq").alias("freq"), R6("timestamp").alias("timestamp"), R6("value", 5).alias("value"))


# ---- shock spectra -----------------------------------------------------------------------------------------------


def _motion(freqs: str, recordings: str, tail: int, out: str) -> str:
    """SQL of oscillators of damping 0.05 at rest, driven by recordings (series_id, s, i, v) and ``tail`` zeros after them.

    Between samples 1/64 s apart the drive is a straight line, under which the motion (z, u) is known in closed form.
    """
    w, h = "2 * pi() * freq", "0.05"
    step = f"""SELECT series_id, s, freq, i, ex * (qa * co + qb * si) - v / (w * w) + 2 * {h} * m / (w * w * w) AS z, ex * ((wd * qb - {h} * w * qa) * co - ({h} * w * qb + wd * qa) * si) - m / (w * w) AS u FROM
(SELECT *, (u + m / (w * w) + {h} * w * qa) / wd AS qb FROM (SELECT *, z + p / (w * w) - 2 * {h} * m / (w * w * w) AS qa FROM (%s)))"""
    cols = "x.series_id, x.s, k.freq, x.i, x.v, x.p, (x.v - x.p) * 64 AS m, k.w, k.wd, k.ex, k.co, k.si"
    return f"""WITH RECURSIVE {PK}, rec AS ({recordings}), len AS (SELECT series_id, s, max(i) + 1 AS n FROM rec GROUP BY 1, 2),
x0 AS (SELECT series_id, s, i, v FROM rec UNION ALL SELECT series_id, s, n + q, 0.0 FROM len, range({tail}) r(q)), x AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY series_id, s ORDER BY i), 0) AS p FROM x0),
k AS (SELECT freq, w, wd, exp(-{h} * w / 64) AS ex, cos(wd / 64) AS co, sin(wd / 64) AS si FROM (SELECT freq, {w} AS w, {w} * sqrt(1 - {h} * {h}) AS wd FROM ({freqs}))),
r AS ({step % f"SELECT {cols}, 0.0 AS z, 0.0 AS u FROM x, k WHERE x.i = 0"} UNION ALL {step % f"SELECT {cols}, r.z, r.u FROM r JOIN x ON x.series_id = r.series_id AND x.s = r.s AND x.i = r.i + 1 JOIN k ON k.freq = r.freq"})
{out}"""


_WHOLE = "SELECT series_id, 0 AS s, i, v FROM pk"


@query(_motion("SELECT pow(2, n / 3.0) AS freq FROM range(15) q(n)", _WHOLE, 33, "SELECT series_id, 'v' AS axis, round(freq, 6) AS freq, round(max(abs(pow(2 * pi() * freq, 2) * z + 0.1 * 2 * pi() * freq * u)), 5) AS value FROM r GROUP BY series_id, r.freq"))
def srs(spark, sf):
    return shock.shock_spectrum(_packed(spark, sf), None, 1.0, 3.0).select("series_id", "axis", R6("freq").alias("freq"), R6("value", 5).alias("value"))


@query(_motion("SELECT unnest([2.0, 5.0, 11.0])::DOUBLE AS freq", _WHOLE, 33, "SELECT series_id, 'v' AS axis, freq, round(max(2 * pi() * freq * z), 6) + 0.0 AS value, round(-min(2 * pi() * freq * z), 6) + 0.0 AS negative FROM r GROUP BY series_id, freq"))
def pvss_two_sided(spark, sf):
    d = shock.shock_spectrum(_packed(spark, sf), [2.0, 5.0, 11.0], mode="pvss", two_sided=True)
    return d.select("series_id", "axis", "freq", R6("value").alias("value"), R6("negative").alias("negative"))


@query(_motion("SELECT unnest([4.0, 9.0])::DOUBLE AS freq", "SELECT series_id, i // 32 AS s, i % 32 AS i, v FROM pk", 9, f"SELECT series_id, axis, freq, round((s * 32 + 16) / 64.0, 6) AS timestamp, round(max(abs(2 * pi() * freq * z)), 6) + 0.0 AS value FROM r, {_BOTH} GROUP BY series_id, axis, freq, s"))
def rolling_shock_spectrum(spark, sf):
    d = shock.rolling_shock_spectrum(_packed(spark, sf), 2, freqs=[4.0, 9.0], mode="pvss")
    return d.select("series_id", "axis", "freq", R6("timestamp").alias("timestamp"), R6("value").alias("value"))


# ---- orientation and components ----------------------------------------------------------------------------------

_SLOPE = "CASE WHEN i = 0 THEN (-1.5 * {c} + 2 * lead({c}) OVER o - 0.5 * lead({c}, 2) OVER o) / 0.01 WHEN lead({c}) OVER o IS NULL THEN (1.5 * {c} - 2 * lag({c}) OVER o + 0.5 * lag({c}, 2) OVER o) / 0.01 ELSE (lead({c}) OVER o - lag({c}) OVER o) / 0.02 END"


@query(f"""WITH {TRI}, d AS (SELECT series_id, i, l_quantity AS w, l_discount AS x, 0.5 AS y, 0.25 AS z, {_SLOPE.format(c="l_quantity")} AS dw, {_SLOPE.format(c="l_discount")} AS dx FROM tri0 WINDOW o AS (PARTITION BY series_id ORDER BY i))
SELECT series_id, i, round(2 * (dx * w - dw * x) / s, 5) + 0.0 AS wx, round(2 * (dx * z - dw * y) / s, 5) + 0.0 AS wy, round(2 * (-dx * y - dw * z) / s, 5) + 0.0 AS wz FROM (SELECT *, w*w + x*x + y*y + z*z AS s FROM d)""")
def quat_to_angvel(spark, sf):
    d = _tri(spark, sf).groupBy("series_id", "i").pivot("axis", ["l_quantity", "l_discount"]).agg(F.first("v"))
    q = d.select("series_id", "i", qn.quat("l_quantity", "l_discount", F.lit(0.5), F.lit(0.25)).alias("q"))
    return qn.angular_velocity(q, dt=0.01).select("series_id", "i", *[R6(c, 5).alias(c) for c in ("wx", "wy", "wz")])


@query("""WITH m AS (SELECT avg(p_size) AS ms, stddev_samp(p_size) AS ss, avg(p_retailprice) AS mp, stddev_samp(p_retailprice) AS sp, corr(p_size, p_retailprice) AS r FROM part),
z AS (SELECT p_partkey, abs((p_size - ms) / ss + (p_retailprice - mp) / sp) / sqrt(2) AS a, abs((p_size - ms) / ss - (p_retailprice - mp) / sp) / sqrt(2) AS b, r FROM part, m)
SELECT p_partkey, round(CASE WHEN r > 0 THEN a ELSE b END, 6) + 0.0 AS pc1, round(CASE WHEN r > 0 THEN b ELSE a END, 6) + 0.0 AS pc2 FROM z""")
def pca_2d(spark, sf):
    """Sizes of the components: their signs are free where both loadings are equally large."""
    d = multivariate.pca(_t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), skip=("p_partkey",))
    return d.select("p_partkey", R6(F.abs("pc1")).alias("pc1"), R6(F.abs("pc2")).alias("pc2"))


# ---- batch -------------------------------------------------------------------------------------------------------


@query(f"""WITH {TRI}, n AS (SELECT series_id, max(i) + 1 AS n FROM tri0 GROUP BY 1), g AS (SELECT series_id, axis, q, i - q * 50 AS j, v - avg(v) OVER (PARTITION BY series_id, axis, q) AS x FROM (SELECT tri.*, unnest([i // 50, i // 50 - 1]) AS q FROM tri) JOIN n USING (series_id) WHERE q >= 0 AND q * 50 + 100 <= n),
f AS (SELECT series_id, axis, q, k, sum(x * h * cos(2 * pi() * k * j / 100)) AS re, sum(x * h * sin(2 * pi() * k * j / 100)) AS im FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 100) AS h FROM g), range(51) r(k) GROUP BY 1, 2, 3, 4),
p AS (SELECT series_id, axis, k, quantile_cont((re * re + im * im) * CASE WHEN k IN (0, 50) THEN 1 ELSE 2 END / 100 / 37.5, 0.5) / CASE WHEN count(*) < 3 THEN 1 ELSE 1 + list_sum(list_transform(range(1, (count(*) - 1) // 2 + 1), lambda q: 1 / (2 * q + 1) - 1 / (2 * q))) END AS p FROM f GROUP BY 1, 2, 3),
a AS (SELECT * FROM p UNION ALL SELECT series_id, 'Resultant', k, sum(p) FROM p GROUP BY 1, 2, 3), b AS (SELECT pow(2, n / 3.0) AS c FROM range(18) r(n)), s AS (SELECT DISTINCT series_id, axis FROM a)
SELECT s.series_id, s.axis, round(c, 6) AS freq, round(log10(avg(p)), 5) AS log10_value FROM s CROSS JOIN b LEFT JOIN a ON a.series_id = s.series_id AND a.axis = s.axis AND k >= c / pow(2, 1 / 6.0) AND k < c * pow(2, 1 / 6.0) GROUP BY 1, 2, 3""")
def batch_psd(spark, sf):
    d = batch.Builder(batch.Params(highpass=None)).add_psd(1.0, 1.0, 3.0).aggregate(_recordings(spark, sf))["psd"]
    return d.select("series_id", "axis", R6("freq").alias("freq"), R6(F.when(F.col("value") > 0, F.log10("value")), 5).alias("log10_value"))


@query(f"""WITH {TRI}, d AS (SELECT series_id, axis, i, v FROM tri UNION ALL SELECT series_id, 'Resultant', i, sqrt(sum(v*v)) FROM tri GROUP BY series_id, i),
p AS (SELECT series_id, axis, min(i) AS pi FROM d JOIN (SELECT series_id, axis, max(abs(v)) AS m FROM d GROUP BY 1, 2) USING (series_id, axis) WHERE abs(v) = m GROUP BY 1, 2)
SELECT series_id, axis, round(CAST(pi AS DOUBLE) / 100, 4) AS peak_time, round(CAST(i - pi AS DOUBLE) / 100, 4) + 0.0 AS peak_offset, round(v, 4) AS value FROM d JOIN p USING (series_id, axis) WHERE i - pi BETWEEN -10 AND 11""")
def batch_peaks(spark, sf):
    d = batch.Builder(batch.Params(highpass=None)).add_peaks(10).aggregate(_recordings(spark, sf))["peaks"]
    return d.select("series_id", "axis", R6("peak time", 4).alias("peak_time"), R6("peak offset", 4).alias("peak_offset"), R6("value", 4).alias("value"))


@query(f"""WITH {TRI}, a AS (SELECT series_id, axis, i, v * 9.80665 AS v FROM tri), u AS (SELECT series_id, axis, i, sum(d) OVER (PARTITION BY series_id, axis ORDER BY i) AS v FROM (SELECT *, coalesce((v + lag(v) OVER (PARTITION BY series_id, axis ORDER BY i)) * 0.005, 0) AS d FROM a)),
z AS (SELECT series_id, axis, i, sum(d) OVER (PARTITION BY series_id, axis ORDER BY i) AS v FROM (SELECT *, coalesce((v + lag(v) OVER (PARTITION BY series_id, axis ORDER BY i)) * 0.005, 0) AS d FROM u)),
r AS (SELECT series_id, 'RMS Velocity' AS calculation, axis, 1e3 * sqrt(avg(v*v)) AS x FROM u GROUP BY 1, 3 UNION ALL SELECT series_id, 'RMS Displacement', axis, 1e3 * sqrt(avg(v*v)) FROM z GROUP BY 1, 3)
SELECT series_id, calculation, axis, round(log10(x), 6) AS log10_value FROM r UNION ALL SELECT series_id, calculation, 'Resultant', round(log10(sqrt(sum(x*x))), 6) FROM r GROUP BY 1, 2""")
def batch_motion(spark, sf):
    b = batch.Builder(batch.Params(highpass=None)).add_metrics(["RMS Velocity", "RMS Displacement"])
    return b.aggregate(_recordings(spark, sf))["metrics"].select("series_id", "calculation", "axis", R6(F.log10("value")).alias("log10_value"))


_CHANNELS = [("Audio", "A", "mic"), ("Pressure", "psi", "p"), ("Temperature", "°F", "t"), ("Humidity", "RH", "h"), ("Rotation", "dps", "X"), ("Rotation", "dps", "Y"), ("Speed", "m/s", "v"), ("GPS", "deg", "Latitude"), ("GPS", "deg", "Longitude")]


def _sensors(spark, sf) -> DataFrame:
    every = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, ("type", "unit", "axis"), strict=True)]) for c in _CHANNELS])
    d = _events(spark, sf).select("series_id", "i", F.col("i").cast("double").alias("t"), "v", F.explode(every).alias("c"))
    return d.select("series_id", "c.*", "i", "t", "v")


@query(f"""WITH {SIG}, r AS (SELECT series_id, sqrt(avg(v*v)) AS rms, avg(v) AS mean, avg(v) FILTER (WHERE v <> 0) AS moving, max_by(v, i) FILTER (WHERE v <> 0) AS fix FROM sig GROUP BY 1)
SELECT series_id, m.c AS calculation, m.a AS axis, round(m.x, 5) AS value FROM (SELECT series_id, unnest([{{'c': 'RMS Microphone', 'a': 'mic', 'x': rms * 5.307530522779073}}, {{'c': 'RMS Microphone Decibels', 'a': 'mic', 'x': 20 * log10(rms * 5.307530522779073 / 2e-5)}},
{{'c': 'Average Pressure', 'a': 'p', 'x': mean * 6.89476}}, {{'c': 'Average Temperature', 'a': 't', 'x': (mean - 32) * 5 / 9}}, {{'c': 'Average Relative Humidity', 'a': 'h', 'x': mean}}, {{'c': 'RMS Angular Velocity', 'a': 'X', 'x': rms}}, {{'c': 'RMS Angular Velocity', 'a': 'Y', 'x': rms}},
{{'c': 'RMS Angular Velocity', 'a': 'Resultant', 'x': rms * sqrt(2)}}, {{'c': 'GPS Speed', 'a': 'v', 'x': moving * 3.6}}, {{'c': 'GPS Position', 'a': 'Latitude', 'x': fix}}, {{'c': 'GPS Position', 'a': 'Longitude', 'x': fix}}]) AS m FROM r)""")
def batch_sensors(spark, sf):
    names = ["RMS Microphone", "RMS Microphone Decibels", "Average Pressure", "Average Temperature", "Average Relative Humidity", "RMS Angular Velocity", "GPS Speed", "GPS Position"]
    d = batch.Builder(batch.Params(highpass=None)).add_metrics(names).aggregate(_sensors(spark, sf))["metrics"]
    return d.select("series_id", "calculation", "axis", R6("value", 5).alias("value"))


# ---- sentences and channels --------------------------------------------------------------------------------------


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS series_id, TIMESTAMP '2022-06-10 00:00:00' + INTERVAL 1 SECOND * (s_suppkey % 3600) AS ts, CAST(s_suppkey % 360 AS DOUBLE) AS direction, round(-(s_suppkey % 90 + (s_suppkey % 60) / 60.0), 6) + 0.0 AS latitude,
round(s_suppkey % 180 + 30.5 / 60.0, 6) AS longitude, CAST(s_suppkey % 200 AS DOUBLE) AS speed, CAST(1 + s_suppkey % 2 AS INTEGER) AS quality FROM supplier""")
def nmea_positions(spark, sf):
    """Sentences made of a table, cut into blocks of 37 characters, put together and parsed."""
    n, pad = F.col("s_suppkey"), lambda c, k: F.lpad(c.cast("string"), k, "0")
    time = F.concat(F.lit("00"), pad(F.floor(n % 3600 / 60), 2), pad(n % 60, 2), F.lit(".00"))
    place = [pad(n % 90, 2), pad(n % 60, 2), F.lit(".0000,S,"), pad(n % 180, 3), F.lit("30.5000,E,")]
    rmc = F.concat(F.lit("junk$GPRMC,"), time, F.lit(",A,"), *place, F.lit("0.0,0.0,100622,,,A*00\r\n"))
    vtg = F.concat(F.lit("$GPVTG,"), (n % 360).cast("string"), F.lit(".0,T,,M,0.0,N,"), (n % 200).cast("string"), F.lit(".0,K,A*00\r\n"))
    gga = F.concat(F.lit("$GPGGA,"), time, F.lit(","), *place, (1 + n % 2).cast("string"), F.lit(",08,1.0,0.0,M,0.0,M,,*00\r\n"))
    d = _t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("series_id"), n, F.concat(rmc, vtg, gga).alias("x"))
    blocks = logs.cut(d, "s_suppkey", 37).withColumn("payload", F.col("payload").cast("binary"))
    m = logs.measurements(logs.parse_sentences(logs.sentences(blocks)))
    return m.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "direction", R6("latitude").alias("latitude"), R6("longitude").alias("longitude"), "speed", "quality")


_UNITS = ["Acceleration", "Pressure", "Temperature", "Relative Humidity", "Voltage"]


@query("SELECT p_partkey, ['Acceleration', 'Pressure', 'Temperature', 'Relative Humidity', 'Voltage'][p_size % 5 + 1] AS type, ['acc', 'pre', 'tem', 'rel', 'vol'][p_size % 5 + 1] AS key FROM part WHERE p_size % 5 NOT IN (2, 4)")
def filter_channels(spark, sf):
    kind = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (F.col("p_size") % 5 + 1).cast("int"))
    d = _t(spark, sf, "part").select("p_partkey", kind.alias("type"))
    return catalog.filter_channels(d, "acceleration + pressure + hum + temperature - tem").withColumn("key", catalog.measurement_type(F.col("type")))
