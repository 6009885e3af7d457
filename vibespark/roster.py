"""Registered queries of the signal operators and the SQL that states each of them.

``events`` stands for recordings: one series per event type, ordered by (ts, event_id). ``lineitem`` gives three axes per
return flag, ``embeddings`` packed recordings of 64 samples, ``part`` a channel catalog, ``orders`` a file table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import quaternion as qn
from .functions import text as tx
from .functions.units import convert_units, to_db
from .model import spacing, to_signal
from .operators import joins, multivariate, shock, spectral, stats, windows
from .plans import batch, metrics, views
from .sources import catalog, files, logs

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark, sf) -> DataFrame:
    return to_signal(_t(spark, sf, "events"), "event_type", ["ts", "event_id"], ["value"], "ts")


def _tri(spark, sf) -> DataFrame:
    return to_signal(_t(spark, sf, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["l_quantity", "l_extendedprice", "l_discount"], dt=0.01)


def _packed(spark, sf) -> DataFrame:
    d = _t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("series_id"), F.posexplode("embedding").alias("i", "v"))
    return d.select("series_id", F.lit("v").alias("axis"), F.col("i").cast("long").alias("i"), (F.col("i") / 64.0).alias("t"), F.col("v").cast("double").alias("v"))


SIG = "sig AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) / 1e6 AS t, value AS v FROM events)"
SP = SIG + ", sp AS (SELECT series_id, max(i) + 1 AS n, (max_by(t, i) - min_by(t, i)) / max(i) AS dt FROM sig GROUP BY 1)"
TRI = """tri0 AS (SELECT l_returnflag AS series_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, l_quantity, l_extendedprice, l_discount FROM lineitem),
tri AS (SELECT series_id, i, CAST(i AS DOUBLE) * 0.01 AS t, axis, v FROM tri0 UNPIVOT (v FOR axis IN (l_quantity, l_extendedprice, l_discount)))"""
PK = "pk AS (SELECT CAST(vec_id AS VARCHAR) AS series_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
R6 = lambda c, n=6: F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0


# ---- aggregates --------------------------------------------------------------------------------------------------


@query("""SELECT event_type AS series_id, count(*) AS n, round(sqrt(avg(value*value)),6) AS rms, round(max(abs(value)),6) AS peak,
round(max(abs(value))/nullif(stddev_samp(value),0),6) AS crest FROM events GROUP BY 1""")
def vib_metrics(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("value").alias("v"))
    return e.groupBy("series_id").agg(F.count("v").alias("n"), R6(stats.rms()).alias("rms"), R6(stats.max_abs()).alias("peak"), R6(stats.crest_factor()).alias("crest"))


@query(f"""WITH {TRI}, r AS (SELECT series_id, axis, sqrt(avg(v*v)) AS x FROM tri GROUP BY 1, 2)
SELECT series_id, axis, round(x, 4) AS value FROM r UNION ALL SELECT series_id, 'Resultant', round(sqrt(sum(x*x)), 4) FROM r GROUP BY 1""")
def rms_by_axis(spark, sf):
    return stats.rms_with_resultant(_tri(spark, sf)).withColumn("value", R6("value", 4))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax), 6) AS l2 FROM lineitem")
def resultant_l2(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R6(stats.l2_of_columns("l_quantity", "l_discount", "l_tax")).alias("l2"))


@query(f"""WITH {TRI}, d AS (SELECT series_id, axis, v FROM tri UNION ALL SELECT series_id, 'Resultant', sqrt(sum(v*v)) FROM tri GROUP BY series_id, i)
SELECT series_id, axis, round(max(abs(v)), 4) AS value FROM d GROUP BY 1, 2""")
def max_abs(spark, sf):
    return stats.peak_with_resultant(_tri(spark, sf)).withColumn("value", R6("value", 4))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS l2 FROM embeddings")
def array_norm(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", R6(stats.l2_of_array("embedding")).alias("l2"))


@query(f"""WITH {SIG} SELECT series_id, 'value' AS axis, count(v) AS count, round(avg(v),5) AS mean, round(stddev_samp(v),5) AS std, min(v) AS min,
round(quantile_cont(v,0.25),5) AS p25, round(quantile_cont(v,0.5),5) AS p50, round(quantile_cont(v,0.75),5) AS p75, max(v) AS max FROM sig GROUP BY 1""")
def describe_series(spark, sf):
    d = stats.describe(_events(spark, sf))
    return d.select("series_id", "axis", "count", *[R6(c, 5).alias(c) for c in ("mean", "std")], "min", *[R6(c, 5).alias(c) for c in ("p25", "p50", "p75")], "max")


@query(f"WITH {SIG}, n AS (SELECT series_id, max(i)+1 AS n FROM sig GROUP BY 1) SELECT series_id, 'value' AS axis, round(sqrt(avg(v*v)),6) AS value FROM sig JOIN n USING(series_id) WHERE i >= floor(n*0.1/2) AND i < n - floor(n*0.1/2) GROUP BY 1")
def rms_without_taper(spark, sf):
    return stats.rms_inside(_events(spark, sf), 0.1).withColumn("value", R6("value"))


@query("""SELECT o_orderpriority AS tag, count(*) AS n, string_agg('''' || name || '''', ', ' ORDER BY name) AS files FROM
(SELECT DISTINCT o_orderpriority, CAST(o_custkey % 7 AS VARCHAR) AS name FROM orders) GROUP BY 1""")
def tag_counts(spark, sf):
    d = _t(spark, sf, "orders").select("o_orderpriority", (F.col("o_custkey") % 7).cast("string").alias("file_name")).distinct()
    return stats.count_tags(d.select(F.array("o_orderpriority").alias("tags"), "file_name"))


@query("SELECT c_nationkey, c_name, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def device_dedupe(spark, sf):
    return stats.first_per_key(_t(spark, sf, "customer").select("c_nationkey", "c_name", "c_custkey"), "c_nationkey", "c_custkey")


@query("SELECT date_trunc('quarter', o_orderdate) AS quarter, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY 1")
def calendar_resample(spark, sf):
    d = _t(spark, sf, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("quarter"), "o_totalprice")
    return d.groupBy("quarter").agg(F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS series_id, arg_max(value, (ts, event_id)) FILTER (WHERE value <> 0 AND event_id % 3 <> 0) AS lat FROM events GROUP BY 1")
def last_fix(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.struct("ts", "event_id").alias("t"), F.col("value").alias("lat"), (F.col("event_id") % 3).alias("lon"))
    return stats.last_fix(e).select("series_id", "lat")


@query("SELECT user_id AS series_id, round(avg(CASE WHEN value <> 0 THEN value END) * 3.6, 6) AS value FROM events GROUP BY 1")
def mean_speed(spark, sf):
    return stats.mean_speed_kmh(_t(spark, sf, "events").select(F.col("user_id").alias("series_id"), F.col("value").alias("speed"))).withColumn("value", R6("value"))


# ---- catalog -----------------------------------------------------------------------------------------------------


@query(f"""WITH {SIG} SELECT series_id, 'value' AS axis, CAST(round(min(t)*1e6) AS BIGINT) AS "start", CAST(round(max(t)*1e6) AS BIGINT) AS "end",
CAST(round(max(t)*1e6) AS BIGINT) - CAST(round(min(t)*1e6) AS BIGINT) AS duration, count(v) AS samples,
round(count(v) / ((CAST(round(max(t)*1e6) AS BIGINT) - CAST(round(min(t)*1e6) AS BIGINT)) / 1e6), 9) AS rate FROM sig GROUP BY 1""")
def channel_table(spark, sf):
    return catalog.channel_table(_events(spark, sf)).withColumn("rate", R6("rate", 9))


@query(f"WITH {TRI}, c AS (SELECT series_id, axis, count(v) AS samples FROM tri GROUP BY 1, 2) SELECT series_id, axis, samples FROM c WHERE samples = (SELECT max(samples) FROM c)")
def primary_channel_ties(spark, sf):
    return catalog.primary_channels(catalog.channel_table(_tri(spark, sf))).select("series_id", "axis", "samples")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%copper%'")
def type_include_semi(spark, sf):
    p = _t(spark, sf, "part")
    kind = catalog.MeasurementType("met", "Metal", ["steel", "copper"])
    chosen = p.filter(kind.match(F.col("p_type"))).select("p_partkey")
    return p.join(chosen, "p_partkey", "left_semi").select("p_partkey", "p_type")


@query("SELECT p_partkey, p_type FROM part WHERE NOT (lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%copper%')")
def type_exclude_anti(spark, sf):
    p = _t(spark, sf, "part")
    gone = p.filter(catalog.MeasurementType("met", "Metal", ["steel", "copper"]).match(F.col("p_type"))).select("p_partkey")
    return p.join(gone, "p_partkey", "left_anti").select("p_partkey", "p_type")


@query("""SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY (p_partkey IN (7, 42, 99)) DESC, p_size DESC, p_partkey) AS r FROM part WHERE p_size > 0) WHERE r = 1""")
def best_channel_per_type(spark, sf):
    d = catalog.best_per_type(_t(spark, sf, "part"), [7, 42, 99], "p_brand", "p_size", "p_partkey")
    return d.select("p_brand", "p_partkey", "p_size")


@query("SELECT p_brand, p_type, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS subs FROM part GROUP BY 1, 2")
def channels_by_type(spark, sf):
    d = catalog.channels_by_type(_t(spark, sf, "part"), "p_brand", "p_type", "p_partkey")
    return d.select("p_brand", "p_type", F.array_join("subchannels", ",").alias("subs"))


# ---- windows -----------------------------------------------------------------------------------------------------


@query(f"WITH {SP} SELECT series_id, n, round(dt, 9) AS dt FROM sp")
def sample_spacing(spark, sf):
    return spacing(_events(spark, sf)).withColumn("dt", R6("dt", 9))


def _rolled(expr: str) -> str:
    return f"WITH {SIG} SELECT series_id, 'value' AS axis, i, CASE WHEN count(v) OVER w = 25 THEN round({expr}, 5) + 0.0 END AS v FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)"


@query(_rolled("sqrt(avg(v*v) OVER w)"))
def rolling_rms(spark, sf):
    return windows.rolling(_events(spark, sf), 25, "rms").select("series_id", "axis", "i", R6("v", 5).alias("v"))


@query(_rolled("max(abs(v)) OVER w"))
def rolling_absmax(spark, sf):
    return windows.rolling(_events(spark, sf), 25, "absmax").select("series_id", "axis", "i", R6("v", 5).alias("v"))


@query(_rolled("stddev_samp(v) OVER w"))
def rolling_metric_std(spark, sf):
    return windows.rolling(_events(spark, sf), 25, "std").select("series_id", "axis", "i", R6("v", 5).alias("v"))


@query(f"WITH {SIG} SELECT series_id, 'value' AS axis, i, round(v - avg(v) OVER (PARTITION BY series_id), 6) + 0.0 AS v FROM sig")
def rolling_mean_removed(spark, sf):
    return windows.rolling_mean_removed(_events(spark, sf), None).select("series_id", "axis", "i", R6("v").alias("v"))


@query(f"""WITH {TRI} SELECT series_id, axis, i, round((v - avg(v) OVER (PARTITION BY series_id, axis ORDER BY i ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)) * 0.98712345, 2) + 0.0 AS v FROM tri""")
def rolling_mean_centred(spark, sf):
    return windows.rolling_mean_removed(_tri(spark, sf), 1.005).select("series_id", "axis", "i", R6(F.col("v") * 0.98712345, 2).alias("v"))


INT = SP + ", a AS (SELECT series_id, i, sum(coalesce(dt * (p + v) / 2, 0)) OVER (PARTITION BY series_id ORDER BY i) AS a FROM (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY i) AS p FROM sig) JOIN sp USING (series_id))"


@query(f"WITH {INT} SELECT series_id, 'value' AS axis, i, round((a) / 1000, 3) + 0.0 AS v FROM a")
def integrate_start(spark, sf):
    return windows.integrate(_events(spark, sf)).select("series_id", "axis", "i", R6(F.col("v") / 1000, 3).alias("v"))


@query(f"WITH {INT} SELECT series_id, 'value' AS axis, i, round((a - avg(a) OVER (PARTITION BY series_id)) / 1000, 3) + 0.0 AS v FROM a")
def integrate_mean(spark, sf):
    return windows.integrate(_events(spark, sf), "mean").select("series_id", "axis", "i", R6(F.col("v") / 1000, 3).alias("v"))


@query(f"WITH {INT} SELECT series_id, 'value' AS axis, i, round((a - median(a) OVER (PARTITION BY series_id)) / 1000, 3) + 0.0 AS v FROM a")
def integrate_median(spark, sf):
    return windows.integrate(_events(spark, sf), "median").select("series_id", "axis", "i", R6(F.col("v") / 1000, 3).alias("v"))


@query(f"""WITH {TRI}, d AS (SELECT series_id, axis, (max(t) - min(t)) / max(i) AS dt FROM tri WHERE axis = 'l_discount' GROUP BY 1, 2),
a AS (SELECT series_id, axis, i, dt, sum(coalesce(dt * (p + v) / 2, 0)) OVER (PARTITION BY series_id ORDER BY i) AS a FROM (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY i) AS p FROM tri WHERE axis = 'l_discount') JOIN d USING (series_id, axis)),
b AS (SELECT series_id, axis, i, sum(coalesce(dt * (p + a) / 2, 0)) OVER (PARTITION BY series_id ORDER BY i) AS b FROM (SELECT *, lag(a) OVER (PARTITION BY series_id ORDER BY i) AS p FROM a))
SELECT series_id, axis, i, round(b * 0.98712345, 4) + 0.0 AS v FROM b""")
def double_integral(spark, sf):
    d = _tri(spark, sf).filter("axis = 'l_discount'")
    return windows.integrals(d, 2)[2].select("series_id", "axis", "i", R6(F.col("v") * 0.98712345, 4).alias("v"))


@query(f"""WITH {SIG}, w AS (SELECT series_id, greatest(CAST(round(max(i) / 100.0) AS BIGINT), 1) AS w FROM sig GROUP BY 1),
e AS (SELECT s.series_id, s.i, w.w, min(b.v) AS lo, max(b.v) AS hi, count(*) AS c FROM sig s JOIN w USING (series_id) JOIN sig b ON b.series_id = s.series_id AND b.i > s.i - w.w AND b.i <= s.i WHERE s.i % greatest(w.w - 1, 1) = 0 GROUP BY 1, 2, 3)
SELECT series_id, 'value' AS axis, i, lo, hi FROM e WHERE c = w""")
def envelope_min_max(spark, sf):
    return windows.envelope(_events(spark, sf), 100).select("series_id", "axis", "i", "lo", "hi")


@query(f"WITH {SIG}, p AS (SELECT series_id, min(i) AS pi FROM sig JOIN (SELECT series_id, max(abs(v)) AS m FROM sig GROUP BY 1) USING (series_id) WHERE abs(v) = m GROUP BY 1) SELECT series_id, 'value' AS axis, i, v FROM sig JOIN p USING (series_id) WHERE i >= pi - 30 AND i < pi + 70")
def around_peak(spark, sf):
    return windows.around_peak(_events(spark, sf), 100, 0.3).select("series_id", "axis", "i", "v")


@query(f"""WITH {TRI}, d AS (SELECT series_id, axis, i, v FROM tri UNION ALL SELECT series_id, 'Resultant', i, sqrt(sum(v*v)) FROM tri GROUP BY series_id, i),
p AS (SELECT series_id, axis, min(i) AS pi FROM d JOIN (SELECT series_id, axis, max(abs(v)) AS m FROM d GROUP BY 1, 2) USING (series_id, axis) WHERE abs(v) = m GROUP BY 1, 2)
SELECT series_id, axis, i - pi AS "offset", round(v, 4) AS v FROM d JOIN p USING (series_id, axis) WHERE i - pi BETWEEN -20 AND 21""")
def peak_windows(spark, sf):
    return windows.peak_windows(_tri(spark, sf), 20).select("series_id", "axis", "offset", R6("v", 4).alias("v"))


@query(f"""WITH {SIG}, a AS (SELECT series_id, i, abs(v) AS v FROM sig), r AS (SELECT *, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY i) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY i) AS p FROM a)),
g AS (SELECT series_id, run, min(v) AS v, (min(i) + max(i)) // 2 AS i FROM r GROUP BY 1, 2), f AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS n FROM g WINDOW w AS (PARTITION BY series_id ORDER BY run))
SELECT series_id, i, v FROM f WHERE v > l AND v > n""")
def local_maxima(spark, sf):
    return windows.local_maxima(_events(spark, sf)).select("series_id", F.col("i").cast("long").alias("i"), "v")


@query()
def find_peaks(spark, sf):
    return windows.find_peaks(_events(spark, sf), 3600.0, None, "rms", 1.5)


def _centres(n: int) -> str:
    return f"c AS (SELECT series_id, s AS slice, CAST(floor(n / {n}.0 * (s + 0.5)) AS BIGINT) AS centre, greatest(CAST(floor(n * dt / {n} / dt / 2) AS BIGINT), 1) AS num FROM sp, range({n}) r(s))"


@query(f"WITH {SP}, {_centres(20)} SELECT series_id, 'value' AS axis, slice, count(v) AS n, round(sqrt(avg(v*v)), 6) AS rms, round(max(abs(v)), 6) AS peak FROM sig JOIN c USING (series_id) WHERE i >= greatest(centre - num, 0) AND i < centre + num GROUP BY 1, 3")
def slice_metrics(spark, sf):
    s = _events(spark, sf)
    return windows.slice_metrics(s, windows.slice_centres(s, 20)).select("series_id", "axis", "slice", "n", R6("rms").alias("rms"), R6("peak").alias("peak"))


@query(f"""WITH {SIG}, x(slice, x) AS (VALUES (0, 1704070800.0), (1, 1704200000.5), (2, 1704400000.25)), d AS (SELECT series_id, slice, i, abs(t - x) AS d FROM sig, x)
SELECT series_id, CAST(slice AS BIGINT) AS slice, min(i) AS centre FROM d JOIN (SELECT series_id, slice, min(d) AS d FROM d GROUP BY 1, 2) USING (series_id, slice, d) GROUP BY 1, 2""")
def nearest_slices(spark, sf):
    s = _events(spark, sf)
    return windows.slice_centres(s, values=[1704070800.0, 1704200000.5, 1704400000.25], slice_width=100.0).select("series_id", "slice", "centre")


@query(f"WITH {SP} SELECT series_id, 'value' AS axis, i, v FROM sig JOIN sp USING (series_id) WHERE i >= ceil(7200 / dt) AND i < n - ceil(3600 / dt)")
def trim_margins(spark, sf):
    return windows.trimmed_by_margin(_events(spark, sf), 7200, 3600).select("series_id", "axis", "i", "v")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW), 6) AS v FROM events")
def range_frame_6h(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return windows.range_means(e, "event_type", F.col("ts"), "value", 6 * 3600 * 10**6).select("event_id", R6("mean").alias("v"))


@query(f"WITH {SIG} SELECT series_id, i, round(v / nullif(first_value(v) OVER (PARTITION BY series_id ORDER BY i), 0), 6) AS rel FROM sig")
def relative_to_first(spark, sf):
    w = Window.partitionBy("series_id").orderBy("i")
    return _events(spark, sf).select("series_id", "i", R6(F.try_divide("v", F.first("v").over(w))).alias("rel"))


# ---- spectra -----------------------------------------------------------------------------------------------------


def _welch(win: str, power: str) -> str:
    return f"""WITH {SP}, seg AS (SELECT s.series_id, g AS seg, i - g * 32 AS j, v, dt FROM sig s JOIN sp USING (series_id), range(0, 4000) r(g) WHERE i >= g * 32 AND i < g * 32 + 64 AND g * 32 + 64 <= n),
w AS (SELECT j, {win} AS w FROM range(64) r(j)), m AS (SELECT *, (v - avg(v) OVER (PARTITION BY series_id, seg)) * w AS x FROM seg JOIN w USING (j)), k AS (SELECT k FROM range(33) r(k)),
f AS (SELECT series_id, seg, k, dt, sum(x * cos(2 * pi() * k * j / 64)) AS re, sum(x * sin(2 * pi() * k * j / 64)) AS im FROM m, k GROUP BY 1, 2, 3, 4),
p AS (SELECT series_id, k, dt, avg((re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * dt / (SELECT sum(w * w) FROM w)) AS p FROM f GROUP BY 1, 2, 3)
SELECT series_id, 'value' AS axis, k, {power} AS value FROM p"""


HANN = "0.5 - 0.5 * cos(2 * pi() * j / 64)"


def _k(d: DataFrame, s: DataFrame, n: int = 64) -> DataFrame:
    return d.join(spacing(s), "series_id").withColumn("k", F.round(F.col("freq") * F.col("dt") * n).cast("long"))


@query(_welch(HANN, "round(p, 1)"))
def welch_density(spark, sf):
    s = _events(spark, sf)
    return _k(spectral.welch(s, None, nperseg=64), s).select("series_id", "axis", "k", R6("value", 1).alias("value"))


@query(_welch(HANN, "round(p / (64 * dt), 5)"))
def welch_parseval(spark, sf):
    s = _events(spark, sf)
    return _k(spectral.welch(s, None, "parseval", nperseg=64), s).select("series_id", "axis", "k", R6("value", 5).alias("value"))


@query(_welch("1.0", "round(sqrt(2 * p / (64 * dt)), 5)"))
def aggregate_fft(spark, sf):
    s = _events(spark, sf)
    return _k(spectral.aggregate_fft(s, None, nperseg=64), s).select("series_id", "axis", "k", R6("value", 5).alias("value"))


DFT = f"WITH {PK}, k AS (SELECT k FROM range(%s) r(k)), f AS (SELECT series_id, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM pk, k GROUP BY 1, 2) SELECT series_id, CAST(k AS DOUBLE) AS freq, %s AS value FROM f"


@query(DFT % (33, "round(2 * sqrt(re * re + im * im) / 64, 6)"))
def rfft_magnitude(spark, sf):
    return spectral.rfft(_packed(spark, sf)).select("series_id", R6("freq").alias("freq"), R6("value").alias("value"))


@query(DFT.replace("CAST(k AS DOUBLE) AS freq", "CAST(CASE WHEN k < 32 THEN k ELSE k - 64 END AS DOUBLE) AS freq") % (64, "round(sqrt(re * re + im * im) / 8, 6)"))
def fft_ortho(spark, sf):
    return spectral.fft(_packed(spark, sf), norm="ortho").select("series_id", R6("freq").alias("freq"), R6("value").alias("value"))


@query(DFT % (33, "round(cos(atan2(im, re)), 5) + 0.0") + " WHERE k BETWEEN 1 AND 31 AND re * re + im * im > 1e-6")
def fft_angle(spark, sf):
    d = spectral.rfft(_packed(spark, sf), "complex", norm="backward").filter("freq BETWEEN 0.5 AND 31.5 AND re * re + im * im > 1e-6")
    return d.select("series_id", R6("freq").alias("freq"), R6(F.cos(F.atan2("im", "re")), 5).alias("value"))


@query(f"WITH {PK}, k AS (SELECT k FROM range(64) r(k)) SELECT series_id, round(k * 32 / 63.0, 6) AS freq, round(2 * sum(v * cos(pi() * k * (2 * i + 1) / 128)) / 64, 5) + 0.0 AS value FROM pk, k GROUP BY 1, k")
def dct_ii(spark, sf):
    return spectral.dct(_packed(spark, sf)).select("series_id", R6("freq").alias("freq"), R6("value", 5).alias("value"))


@query(f"WITH {PK}, k AS (SELECT k FROM range(64) r(k)) SELECT series_id, round(k * 32 / 63.0, 6) AS freq, round(2 * sum(v * sin(pi() * (k + 1) * (2 * i + 1) / 128)) / 64, 5) + 0.0 AS value FROM pk, k GROUP BY 1, k")
def dst_ii(spark, sf):
    return spectral.dst(_packed(spark, sf)).select("series_id", R6("freq").alias("freq"), R6("value", 5).alias("value"))


SPEC = "spec AS (SELECT l_returnflag AS series_id, CAST(l_partkey AS DOUBLE) AS freq, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"
JAG = [0, 10, 25, 60, 150, 400, 1000]


def _spec(spark, sf) -> DataFrame:
    d = _t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_partkey").cast("double").alias("freq")).agg(F.sum("l_extendedprice").alias("value"))
    return d.select("series_id", F.lit("v").alias("axis"), "freq", "value")


def _jagged(agg: str) -> str:
    bins = ", ".join(f"({a}.0, {b}.0, {k == len(JAG) - 2})" for k, (a, b) in enumerate(zip(JAG, JAG[1:], strict=False)))
    return f"WITH {SPEC}, b(lo, hi, last) AS (VALUES {bins}), s AS (SELECT DISTINCT series_id FROM spec) SELECT s.series_id, (lo + hi) / 2 AS freq, round(coalesce({agg}(value), 0), 2) AS value FROM s CROSS JOIN b LEFT JOIN spec x ON x.series_id = s.series_id AND freq >= lo AND (freq < hi OR last AND freq = hi) GROUP BY 1, 2"


@query(_jagged("avg"))
def jagged_mean(spark, sf):
    return spectral.to_jagged(_spec(spark, sf), JAG).select("series_id", "freq", R6("value", 2).alias("value"))


@query(_jagged("sum"))
def jagged_sum(spark, sf):
    return spectral.to_jagged(_spec(spark, sf), JAG, "sum").select("series_id", "freq", R6("value", 2).alias("value"))


@query(f"""WITH {SIG}, b(lo, hi, last) AS (VALUES (0.0, 10.0, false), (10.0, 40.0, false), (40.0, 90.0, true)), s AS (SELECT DISTINCT series_id FROM sig)
SELECT s.series_id, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(count(v) AS DOUBLE) AS n FROM s CROSS JOIN b LEFT JOIN sig x ON x.series_id = s.series_id AND v >= lo AND (v < hi OR last AND v = hi) GROUP BY 1, 2, 3""")
def histogram(spark, sf):
    return spectral.histogram(_events(spark, sf), [0, 10, 40, 90]).select("series_id", "lo", "hi", "n")


OCT = f"""WITH {SPEC}, top AS (SELECT max(freq) AS m FROM spec), b AS (SELECT k, pow(2.0, k / 3.0) AS c FROM top, range(100) r(k) WHERE k <= floor(log2(m) * 3 + 0.5)), s AS (SELECT DISTINCT series_id FROM spec)"""


@query(OCT + " SELECT s.series_id, round(c, 6) AS freq, round(coalesce(sum(value), 0), 2) AS value FROM s CROSS JOIN b LEFT JOIN spec x ON x.series_id = s.series_id AND freq >= c / pow(2.0, 1 / 6.0) AND freq < c * pow(2.0, 1 / 6.0) GROUP BY 1, 2")
def octave_bins(spark, sf):
    return spectral.to_octave(_spec(spark, sf), 1.0, 3.0, "sum").select("series_id", R6("freq").alias("freq"), R6("value", 2).alias("value"))


@query(f"WITH {SPEC} SELECT series_id, freq, CASE WHEN freq = 0 THEN 0.0 ELSE round(value / pow(2 * pi() * freq, 2), 4) END AS value FROM spec")
def spectrum_differentiate(spark, sf):
    return spectral.differentiate(_spec(spark, sf), -1.0).select("series_id", "freq", R6("value", 4).alias("value"))


@query(OCT + ", v AS (SELECT series_id, freq, value / pow(2 * pi() * freq, 2) AS value FROM spec WHERE freq > 0), d AS (SELECT series_id, min(freq) FILTER (WHERE freq > 0) AS df FROM spec GROUP BY 1) SELECT s.series_id, round(c, 6) AS freq, round(sqrt(coalesce(sum(value), 0) * max(df)), 4) AS value FROM s CROSS JOIN b JOIN d USING (series_id) LEFT JOIN v x ON x.series_id = s.series_id AND freq >= c / pow(2.0, 1 / 6.0) AND freq < c * pow(2.0, 1 / 6.0) GROUP BY 1, 2")
def vc_curves(spark, sf):
    return spectral.vc_curves(_spec(spark, sf), 1.0, 3.0).select("series_id", R6("freq").alias("freq"), R6("value", 4).alias("value"))


@query(f"WITH {SPEC}, d AS (SELECT series_id, min(freq) FILTER (WHERE freq > 0) AS df FROM spec GROUP BY 1) SELECT series_id, freq, round(sqrt(sum(value * df) OVER (PARTITION BY series_id ORDER BY freq)), 3) AS value FROM spec JOIN d USING (series_id)")
def cumulative_rms(spark, sf):
    return spectral.cumulative_rms(_spec(spark, sf)).select("series_id", "freq", R6("value", 3).alias("value"))


@query(f"WITH {SPEC}, a AS (SELECT freq, value FROM spec WHERE series_id = 'A'), n AS (SELECT freq, value FROM spec WHERE series_id = 'N') SELECT freq, round(sqrt(a.value / nullif(n.value, 0)), 6) AS value FROM a JOIN n USING (freq)")
def transfer_function(spark, sf):
    s = _spec(spark, sf)
    part = lambda f: s.filter(F.col("series_id") == f).withColumn("series_id", F.lit("x"))
    return spectral.transfer(part("A"), part("N")).select("freq", R6("value").alias("value"))


@query(f"""WITH {PK}, g AS (SELECT series_id, s, i - s * 16 AS j, v FROM pk, range(4) r(s) WHERE i >= s * 16 AND i < s * 16 + 16), m AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id, s) AS x FROM g), k AS (SELECT k FROM range(9) r(k)),
f AS (SELECT series_id, s, k, sum(x * cos(2 * pi() * k * j / 16)) AS re, sum(x * sin(2 * pi() * k * j / 16)) AS im FROM m, k GROUP BY 1, 2, 3)
SELECT series_id, 'v' AS axis, CAST(k * 4 AS DOUBLE) AS freq, round(CAST(s AS DOUBLE) * 0.25 + 0.125, 6) AS timestamp, round((re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / 64 / 16, 6) AS value FROM f""")
def spectrogram_long(spark, sf):
    d = spectral.spectrogram(_packed(spark, sf), 4, None, 4.0, add_resultant=False)
    return d.select("series_id", "axis", R6("freq").alias("freq"), R6("timestamp").alias("timestamp"), R6("value").alias("value"))


@query(f"""WITH {PK}, g AS (SELECT series_id, s, i - s * 16 AS j, v FROM pk, range(4) r(s) WHERE i >= s * 16 AND i < s * 16 + 16), m AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id, s) AS x FROM g), k AS (SELECT k FROM range(1, 9) r(k)),
f AS (SELECT series_id, s, k, sum(x * cos(2 * pi() * k * j / 16)) AS re, sum(x * sin(2 * pi() * k * j / 16)) AS im FROM m, k GROUP BY 1, 2, 3), p AS (SELECT series_id, s, k, (re * re + im * im) * CASE WHEN k = 8 THEN 1 ELSE 2 END AS p FROM f)
SELECT series_id, round(CAST(s AS DOUBLE) * 0.25 + 0.125, 6) AS timestamp, arg_max(CAST(k * 4 AS DOUBLE), p) AS freq FROM p GROUP BY 1, 2""")
def peak_frequency_over_time(spark, sf):
    d = spectral.spectrogram(_packed(spark, sf), 4, None, 4.0, add_resultant=False)
    return spectral.spectrum_over_time(d, "peak").select("series_id", R6("timestamp").alias("timestamp"), "freq")


# ---- shock -------------------------------------------------------------------------------------------------------

_F = [2.0, 5.0, 11.0]
_IIR = f"""WITH RECURSIVE {PK}, c0(freq) AS (VALUES {", ".join(f"({f})" for f in _F)}),
c1 AS (SELECT freq, exp(-a) AS e, cos(b) AS cb, sin(b) / b AS sb FROM (SELECT freq, 2 * pi() * freq / 64 * 0.05 AS a, 2 * pi() * freq / 64 * sqrt(1 - 0.0025) AS b FROM c0)),
c AS (SELECT freq, 1 - e * sb AS b0, 2 * e * (sb - cb) AS b1, e * e - e * sb AS b2, -2 * e * cb AS a1, e * e AS a2 FROM c1),
x AS (SELECT * FROM pk),
r AS (SELECT series_id, freq, 0 AS i, b0 * v AS y, b1 * v - a1 * (b0 * v) AS z1, b2 * v - a2 * (b0 * v) AS z2, b0, b1, b2, a1, a2 FROM x, c WHERE i = 0
UNION ALL SELECT r.series_id, freq, r.i + 1, b0 * v + z1, b1 * v - a1 * (b0 * v + z1) + z2, b2 * v - a2 * (b0 * v + z1), b0, b1, b2, a1, a2 FROM r JOIN x ON x.series_id = r.series_id AND x.i = r.i + 1)
"""


@query(_IIR + "SELECT series_id, CAST(i AS BIGINT) AS i, round(y, 6) + 0.0 AS v FROM r WHERE freq = 5.0")
def sdof_abs_accel(spark, sf):
    return shock.response(_packed(spark, sf), 2 * math.pi * 5.0, 0.05).select("series_id", "i", R6("v").alias("v"))


@query(_IIR + "SELECT series_id, CAST(freq AS DOUBLE) AS freq, round(least(min(y), 0), 6) + 0.0 AS lo, round(greatest(max(y), 0), 6) + 0.0 AS hi FROM r GROUP BY 1, 2")
def response_extremes(spark, sf):
    return shock.response_extremes(_packed(spark, sf), _F, 0.05).select("series_id", "freq", R6("lo").alias("lo"), R6("hi").alias("hi"))


@query(f"WITH {SPEC} SELECT series_id, round(2 * pi() * max(freq * value), 2) AS amplitude, round(max(value) / (4 * max(freq * value)), 9) AS duration FROM spec GROUP BY 1")
def halfsine_envelope(spark, sf):
    return shock.enveloping_half_sine(_spec(spark, sf)).select("series_id", R6("amplitude", 2).alias("amplitude"), R6("duration", 9).alias("duration"))


@query("SELECT i, round(CAST(i AS DOUBLE) * 0.001, 6) AS t, round(CASE WHEN i * 0.001 >= 0.01 AND i * 0.001 < 0.01 + 0.02 THEN 50 * sin(pi() * (i * 0.001 - 0.01) / 0.02) ELSE 0 END, 6) + 0.0 AS v FROM range(60) r(i)")
def halfsine_series(spark, sf):
    p = spark.createDataFrame([("s", "v", 50.0, 0.02)], "series_id string, axis string, amplitude double, duration double")
    return shock.pulse_time_series(p, 0.0, 0.06, 0.001, 0.01).select("i", R6("t").alias("t"), R6("v").alias("v"))


@query(f"WITH {SPEC} SELECT series_id, freq, round(value * 386.08858267716533 / nullif(2 * pi() * freq, 0), 2) AS velocity, round(value * 386.08858267716533 / nullif(pow(2 * pi() * freq, 2), 0), 2) AS displacement FROM spec")
def four_coordinates(spark, sf):
    return shock.on_four_coordinates(_spec(spark, sf)).select("series_id", "freq", R6("velocity", 2).alias("velocity"), R6("displacement", 2).alias("displacement"))


@query()
def shock_vibe_metrics(spark, sf):
    return metrics.shock_vibe_metrics(_tri(spark, sf), freq_splits=(0, 10, 30, None), include_resultant=True)


@query()
def rolling_metrics(spark, sf):
    return metrics.rolling_metrics(_tri(spark, sf), 5, freq_splits=(0, 10, 30, None), include_integration=False)


# ---- functions ---------------------------------------------------------------------------------------------------

_Q = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity*l_tax - l_discount*l_quantity - l_tax*l_discount - l_linenumber*l_linenumber, 6) + 0.0 AS w, round(l_quantity*l_quantity + l_discount*l_tax + l_tax*l_linenumber - l_linenumber*l_discount, 6) + 0.0 AS x,
round(l_tax / nullif(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax + l_linenumber*l_linenumber, 0) * -1, 9) + 0.0 AS iy FROM lineitem""")
def quat_mul_inv(spark, sf):
    d = _t(spark, sf, "lineitem")
    p, q = qn.quat(*_Q), qn.quat("l_tax", "l_quantity", "l_discount", "l_linenumber")
    m, v = qn.mul(p, q), qn.inv(p)
    return d.select("l_orderkey", "l_linenumber", R6(m["w"]).alias("w"), R6(m["x"]).alias("x"), R6(v["y"], 9).alias("iy"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_discount*30 AS x, l_tax*30 AS y, l_linenumber AS z FROM lineitem), n AS (SELECT l_orderkey, l_linenumber, w/s AS w, x/s AS x, y/s AS y, z/s AS z FROM (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS s FROM q))
SELECT l_orderkey, l_linenumber, round(atan2(2*(w*x+y*z), 1-2*(x*x+y*y)), 6) + 0.0 AS x, round(asin(2*(w*y-z*x)), 6) + 0.0 AS y, round(atan2(2*(w*z+x*y), 1-2*(y*y+z*z)), 6) + 0.0 AS z FROM n""")
def quaternion_to_euler(spark, sf):
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("W"), (F.col("l_discount") * 30).alias("X"), (F.col("l_tax") * 30).alias("Y"), F.col("l_linenumber").cast("double").alias("Z"))
    x, y, z = qn.to_euler(qn.quat("W", "X", "Y", "Z"), "xyz")
    return d.select("l_orderkey", "l_linenumber", R6(x).alias("x"), R6(y).alias("y"), R6(z).alias("z"))


@query("SELECT c_custkey, round(c_acctbal * 1.8 + 32, 6) AS degf, round(c_acctbal * 25.4, 6) AS mm FROM customer")
def unit_convert(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", R6(convert_units("c_acctbal", "degC", "degF")).alias("degf"), R6(convert_units("c_acctbal", "in", "mm")).alias("mm"))


@query("SELECT o_orderkey, round(20 * (log10(o_totalprice) - log10(2e-5)), 6) AS db FROM orders")
def to_decibel(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", R6(to_db("o_totalprice", "SPL")).alias("db"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_attributes(spark, sf):
    e = _t(spark, sf, "events")
    a = F.array(F.struct(F.lit("k").alias("name"), F.lit("float").alias("type"), F.get_json_object("props", "$.k").alias("value")))
    d = tx.attributes_table(e.select(F.col("event_id").alias("id"), a.alias("attributes")), [("k", "float")])
    return d.select(F.col("id").alias("event_id"), "k")


@query("""SELECT event_id, CASE WHEN d > 0 THEN CAST(d AS VARCHAR) || 'd ' ELSE '' END || CASE WHEN h > 0 OR d > 0 THEN lpad(CAST(h AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(s AS VARCHAR), 2, '0') || '.' || lpad(CAST(f AS VARCHAR), 4, '0') AS txt
FROM (SELECT event_id, u // 86400000000 AS d, u // 3600000000 % 24 AS h, u // 60000000 % 60 AS m, u // 1000000 % 60 AS s, u % 1000000 // 1000 AS f FROM (SELECT event_id, epoch_us(ts) - 1704067200000000 AS u FROM events))""")
def format_times(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    return _t(spark, sf, "events").select("event_id", tx.format_timedelta(us).alias("txt"))


@query("SELECT o_orderkey, CAST((o_orderkey % 24) * 3600000000 + (o_orderkey % 60) * 60000000 + (o_orderkey % 50) * 1000000 AS BIGINT) AS us FROM orders")
def parse_times(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat_ws(":", (k % 24).cast("string"), (k % 60).cast("string"), (k % 50).cast("string"))
    return _t(spark, sf, "orders").select("o_orderkey", tx.parse_time_column(text).alias("us"))


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'id' || CAST(s_suppkey AS VARCHAR) WHEN s_suppkey % 3 = 1 THEN 'f' || CAST(s_suppkey AS VARCHAR) END AS file FROM supplier""")
def drive_ids(spark, sf):
    k = F.col("s_suppkey").cast("string")
    url = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://x.example/open?id=id"), k)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("https://x.example/file/d/f"), k, F.lit("/view?usp=a"))).otherwise(F.lit("https://x.example/none"))
    return _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", files.drive_file_id(url).alias("file"))


@query("SELECT round(degrees(atan2(avg(sin(radians(c_acctbal/200)) * cos(radians(c_nationkey))), avg(cos(radians(c_acctbal/200)) * cos(radians(c_nationkey))))), 6) AS lat FROM customer")
def centre_of_points(spark, sf):
    d = _t(spark, sf, "customer").select((F.col("c_acctbal") / 200).alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    return d.agg(qn.centre_of_coordinates().alias("c")).select(R6("c.lat").alias("lat"))


@query("""WITH e AS (SELECT least(greatest(greatest((max(c_nationkey) - min(c_nationkey)) * 1.2, (max(c_acctbal) - min(c_acctbal)) / 500 * 2.4), 360 / pow(2, 19)), 360) AS w FROM customer)
SELECT round(j + 1 + (360 / pow(2, j) - w) / (360 / pow(2, j + 1)), 2) AS zoom FROM (SELECT w, floor(log2(360 / w) + 1e-12) AS j FROM e)""")
def map_zoom(spark, sf):
    d = _t(spark, sf, "customer").select((F.col("c_acctbal") / 500).alias("lat"), F.col("c_nationkey").cast("double").alias("lon"))
    return d.agg(qn.map_zoom(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).alias("zoom"))


# ---- joins, logs, reshaping --------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT conv_id, block, count(*) AS n, min(turn) AS first_turn FROM b WHERE block > 0 GROUP BY 1, 2""")
def nmea_blocks(spark, sf):
    d = logs.blocks(_t(spark, sf, "conversations"), F.col("role") == "user", "conv_id", ["turn"]).filter("block > 0")
    return d.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


@query("SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def meta_left_join(spark, sf):
    meta = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return joins.lookup(_t(spark, sf, "orders"), meta, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query(f"WITH {SPEC} SELECT freq, round(max(CASE WHEN series_id = 'A' THEN value END), 2) AS a, round(max(CASE WHEN series_id = 'R' THEN value END), 2) AS r FROM spec WHERE series_id IN ('A', 'R') GROUP BY 1")
def align_full_outer(spark, sf):
    s = _spec(spark, sf)
    d = joins.aligned({"a": s.filter("series_id = 'A'"), "r": s.filter("series_id = 'R'")}, ["freq"])
    return d.select("freq", R6("a", 2).alias("a"), R6("r", 2).alias("r"))


@query("""SELECT l.event_id, r.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT ts, value FROM (SELECT ts, value, row_number() OVER (PARTITION BY ts ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'view') WHERE k = 1) r ON l.ts >= r.ts""")
def asof_join(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "event_type", "ts", "value", F.lit(1).alias("k"))
    left, right = e.filter("event_type = 'click'").select("k", "ts", "event_id"), e.filter("event_type = 'view'").select("k", "ts", F.col("value").alias("last_view"))
    return joins.asof(left, right, ["k"], "ts", ["last_view"]).select("event_id", "last_view")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def element_paths(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    d = joins.lookup(_t(spark, sf, "supplier"), n, ["s_nationkey"], "inner")
    return joins.lookup(d, _t(spark, sf, "region"), ["r_regionkey"], "inner").select("s_suppkey", "n_name", "r_name")


@query("""SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def tree_paths(spark, sf):
    r = _t(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = _t(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    return logs.tree_paths(r.unionByName(n)).select("id", "depth", F.array_join("path", "/").alias("path"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, -CAST((a.n_regionkey - b.n_regionkey) * (a.n_regionkey - b.n_regionkey) + (a.n_nationkey - b.n_nationkey) * (a.n_nationkey - b.n_nationkey) AS DOUBLE) + 0.0 AS d FROM nation a, nation b")
def pairwise_distance(spark, sf):
    n = _t(spark, sf, "nation").select("n_nationkey", F.array(F.col("n_regionkey").cast("double"), F.col("n_nationkey").cast("double")).alias("x"))
    return multivariate.negative_squared_distances(n, "n_nationkey", "x").withColumn("d", F.col("d") + 0.0)


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) + 0.0 FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) + 0.0 FROM lineitem")
def correlation_matrix(spark, sf):
    return multivariate.correlations(_t(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")).withColumn("corr", R6("corr"))


# ---- streams (the same plans, over tables) -----------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(value) AS n, round(sqrt(avg(value*value)), 6) AS rms, max(abs(value)) AS peak FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf):
    from .streaming.streams import window_metrics

    d = window_metrics(_t(spark, sf, "events"), "ts", "event_type", "value", "6 hours")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", R6("rms").alias("rms"), "peak")


@query("""WITH s AS (SELECT *, sum(CASE WHEN ts < p + INTERVAL '2 hours' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, min(ts) AS start, count(value) AS n, max(abs(value)) AS peak FROM s GROUP BY user_id, g""")
def session_window(spark, sf):
    from .streaming.streams import session_metrics

    d = session_metrics(_t(spark, sf, "events"), "ts", "user_id", "value", "2 hours")
    return d.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "peak")


# ---- batch -------------------------------------------------------------------------------------------------------


def _recordings(spark, sf) -> DataFrame:
    return _tri(spark, sf).withColumns({"type": F.lit("Acceleration"), "unit": F.lit("g")})


@query(f"""WITH {TRI}, r AS (SELECT series_id, axis, sqrt(avg(v*v)) AS x FROM tri GROUP BY 1, 2), p AS (SELECT series_id, axis, v FROM tri UNION ALL SELECT series_id, 'Resultant', sqrt(sum(v*v)) FROM tri GROUP BY series_id, i)
SELECT series_id, 'RMS Acceleration' AS calculation, axis, round(x, 3) AS value FROM r UNION ALL SELECT series_id, 'RMS Acceleration', 'Resultant', round(sqrt(sum(x*x)), 3) FROM r GROUP BY 1 UNION ALL SELECT series_id, 'Peak Absolute Acceleration', axis, round(max(abs(v)), 3) FROM p GROUP BY 1, 3""")
def batch_metrics(spark, sf):
    b = batch.Builder(batch.Params(highpass=None)).add_metrics(["RMS Acceleration", "Peak Absolute Acceleration"])
    return b.aggregate(_recordings(spark, sf))["metrics"].select("series_id", "calculation", "axis", R6("value", 3).alias("value"))


@query("SELECT p_partkey, round(p_retailprice, 1) AS p_retailprice FROM part")
def rounded_table(spark, sf):
    return views.rounded_table(_t(spark, sf, "part").select("p_partkey", "p_retailprice"), 1)


@query("SELECT series_id, round(t, 3) AS t, max(CASE WHEN axis = 'l_quantity' THEN v END) AS q, max(CASE WHEN axis = 'l_discount' THEN v END) AS d FROM (WITH " + TRI + " SELECT * FROM tri) GROUP BY series_id, i, t")
def scan_wide(spark, sf):
    d = files.wide(_tri(spark, sf), ["l_quantity", "l_discount"], "seconds")
    return d.select("series_id", R6("t", 3).alias("t"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))


