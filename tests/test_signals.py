"""Signal operators on the session: equal formulations, invariances, contracts of batch outputs, sources, streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vibespark.functions import quaternion as qn
from vibespark.functions import text as tx
from vibespark.model import haloed, running_sum, spacing
from vibespark.operators import filters, joins, multivariate, shock, spectral, stats, windows
from vibespark.plans import batch, metrics, views
from vibespark.sources import catalog, files, logs
from vibespark.streaming import streams

SIGNAL = "series_id string, axis string, i long, t double, v double"


def make(spark, series, dt=0.001):
    rows = [(s, a, i, i * dt, float(v)) for (s, a), x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "axis", "i", "t", "v"]), SIGNAL)


def values(d, series="s", axis="A", column="v", by="i"):
    rows = d.filter((F.col("series_id") == series) & (F.col("axis") == axis)).orderBy(by).collect()
    return np.array([r[column] for r in rows], float)


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(7)
    d = make(spark, {("s", "A"): rng.normal(size=3000), ("s", "B"): rng.normal(size=3000), ("q", "A"): rng.normal(size=900)}).persist()
    d.count()
    return d


def test_chunked_frames_equal_whole_ones(noise):
    x = values(noise)
    want = pd.Series(x).rolling(40).apply(lambda v: math.sqrt((v * v).mean()))
    got = values(windows.rolling(noise, 40))
    assert np.allclose(got[39:], want[39:]) and np.isnan(got[:39]).all()
    small = haloed(noise, 5, 2, size=100)
    assert small.filter("core").count() == noise.count()
    s = running_sum(noise, F.col("v"), "s", size=100)
    assert np.allclose(values(s, column="s"), np.cumsum(x))


def test_integration_is_undone_by_differences(noise):
    x, y = values(noise), values(windows.integrate(noise))
    assert y[0] == 0 and np.allclose(np.diff(y), 0.001 * (x[1:] + x[:-1]) / 2)
    m = values(windows.integrate(noise, "mean"))
    assert abs(m.mean()) < 1e-9


def test_parseval(noise):
    p = spectral.welch(noise, None, "parseval", "boxcar", nperseg=1000, overlap=0.0, detrend=None)
    x = values(noise)
    assert values(p, column="value", by="freq").sum() == pytest.approx((x * x).mean())


def test_welch_of_a_sine(spark):
    t = np.arange(4000) / 1000
    d = make(spark, {("s", "A"): 3 * np.sin(2 * np.pi * 50 * t)})
    u = spectral.aggregate_fft(d, 1.0).orderBy(F.desc("value")).first()
    assert u.freq == pytest.approx(50, abs=0.02) and u.value == pytest.approx(3, rel=1e-3)
    assert spectral.welch(d, 1.0, average="median").count() == 501
    with pytest.raises(ValueError):
        spectral.welch(d, scaling="odd")


def test_transforms_equal_numpy(noise):
    x = values(noise, "q")
    r = spectral.rfft(noise, "complex", norm="forward", optimize=False)
    want = np.fft.rfft(x) / len(x)
    assert np.allclose(values(r, "q", column="re", by="freq"), want.real) and np.allclose(values(r, "q", column="im", by="freq"), want.imag)
    k = np.arange(len(x))
    c = values(spectral.dct(noise, norm="backward"), "q", column="value", by="freq")
    s = values(spectral.dst(noise, norm="ortho"), "q", column="value", by="freq")
    assert np.allclose(c[:5], [2 * (x * np.cos(np.pi * j * (2 * k + 1) / (2 * len(x)))).sum() for j in range(5)])
    assert (s * s).sum() == pytest.approx((x * x).sum())
    with pytest.raises(ValueError):
        spectral.rfft(noise, "odd")


def test_slices_equal_manual_ones(noise):
    c = windows.slice_centres(noise.filter("series_id = 's'"), indexes=[500, 1500], slice_width=0.2)
    got = windows.slice_metrics(noise, c).filter("axis = 'A'").orderBy("slice").collect()
    x = values(noise)
    assert [r.n for r in got] == [200, 200]
    assert [r.rms for r in got] == pytest.approx([math.sqrt((x[a:b] ** 2).mean()) for a, b in ((400, 600), (1400, 1600))])
    p = spectral.rolling_psd(noise.filter("series_id = 's'"), 10.0, indexes=[500, 1500], slice_width=0.2, add_resultant=False)
    one = make(noise.sparkSession, {("s", "A"): x[400:600]})
    want = values(spectral.welch(one, 10.0), column="value", by="freq")
    assert np.allclose(values(p.filter("timestamp < 1"), column="value", by="freq"), want)


def test_peaks_equal_a_greedy_search(noise):
    x = np.abs(values(noise, "q"))
    got = [r.i for r in windows.find_peaks(noise.filter("series_id = 'q'"), 0.02, None, "peak", 0.3).orderBy("i").collect()]
    cand = [k for k in range(1, len(x) - 1) if x[k] > x[k - 1] and x[k] > x[k + 1] and x[k] >= 0.3 * x.max()]
    keep = []
    for k in sorted(cand, key=lambda k: -x[k]):
        if all(abs(k - j) >= 20 for j in keep):
            keep.append(k)
    assert got == sorted(keep)


def test_filters_on_signals(noise):
    y = values(filters.butterworth(noise, 50.0, None, 3, 0.1))
    x = values(noise)
    want = filters.zero_phase(x, filters.sections("butterworth", 3, "highpass", [50.0], 1000.0)) * spectral.tukey(len(x), 0.1)
    assert np.allclose(y, want, atol=1e-9)
    assert np.allclose(values(filters.taper(noise, 0.2)), x * spectral.tukey(len(x), 0.2))
    for f in (filters.bessel, filters.cheby1, filters.cheby2, filters.ellip):
        assert f(noise, None, 100.0).count() == noise.count()
    assert filters.butterworth(noise, None, None).count() == noise.count()


def test_resampling_a_cosine(spark):
    t = np.arange(50) / 50
    d = make(spark, {("s", "A"): np.cos(2 * np.pi * 3 * t)}, 1 / 50)
    for rate in (20, 33, 80):
        y = values(filters.resample(d, rate))
        assert np.allclose(y, np.cos(2 * np.pi * 3 * np.arange(rate) / rate))
    n = filters.band_limited_noise(spark, 10, 50, 1.0, 1000, "rms", 3)
    assert n.agg(stats.rms()).first()[0] == pytest.approx(1.0)


def test_shock_spectrum_ignores_trailing_zeros(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    d = make(spark, {("a", "A"): x, ("b", "A"): np.concatenate([x, np.zeros(300)])})
    f = [5.0, 20.0, 77.0]
    s = shock.shock_spectrum(d, f)
    assert np.allclose(values(s, "a", column="value", by="freq"), values(s, "b", column="value", by="freq"), rtol=1e-6)
    e = shock.response_extremes(d.filter("series_id = 'b'"), f).orderBy("freq").collect()
    assert [max(-r.lo, r.hi) for r in e] == pytest.approx(values(s, "b", column="value", by="freq").tolist(), rel=1e-6)
    agg = shock.shock_spectrum(d, f, aggregate_axes=True)
    assert {r.axis for r in agg.select("axis").distinct().collect()} == {"Resultant"}
    rolled = shock.rolling_shock_spectrum(d.filter("series_id = 'b'"), 2, freqs=f)
    assert rolled.select("timestamp").distinct().count() == 2
    assert shock.shock_spectrum(d, f, max_time=0.1).count() == 6
    with pytest.raises(ValueError):
        shock.shock_spectrum(d, f, mode="odd")


def test_enveloping_pulse(spark):
    pv = spark.createDataFrame([("s", "A", float(f), 10.0 / f) for f in range(1, 41)], "series_id string, axis string, freq double, value double")
    p = shock.enveloping_half_sine(pv, 0.05)
    series = shock.pulse_time_series(p)
    back = shock.shock_spectrum(series, [float(f) for f in range(1, 41)], damp=0.05, mode="pvss")
    got, want = values(back, column="value", by="freq"), 10.0 / np.arange(1, 41)
    assert (want / got).max() < 1.2


def test_nearest_and_intervals(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 2.4), (1, 9.0), (2, 1.0)], "k long, t double").withColumn("name", F.lit("x"))
    b = spark.createDataFrame([(1, 1.0, 10), (1, 3.0, 30), (1, 5.0, 50)], "k long, t double, v long")
    got = lambda d: [(r.k, r.t, r.v) for r in d.orderBy("k", "t").collect()]
    assert got(joins.asof(a, b, ["k"], "t", ["v"])) == [(1, 0.0, None), (1, 2.4, 10), (1, 9.0, 50), (2, 1.0, None)]
    assert got(joins.asof(a, b, ["k"], "t", ["v"], "forward")) == [(1, 0.0, 10), (1, 2.4, 30), (1, 9.0, None), (2, 1.0, None)]
    assert got(joins.asof(a, b, ["k"], "t", ["v"], "nearest", 1.5)) == [(1, 0.0, 10), (1, 2.4, 30), (1, 9.0, None), (2, 1.0, None)]
    i = spark.createDataFrame([(0.0, 2.0, "p"), (2.0, 8.0, "q")], "lo double, hi double, n string")
    assert sorted((r.t, r.n) for r in joins.in_interval(b, i, "t", "lo", "hi", 2.0).collect()) == [(1.0, "p"), (3.0, "q"), (5.0, "q")]


def test_quaternions(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (0.5, -1.0, 0.25, 2.0)], "w double, x double, y double, z double")
    q = qn.quat("w", "x", "y", "z")
    one = d.select(qn.mul(q, qn.inv(q)).alias("a"), qn.div(q, q).alias("b"), qn.norm2(qn.mul(q, qn.conj(q))).alias("n"), (qn.norm2(q) * qn.norm2(q)).alias("m")).collect()
    for r in one:
        assert list(r.a) == pytest.approx([1, 0, 0, 0]) and list(r.b) == pytest.approx([1, 0, 0, 0]) and r.n == pytest.approx(r.m)
    a = 0.7
    e = spark.createDataFrame([(math.sin(a / 2), 0.0, 0.0, math.cos(a / 2))], "X double, Y double, Z double, W double")
    r = qn.quaternion_to_euler(e, "roll-pitch-yaw").first()
    assert (r.roll, r.pitch, r.yaw) == pytest.approx((a, 0, 0))
    named = e.toDF("qx", "qy", "qz", "qw")
    assert list(qn.quaternion_to_euler(named, "xyx", "qx", "qy", "qz", "qw").select("x0", "y", "x2").first()) == pytest.approx([a, 0, 0])
    turn = [("s", k, k * 0.1, (math.cos(k * 0.05), math.sin(k * 0.05), 0.0, 0.0)) for k in range(11)]
    t = spark.createDataFrame(turn, "series_id string, i long, t double, q struct<w: double, x: double, y: double, z: double>")
    w = qn.angular_velocity(t, dt=0.1).orderBy("i").collect()
    assert [x.wx for x in w] == pytest.approx([1.0] * 11, abs=3e-3)
    frames = qn.resample_quaternions(t, 4).orderBy("frame").collect()
    assert [f.q.x for f in frames] == pytest.approx([math.sin(f.t / 2) for f in frames], abs=1e-9) and len(frames) >= 4
    assert frames[1].ey.z == pytest.approx(math.sin(0.25), abs=1e-6)


def test_logs(spark):
    block = b"$GPRMC,171839.00,A,3958.2,N,08305.4,W,0.1,,100622,,*1\r\n$GPVTG,12.5,T,,M,0.1,N,0.3,K*2\r\n$GPGGA,171839,3958.2,N,08305.4,W,2,08*3\r\n$GPGSV,1,1,09,01*4\r\n$GPGLL,3958*5\r\n"
    raw = b"junk\r\n" + block + block.replace(b"39.00", b"40.00") + b"$GPRM"
    rows = [("s", k // 37, bytearray(raw[k : k + 37])) for k in range(0, len(raw), 37)]
    d = spark.createDataFrame(rows, "series_id string, seq long, payload binary")
    lines = logs.sentences(d)
    assert lines.count() == 10
    got = logs.measurements(logs.parse_sentences(lines)).orderBy("ts").collect()
    assert len(got) == 2 and str(got[0].ts) == "2022-06-10 17:18:39" and got[0].latitude == pytest.approx(39.97) and got[0].longitude == pytest.approx(-83.09) and got[0].quality == 2 and got[0].direction == 12.5
    assert logs.measurements(logs.parse_sentences(lines), 10).count() == 0
    e = spark.createDataFrame([(1, None, "Root", None), (2, 1, "Config", None), (3, 2, "ConfigID", str(0xBFF7F)), (4, 2, "IntValue", "-18000"), (5, 1, "Other", "x")], "id long, parent_id long, name string, value string")
    assert logs.utc_offset(e) == -18000 and logs.utc_offset(e.filter("id <> 4")) == 0
    assert [r.id for r in logs.elements_at(e, ["Root", "Config", "IntValue"]).collect()] == [4]
    assert {tuple(r.path) for r in logs.tree_paths(e).collect()} >= {("Root", "Config", "ConfigID")}


def test_sources_and_sinks(spark, tmp_path, noise):
    path = tmp_path / "r1.csv"
    path.write_text("t,X,Y\n0.0,1,2\n0.5,3,4\n1.0,5,6\n")
    spark.dataSource.register(files.RecordingSource)
    d = spark.read.format("recording").option("path", str(path)).option("start", "0.4").load()
    assert sorted((r.axis, r.t, r.v) for r in d.collect()) == [("X", 0.5, 3.0), ("X", 1.0, 5.0), ("Y", 0.5, 4.0), ("Y", 1.0, 6.0)]
    files.extract_time(noise, str(tmp_path / "out"), 0.1, 0.2)
    back = files.open_signal(spark, str(tmp_path / "out"), start=0.15, channels=["A"])
    assert back.count() == 2 * 51 and "GreaterThanOrEqual(t,0.15)" in back._jdf.queryExecution().toString()
    with pytest.raises(TypeError):
        files.open_signal(spark)
    files.write_csv_folder({"x": back.limit(3)}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "x.csv")).count() == 3
    w = files.wide(noise.filter("series_id = 's'"), ["A", "B"], "timedelta")
    assert w.count() == 3000 and w.schema["time"].dataType.simpleString().startswith("interval")
    page = '{"data": [{"id": "1", "file_name": "a.ide", "tags": ["t"], "recording_ts": 10, "attributes": [{"name": "peak", "type": "float", "value": "1.5"}, {"name": "psd", "type": "array", "value": "[1, nan]"}, {"name": "location", "type": "string", "value": "1.5,2.5"}]}]}'
    t = files.file_pages(spark, [page, page.replace('"1"', '"2"')], 2)
    a = tx.attributes_table(t).orderBy("id").first()
    assert a.peak == 1.5 and a.psd[0] == 1.0 and math.isnan(a.psd[1]) and (a.location_lat, a.location_lon) == (1.5, 2.5)
    files.attributes_csv(t, str(tmp_path / "attr"))
    ok = spark.createDataFrame([(bytearray(b"\x1a\x01a\x1a\x00"),), (bytearray(b"zzzz"),), (None,)], "c binary").select(files.valid_header(F.col("c"), [0x1A]).alias("k")).collect()
    assert [r.k for r in ok] == [True, False, False]


def test_catalog_choice(spark, noise):
    c = spark.createDataFrame([("s", "A", "Acceleration"), ("s", "B", "Pressure"), ("q", "A", "Acceleration")], "series_id string, axis string, type string")
    assert catalog.filter_channels(c, "acc").count() == 2 and catalog.filter_channels(c, "-acc").count() == 1
    assert catalog.channel_table(noise, c, "acc").count() == 2
    assert catalog.primary_sensor_data(noise, c, "acc").select("series_id").distinct().collect()[0][0] == "s"
    with pytest.raises(ValueError):
        catalog.primary_sensor_data(noise, c, "gps")
    assert catalog.primary_sensor_data(noise, c, "gps", force=True).count() == 6000
    assert c.select(catalog.measurement_type(F.col("type")).alias("k")).distinct().count() == 2


def test_metrics_equal_the_chain(noise):
    s = noise.filter("series_id = 'q'")
    m = {(r.axis, r.calculation): r.value for r in metrics.shock_vibe_metrics(s, freq_splits=(0, 65, 300, None), bin_width=5.0).collect()}
    x = values(s, "q")
    y = (x - np.median(x)) * spectral.tukey(len(x), 0.1)
    assert m["A", "Acceleration Peak"] == pytest.approx(np.abs(y).max())
    assert m["A", "Acceleration RMS"] == pytest.approx(math.sqrt((y[45:-45] ** 2).mean()))
    assert {c for _, c in m} >= {"Velocity Peak", "Displacement RMS", "Peak Frequency", "RMS from 0 to 65"}


def test_batch_tables(spark, noise):
    sig = noise.withColumns({"type": F.lit("Acceleration"), "unit": F.lit("g")})
    meta = spark.createDataFrame([("s", 7), ("q", 8)], "series_id string, `serial number` long")
    b = batch.Builder(batch.Params(highpass=5.0)).add_psd(5.0).add_pvss(20.0, 3.0).add_pvss_halfsine_envelope().add_metrics(["RMS Acceleration", "RMS Velocity"]).add_peaks(10).add_vc_curves(10.0)
    out = b.aggregate(sig, meta)
    assert list(out) == ["meta", "psd", "pvss", "halfsine", "metrics", "peaks", "vc_curves"]
    want = {"psd": ["axis", "freq", "value"], "pvss": ["axis", "freq", "value"], "halfsine": ["axis", "timestamp", "value"], "metrics": ["calculation", "axis", "value"], "peaks": ["axis", "peak time", "peak offset", "value"], "vc_curves": ["axis", "freq", "value"]}
    for name, cols in want.items():
        assert set(out[name].columns) == {"series_id", "serial number", *cols}, name
        assert out[name].limit(1).count() == 1, name
    with pytest.raises(RuntimeError):
        b.add_pvss()
    with pytest.raises(ValueError):
        batch.Builder().add_psd()
    with pytest.raises(ValueError):
        batch.Params(start_time=1.0, start_margin=1.0)


def test_derived_channels(spark):
    rows = [("s", k, u, "v", i, i * 0.1, 10.0 + i) for k, u in (("Pressure", "psi"), ("Temperature", "°F"), ("Audio", "A"), ("Humidity", "RH"), ("Speed", "m/s")) for i in range(3)]
    c = batch.Channels(spark.createDataFrame(rows, "series_id string, type string, unit string, axis string, i long, t double, v double"))
    first = lambda d: d.filter("i = 0").first().v
    assert first(c.pressure) == pytest.approx(68.9476) and first(c.temperature) == pytest.approx(-12.2222, abs=1e-3)
    assert first(c.microphone) == pytest.approx(-53.075) and first(c.humidity) == 10 and first(c.gps_speed) == 36
    assert c.acceleration.count() == 0 and c.gyroscope.count() == 0
    for name in ("Average Temperature", "Average Pressure", "RMS Microphone", "RMS Microphone Decibels", "GPS Speed", "RMS Angular Velocity", "GPS Position"):
        batch.METRICS[name](c).collect()
    bad = batch.Channels(spark.createDataFrame([("s", "Pressure", "furlong", "v", 0, 0.0, 1.0)], "series_id string, type string, unit string, axis string, i long, t double, v double"))
    with pytest.raises(Exception, match="unknown unit"):
        bad.pressure.collect()


def test_multivariate(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=60)
    rows = [(k, float(a[k]), float(2 * a[k] + 0.01 * rng.normal()), 1.0, None if k == 3 else 2.0) for k in range(60)]
    d = spark.createDataFrame(rows, "id long, p double, q double, c double, n double")
    assert multivariate.useful_columns(d, ("id",)) == ["p", "q"] and "n" in multivariate.non_null_columns(d)
    pc = multivariate.pca(d, skip=("id",)).agg(F.var_samp("pc1"), F.var_samp("pc2")).first()
    assert pc[0] == pytest.approx(2, abs=0.01) and pc[1] < 0.01
    y = multivariate.tsne(d.select("id", "p", "q"), ("id",), 10, iterations=50)
    assert y.count() == 60 and y.filter("x IS NULL OR isnan(x)").count() == 0
    with pytest.raises(ValueError):
        multivariate.tsne(d, max_rows=10)
    assert views.attribute_points(d, ["p", "n"]).count() == 120 and views.theme("dark")["text"]
    gps = spark.createDataFrame([(10.0, 20.0, 1.0), (10.0, 20.0, 0.0)], "lat double, lon double, c double")
    v = views.map_view(gps, positive="c").first()
    assert (v.centre.lat, v.centre.lon) == pytest.approx((10, 20)) and v.zoom == 20.0


def test_own_aggregates(noise):
    col = {r.series_id: r.value for r in stats.aggregate_with(noise.filter("axis = 'A'"), lambda v: F.max(v)).collect()}
    arr = {r.series_id: r.value for r in stats.aggregate_with(noise.filter("axis = 'A'"), np.max).collect()}
    assert col == arr


def test_trims_and_prefix(spark):
    x = np.ones(100)
    x[3] = 50
    d = make(spark, {("s", "A"): x, ("r", "A"): np.ones(100)})
    out = windows.strip_invalid_prefix(d)
    assert out.filter("series_id = 's'").agg(F.min("i")).first()[0] == 5 and out.filter("series_id = 'r'").count() == 100
    assert windows.trimmed(d, 0.01, 0.02).filter("series_id = 's'").count() == 11
    assert spacing(make(spark, {("x", "A"): [1.0]})).first().dt is None


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    d = make(spark, {("s", "A"): x})
    folder = str(tmp_path / "in")
    for k in range(4):
        d.filter(F.col("i").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(folder)
    freqs = [5.0, 40.0]
    src = spark.readStream.schema(SIGNAL).parquet(folder)
    streams.to_table(streams.running_shock_spectrum(src, freqs, 0.001), "srs_stream", "update", str(tmp_path / "c1"))
    got = {r.freq: r.value for r in spark.table("srs_stream").collect() if r.samples == 400}
    co = shock.coefficients("absolute_acceleration", 2 * np.pi * np.array(freqs), 10, 0.001)
    assert [got[f] for f in freqs] == pytest.approx(np.abs(shock.filtered(x, *co)).max(axis=1).tolist())
    text = b"".join(b"$GPX,%d\r\n" % k for k in range(50))
    rows = [("s", k // 11, bytearray(text[k : k + 11])) for k in range(0, len(text), 11)]
    spark.createDataFrame(rows, "series_id string, seq long, payload binary").coalesce(1).write.parquet(str(tmp_path / "raw"))
    src = streams.read_stream(spark, str(tmp_path / "raw"), "series_id string, seq long, payload binary")
    streams.to_table(streams.sentence_stream(src), "lines_stream", "append", str(tmp_path / "c2"))
    assert sorted(r.sentence for r in spark.table("lines_stream").collect()) == sorted(f"$GPX,{k}" for k in range(50))


def test_window_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    src = streams.read_stream(spark, str(tmp_path / "e"), ", ".join(f"{n} {t}" for n, t in e.dtypes))
    for name, make_view in (("w1", lambda d: streams.window_metrics(d, "ts", "event_type", "value", "6 hours")), ("w2", lambda d: streams.session_metrics(d, "ts", "user_id", "value", "2 hours"))):
        streams.to_table(make_view(src), name, "complete" if name == "w1" else "append", str(tmp_path / name))
        want = make_view(e).select("start", "n").collect()
        got = spark.table(name).select("start", "n").collect()
        assert set(got) <= set(want) and (name == "w2" or len(got) == len(want))


def test_octave_bins_of_spectrograms(spark):
    """Bins added up beside the arrays equal those of exploded spectra."""
    from pyspark.sql import functions as F

    from vibespark.operators import spectral

    i = F.col("id")
    sig = spark.range(4000).select(F.lit("r").alias("series_id"), F.lit("x").alias("axis"), i.alias("i"), (i / 200.0).alias("t"), (F.sin(i / 3.0) + F.rand(1)).alias("v")).persist()
    for agg in ("sum", "mean"):
        got = spectral.spectrogram(sig, 5, None, 0.5, 3, 2.0, agg, None, False)
        plain = spectral.spectrogram(sig, 5, None, 0.5, None, 2.0, agg, None, False)
        want = spectral.to_octave(plain, 2.0, 3, agg, ["timestamp"])
        rows = {(r.timestamp, round(r.freq, 6)): r.value for r in want.collect()}
        assert {(r.timestamp, round(r.freq, 6)): r.value for r in got.collect()} == pytest.approx(rows) and len(rows) > 40
    made = spectral.octave_spectrogram(sig, 4.0, 3, 2.0)
    assert {r.axis for r in made.select("axis").distinct().collect()} == {"x"}
