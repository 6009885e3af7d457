"""Steps that must not grow faster than their input: each test failed before the finding it names was mended."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vibespark import model, roster, roster_kernels  # noqa: F401
from vibespark.plans import batch

SF = "/root/testdata/sf0.001"
SIGNAL = "series_id string, axis string, i long, t double, v double"


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_spectra_are_made_once(spark):
    """what the resultant and the octaves read many times is not made from the recordings again."""
    d = batch.Builder(batch.Params(highpass=None)).add_psd(1.0, 1.0, 3.0).aggregate(roster._recordings(spark, SF))["psd"]
    assert "lineitem" not in plan(d) and "parquet" not in plan(d)


def test_medians_over_blocks(spark, monkeypatch):
    """blocks of segments give the medians that all segments give."""
    from vibespark.operators import spectral

    x = np.random.default_rng(1).normal(size=4000)
    sig = spark.createDataFrame([("s", "A", i, i * 0.01, float(v)) for i, v in enumerate(x)], SIGNAL)
    whole = np.array([r.value for r in spectral.welch(sig, 1.0, None, "hann", "median").orderBy("freq").collect()])
    monkeypatch.setattr(spectral, "BLOCK", 300)
    parts = np.array([r.value for r in spectral.welch(sig, 1.0, None, "hann", "median").orderBy("freq").collect()])
    w = spectral.window_values("hann", 100)
    seg = np.lib.stride_tricks.sliding_window_view(x, 100)[::50]
    p = np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 * 0.01 / (w * w).sum()
    p[:, 1:-1] *= 2
    want = np.median(p, axis=0) / spectral.median_bias(len(p))
    assert np.allclose(whole, want) and np.allclose(parts, want)


def test_metrics_keep_no_signal(spark):
    """the metrics keep no copy of the signal; chunks, carried on, give what whole axes give."""
    from vibespark.operators import motion
    from vibespark.plans import metrics

    rng = np.random.default_rng(2)
    x = {a: rng.normal(size=1000) for a in "AB"}
    sig = spark.createDataFrame([("s", a, i, i * 0.01, float(v)) for a in x for i, v in enumerate(x[a])], SIGNAL)
    spark.catalog.clearCache()
    metrics.shock_vibe_metrics(sig, include_resultant=True).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    axes = model.axes_of(sig)
    got = {(r.axis, r.name): (r.peak, r.rms) for r in motion.extremes(sig, axes, F.col("v"), 0.0, 0.0, 2.0, True, 64).collect()}
    first = {a: 2 * np.append(0, np.cumsum((v[1:] + v[:-1]) / 2 * 0.01)) for a, v in x.items()}
    second = {a: np.append(0, np.cumsum((v[1:] + v[:-1]) / 2 * 0.01)) for a, v in first.items()}
    for name, d in (("Acceleration", x), ("Velocity", first), ("Displacement", second)):
        for a, v in (d | {"Resultant": np.hypot(d["A"], d["B"])}).items():
            assert np.allclose(got[a, name], (np.abs(v).max(), np.sqrt((v * v).mean())))


def test_range_means_add_parts(spark):
    """means over time ranges from sums of parts equal those over the rows, ties, gaps and missing times included."""
    from vibespark.operators import windows

    rng = np.random.default_rng(3)
    t = rng.integers(0, 3000, 400)
    rows = [(k, "ab"[k % 2], None if k % 50 == 0 else int(x), float(k % 13) if k % 9 else None) for k, x in enumerate(t)]
    d = spark.createDataFrame(rows, "id long, k string, us long, v double").withColumn("ts", F.timestamp_micros("us"))
    for width in (640, 7, 1000):
        got = {r.id: r["mean"] for r in windows.range_means(d, "k", F.col("ts"), "v", width).collect()}
        for k, key, x, _ in rows:
            some = [v for _, q, y, v in rows if q == key and v is not None and (y is None if x is None else y is not None and x - width < y <= x)]
            assert (got[k] is None) == (not some) and (not some or abs(got[k] - sum(some) / len(some)) < 1e-9)


def test_texts_are_cut_in_place(spark):
    """F8: blocks of texts put end to end, without the whole as one value."""
    from vibespark.sources import logs

    texts = ["ab" * (k % 5) + str(k) for k in range(60)]
    d = spark.createDataFrame([("s", k, x) for k, x in enumerate(texts)], "series_id string, k long, x string")
    got = [r.payload for r in logs.cut(d, "k", 7).orderBy("seq").collect()]
    whole = "".join(texts)
    assert got == [whole[k : k + 7] for k in range(0, len(whole), 7)]


def test_integrals_carry_chunks_on(spark):
    """both integrals from one pass over chunks equal those of the whole axis; a missing sample adds nothing."""
    from vibespark.operators import motion

    x = np.random.default_rng(4).normal(size=500)
    rows = [("s", "A", i, i * 0.5, None if i in (0, 63, 64, 200) else float(v)) for i, v in enumerate(x)]
    got = motion.integrated(spark.createDataFrame(rows, SIGNAL), 64).orderBy("i").collect()
    v = np.array([np.nan if r[4] is None else r[4] for r in rows])
    first = np.append(0, np.cumsum(np.nan_to_num((v[1:] + v[:-1]) / 4)))
    second = np.append(0, np.cumsum((first[1:] + first[:-1]) / 4))
    assert np.allclose([r.first for r in got], first) and np.allclose([r.second for r in got], second)


def test_rolling_means_by_chunks(spark):
    """chunks with the rows around them give what joined running sums gave, for frames wider than a chunk too."""
    from vibespark.operators import windows

    x = np.random.default_rng(5).normal(size=400)
    sig = spark.createDataFrame([("s", "A", i, i * 1.0, float(v)) for i, v in enumerate(x)], SIGNAL)
    for half in (3, 40, 150):
        d = windows._near_mean_removed(sig, model.axes_of(sig).withColumn("half", F.lit(half).cast("long")), 64)
        got = np.array([r.v for r in d.orderBy("i").collect()])
        assert np.allclose(got, [x[i] - x[max(i - half, 0) : i + half + 1].mean() for i in range(400)])


def test_peak_windows_join_once(spark):
    """one reading picks the rows of all windows; before, the signal was joined twice and with its resultant."""
    from vibespark.operators import windows

    d = windows.peak_windows(roster._tri(spark, SF), 20)
    assert plan(d).count("Join ") == 1 and plan(d).count("lineitem") <= 3


def test_angular_velocity_by_chunks(spark, monkeypatch):
    """F16: differences over chunks of rows equal those over the series."""
    from vibespark.functions import quaternion as qn

    q = np.random.default_rng(6).normal(size=(50, 4)).tolist()
    d = spark.createDataFrame([("s", i, *r) for i, r in enumerate(q)], "series_id string, i long, w double, x double, y double, z double").select("series_id", "i", F.struct("w", "x", "y", "z").alias("q"))
    whole = [tuple(r) for r in qn.angular_velocity(d).select("i", "wx", "wy", "wz").orderBy("i").collect()]
    monkeypatch.setattr(qn, "CHUNK", 7)
    assert whole == [tuple(r) for r in qn.angular_velocity(d).select("i", "wx", "wy", "wz").orderBy("i").collect()]


def test_rows_are_numbered_by_many_tasks(spark):
    """numbers equal those of one window over the series, null keys, null times and ties included."""
    n = F.col("id")
    d = spark.range(5000).select(n, F.when(n % 7 > 0, (n % 3).cast("string")).alias("k"), F.when(n % 11 > 0, (n * 7919 % 400).cast("double")).alias("t"))
    got = model.numbered(d, "k", ["t", "id"])
    want = F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1
    assert got.withColumn("j", want).filter("i <> j").count() == 0 and got.count() == 5000
    assert got.groupBy("k").agg(F.countDistinct("i").alias("a"), F.max("i").alias("b")).filter("a <> b + 1").count() == 0
    assert "row_number() windowspecdefinition(k#" in plan(got) and ", _b#" in plan(got).split("windowspecdefinition(k#")[1][:40]


def test_short_recordings_share_responses(spark, monkeypatch):
    """recordings of a length, worked on together, have the spectra that each has alone."""
    from vibespark.operators import shock

    rng = np.random.default_rng(8)
    rows = [(s, a, i, i * 0.01, float(v)) for s, n in (("p", 40), ("q", 40), ("r", 55)) for a in "AB" for i, v in enumerate(rng.normal(size=n))]
    sig = spark.createDataFrame(rows, SIGNAL)
    for options in ({}, {"mode": "pvss", "two_sided": True, "freqs": [3.0, 20.0]}, {"aggregate_axes": True}):
        made = lambda: np.array([tuple(r)[3:] for r in shock.shock_spectrum(sig, **options).orderBy("series_id", "axis", "freq").collect()])  # noqa: B023, E731
        with monkeypatch.context() as m:
            together = made()
            m.setattr(shock, "SHORT", 0)
            assert np.allclose(together, made()) and len(together)


def test_short_axes_are_filtered_together(spark):
    """many axes filtered at a time give what each gives alone."""
    from vibespark.operators import filters

    x = np.random.default_rng(9).normal(size=(12, 64))
    for sos in (filters.sections("bessel", 2, "lowpass", [6.0], 64.0), filters.sections("butterworth", 3, "highpass", [4.0], 64.0)):
        assert np.allclose(filters.zero_phase_many(x, sos), [filters.zero_phase(r, sos) for r in x])


def test_spectra_of_slices_are_made_once(spark):
    """the bins, the resultant and the spacing of slices' spectra do not make them again."""
    assert "embedding" not in plan(roster.QUERIES["rolling_psd"](spark, SF))
