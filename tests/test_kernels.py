"""Numerical kernels by their analytic properties."""

import datetime as dt
import math

import numpy as np
import pytest

from vibespark.functions import text as tx
from vibespark.functions import units
from vibespark.functions.quaternion import euler_order
from vibespark.operators import filters, multivariate, shock, spectral, stats
from vibespark.sources import catalog, files, logs


def gain(sos, f, rate):
    z = np.exp(2j * np.pi * np.asarray(f) / rate)
    h = np.ones(len(z), complex)
    for b0, b1, b2, _, a1, a2 in sos:
        h *= (b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)
    return 20 * np.log10(np.abs(h) + 1e-300)


CORNER = {"butterworth": -3.0103, "bessel": -3.0103, "cheby1": -3.0, "cheby2": -30.0, "ellip": -3.0}


@pytest.mark.parametrize("family", CORNER)
@pytest.mark.parametrize("order", [1, 2, 3, 4, 5, 6])
def test_filter_corners_and_ripple(family, order):
    low = filters.sections(family, order, "lowpass", [50.0], 1000.0)
    high = filters.sections(family, order, "highpass", [50.0], 1000.0)
    both = filters.sections(family, order, "bandpass", [50.0, 100.0], 1000.0)
    for sos in (low, high):
        assert gain(sos, [50.0], 1000.0)[0] == pytest.approx(CORNER[family], abs=1e-3)
    assert gain(both, [50.0, 100.0], 1000.0) == pytest.approx([CORNER[family]] * 2, abs=1e-3)
    assert gain(low, np.linspace(0.1, 499, 5000), 1000.0).max() < 1e-6
    if family in ("cheby2", "ellip") and order > 1:
        stop = gain(low, np.linspace(250, 499, 3000), 1000.0)
        assert stop.max() < -29.99 or order == 2
    assert all(np.abs(np.roots([1, r[4], r[5]])).max() < 1 for r in low)


def test_zero_phase():
    t = np.arange(3000) / 1000
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 200 * t)
    y = filters.zero_phase(x, filters.sections("butterworth", 3, "lowpass", [50.0], 1000.0))
    assert np.abs(y - np.sin(2 * np.pi * 5 * t))[200:-200].max() < 1e-3
    assert filters.zero_phase(np.ones(300), filters.sections("butterworth", 3, "lowpass", [50.0], 1000.0)) == pytest.approx(np.ones(300))
    impulse = np.zeros(1001)
    impulse[500] = 1
    y = filters.zero_phase(impulse, filters.sections("cheby1", 4, "bandpass", [50.0, 120.0], 1000.0))
    assert y == pytest.approx(y[::-1], abs=1e-4) and np.abs(y).max() > 0.05
    with pytest.raises(ValueError):
        filters.zero_phase(np.ones(9), filters.sections("butterworth", 3, "lowpass", [50.0], 1000.0))


def test_bands():
    assert filters.band(None, None) == (None, []) and filters.band(1, None)[0] == "highpass"
    assert filters.band(None, 2)[0] == "lowpass" and filters.band(1, 2) == ("bandpass", [1, 2])
    with pytest.raises(ValueError):
        filters.sections("butterworth", 3, "lowpass", [600.0], 1000.0)
    with pytest.raises(ValueError):
        filters.prototype("none", 3)


@pytest.mark.parametrize("kind", shock.RESPONSES)
def test_responses_follow_their_transfer_functions(kind):
    damp, w, step = 0.05, 2 * np.pi * 10, 1e-3
    f = np.array([0.5, 3, 10, 20, 40])
    s, z = 2j * np.pi * f, np.exp(2j * np.pi * f * step)
    low = s * s + 2 * damp * w * s + w * w
    want = {"absolute_acceleration": (2 * damp * w * s + w * w) / low, "relative_velocity": -s / low, "relative_displacement": -1 / low, "pseudo_velocity": -w / low, "relative_displacement_static": -w * w / low}[kind]
    b0, b1, b2, a1, a2 = shock.coefficients(kind, w, 1 / (2 * damp), step)
    got = (b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)
    assert np.abs(got / want) == pytest.approx(np.ones(5), abs=0.01)
    assert np.angle(got / want) == pytest.approx(np.zeros(5), abs=0.01)


def test_block_filter_equals_the_recurrence():
    x = np.random.default_rng(0).normal(size=333)
    co = shock.coefficients("pseudo_velocity", 2 * np.pi * np.array([3.0, 50.0]), 10, 1e-3)
    got = shock.filtered(x, *co)
    for k in range(2):
        b0, b1, b2, a1, a2 = (np.ravel(c)[k] for c in co)
        z1 = z2 = 0.0
        for n, v in enumerate(x):
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            assert got[k, n] == pytest.approx(y, abs=1e-12)


def test_shock_parts():
    assert shock.pulse_factor(0.0) == pytest.approx(1.0)
    for damp in (0.05, 0.3):
        t = np.linspace(0, 20, 200_001)
        wd = math.sqrt(1 - damp**2)
        assert shock.pulse_factor(damp) == pytest.approx((np.exp(-damp * t) * np.sin(wd * t) / wd).max(), rel=1e-6)
    assert list(shock.HalfSine(2.0, 0.5)) == [2.0, 0.5]
    f = shock.log_freqs(10, 0.01, None, 3)
    assert f[0] == pytest.approx(0.1) and f[-1] < 50 and np.diff(np.log2(f)) == pytest.approx(np.full(len(f) - 1, 1 / 3))
    with pytest.raises(ValueError):
        shock._check(0.0)


def test_spectral_parts():
    assert [spectral.next_fast_len(n) for n in (1, 7, 11, 97)] == [1, 8, 12, 100] and spectral.next_fast_len(13, False) == 14
    assert spectral.median_bias(1) == 1 and spectral.median_bias(3) == pytest.approx(1 + 1 / 3 - 1 / 2)
    draws = np.random.default_rng(1).exponential(size=(200_000, 9))
    assert spectral.median_bias(9) == pytest.approx(np.median(draws, axis=1).mean(), rel=0.01)
    lo, hi, c = spectral.octave_bins(1.0, 1.0, 7.0)
    assert c.tolist() == [1, 2, 4, 8] and hi[:-1] == pytest.approx(lo[1:])
    w = spectral.tukey(11, 0.5)
    assert w == pytest.approx(w[::-1]) and w[0] == 0 and w[5] == 1 and spectral.tukey(5, 0).tolist() == [1] * 5
    assert spectral.aligned_bin_width() == pytest.approx(1 / int(5 / (2 ** (1 / 24) - 2 ** (-1 / 24))))
    with pytest.raises(ValueError):
        spectral.window_values("none", 3)


def test_units():
    assert units.affine("degC", "degF") == pytest.approx((1.8, 32)) and units.factor("in", "mm") == pytest.approx(25.4)
    assert units.factor("gravity", "in/s^2") == pytest.approx(386.0886, rel=1e-6) and units.factor("km/h", "m/s") == pytest.approx(1 / 3.6)
    for bad in (("m", "s"), ("m", "parsec")):
        with pytest.raises(ValueError):
            units.factor(*bad)
    with pytest.raises(ValueError):
        units.to_db("x", "nothing")


def test_times_and_ticks():
    assert tx.parse_time("1:02:03.5") == 3_723_500_000 and tx.parse_time("5m") == 5_000_000 and tx.parse_time(7) == 7 and tx.parse_time(None) is None
    assert tx.parse_time(dt.timedelta(seconds=2)) == 2_000_000
    assert tx.parse_time(dt.datetime(2024, 1, 1, 0, 0, 3), dt.datetime(2024, 1, 1)) == 3_000_000
    with pytest.raises(ValueError):
        tx.parse_time("1:2:3:4:5")
    assert tx.parse_time("") is None and tx.parse_time("1d 2h 3m 4s") == ((26 * 60 + 3) * 60 + 4) * 1_000_000
    assert tx.parse_time(dt.time(1, 0, 2)) == 3_602_000_000 and tx.parse_time(dt.datetime(2024, 1, 1, 0, 0, 3)) == 3_000_000
    assert tx.parse_time(dt.time(1, 0, 2), dt.datetime(2024, 1, 1, 1)) == 2_000_000
    with pytest.raises(ValueError):
        tx.parse_time("5 weeks")
    assert tx.log_ticks(1, 100) == [1, 2, 5, 10, 20, 50, 100] and tx.log_ticks(1, 10, "coarse") == [1, 10]
    assert tx.log_ticks(3, 40) == [1, 2, 5, 10, 20, 50, 100] and tx.log_ticks(3, 8, "any") == [*range(1, 10), 10]


def test_measurement_types():
    acc, gps = catalog.REGISTRY["acc"], catalog.REGISTRY["loc"]
    assert catalog.split_types(acc + gps) == ({"acc", "loc"}, set()) and catalog.split_types(acc | gps) == ({"acc", "loc"}, set())
    assert catalog.split_types("acceleration -GPS") == ({"acc"}, {"loc"}) and catalog.split_types(-acc) == (set(), {"acc"})
    assert catalog.split_types("acceleration - GPS + pressure") == ({"acc", "pre"}, {"loc"})
    assert catalog.split_types("*")[0] == set(catalog.REGISTRY) and acc == "acc"
    with pytest.raises(TypeError):
        catalog.split_types("xyz")


def test_sentences_and_paths():
    got, left = logs.take_sentences(bytearray(b"junk$GPRMC,1\r\nnone\r\nxx$GPGLL,2\r\n$GPV"))
    assert got == ["$GPRMC,1", "$GPGLL,2"] and left == bytearray(b"$GPV")
    got, left = logs.take_sentences(left + b"TG,3\r\n")
    assert got == ["$GPVTG,3"] and not left
    with pytest.raises(ValueError):
        logs.take_sentences(b"x")
    assert files.normalized_path("file:///a/b") == ("local", "/a/b") and files.normalized_path("https://x/y")[0] == "url"
    assert files.normalized_path("a/b") == ("local", "a/b") and files.normalized_path("a/b", "url")[0] == "url"
    with pytest.raises(ValueError):
        files.normalized_path("a", "other")
    assert euler_order("roll pitch yaw") == "xyz" and euler_order("zxz") == "zxz"
    for bad in ("xx", "x-x-y", "a-b-c"):
        with pytest.raises(ValueError):
            euler_order(bad)
    with pytest.raises(ValueError):
        stats.pick(["a"], ["a"], ["a"])
    assert stats.pick(["Ab", "C"], ["ab"]) == ["Ab"] and stats.pick(["Ab", "C"], exclude=["c"]) == ["Ab"]


def test_embedding_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    d = -((x[:, None] - x[None]) ** 2).sum(-1)
    p = multivariate.affinities(d, multivariate.find_sigmas(d, 10))
    assert p.sum(1) == pytest.approx(np.ones(30)) and 2 ** -(p * np.log2(p)).sum(1) == pytest.approx(np.full(30, 10.0), rel=1e-3)
