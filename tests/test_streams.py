"""Streams in parts against NumPy on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import streams

SIZES = {1: 360, 2: 97, 3: 1, 4: 2, 5: 441, 6: 64}


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(11)
    return {d: r.normal(size=n).cumsum() for d, n in SIZES.items()}


@pytest.fixture(scope="module")
def samples(spark, data):
    rows = [(d, k, float(x)) for d, v in data.items() for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "det long, samp long, value double").repartition(5).cache()


def arrays(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["det"], {})[r["samp"]] = r["value"]
    assert all(sorted(x) == list(range(len(x))) for x in out.values())
    return {d: np.array([x[k] for k in range(len(x))]) for d, x in out.items()}


def test_spectrum(samples, data):
    got = {}
    for r in streams.spectrum(samples).collect():
        got.setdefault(r["det"], {})[r["bin"]] = complex(r["re"], r["im"])
    for d, v in data.items():
        want = np.fft.rfft(v)
        assert sorted(got[d]) == list(range(len(want)))
        assert np.allclose([got[d][k] for k in range(len(want))], want, atol=1e-9)


def test_there_and_back(samples, data):
    got = arrays(streams.signal(streams.spectrum(samples)))
    assert got.keys() == data.keys() and all(np.allclose(got[d], data[d], atol=1e-10) for d in data)


@pytest.mark.parametrize("alpha", [8.0, -4.0])
def test_pass_filters(samples, data, alpha):
    x = streams.spectrum(samples)
    got = arrays(streams.signal(streams.times(x, streams.lowpass_gain(streams.frequency(50.0), 5.0, alpha))))
    for d, v in data.items():
        with np.errstate(divide="ignore"):
            gain = 1 / (1 + (np.fft.rfftfreq(len(v), 1 / 50) / 5.0) ** alpha)
        assert np.allclose(got[d], np.fft.irfft(np.fft.rfft(v) * gain, len(v)), atol=1e-9)


def test_deconvolution_and_readout_filter(samples, data):
    a, b, scale, rate, tau = [1.0, -0.5, 0.1], [0.2, 0.3, 0.1], 1 / 200, 200.0, 0.003
    x = streams.deconvolved(streams.spectrum(samples), F.col("det") * tau, rate)
    got = arrays(streams.signal(streams.times(x, *streams.recursive_gain(streams.frequency(rate), b, a, scale))))
    for d, v in data.items():
        f = np.fft.rfftfreq(len(v), 1 / rate)
        z = np.exp(-2j * np.pi * scale * f)
        gain = np.polyval(a[::-1], z) / np.polyval(b[::-1], z) * (1 + 2j * np.pi * f * d * tau)
        assert np.allclose(got[d], np.fft.irfft(np.fft.rfft(v) * gain, len(v)), atol=1e-8)


@pytest.mark.parametrize("size", [lambda n: n * 2, lambda n: F.floor(n * 0.3) + 1, lambda n: n])
def test_resampling(samples, data, size):
    got = arrays(streams.resampled(samples, size(F.col("n"))))
    for d, v in data.items():
        m = len(got[d])
        f, out = np.fft.rfft(v), np.zeros(m // 2 + 1, complex)
        k = min(len(f), len(out))
        out[:k] = f[:k]
        assert np.allclose(got[d], np.fft.irfft(out, m) * (m / len(v)), atol=1e-9)


@pytest.mark.parametrize("size, halo", [(50, 40), (33, 45), (7, 60)])
def test_stretches_with_halos(samples, data, size, halo):
    gain = lambda f: np.exp(-((f / 0.08) ** 2))
    got = arrays(streams.local_filter(samples, gain, size, halo))
    for d, v in data.items():
        assert np.abs(got[d] - np.fft.irfft(np.fft.rfft(v) * gain(np.fft.rfftfreq(len(v))), len(v))).max() < 1e-6


def test_friendly_lengths(spark):
    got = spark.range(1, 400).select("id", streams.friendly_length(F.col("id")).alias("n")).collect()
    smooth = [n for n in range(1, 400) if all(n % p or p in (2, 3, 5, 7) for p in range(2, n + 1) if all(p % q for q in range(2, p)))]
    assert all(r["n"] == max(x for x in smooth if x <= r["id"]) for r in got)


def test_nothing(samples):
    assert streams.signal(streams.spectrum(samples.limit(0))).count() == 0


def test_edges_grow_and_are_wide_enough(spark):
    from scanloom.operators import spectra

    for n, count, least in ((1, 20, 4), (5, 20, 4), (30, 20, 4), (1000, 20, 4), (1000, 3, 1)):
        e = spark.range(1).select(spectra.exponential_edges(F.lit(n).cast("long"), count, least).alias("e")).first()["e"]
        wide = np.diff(e)
        assert e[0] == 0 and e[-1] == n and (wide >= min(least, n)).all()
        if n == 1000:
            assert len(e) > count // 2 and wide[-1] >= wide[0]


def test_nested_ranges(spark):
    from scanloom.operators import spectra

    r = np.random.default_rng(5)
    rows = []
    for g in range(6):
        for k in range(4):
            for i in range(12):
                lo = int(r.integers(0, 90))
                rows.append((g, k, i, lo, lo + int(r.integers(0, 40))))
    df = spark.createDataFrame(rows, "g int, list int, number int, lo int, hi int")
    got = spectra.owned_stretches(df, "g").collect()
    for g in range(6):
        owner = {}
        for x in range(140):
            held = [(lo, k, i) for g2, k, i, lo, hi in rows if g2 == g and lo <= x < hi]
            if held:
                owner[x] = max(held)[1:]
        mine = sorted((s["lo"], s["hi"], s["list"], s["number"]) for s in got if s["g"] == g)
        assert {x: s[2:] for s in mine for x in range(s[0], s[1])} == owner
        assert all(a[1] < b[0] or a[2:] != b[2:] for a, b in zip(mine, mine[1:]))  # no stretch is cut without need


def test_white_spectra_have_power_one(samples):
    from scanloom.operators import spectra

    x = streams.spectrum(samples.where("det in (1, 5)"))
    p = spectra.binned_power(x, count=20, least=4)
    flat = spectra.whitened(x, p).groupBy("det").agg(F.avg((F.col("re") ** 2 + F.col("im") ** 2) / F.col("n") * 1.0).alias("p")).collect()
    assert len(flat) == 2  # in each bin the mean power of what is left is 1 / power
    both = spectra.binned_power(spectra.whitened(x, p), count=20, least=4).join(p.withColumnRenamed("power", "was"), ["det", "n", "lo", "hi"]).collect()
    assert all(abs(r["power"] * r["was"] - 1) < 1e-9 for r in both)


def test_short_and_long_streams_agree(spark, samples, data, monkeypatch):
    """Short streams take one step and no second shuffle; where some are long, all are there and equal."""
    plan = streams.spectrum(samples)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    monkeypatch.setattr(streams, "WHOLE", 80)
    monkeypatch.setattr(streams, "ABREAST", 100)
    x = streams.spectrum(samples)
    got = {}
    for r in x.collect():
        got.setdefault(r["det"], {})[r["bin"]] = complex(r["re"], r["im"])
    for d, v in data.items():
        want = np.fft.rfft(v)
        assert sorted(got[d]) == list(range(len(want))) and np.allclose([got[d][k] for k in range(len(want))], want, atol=1e-9)
    back = arrays(streams.signal(x))
    assert back.keys() == data.keys() and all(np.allclose(back[d], data[d], atol=1e-10) for d in data)
