"""The calibration chain against NumPy, step by step on whole arrays."""

import numpy as np
import pytest

from scanloom.operators import calibrate

RATE, READOUT = 50.0, ([0.4, 0.3, 0.1], [1.0, -0.3, 0.1], 1 / 50)


def lines(v, lo, hi, n, left_end, right_end):
    """Borders of a range: means of up to n samples on both sides, as gap_filled() takes them."""
    a, b = max(lo - n, left_end), min(hi + n, right_end)
    left = v[a:lo].mean() if lo > a else None
    right = v[hi:b].mean() if b > hi else None
    left, right = (right if left is None else left) or 0.0, (left if right is None else right) or 0.0
    return a, b, left, right


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(12)
    gain, tau = {d: 1 + 0.1 * d for d in range(7)}, {d: 0.001 * (d + 1) for d in range(7)}
    phase = np.linspace(0, 40, 331)
    c, s = r.normal(size=(7, 3)) * 5, r.normal(size=(7, 3)) * 5
    raw = r.normal(size=(7, 331)) + np.linspace(0, 3, 331)
    raw[6] *= 1e-4  # far too quiet
    for k in range(3):
        raw += c[:, k : k + 1] * np.cos((k + 1) * phase) + s[:, k : k + 1] * np.sin((k + 1) * phase)
    raw[2, 100:] += 50  # a jump
    raw[3, 60:64] = 1e4  # a glitch
    cuts, jumps = [(3, 60, 64), (5, 10, 90), (1, 325, 331)], [(2, 99, 101)]
    frames = (
        spark.createDataFrame([(d, k, float(raw[d, k]), float(phase[k])) for d in range(7) for k in range(331)] + [(77, 0, 1.0, 0.0)], "det long, samp long, value double, phase double"),
        spark.createDataFrame([(d, gain[d], tau[d]) for d in range(7)], "det long, gain double, tau double"),
        spark.createDataFrame(cuts, "det long, lo int, hi int"),
        spark.createDataFrame(jumps, "det long, lo int, hi int"),
        spark.createDataFrame([(d, c[d].tolist(), s[d].tolist()) for d in range(7)], "det long, c array<double>, s array<double>"),
    )
    want = {}
    for d in range(7):
        n = 324  # of 331 the largest length without large prime factors
        v = raw[d, :n].copy()
        for k in range(3):
            v -= c[d, k] * np.cos((k + 1) * phase[:n]) + s[d, k] * np.sin((k + 1) * phase[:n])
        v *= gain[d]
        for det, lo, hi in jumps:
            if det == d:
                _, _, left, right = lines(v, lo, hi, 10, 0, n)
                v[lo:] -= right - left
        for det, lo, hi in cuts:
            if det == d and lo < n:
                hi = min(hi, n)
                a, b, left, right = lines(v, lo, hi, 10, 0, n)
                ml, mr = (a + lo - 1) / 2, max((hi + b - 1) / 2, (a + lo - 1) / 2 + 1)
                at = lambda x: left + (right - left) / (mr - ml) * (x - ml)  # noqa: B023, E731
                p, q = at(lo - 1), at(hi)
                v[lo:hi] = p + (q - p) * (np.arange(lo, hi) - lo + 1) / (hi - lo + 1)
        v -= v[:10].mean() + (v[-10:].mean() - v[:10].mean()) * np.arange(n) / (n - 1)
        f = np.fft.rfftfreq(n, 1 / RATE)
        z = np.exp(-2j * np.pi * READOUT[2] * f)
        full = np.polyval(READOUT[1][::-1], z) / np.polyval(READOUT[0][::-1], z) * (1 + 2j * np.pi * f * tau[d])
        want[d] = np.fft.irfft(np.fft.rfft(v) * full, n)
    return frames, want


def test_chain(made):
    (samples, detectors, cuts, jumps, harmonics), want = made
    out, told = calibrate.calibrated(samples, detectors, cuts, jumps, RATE, 0.05, harmonics, READOUT, most_density=0.01)
    verdict = {r["det"]: r for r in told.collect()}
    assert {d for d, r in verdict.items() if r["good"]} == {0, 1, 2, 3, 4}  # 5 has too many flags, 6 no noise, 77 no gain
    assert verdict[5]["share"] == pytest.approx(80 / 324) and verdict[2]["density"] == pytest.approx(1 / 324) and 77 not in verdict
    got = {}
    for r in out.collect():
        got.setdefault(r["det"], {})[r["samp"]] = r["value"]
    assert sorted(got) == [0, 1, 2, 3, 4]
    for d, v in got.items():
        assert sorted(v) == list(range(324)) and np.allclose([v[k] for k in range(324)], want[d], atol=1e-8)
    diff = np.diff(want[4][: 324 // 32 * 32].reshape(-1, 32), n=3)
    assert verdict[4]["rms"] == pytest.approx(np.median(diff.std(1)) / 20**0.5 / RATE**0.5)


def test_too_few_good_ones_are_none(made):
    (samples, detectors, cuts, jumps, _), _ = made
    out, told = calibrate.calibrated(samples.drop("phase"), detectors, cuts, jumps, RATE, 1e9)
    assert out.count() == 0 and told.count() == 7 and told.where("good").count() == 0
