"""Modes and noise levels of groups against the detectors' own matrix."""

import numpy as np
import pandas as pd
import pytest

from scanloom.operators import noise

N, M = 40, 64


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    t = np.arange(M)
    out = {}
    for grp, n in ((1, N), (2, 5), (3, 1), (4, 200)):
        drift = 6 * np.sin(t / 5) + 3 * rng.normal(size=M)
        out[grp] = rng.normal(size=(n, 1)) * drift + rng.normal(size=(n, M)) * rng.uniform(0.5, 2, (n, 1))
    return out


@pytest.fixture(scope="module")
def matrix(spark, groups):
    rows = [(g, k, x[k].tolist()) for g, x in groups.items() for k in range(len(x))]
    return spark.createDataFrame(rows, "grp int, det long, value array<double>").repartition(5)


def by_group(df, *cols):
    pdf = df.toPandas().sort_values(["grp", "det"])
    return {g: [x[c].to_numpy() for c in cols] for g, x in pdf.groupby("grp")}


def test_modes(matrix, groups):
    got = by_group(noise.group_modes(matrix), "weight", "share")
    for g, x in groups.items():
        mode, share = noise.principal(x - x.mean(1, keepdims=True))
        assert np.allclose(got[g][0], mode, atol=1e-8) and np.allclose(got[g][1], share, atol=1e-9)


def test_noise_levels(matrix, groups):
    got = by_group(noise.noise_weights(matrix, [0.1, 0.25]), "ivar", "nmode")
    for g, x in groups.items():
        ft = np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)[:, 1:]
        inverse, modes = [], 0
        for a, b in noise.freq_bins([0.1, 0.25], 1.0, ft.shape[1], 4):
            part = ft[:, a:b]
            e, v = np.linalg.eigh((part @ part.conj().T).real)
            own = np.sort(e)[::-1][: min(len(x), 2 * (b - a))]
            keep = np.flatnonzero((e > 1e-9) & (e >= 16 * np.median(own)) & (np.abs(v).max(0) < 0.55))[::-1][: max(1, int(0.1 * len(x)))]
            rest = (np.abs(part - v[:, keep] @ (v[:, keep].T @ part)) ** 2).mean(1)
            inverse.append(1 / np.maximum(rest, 1e-3 * np.median(rest)))
            modes += len(keep)
        assert np.allclose(got[g][0], np.mean(inverse, 0) * M, rtol=1e-6) and set(got[g][1]) == {modes}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "grp int, det long, value array<double>")
    assert noise.group_modes(empty).count() == 0 and noise.noise_weights(empty, [0.1]).count() == 0


def test_rows_that_do_not_vary(spark):
    df = spark.createDataFrame([(1, 1, [2.0] * 8), (1, 2, [3.0] * 8)], "grp int, det long, value array<double>")
    assert [r["weight"] for r in noise.group_modes(df).collect()] == [0.0, 0.0]
