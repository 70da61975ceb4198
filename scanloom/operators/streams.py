"""Fourier analysis of long streams: spectra as tables, and filters that see a stretch and its neighbourhood.

A stream of n = n1 n2 samples is transformed in two steps: n2 short transforms of every n2-th sample, a twist by a phase,
and n1 short transforms across those. Between the steps the values are transposed by a shuffle, so a task holds about
sqrt(n) of a detector's samples at a time and not its stream. Streams of at most WHOLE samples are transformed in one
step, many abreast. What is done to a spectrum are native columns on rows (stream, n, bin, re, im), bins from 0 to n / 2.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURN = 2 * math.pi
#: Samples of a stream that is transformed whole, and of the streams that are transformed abreast.
WHOLE, ABREAST = 4096, 1 << 20


def _with_factors(df: DataFrame, n: str = "n") -> DataFrame:
    """df with n1, the largest divisor of n up to its square root, and n2 = n / n1. A prime number has n1 = 1: see
    friendly_length()."""

    @F.pandas_udf("long")
    def divisor(sizes: pd.Series) -> pd.Series:
        known = {x: next(d for d in range(math.isqrt(int(x)), 0, -1) if x % d == 0) for x in sizes.unique()}
        return sizes.map(known)

    return df.withColumn("n1", divisor(n)).withColumn("n2", (F.col(n) / F.col("n1")).cast("long"))


def friendly_length(n: Column) -> Column:
    """The largest number up to n without prime factors above 7, for transforms in short steps."""

    @F.pandas_udf("long")
    def smooth(sizes: pd.Series) -> pd.Series:
        def best(x: int) -> int:
            while x > 1:
                left = x
                for p in (2, 3, 5, 7):
                    while left % p == 0:
                        left //= p
                if left == 1:
                    break
                x -= 1
            return x

        known = {x: best(int(x)) for x in sizes.unique()}
        return sizes.map(known)

    return smooth(n)


def _gathered(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Rows (keys, place, re, im) as arrays in the order of place."""
    z = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), "re", "im")))
    return df.groupBy(*keys).agg(z.alias("z")).select(*keys, *(F.col(f"z.{c}").alias(c) for c in ("p", "re", "im")))


def _stepped(df: DataFrame, keys: list[str], by: str, step: Callable[[dict, int], np.ndarray]) -> DataFrame:
    """Each row through step(row, its number `by`), which gives an array: rows (keys, by, re, im)."""
    kind = df.select(*keys, by, "re", "im").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [step(r, i) for r, i in zip(pdf.to_dict("records"), pdf[by])]
            out = pdf[[*keys, by]].copy()
            out["re"], out["im"] = [x.real.copy() for x in done], [x.imag.copy() for x in done]
            yield out

    return df.mapInPandas(run, kind)


def _values(r: dict, size: int) -> np.ndarray:
    """A row's values by place, 0 where there is none."""
    z = np.zeros(size, complex)
    z[np.asarray(r["p"], int)] = np.asarray(r["re"]) + 1j * np.asarray(r["im"])
    return z


def _transposed(df: DataFrame, keys: list[str], by: str, across: str) -> DataFrame:
    rows = df.select(*keys, F.col(by).alias("__by"), F.posexplode(F.arrays_zip("re", "im")).alias(across, "x"))
    rows = rows.select(*keys, F.col(across).cast("long").alias(across), "__by", "x.re", "x.im")
    return _gathered(rows, [*keys, across], "__by")


def _field(df: DataFrame, name: str) -> str:
    return df.select(name).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)


def _abreast(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, rows of that size), as many rows as may go abreast."""
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, ABREAST // max(n, 1))
        for k in range(0, len(rows), step):
            yield n, rows[k : k + step]


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False)


def _starts(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's list starts in _flat(), and its length."""
    sizes = b.column(name).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes


def _whole_spectrum(s: DataFrame, by: str) -> DataFrame:
    """spectrum() of short streams (by, s, re), each in one row."""
    rows = s.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("s", "re"))).alias("z")).select(by, F.col("z.re").alias("re"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, (start, sizes) = _flat(b, "re"), _starts(b, "re")
            for n, at in _abreast(sizes):
                z = np.fft.rfft(value[start[at][:, None] + np.arange(n)], axis=1)
                bins = np.tile(np.arange(z.shape[1]), len(at))
                cols = [b.column(by).take(pa.array(np.repeat(at, z.shape[1]))), *map(pa.array, (np.full(z.size, n), bins, z.real.ravel(), z.imag.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, [by, "n", "bin", "re", "im"])

    return rows.mapInArrow(run, f"{_field(s, by)}, n long, bin long, re double, im double")


def _whole_signal(x: DataFrame, by: str) -> DataFrame:
    """signal() of short streams (by, n, bin, re, im), each in one row."""
    rows = x.groupBy(by, "n").agg(F.collect_list(F.struct("bin", "re", "im")).alias("z")).select(by, "n", *(F.col(f"z.{c}").alias(c) for c in ("bin", "re", "im")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, re, im = (_flat(b, c) for c in ("bin", "re", "im"))
            start, count = _starts(b, "bin")
            for n, at in _abreast(b.column("n").to_numpy()):
                row = np.repeat(np.arange(len(at)), count[at])
                place = np.arange(len(row)) + np.repeat(start[at] - (np.cumsum(count[at]) - count[at]), count[at])
                z = np.zeros((len(at), n // 2 + 1), complex)
                z[row, bins[place]] = re[place] + 1j * im[place]
                samp = np.tile(np.arange(n), len(at))
                cols = [b.column(by).take(pa.array(np.repeat(at, n))), pa.array(samp), pa.array(np.fft.irfft(z, n, axis=1).ravel())]
                yield pa.RecordBatch.from_arrays(cols, [by, "samp", "value"])

    return rows.mapInArrow(run, f"{_field(x, by)}, samp long, value double")


def spectrum(samples: DataFrame, by: str = "det", samp: str = "samp", value: str = "value", longest: int | None = None) -> DataFrame:
    """(by, n, bin, re, im): the discrete Fourier transform of each stream, for the bins 0 to n / 2.

    Samples are numbered from 0 without gaps; a null counts as 0. No samples give no rows. `longest`: the largest n, which
    is counted first if it is not given."""
    counts = samples.groupBy(by).agg(F.count("*").alias("n"))
    if longest is None:
        longest = counts.agg(F.max("n")).first()[0] or 0
    s = samples.where(F.col(by).isNotNull()).select(by, F.col(samp).cast("long").alias("s"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("re"))
    if longest <= WHOLE:
        return _whole_spectrum(s, by)
    short = _whole_spectrum(s.join(counts.where(F.col("n") <= WHOLE).select(by), by, "left_semi"), by)
    s = s.join(_with_factors(counts.where(F.col("n") > WHOLE)), by)
    keys = [by, "n", "n1", "n2"]
    s = s.select(*keys, (F.col("s") % F.col("n2")).alias("j"), F.floor(F.col("s") / F.col("n2")).alias("i"), "re", F.lit(0.0).alias("im"))

    def first(r: dict, j: int) -> np.ndarray:
        k = np.arange(r["n1"])
        return np.fft.fft(_values(r, r["n1"])) * np.exp(-1j * _TURN * ((j * k) % r["n"]) / r["n"])

    def second(r: dict, k: int) -> np.ndarray:
        return np.fft.fft(_values(r, r["n2"]))

    done = _stepped(_gathered(s, [*keys, "j"], "i"), keys, "j", first)
    done = _stepped(_transposed(done, keys, "j", "k"), keys, "k", second)
    out = done.select(*keys, "k", F.posexplode(F.arrays_zip("re", "im")).alias("m", "x"))
    out = out.select(by, "n", (F.col("k") + F.col("n1") * F.col("m")).alias("bin"), "x.re", "x.im")
    return short.unionByName(out.where(F.col("bin") <= F.floor(F.col("n") / 2)))


def signal(spectra: DataFrame, by: str = "det", longest: int | None = None) -> DataFrame:
    """(by, samp, value): the streams of n samples whose spectra are given, the inverse of spectrum(). Missing bins are 0;
    of the bin n / 2 of an even n only the real part counts. `longest`: the largest n, which is counted first if it is not
    given."""
    if longest is None:
        longest = spectra.agg(F.max("n")).first()[0] or 0
    known = spectra.where(F.col(by).isNotNull() & (2 * F.col("bin") <= F.col("n"))).select(by, F.col("n").cast("long").alias("n"), F.col("bin").cast("long").alias("bin"), "re", "im")
    if longest <= WHOLE:
        return _whole_signal(known, by)
    short = _whole_signal(known.where(F.col("n") <= WHOLE), by)
    spectra = spectra.where(F.col("n") > WHOLE)
    sized = _with_factors(spectra.select(by, "n").distinct())
    x = spectra.select(by, F.col("n").alias("__n"), "bin", "re", "im").join(sized, by).drop("__n").where(2 * F.col("bin") <= F.col("n"))
    edge = (F.col("bin") == 0) | (2 * F.col("bin") == F.col("n"))
    own = F.struct(F.col("bin").alias("b"), "re", F.when(edge, 0.0).otherwise(F.col("im")).alias("im"))
    twin = F.struct((F.col("n") - F.col("bin")).alias("b"), "re", (-F.col("im")).alias("im"))
    keys = [by, "n", "n1", "n2"]
    x = x.select(*keys, F.explode(F.when(edge, F.array(own)).otherwise(F.array(own, twin))).alias("x")).select(*keys, "x.*")
    x = x.select(*keys, (F.col("b") % F.col("n1")).alias("k"), F.floor(F.col("b") / F.col("n1")).alias("m"), "re", "im")

    def first(r: dict, k: int) -> np.ndarray:
        j = np.arange(r["n2"])
        return np.fft.ifft(_values(r, r["n2"])) * np.exp(1j * _TURN * ((j * k) % r["n"]) / r["n"])

    def second(r: dict, j: int) -> np.ndarray:
        return np.fft.ifft(_values(r, r["n1"]))

    done = _stepped(_gathered(x, [*keys, "k"], "m"), keys, "k", first)
    done = _stepped(_transposed(done, keys, "k", "j"), keys, "j", second)
    out = done.select(by, "n2", "j", F.posexplode("re").alias("i", "value"))
    return short.unionByName(out.select(by, (F.col("n2") * F.col("i") + F.col("j")).alias("samp"), "value"))


def frequency(rate: Column | float = 1.0) -> Column:
    """The frequency of a spectrum's bin."""
    return F.col("bin") * F.lit(rate) / F.col("n") if isinstance(rate, float) else F.col("bin") * rate / F.col("n")


def times(spectra: DataFrame, re: Column, im: Column | None = None) -> DataFrame:
    """Spectra multiplied by a complex gain."""
    im = F.lit(0.0) if im is None else im
    return spectra.withColumns({"re": F.col("re") * re - F.col("im") * im, "im": F.col("re") * im + F.col("im") * re})


def lowpass_gain(freq: Column, knee: float, alpha: float = 8.0) -> Column:
    """1 / (1 + (f / knee)^alpha); a negative alpha is a high pass, with 0 at the frequency 0."""
    power = F.when((freq == 0) & F.lit(alpha < 0), float("inf")).otherwise(F.pow(freq / knee, F.lit(float(alpha))))
    return 1 / (1 + power)


def deconvolved(spectra: DataFrame, tau: Column, rate: float) -> DataFrame:
    """Spectra without a detector's time constant tau: times 1 + 2 pi i f tau."""
    return times(spectra, F.lit(1.0), _TURN * frequency(rate) * tau)


def recursive_gain(freq: Column, numerator: list[float], denominator: list[float], scale: float) -> tuple[Column, Column]:
    """The gain A / B that undoes a recursive filter B / A: polynomials in z = exp(-2 pi i scale f), lowest power first."""
    part = lambda c, fun: sum((F.lit(float(x)) * fun(F.lit(-_TURN * scale * k) * freq) for k, x in enumerate(c)), F.lit(0.0))
    ar, ai, br, bi = part(denominator, F.cos), part(denominator, F.sin), part(numerator, F.cos), part(numerator, F.sin)
    size = br * br + bi * bi
    return (ar * br + ai * bi) / size, (ai * br - ar * bi) / size


def resampled(samples: DataFrame, size: Column, by: str = "det", samp: str = "samp", value: str = "value") -> DataFrame:
    """Streams at `size` samples (a column of n) over the same time: their spectra are cut or padded with zeros."""
    x = spectrum(samples, by, samp, value).withColumn("__m", size.cast("long"))
    x = x.where(F.col("bin") <= F.floor(F.least("n", "__m") / 2))
    x = times(x, F.col("__m") / F.col("n"))
    return signal(x.withColumn("n", F.col("__m")).drop("__m"), by)


def local_filter(samples: DataFrame, gain: Callable[[np.ndarray], np.ndarray], size: int, halo: int, by: str = "det", samp: str = "samp", value: str = "value") -> DataFrame:
    """(by, samp, value): streams through gain(frequency in cycles per sample), in stretches of `size` samples.

    Each stretch is transformed with `halo` samples of its neighbours on both sides, which are dropped again, in one
    shuffle. That equals the transform of whole streams as far as the filter's response to a peak fades within `halo`
    samples; the ends of a stream are neighbours, as there. Streams of up to size + 2 halo samples are one stretch."""
    n = samples.groupBy(by).agg(F.count("*").alias("n"))
    s = samples.select(by, F.col(samp).cast("long").alias("s"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).join(n, by)
    whole = F.col("n") <= size + 2 * halo
    # a stretch takes the samples halo before its start to halo behind its end, modulo n: each sample and its images
    images = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = s.select("*", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(images)).alias("turn")).withColumn("at", F.col("s") + F.col("turn") * F.col("n"))
    last = F.floor((F.col("n") - 1) / size)
    low = F.greatest(F.floor((F.col("at") - halo) / size), F.lit(0))
    high = F.least(F.floor((F.col("at") + halo) / size), last)
    # the last stretch ends with the stream, so its halo ends sooner
    takes = F.filter(F.sequence(low, high), lambda c: (F.col("at") >= c * size - halo) & (F.col("at") < F.least((c + 1) * size, F.col("n")) + halo))
    stretch = F.when(whole, F.array(F.lit(0).cast("long"))).when(low > high, F.array().cast("array<bigint>")).otherwise(takes)
    dealt = near.select(by, "n", F.explode(stretch).alias("c"), "at", "v")
    rows = dealt.groupBy(by, "n", "c").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x"))
    rows = rows.select(by, "n", "c", F.col("x.at").alias("at"), F.col("x.v").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[by]].copy()
            kept, places = [], []
            for n, c, at, v in zip(pdf["n"], pdf["c"], pdf["at"], pdf["v"]):
                done = np.fft.irfft(np.fft.rfft(v) * gain(np.fft.rfftfreq(len(v))), len(v))
                at = np.asarray(at)
                own = (at >= 0) & (at < n) if n <= size + 2 * halo else (at >= c * size) & (at < min(n, (c + 1) * size))
                kept.append(done[own])
                places.append(at[own])
            out["samp"], out["value"] = places, kept
            yield out

    kind = samples.select(by).schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", samp array<long>, value array<double>"
    done = rows.mapInPandas(run, kind)
    return done.select(by, F.explode(F.arrays_zip("samp", "value")).alias("x")).select(by, "x.samp", "x.value")
