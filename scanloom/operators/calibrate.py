"""From raw samples to calibrated ones: gains, the wave plate's signal, jumps and gaps, slopes, the readout's filter and
time constants, and detectors that are good enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators import blocks, calibration, intervals, streams
from scanloom.sources.shared import forget, written


def _clipped(ranges: DataFrame, nsamp: DataFrame) -> DataFrame:
    """Ranges within the samples that are left; those outside of them drop out."""
    inside = ranges.join(nsamp, "det").select("det", F.greatest(F.col("lo"), F.lit(0)).alias("lo"), F.least(F.col("hi"), F.col("nsamp").cast("int")).alias("hi"))
    return inside.where("lo < hi")


def cut_shares(cuts: DataFrame, nsamp: DataFrame) -> DataFrame:
    """(det, share, density): flagged samples and flagged ranges by number of samples, 0 without any."""
    sums = cuts.groupBy("det").agg(F.sum(F.col("hi") - F.col("lo")).alias("__s"), F.count("*").alias("__k"))
    known = nsamp.join(sums, "det", "left")
    return known.select("det", (F.coalesce("__s", F.lit(0)) / F.col("nsamp")).alias("share"), (F.coalesce("__k", F.lit(0)) / F.col("nsamp")).alias("density"))


def calibrated(
    samples: DataFrame,
    detectors: DataFrame,
    cuts: DataFrame,
    jumps: DataFrame,
    rate: float,
    least_rms: float,
    harmonics: DataFrame | None = None,
    readout: tuple[list[float], list[float], float] | None = None,
    edge: int = 10,
    size: int = 32,
    most_share: float = 0.1,
    most_density: float = 1e-3,
    least_good: float = 0.25,
    friendly: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """((det, samp, value), (det, rms, share, density, good)): calibrated samples of the good detectors, and the verdict on
    all of them.

    samples: (det, samp, value), with phase if there are harmonics (det, c, s: in raw units). detectors: (det, gain, tau).
    cuts and jumps: (det, lo, hi), united. rate: samples in a second. readout: numerator, denominator and scale of the
    recursive filter to undo. With `friendly`, streams end at the largest length without prime factors above 7.

    Values are multiplied by the gain; the harmonics go; steps over jumps are levelled, then flagged ranges filled with lines
    and the slope between the means of the first and last `edge` samples taken out; filter and time constant are undone in
    Fourier space. A detector is good if its rms (blocks of `size` samples, third differences, times the root of the
    sampling interval) is sensitive, see blocks.sensitive(), and fewer than most_share of its samples and most_density
    ranges a sample are cut; if fewer than least_good of all are, none is. Detectors that `detectors` lacks are left out.
    """
    n = samples.groupBy("det").agg(F.count("*").alias("nsamp")).join(detectors.select("det"), "det", "left_semi")
    n = n.select("det", streams.friendly_length(F.col("nsamp")).alias("nsamp")) if friendly else n
    s = samples.join(n, "det").where(F.col("samp") < F.col("nsamp")).drop("nsamp").join(detectors.select("det", "gain"), "det")
    s = s.withColumn("value", F.col("value") * F.col("gain"))
    if harmonics is not None:
        scaled = harmonics.join(detectors.select("det", "gain"), "det")
        scaled = scaled.select("det", *(F.transform(c, lambda x: x * F.col("gain")).alias(c) for c in ("c", "s")))
        order = harmonics.agg(F.max(F.size("c"))).first()[0] or 0
        s = calibration.without_harmonics(s, scaled, "phase", order)
    s = written(s.select("det", "samp", "value"), "calibrated-gains")
    n = written(n, "calibrated-lengths")
    cuts, jumps = _clipped(cuts, n), _clipped(jumps, n)
    every = intervals.united(cuts.unionByName(jumps))
    level = written(intervals.dejumped(s, jumps, edge, n).select("det", "samp", "value"), "calibrated-levels")
    filled = intervals.gap_filled(level, cuts, edge, n).select("det", "samp", "value")
    flat = blocks.desloped(filled, edge, n).select("det", "samp", "value")
    longest = n.agg(F.max("nsamp")).first()[0] or 0
    x = streams.spectrum(flat, longest=longest)
    if readout is not None:
        x = streams.times(x, *streams.recursive_gain(streams.frequency(rate), *readout))
    x = streams.deconvolved(x.join(detectors.select("det", "tau"), "det"), F.col("tau"), rate).drop("tau")
    out = written(streams.signal(x, longest=longest), "calibrated")
    forget(s, level)
    rms = blocks.difference_rms(out, size).withColumn("rms", F.col("rms") / rate**0.5)
    fine = blocks.sensitive(rms, least_rms).select("det", F.lit(True).alias("__fine"))
    told = cut_shares(every, n).join(rms, "det", "left").join(fine, "det", "left")
    ok = F.coalesce("__fine", F.lit(False)) & (F.col("share") < most_share) & (F.col("density") < most_density)
    told = written(told.select("det", "rms", "share", "density", ok.alias("__ok")), "calibrated-detectors")
    enough = F.broadcast(told.agg((F.count_if("__ok") > least_good * F.count("*")).alias("__enough")))  # one row
    told = told.crossJoin(enough).select("det", "rms", "share", "density", (F.col("__ok") & F.col("__enough")).alias("good"))
    return out.join(told.where("good").select("det"), "det", "left_semi"), told
