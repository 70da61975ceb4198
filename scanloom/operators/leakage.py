"""How much of one stream leaks into another: lines fitted to blocks with errors on both sides, and a sampler of the
leakage and its noise from sums over the samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mx, my, sxx, syy, sxy): counts, means and sums of squares about the means of x and y, in one pass."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.var_pop("x") * F.count("*")).alias("sxx"), (F.var_pop("y") * F.count("*")).alias("syy"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"),
    )


def nearest_line(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Slope of the line from which points are nearest, at right angles: errors in both coordinates, of one size. Null where
    no direction is better than another."""
    half = syy - sxx
    slope = (half + F.sqrt(half * half + 4 * sxy * sxy)) / F.when(sxy != 0, 2 * sxy)
    return F.when(sxy != 0, slope).when(sxx > syy, 0.0)


def leakage(streams: DataFrame, by: str = "det", samp: str = "samp", down: int = 10, block: int = 700) -> DataFrame:
    """(by, slope, offset, blocks): y = slope x + offset of each pair of streams (by, samp, x, y), the median of the lines
    nearest to the points of each block of about `block` samples, which are first averaged over `down` each.

    Samples at the end that fill no average or no block are left out; streams without a block have no row."""
    averages = streams.groupBy(by, F.floor(F.col(samp) / down).alias("__a")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("__n")).where(F.col("__n") == down)
    size = max(1, block // down)
    fits = moments(averages.withColumn("__b", F.floor(F.col("__a") / size)), [by, "__b"]).where(F.col("n") == size)
    slope = nearest_line(F.col("sxx"), F.col("syy"), F.col("sxy"))
    fits = fits.withColumn("__s", slope).withColumn("__o", F.col("my") - F.col("__s") * F.col("mx"))
    return fits.groupBy(by).agg(F.median("__s").alias("slope"), F.median("__o").alias("offset"), F.count("*").alias("blocks"))


def sampled_leakage(streams: DataFrame, by: str = "det", draws: int = 400, burn: int = 50, seed: int = 1) -> DataFrame:
    """(by, slope, slope_sd, noise): mean and spread of the leakage y = slope x + noise given the streams, and the mean
    variance of the noise, by Gibbs sampling with flat priors, from the sums x x, x y, y y and the count of each pair.

    The sums are one aggregation; the draws of a pair need nothing else, and start from its own seed, so that results do
    not depend on where its row lies. Pairs with no more than two samples or without x have null results."""
    sums = streams.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("x", "x"), ("x", "y"), ("y", "y"))))
    sums = sums.withColumn("seed", F.xxhash64(F.col(by), F.lit(seed)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, xx, xy, yy, start in zip(pdf["n"], pdf["xx"], pdf["xy"], pdf["yy"], pdf["seed"]):
                if n <= 2 or not xx > 0:
                    out.append((None, None, None))
                    continue
                rng = np.random.default_rng(int(start) & 0xFFFFFFFFFFFFFFFF)
                best = xy / xx
                rest, slopes, noises = max(yy - best * xy, 1e-300), [], []
                slope = best
                for k in range(burn + draws):
                    var = (rest + (slope - best) ** 2 * xx) / rng.chisquare(n)
                    slope = best + rng.normal() * (var / xx) ** 0.5
                    if k >= burn:
                        slopes.append(slope)
                        noises.append(var)
                out.append((float(np.mean(slopes)), float(np.std(slopes)), float(np.mean(noises))))
            yield pd.concat([pdf[[by]].reset_index(drop=True), pd.DataFrame(out, columns=["slope", "slope_sd", "noise"], dtype=float)], axis=1)

    kind = sums.select(by).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    return sums.mapInPandas(run, kind + ", slope double, slope_sd double, noise double")
