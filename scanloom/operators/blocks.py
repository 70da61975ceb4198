"""Transforms of detectors' sample streams: block means, tapers, slopes, offsets and noise measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.catalog import with_position


def block_means(samples: DataFrame, size: int, inclusive: bool = False, op=F.avg) -> DataFrame:
    """(det, block, value, n): op over blocks of `size` samples; the last partial block counts if inclusive."""
    out = samples.groupBy("det", F.floor(F.col("samp") / size).alias("block")).agg(op("value").alias("value"), F.count("*").alias("n"))
    return out if inclusive else out.where(F.col("n") == size)


def decimated(samples: DataFrame, step: int, multiple: int = 1) -> DataFrame:
    """Every step-th sample, renumbered, as many as are a multiple of `multiple` in each detector."""
    kept = samples.where(F.col("samp") % step == 0).withColumn("samp", (F.col("samp") / step).cast("long"))
    n = F.max("samp").over(Window.partitionBy("det")) + 1
    return kept.withColumn("__n", n - n % multiple).where(F.col("samp") < F.col("__n")).drop("__n")


def tapered(samples: DataFrame, n: int, nsamp: DataFrame) -> DataFrame:
    """Values under a cosine taper of n samples at both ends."""
    edge = F.least(F.col("samp"), F.col("nsamp") - 1 - F.col("samp"))
    weight = F.when(edge < n, 0.5 * (1 - F.cos((edge + 1) * F.lit(math.pi) / n))).otherwise(1.0)
    return samples.join(nsamp, "det").withColumn("value", F.col("value") * weight).drop("nsamp")


def deoffset(samples: DataFrame, size: int) -> DataFrame:
    """Values less the median of the detector's block means; detectors without a full block keep theirs."""
    mid = block_means(samples, size).groupBy("det").agg(F.median("value").alias("__mid"))
    return samples.join(mid, "det", "left").withColumn("value", F.col("value") - F.coalesce("__mid", F.lit(0.0))).drop("__mid")


def edge_means(samples: DataFrame, n: int, nsamp: DataFrame) -> DataFrame:
    """(det, nsamp, v1, v2): means of the first and the last n samples."""
    at = samples.join(nsamp, "det")
    return at.groupBy("det", "nsamp").agg(
        F.avg(F.when(F.col("samp") < n, F.col("value"))).alias("v1"),
        F.avg(F.when(F.col("samp") >= F.col("nsamp") - n, F.col("value"))).alias("v2"),
    )


def desloped(samples: DataFrame, n: int, nsamp: DataFrame, common: bool = False) -> DataFrame:
    """Values less the line through the means of the first and last n samples; with `common`, the line through the
    medians of those means over all detectors."""
    edges = edge_means(samples, n, nsamp)
    if common:
        mid = F.broadcast(edges.agg(F.median("v1").alias("v1"), F.median("v2").alias("v2")))  # one row
        edges = edges.select("det", "nsamp").crossJoin(mid)
    span = F.greatest(F.col("nsamp") - 1, F.lit(1))
    line = F.col("v1") + (F.col("v2") - F.col("v1")) * F.col("samp") / span
    return samples.join(edges, "det").withColumn("value", F.col("value") - line).drop("nsamp", "v1", "v2")


def block_rms(samples: DataFrame, size: int) -> DataFrame:
    """(det, rms): median over full blocks of their standard deviation."""
    return block_means(samples, size, op=F.stddev_pop).groupBy("det").agg(F.median("value").alias("rms"))


def difference_rms(samples: DataFrame, size: int, order: int = 3) -> DataFrame:
    """(det, rms): median over full blocks of the standard deviation of the order-th difference, over the square root
    of C(2 order, order), which is what white noise gains by it."""
    w = Window.partitionBy("det", "block").orderBy("samp")
    df = samples.withColumn("block", F.floor(F.col("samp") / size))
    diff = F.lit(0.0)
    for k in range(order + 1):
        diff = diff + (-1) ** k * math.comb(order, k) * F.lag("value", k).over(w)
    df = df.withColumn("diff", diff)
    full = df.groupBy("det", "block").agg(F.stddev_pop("diff").alias("s"), F.count("*").alias("n")).where(F.col("n") == size)
    return full.groupBy("det").agg((F.median("s") / math.sqrt(math.comb(2 * order, order))).alias("rms"))


def sensitive(rms: DataFrame, least: float, spread: float = 0.2, most: float = 1e4) -> DataFrame:
    """Detectors whose rms is in [least, least * most) and within a factor 1 / spread of the median of those."""
    some = rms.where((F.col("rms") >= least) & (F.col("rms") < least * most))
    mid = F.broadcast(some.agg(F.median("rms").alias("mid")))  # one row
    return some.crossJoin(mid).where((F.col("rms") > F.col("mid") * spread) & (F.col("rms") < F.col("mid") / spread)).select(*rms.columns)


def robust_mean(df: DataFrame, by: list[str], value: str, quantile: float = 0.1) -> DataFrame:
    """(by, mean, err, n) without the lowest and highest quantile of each group; err is of the mean."""
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1
    cut = F.floor(F.col("__n") * quantile)
    kept = df.withColumn("__n", n).withColumn("__at", at).where((F.col("__at") >= cut) & (F.col("__at") < F.col("__n") - cut))
    return kept.groupBy(*by).agg(
        F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count("*"))).alias("err"), F.count("*").alias("n")
    )


def exclusive_sum(value: str, order: list[str], by: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def scanning_range(samples: DataFrame, size: int, tol: float) -> DataFrame:
    """(det, first, last): the blocks in which the mean speed exceeds tol times the detector's mean speed."""
    w = Window.partitionBy("det").orderBy("block")
    means = block_means(samples, size).withColumn("speed", F.abs(F.lead("value").over(w) - F.lag("value").over(w)) / 2)
    mean = F.avg("speed").over(Window.partitionBy("det"))
    fast = means.withColumn("__m", mean).where(F.col("speed") > tol * F.col("__m"))
    return fast.groupBy("det").agg(F.min("block").alias("first"), F.max("block").alias("last"))


def common_mode(samples: DataFrame, group: int) -> DataFrame:
    """(samp, value): median over blocks of `group` detectors of the blocks' medians."""
    inner = samples.groupBy("samp", F.floor(F.col("det") / group).alias("g")).agg(F.median("value").alias("m"))
    return inner.groupBy("samp").agg(F.median("m").alias("value"))


def pair_rotated(samples: DataFrame) -> DataFrame:
    """Detectors 2k and 2k + 1 as (sum, difference) / sqrt(2), sample by sample; applied twice it changes nothing."""
    even = F.max(F.when(F.col("det") % 2 == 0, F.col("value"))).alias("a")
    odd = F.max(F.when(F.col("det") % 2 == 1, F.col("value"))).alias("b")
    pairs = samples.groupBy(F.floor(F.col("det") / 2).alias("pair"), "samp").agg(even, odd).where("a is not null and b is not null")
    s = math.sqrt(2)
    return pairs.select("pair", "samp", ((F.col("a") + F.col("b")) / s).alias("plus"), ((F.col("a") - F.col("b")) / s).alias("minus"))


def detwise_adjoint(samples: DataFrame, x: Column) -> DataFrame:
    """(det, a, b): sums of value * x and of value, the transpose of adding a * x + b."""
    return samples.groupBy("det").agg(F.sum(F.col("value") * x).alias("a"), F.sum("value").alias("b"))


def last_crossing(samples: DataFrame, reference: Column, period: float) -> DataFrame:
    """(det, samp): the last sample after which the value changes sides of the reference, jumps by more than half a
    period left out; detectors without a crossing drop out."""
    w = Window.partitionBy("det").orderBy("samp")
    side = F.signum(F.col("value") - reference)
    at = samples.withColumn("__side", side)
    crossed = (F.lead("__side").over(w) != F.col("__side")) & (F.abs(F.lead("value").over(w) - F.col("value")) <= period / 2)
    return at.withColumn("__x", crossed).where("__x").groupBy("det").agg(F.max("samp").alias("samp"))


def inverse_weights(weights: DataFrame, order: str, tol: float = 1e-6, step: int = 100) -> DataFrame:
    """weights with `inverse`: 1 / ivar, or 0 where ivar is at most tol times the mean of every step-th weight, by
    `order` (unique), that is not 0."""
    some = with_position(weights.where("ivar <> 0").select(order, "ivar"), order).where(F.col("pos") % step == 0)
    mean = F.broadcast(some.agg(F.avg("ivar").alias("__mean")))  # one row
    return weights.crossJoin(mean).withColumn("inverse", F.when(F.col("ivar") > F.col("__mean") * tol, 1 / F.col("ivar")).otherwise(0.0)).drop("__mean")
