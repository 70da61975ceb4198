"""Calibration of samples and of detectors: modulation, elevation and common-mode response, object cuts, extra unknowns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import angles
from scanloom.operators.intervals import in_ranges


def without_harmonics(samples: DataFrame, coefficients: DataFrame, phase: str, order: int = 2) -> DataFrame:
    """Values less sum_k (c_k cos k phase + s_k sin k phase); coefficients is (det, c array<double>, s array<double>)."""
    joined = samples.join(coefficients, "det", "left")
    model = F.lit(0.0)
    for k in range(1, order + 1):
        part = F.get("c", F.lit(k - 1)) * F.cos(k * F.col(phase)) + F.get("s", F.lit(k - 1)) * F.sin(k * F.col(phase))
        model = model + F.coalesce(part, F.lit(0.0))
    return joined.withColumn("value", F.col("value") - model).drop("c", "s")


def harmonic_coefficients(samples: DataFrame, phase: str, order: int = 2) -> DataFrame:
    """(det, c, s): twice the mean of value * cos k phase and value * sin k phase, k = 1 to order."""
    sums = lambda f: F.array(*(2 * F.avg(F.col("value") * f(k * F.col(phase))) for k in range(1, order + 1)))
    return samples.groupBy("det").agg(sums(F.cos).alias("c"), sums(F.sin).alias("s"))


def demodulated(samples: DataFrame, phase: str, size: int, harmonic: int = 4) -> DataFrame:
    """(det, comp, block, value): T is the mean of a block of `size` samples, Q and U twice the mean of the value times
    cos and sin of harmonic * phase. A block mean takes the place of a low pass in Fourier space."""
    carrier = harmonic * F.col(phase)
    blocks = samples.groupBy("det", F.floor(F.col("samp") / size).alias("block")).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("t"),
        (2 * F.avg(F.col("value") * F.cos(carrier))).alias("q"),
        (2 * F.avg(F.col("value") * F.sin(carrier))).alias("u"),
    )
    parts = F.array(*(F.struct(F.lit(k).alias("comp"), F.col(c).alias("value")) for k, c in enumerate("tqu")))
    return blocks.where(F.col("n") == size).select("det", "block", F.explode(parts).alias("p")).select("det", "p.comp", "block", "p.value")


def block_response(samples: DataFrame, x: Column, size: int) -> DataFrame:
    """(det, block, slope, offset): least squares of value = slope * x + offset in each full block; null where x is constant."""
    at = samples.withColumn("__x", x)
    sums = at.groupBy("det", F.floor(F.col("samp") / size).alias("block")).agg(
        F.count("*").alias("n"),
        F.covar_pop("value", "__x").alias("cov"),
        F.var_pop("__x").alias("var"),
        F.avg("value").alias("v"),
        F.avg("__x").alias("m"),
    )
    slope = F.col("cov") / F.when(F.col("var") > 0, F.col("var"))
    return sums.where(F.col("n") == size).select("det", "block", slope.alias("slope"), (F.col("v") - slope * F.col("m")).alias("offset"))


def response_gains(response: DataFrame, band: Column, least: float = 0.0) -> DataFrame:
    """(det, response, gain): the median response of a detector over blocks, and its band's median over that; detectors
    of a response of at most `least` drop out."""
    own = response.where("slope is not null").groupBy("det").agg(F.median("slope").alias("response"))
    own = own.where(F.abs("response") > least).withColumn("band", band)
    mid = own.groupBy("band").agg(F.median("response").alias("mid"))
    return own.join(mid, "band").select("det", "band", "response", (F.col("mid") / F.col("response")).alias("gain"))


def common_mode_gains(samples: DataFrame, common: DataFrame, band: Column) -> DataFrame:
    """Gains from each detector's least-squares amplitude on a common mode (samp, value)."""
    at = samples.join(common.select("samp", F.col("value").alias("m")), "samp")
    amp = at.groupBy("det").agg((F.sum(F.col("value") * F.col("m")) / F.sum(F.col("m") * F.col("m"))).alias("slope"))
    return response_gains(amp.withColumn("block", F.lit(0)), band)


def object_positions(track: DataFrame, times: DataFrame, at: str, step: float) -> DataFrame:
    """Positions of objects at `at` by linear interpolation of their track (name, t, lon, lat), given every `step`."""
    w = Window.partitionBy("name").orderBy("t")
    legs = track.select("name", "t", "lon", "lat", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    legs = legs.withColumn("leg", F.floor(F.col("t") / step)).where("lon2 is not null")
    joined = times.withColumn("leg", F.floor(F.col(at) / step)).join(legs, "leg")
    share = (F.col(at) - F.col("t")) / step
    return joined.withColumns(
        {"olon": F.col("lon") + (F.col("lon2") - F.col("lon")) * share, "olat": F.col("lat") + (F.col("lat2") - F.col("lat")) * share}
    ).drop("leg", "t", "lon", "lat", "lon2", "lat2")


def near_objects(samples: DataFrame, track: DataFrame, at: str, step: float, lon: Column, lat: Column, radius: float) -> DataFrame:
    """Samples with `near`, whether some object is within `radius` (radians) at their time. The track meets the samples by
    leg of `step`, a few objects each; latitude is compared before the distance is computed."""
    posed = object_positions(track, samples.select("det", "samp", F.col(at).alias("__at"), lon.alias("__lon"), lat.alias("__lat")), "__at", step)
    close = posed.where(F.abs(F.col("__lat") - F.col("olat")) <= radius)
    close = close.where(angles.distance(F.col("__lon"), F.col("__lat"), F.col("olon"), F.col("olat")) <= radius)
    hit = close.select("det", "samp").distinct().withColumn("near", F.lit(True))
    return samples.join(hit, ["det", "samp"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def legendre(x: Column, order: int) -> list[Column]:
    """Legendre polynomials 0 to order at x, by their recursion."""
    out = [F.lit(1.0), x]
    for n in range(1, order):
        out.append(((2 * n + 1) * x * out[n] - n * out[n - 1]) / (n + 1))
    return out[: order + 1]


def cut_polynomials(samples: DataFrame, cuts: DataFrame, order: int = 2) -> DataFrame:
    """(det, lo, n, p0 ... p_order): sums over each range of value times the Legendre polynomials of the place in it."""
    at = in_ranges(samples.select("det", "samp", "value"), cuts, "lo", "hi")
    x = (2 * F.col("samp") + 1 - F.col("lo") - F.col("hi")) / (F.col("hi") - F.col("lo"))
    return at.groupBy("det", "lo").agg(
        F.count("*").alias("n"), *(F.sum(F.col("value") * p).alias(f"p{k}") for k, p in enumerate(legendre(x, order)))
    )


def loud_blocks(samples: DataFrame, weights: DataFrame, size: int, tol: float) -> DataFrame:
    """(det, block, var): full blocks whose variance exceeds tol^2 / ivar; their samples become unknowns of their own."""
    blocks = samples.groupBy("det", F.floor(F.col("samp") / size).alias("block")).agg(F.var_pop("value").alias("var"), F.count("*").alias("n"))
    return blocks.where(F.col("n") == size).join(weights, "det").where(F.col("var") * F.col("ivar") > tol**2).select("det", "block", "var")


def shared_ranges(members: DataFrame, by: str, tol: float) -> DataFrame:
    """(by, t1, t2, n, ok): what the time ranges [t1, t2) of a group's members share, and whether it is not empty and the
    members' lengths agree within tol."""
    got = members.groupBy(by).agg(
        F.max("t1").alias("t1"),
        F.min("t2").alias("t2"),
        F.count("*").alias("n"),
        (F.max(F.col("t2") - F.col("t1")) - F.min(F.col("t2") - F.col("t1"))).alias("spread"),
    )
    ok = (F.col("t2") > F.col("t1")) & (F.col("spread") <= tol)
    return got.select(by, "t1", "t2", "n", ok.alias("ok"))


def pixel_bounds(hits: DataFrame, nx: int) -> DataFrame:
    """(y0, y1, x0, width): the smallest box of the hit pixels (y, x), where x has period nx: it begins behind the widest
    gap. Only rows and columns that are hit, not pixels, meet in one task."""
    columns = hits.select("x").distinct()
    edges = Window.orderBy("x")
    first, last = F.min("x").over(Window.partitionBy()), F.max("x").over(Window.partitionBy())
    gaps = columns.select("x", (F.coalesce(F.lead("x").over(edges), first + nx) - F.col("x")).alias("gap"), last.alias("__l"))
    widest = gaps.agg(F.max_by("x", F.struct("gap", "x")).alias("before"), F.max("gap").alias("gap"))
    start = widest.join(columns, F.lit(True)).where(F.col("x") > F.col("before")).agg(F.min("x").alias("after"))
    box = hits.agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    least = columns.agg(F.min("x").alias("least"))
    return box.crossJoin(start).crossJoin(least).crossJoin(widest).select(
        "y0", "y1", F.coalesce("after", "least").alias("x0"), (F.lit(nx) - F.col("gap") + 1).alias("width")
    )


def box_tiles(boxes: DataFrame, size: int, ny: int, nx: int) -> DataFrame:
    """The tiles that pixel boxes (y0, y1, x0, x1) meet; y is cut at the map's edges, x wraps."""
    y = F.explode(F.sequence(F.floor(F.greatest(F.col("y0"), F.lit(0)) / size), F.floor((F.least(F.col("y1"), F.lit(ny)) - 1) / size)))
    rows = boxes.where((F.col("y1") > 0) & (F.col("y0") < ny) & (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))).withColumn("ty", y)
    tx = F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor((F.col("x1") - 1) / size)))
    out = rows.withColumn("tx", tx).withColumn("tx", F.pmod("tx", F.lit(math.ceil(nx / size))))
    return out.drop("y0", "y1", "x0", "x1").distinct()
