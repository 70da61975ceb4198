"""Maps: samples gathered by sky pixel with noise weights, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def white_weights(samples: DataFrame, size: int | None = None) -> DataFrame:
    """(det, ivar): inverse variance of each detector, or the inverse of the median of its blocks' variances."""
    if size is None:
        var = samples.groupBy("det").agg(F.var_pop("value").alias("var"))
    else:
        blocks = samples.groupBy("det", F.floor(F.col("samp") / size).alias("b")).agg(F.var_pop("value").alias("v"), F.count("*").alias("n"))
        var = blocks.where(F.col("n") == size).groupBy("det").agg(F.median("v").alias("var"))
    return var.where("var > 0").select("det", (1 / F.col("var")).alias("ivar"))


def binned(samples: DataFrame, weights: DataFrame, pixel: list[str]) -> DataFrame:
    """Per pixel: hits, the weighted sum, weight and mean of the samples."""
    at = samples.join(weights, "det")
    return at.groupBy(*pixel).agg(
        F.count("*").alias("hits"),
        F.sum(F.col("ivar") * F.col("value")).alias("rhs"),
        F.sum("ivar").alias("ivar"),
    ).withColumn("m", F.col("rhs") / F.col("ivar"))


def bilinear(samples: DataFrame, y: Column, x: Column, nx: int) -> DataFrame:
    """samples copied to the four pixels around (y, x) with their weights w; x is periodic with nx pixels."""
    fy, fx = F.floor(y), F.floor(x)
    ty, tx = y - fy, x - fx
    corners = F.array(
        *(
            F.struct(
                (fy + dy).cast("int").alias("py"),
                F.pmod((fx + dx), F.lit(nx)).cast("int").alias("px"),
                ((ty if dy else 1 - ty) * (tx if dx else 1 - tx)).alias("w"),
            )
            for dy in (0, 1)
            for dx in (0, 1)
        )
    )
    return samples.withColumn("__c", F.explode(corners)).select(*samples.columns, "__c.*").where("w > 0")


def polarised(samples: DataFrame, psi: Column, pixel: list[str], weight: Column) -> DataFrame:
    """Per pixel: hits, the three weighted sums of T, Q, U and the six elements of their weight matrix."""
    c, s, v = F.cos(2 * psi), F.sin(2 * psi), F.col("value")
    base = samples.withColumns({"__c": c, "__s": s, "__w": weight})
    c, s, w = F.col("__c"), F.col("__s"), F.col("__w")
    return base.groupBy(*pixel).agg(
        F.count("*").alias("hits"),
        F.sum(w * v).alias("rt"),
        F.sum(w * v * c).alias("rq"),
        F.sum(w * v * s).alias("ru"),
        F.sum(w).alias("tt"),
        F.sum(w * c).alias("tq"),
        F.sum(w * s).alias("tu"),
        F.sum(w * c * c).alias("qq"),
        F.sum(w * c * s).alias("qu"),
        F.sum(w * s * s).alias("uu"),
    )


def time_map(samples: DataFrame, weights: DataFrame, pixel: list[str], t: str) -> DataFrame:
    """Per pixel the weighted mean of the time since the first sample of all."""
    first = F.broadcast(samples.agg(F.min(t).alias("__t0")))  # one row
    at = samples.join(weights, "det").crossJoin(first)
    return at.groupBy(*pixel).agg((F.sum(F.col("ivar") * (F.col(t) - F.col("__t0"))) / F.sum("ivar")).alias("t"))


def scanned(samples: DataFrame, sky: DataFrame, pixel: list[str], value: str) -> DataFrame:
    """samples with what the sky map holds at their pixel, 0 outside it (the transpose of binning)."""
    return samples.join(sky.select(*pixel, F.col(value).alias("model")), pixel, "left").withColumn("model", F.coalesce("model", F.lit(0.0)))


def tiles(pixels: DataFrame, size: int, values: dict[str, Column]) -> DataFrame:
    """Sums of pixel values over tiles of size x size."""
    return pixels.groupBy(F.floor(F.col("py") / size).cast("int").alias("ty"), F.floor(F.col("px") / size).cast("int").alias("tx")).agg(
        *(v.alias(k) for k, v in values.items())
    )


def observation_info(samples: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """Per observation and band (every band): time, duration, samples and sensitivity, (sum of ivar)^-1/2."""
    dets = samples.groupBy(*by, "det").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")).join(weights, "det")
    return dets.groupBy(*by).agg(
        F.min("t0").alias("ctime"),
        (F.max("t1") - F.min("t0")).alias("dur"),
        F.sum("n").alias("nsamp"),
        F.count("*").alias("ndet"),
        (1 / F.sqrt(F.sum("ivar"))).alias("sens"),
    )
