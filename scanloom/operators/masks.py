"""Samples that look into a mask of the sky, found through a pyramid of ever coarser pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pyramid(mask: DataFrame, levels: int, factor: int = 8) -> DataFrame:
    """(level, y, x): the pixels of a mask (y, x) at level 0, and those of factor^level pixels that hold some of them."""
    out = mask.select(F.lit(0).alias("level"), "y", "x").distinct()
    for k in range(1, levels + 1):
        size = factor**k
        out = out.unionByName(mask.select(F.lit(k).alias("level"), F.floor(F.col("y") / size).alias("y"), F.floor(F.col("x") / size).alias("x")).distinct())
    return out


def boxes_near(boxes: DataFrame, mask: DataFrame, key: str, size: int, pad: Column) -> DataFrame:
    """Of boxes (key, y0, y1, x0, x1, ends included) those that, wider by `pad` pixels on all sides, meet a pixel of `size`
    pixels that holds some of the mask: keys that come near enough to look closer."""
    coarse = mask.select(F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx")).distinct()
    edge = lambda c, d: F.floor((F.col(c) + d) / size)
    cells = boxes.select(key, F.explode(F.sequence(edge("y0", -pad), edge("y1", pad))).alias("cy"), edge("x0", -pad).alias("a"), edge("x1", pad).alias("b"))
    cells = cells.select(key, "cy", F.explode(F.sequence("a", "b")).alias("cx"))
    return cells.join(coarse, ["cy", "cx"], "left_semi").select(key).distinct()


def masked_samples(samples: DataFrame, mask: DataFrame, key: str, factor: int = 8, levels: int = 2) -> DataFrame:
    """Of samples (key, y, x in whole pixels, ...) those in the mask (y, x), like a join with it.

    Each key's box is compared with the coarsest pixels first; only samples of keys that come near go on, and of those only
    samples in coarse pixels of each finer level reach the join with the mask itself. Nulls are in no mask."""
    box = samples.groupBy(key).agg(*(f(c).alias(f"{c}{k}") for c in ("y", "x") for f, k in ((F.min, 0), (F.max, 1)))).where("y0 is not null and x0 is not null")
    near = boxes_near(box, mask, key, factor**levels, F.lit(0))
    left = samples.join(near, key, "left_semi")
    for k in range(levels - 1, 0, -1):
        size = factor**k
        coarse = mask.select(F.floor(F.col("y") / size).alias("__cy"), F.floor(F.col("x") / size).alias("__cx")).distinct()
        left = left.join(coarse, (F.floor(left["y"] / size) == F.col("__cy")) & (F.floor(left["x"] / size) == F.col("__cx")), "left_semi")
    return left.join(mask.select("y", "x").distinct(), ["y", "x"], "left_semi").select(*samples.columns)
