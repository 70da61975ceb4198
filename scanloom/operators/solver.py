"""The map equation (P' N^-1 P + Q) m = P' N^-1 d by conjugate gradients over DataFrames.

The unknowns are the sky's pixels and one offset for each detector and block (a destriping model with white noise).
Vectors are tables (signal, idx, value); a step is two joins and two aggregations, the scalars come back to the driver
and every step's vectors are written to the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Solution:
    vector: DataFrame
    errors: list[float]


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(samples: DataFrame, value: str) -> DataFrame:
    """P' N^-1: samples (pix, off, ivar, value) summed into the unknowns (signal, idx, value)."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("signal"), F.col("pix").alias("idx")), F.struct(F.lit(1).alias("signal"), F.col("off").alias("idx"))))
    rows = samples.select(both.alias("u"), (F.col("ivar") * F.col(value)).alias("wv"))
    return rows.groupBy("u.signal", "u.idx").agg(F.sum("wv").alias("value"))


def projected(samples: DataFrame, x: DataFrame) -> DataFrame:
    """P: samples with what the unknowns add up to, as `model`."""
    sky = x.where("signal = 0").select(F.col("idx").alias("pix"), F.col("value").alias("__s"))
    off = x.where("signal = 1").select(F.col("idx").alias("off"), F.col("value").alias("__o"))
    out = samples.join(sky, "pix", "left").join(off, "off", "left")
    return out.withColumn("model", F.coalesce("__s", F.lit(0.0)) + F.coalesce("__o", F.lit(0.0))).drop("__s", "__o")


def solve(samples: DataFrame, folder: str, prior: float = 1e-3, steps: int = 50, error: float = 1e-7) -> Solution:
    """The unknowns of samples (pix long, off long, ivar, value), with `prior` times its weight added to each offset,
    preconditioned by the diagonal. `folder` is shared by all executors."""
    samples = _written(samples.select("pix", "off", "ivar", "value"), folder, "samples")
    diag = gathered(samples.withColumn("one", F.lit(1.0)), "one")
    diag = diag.withColumn("q", F.when(F.col("signal") == 1, prior * F.col("value")).otherwise(0.0))
    diag = _written(diag.withColumnRenamed("value", "d"), folder, "diag")
    keys = ["signal", "idx"]
    b = gathered(samples, "value")
    state = b.join(diag, keys).select(*keys, "d", "q", F.lit(0.0).alias("x"), F.col("value").alias("r"), (F.col("value") / (F.col("d") + F.col("q"))).alias("p"))
    state = _written(state, folder, "state")
    rz = first = state.agg(F.sum(F.col("r") * F.col("r") / (F.col("d") + F.col("q")))).first()[0] or 0.0
    errors = [1.0]
    for _ in range(steps):
        if not first or errors[-1] < error:
            break
        p = state.select(*keys, F.col("p").alias("value"))
        ap = gathered(projected(samples, p), "model").withColumnRenamed("value", "ap")
        both = _written(state.join(ap, keys).withColumn("ap", F.col("ap") + F.col("q") * F.col("p")), folder, "step")
        alpha = rz / both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        both = both.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("ap")})
        new = both.agg(F.sum(F.col("r") * F.col("r") / (F.col("d") + F.col("q")))).first()[0]
        beta = new / rz
        state = both.select(*keys, "d", "q", "x", "r", (F.col("r") / (F.col("d") + F.col("q")) + beta * F.col("p")).alias("p"))
        state = _written(state, folder, "state")
        rz = new
        errors.append(rz / first)
    return Solution(state.select(*keys, F.col("x").alias("value")), errors)
