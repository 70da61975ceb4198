"""Clusters and sessions whose rows lie in several ranges."""

import pandas as pd
import numpy as np

from pyspark.sql import functions as F

from scanloom.operators import grouping


def test_clusters_of_one_large_group_come_from_ranges(spark):
    r = np.random.default_rng(2)
    at = [*map(float, np.cumsum(r.choice([1.0, 50.0], 3000, p=[0.97, 0.03])))]
    rows = [("a" if k % 10 else None, k, x) for k, x in enumerate(at)] + [("b", 9000, 5.0)]
    df = spark.createDataFrame(rows, "by string, id long, at double").repartition(5)
    out = grouping.group_by_tolerance(df, "at", 10.0, ["by"], ["id"])
    got = {(x["by"], x["id"]): x["cluster"] for x in out.collect()}
    want, last, now = {}, {}, {}
    for by, k, x in rows:
        now[by] = now.get(by, 0) + (by in last and x - last[by] > 10)
        last[by] = x
        want[by, k] = now[by]
    assert got == want
    # no task gets the whole group: it lies in several ranges, and every window over rows goes by range
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in x for x in plan.split("\n") if "Window [" in x)
