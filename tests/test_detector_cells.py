"""The detectors of all observations, dealt out in cells."""

import collections

from pyspark.sql import functions as F

from scanloom.operators import detectors
from scanloom.plans import registry


def test_table_of_one_set_comes_from_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(detectors, "_CELL", 10)
    sets = spark.range(60).select(F.format_string("obs_%d", "id").alias("obs_id"), F.format_string("ufm_a_%d", F.col("id") % 1 + 1).alias("detset"))
    slots = spark.createDataFrame([("ufm_a_1", "ws0")], "detset string, slot string")
    dets = spark.range(90).select("id", F.format_string("det_%d", "id").alias("det"))
    matches = dets.select(F.format_string("ufm_a_%d", F.col("id") % 1 + 1).alias("detset"), F.concat(F.lit("ch"), "det").alias("channel"), "det")
    wafers = dets.select(F.lit("ufm_a").alias("wafer"), "det", F.when(F.col("det") == "det_3", None).otherwise("f090").alias("band"), F.lit("OPTC").alias("type"))
    out = detectors.detector_table(sets, slots, matches, wafers)
    rows = out.select("subid", "det", "channel", F.spark_partition_id().alias("p")).collect()
    want = {(f"obs_{o}:ws0:OPTC" if k == 3 else f"obs_{o}:ws0:f090:OPTC", f"det_{k}", f"chdet_{k}") for o in range(60) for k in range(90)}
    assert len(rows) == 60 * 90 and {tuple(r)[:3] for r in rows} == want
    assert len({r["p"] for r in rows}) > 1


def test_subids_are_put_together_before_rows_multiply(spark, small):
    plan = registry.QUERIES["detector_table"](spark, small)._jdf.queryExecution().sparkPlan().toString()
    above, below = plan.split("SortMergeJoin", 1)
    assert "concat_ws" not in above and "concat_ws" in below


def test_kinds_without_a_band_a_type_or_a_name(spark, monkeypatch):
    monkeypatch.setattr(detectors, "_CELL", 5)
    kinds = [("f090", "OPTC"), (None, "OPTC"), ("f090", None), (None, None), ("", ""), ("", "DARK")]
    dets = [(f"d{k}", *kinds[k % 6]) for k in range(60)]
    wafers = spark.createDataFrame([("u_a", d, b, t) for d, b, t in dets], "wafer string, det string, band string, type string")
    # a detector that is matched twice, one that no wafer has and a set without observations
    pairs = [("u_a_1", f"c{d}", d) for d, _, _ in dets] + [("u_a_1", "again", "d0"), ("u_a_1", "c", "none"), ("u_a_9", "c", "d0"), (None, "c", "d0")]
    matches = spark.createDataFrame(pairs, "detset string, channel string, det string")
    sets = spark.createDataFrame([(f"o{i}", "u_a_1") for i in range(12)] + [("o1", "u_a_1"), (None, "u_a_1"), ("x", "u_a_2"), ("x", None)], "obs_id string, detset string")
    slots = spark.createDataFrame([("u_a_1", "ws0"), ("u_a_1", ""), ("u_a_2", "ws1")], "detset string, slot string")
    got = collections.Counter(map(tuple, detectors.detector_table(sets, slots, matches, wafers).select("subid", "channel", "det").collect()))
    join = lambda *parts: ":".join(p for p in parts if p is not None)
    want = collections.Counter()
    for obs in [f"o{i}" for i in range(12)] + ["o1", None]:
        for slot in ("ws0", ""):
            for detset, channel, det in pairs:
                for d, band, kind in dets:
                    if d == det and detset == "u_a_1":
                        want[join(*(x for x in (join(obs, slot), join(band, kind)) if x)), channel, det] += 1
    assert got == want and sum(want.values()) == 28 * 61
