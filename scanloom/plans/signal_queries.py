"""Queries of maps with several kinds of unknowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators import intervals, mapping, signals
from scanloom.plans.sql_parts import CUTS, IVAR, SAMP, q
from scanloom.sources import catalog


def pointed(spark: SparkSession, d: str) -> DataFrame:
    """All samples with weights, a pixel (day and hour), a time of day as elevation, and the block of their cut."""
    s = catalog.samples(spark, d)
    s = signals.with_cut_blocks(s, intervals.runs(s, "cut")).join(mapping.white_weights(s), "det")
    at = s.withColumns({"grp": F.col("det") % 25, "pix": (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("long")})
    return signals.with_elevation_basis(at, ["grp"], F.hour("ts") * 60 + F.minute("ts"), 1)


def unknowns() -> list[signals.Signal]:
    """Sky where nothing is cut, offsets of 16 samples, lines over cuts, and the response to elevation."""
    prior = signals.relative_prior(1.0)
    block = F.col("det") * 1_000_000
    return [
        signals.constant("sky", F.col("pix")).only(~F.col("cut")),
        signals.constant("offset", block + F.floor(F.col("samp") / 16), prior),
        signals.cut_polynomial(block + F.col("lo"), 1, prior),
        signals.elevation(F.col("det"), 1, prior),
    ]


def _parts(vector: DataFrame, digits: int, nudge: float = 0.0) -> DataFrame:
    rows = vector.select("signal", "key", F.posexplode("value").alias("part", "value"))
    return rows.withColumn("value", F.round(F.col("value") + nudge, digits))


def signal_rhs(spark, d):
    """The right side of the map equation, of samples weighed by white noise and a common mode of each group of detectors."""
    data = signals.prepared(pointed(spark, d), unknowns())
    weigh = signals.common_mode_noise(["grp", "samp"], F.lit(1.0), F.lit(500.0))
    return _parts(signals.gathered(weigh(data, "v"), unknowns(), "nv"), 7, 1.23e-10)


def signal_map(spark, d):
    """The sky of the joint solution with white noise."""
    got = signals.solve(pointed(spark, d), unknowns(), error=1e-12)
    return _parts(got.vector.where("signal = 0"), 3).drop("signal")


QUERIES = {f.__name__: f for f in (signal_rhs, signal_map)}

ORACLE_SQL = {
    "signal_rhs": q(SAMP, CUTS, IVAR, """e as (select s.*, ivar, det % 25 as grp, day(ts) * 24 + hour(ts) as pix, cast(hour(ts) * 60 + minute(ts) as double) as el
            from samp s join ivar using (det)),
        n as (select *, coalesce((2 * el - min(el) over g - max(el) over g) / nullif(max(el) over g - min(el) over g, 0), 0) as el1,
            ivar * (value - 500 * sum(ivar * value) over t / (1 + 500 * sum(ivar) over t)) as nv
            from e window g as (partition by grp), t as (partition by grp, samp)),
        c as (select n.*, lo, hi from n left join cuts on n.det = cuts.det and samp >= lo and samp < hi),
        u as (select 0 as signal, pix as key, 0 as part, nv as x from c where not cut
            union all select 1, det * 1000000 + samp // 16, 0, nv from c
            union all select 2, det * 1000000 + lo, 0, nv from c where lo is not null
            union all select 2, det * 1000000 + lo, 1, case when hi - lo > 1 then nv * (2 * samp + 1 - lo - hi) / (hi - lo) else 0 end from c where lo is not null
            union all select 3, det, 0, nv * el1 from c)""",
        select="select signal, key, part, round(sum(x) + 1.23e-10, 7) as value from u group by 1, 2, 3"),
}
