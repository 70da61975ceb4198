"""Queries of compact distribution, extreme values, leakage and masks, each with its SQL but for those that iterate or draw."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import balance, intervals, leakage, masks
from scanloom.plans.sample_queries import EDGED, MEANS
from scanloom.plans.sql_parts import CUTS, SAMP, WIDE, q
from scanloom.sources import catalog, simple
from scanloom.sources.shared import written


def distribute_compact(spark, d):
    """Observations dealt out to six owners by place and time; tests/test_balance.py has the method in NumPy."""
    state = F.array(F.col("bel") / 5, F.col("baz") / 60, (F.col("ctime") - 788918400.0) / 3e7)
    items = catalog.observations(spark, d).select("obs_key", F.col("nsamp").cast("double").alias("weight"), state.alias("state"))
    return balance.distribute_compact(items, 6, "obs_key", "weight").select("obs_key", "owner")


def extremes_clipped(spark, d):
    s = catalog.samples(spark, d)
    cuts = intervals.runs(s, "cut")
    nsamp = s.groupBy("det").agg(F.count("*").alias("nsamp"))
    n = F.col("nsamp").cast("int")
    wide = cuts.join(nsamp, "det")
    wide = wide.select("det", F.greatest(F.col("lo") - 1, F.lit(0)).alias("lo"), F.least(F.col("hi") + 1, n).alias("hi")).union(wide.select("det", "lo", F.least(F.col("hi") + 3, n).alias("hi")))
    out = intervals.extremes_clipped(s.select("det", "samp", "value"), intervals.united(wide), 5, nsamp, tol=0.5, det_step=2, step=5)
    return out.select("det", "samp", F.round("value", 5).alias("value"))


def _pairs(spark, d):
    s = catalog.samples(spark, d)
    return s.select("det", "samp", F.col("value").alias("x"), (F.col("value") * 0.25 + F.col("samp") % 7 + F.col("det") % 3).alias("y"))


def leakage_lines(spark, d):
    out = leakage.leakage(_pairs(spark, d), down=4, block=20)
    return out.select("det", F.round("slope", 6).alias("slope"), F.round("offset", 5).alias("offset"), "blocks")


def sampled_leakage(spark, d):
    """Drawn with a seed for each detector; tests/test_balance.py compares means and spreads with the exact posterior's."""
    return leakage.sampled_leakage(_pairs(spark, d), draws=100)


def masked_samples(spark, d):
    s = catalog.samples(spark, d).select("det", "samp", F.floor(F.col("value") / 10).alias("y"), F.col("samp").alias("x"))
    e = catalog.table(spark, d, "events").where("event_type = 'purchase'")
    mask = e.select((F.col("user_id") * 7 % 49).alias("y"), (F.col("event_id") % 200).alias("x")).distinct()
    return masks.masked_samples(s, mask, "det", 4, 2).select("det", "samp")


def simple_files(spark, d):
    """Samples written to one file for each of 12 groups of detectors, and read again: those that are not flagged."""
    s = catalog.samples(spark, d).withColumn("t", catalog.seconds(F.col("ts"))).withColumn("grp", F.col("det") % 12)
    info = written(simple.write_files(s.select("grp", "det", "samp", "t", "value", "cut"), "grp"), "simple-list")
    rows = simple.read_files(info, ("tod", "cuts"), mul=1).where("error is null")
    flat = rows.select("id", F.col("det").cast("long").alias("det"), "cut", F.posexplode("tod").alias("samp", "value"))
    good = flat.where(~F.exists("cut", lambda c: (F.col("samp") >= c["lo"]) & (F.col("samp") < c["hi"])))
    return good.groupBy("id", "det").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (simple_files, distribute_compact, extremes_clipped, leakage_lines, sampled_leakage, masked_samples)}
ORACLE_SQL = {
    "extremes_clipped": q(SAMP, CUTS, WIDE, MEANS, EDGED, """fl as (select s.det, samp, value as raw, m.lo is not null as inside, case when m.lo is null then value else l + (r - l) * ((samp - lo + 1) / (hi - lo + 1)) end as v
            from samp s left join edged m on m.det = s.det and samp >= lo and samp < hi),
        dn as (select det, row_number() over (order by det) - 1 as k from (select distinct det from samp)),
        df as (select v - lag(v) over (partition by det order by samp) as d from fl join dn using (det) where samp % 5 = 0 and k % 2 = 0),
        rm as (select sqrt(median(d * d)) * 0.5::double as most from df where d is not null)""",
        select="select det, samp, round(case when inside then v + greatest(-most, least(most, raw - v)) else raw end, 5) as value from fl cross join rm"),
    "leakage_lines": q(SAMP, """p as (select det, samp, value as x, value * 0.25::double + samp % 7 + det % 3 as y from samp),
        a as (select det, samp // 4 as a, avg(x) as x, avg(y) as y from p group by det, samp // 4 having count(*) = 4),
        m as (select det, a // 5 as b, avg(x) as mx, avg(y) as my, var_pop(x) * 5 as sxx, var_pop(y) * 5 as syy, covar_pop(x, y) * 5 as sxy from a group by det, a // 5 having count(*) = 5),
        f as (select det, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) as s, mx, my from m where sxy <> 0)""",
        select="select det, round(median(s), 6) as slope, round(median(my - s * mx), 5) as \"offset\", count(*) as blocks from f group by det"),
    # files are cut to a length without prime factors above 7
    "simple_files": q(SAMP, """g as (select det % 12 as grp, max(samp) + 1 as n from samp group by 1),
        pw as (select cast(a.x * b.x * c.x * e.x as double) as v from (select power(2, i) as x from range(20) r(i)) a, (select power(3, i) as x from range(12) r(i)) b,
            (select power(5, i) as x from range(8) r(i)) c, (select power(7, i) as x from range(7) r(i)) e),
        f as (select grp, (select max(v) from pw where v <= n) as n from g)""",
        select="select 'obs_' || grp as id, det, count(*) as n, round(sum(value), 4) as total from samp join f on f.grp = det % 12 where not cut and samp < f.n group by 1, 2"),
    "masked_samples": q(SAMP, "mk as (select distinct user_id * 7 % 49 as y, event_id % 200 as x from events where event_type = 'purchase')",
        select="select det, samp from samp join mk on mk.x = samp and mk.y = floor(value / 10)"),
}
