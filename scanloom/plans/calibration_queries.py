"""Queries of calibration and extra unknowns, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scanloom.operators import blocks, calibration, grouping, intervals, joins, mapping
from scanloom.plans.catalog_queries import PERIODS
from scanloom.plans.sql_parts import CUTS, IVAR, OBS, SAMP, q
from scanloom.sources import catalog


def _phased(spark, d):
    phase = (F.minute("ts") * 60 + F.second("ts")).cast("double") * (math.pi / 1800)
    return catalog.samples(spark, d).withColumn("phase", phase)


PHASED = "ph as (select *, cast(minute(ts) * 60 + second(ts) as double) * (pi() / 1800) as phase from samp)"


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n) + 1.23e-9, digits) for n in names})


def subtract_harmonics(spark, d):
    s = _phased(spark, d)
    out = calibration.without_harmonics(s, calibration.harmonic_coefficients(s, "phase"), "phase")
    return _rounded(out.groupBy("det").agg(F.sum(F.col("value") * F.col("value")).alias("power")), "power", digits=4)


def demodulate(spark, d):
    return _rounded(calibration.demodulated(_phased(spark, d), "phase", 8), "value")


def el_response(spark, d):
    got = calibration.block_response(catalog.samples(spark, d), F.hour("ts").cast("double"), 16)
    return _rounded(got, "slope", "offset")


def el_gains(spark, d):
    got = calibration.block_response(catalog.samples(spark, d), F.hour("ts").cast("double"), 16)
    return _rounded(calibration.response_gains(got, F.col("det") % 3, 0.5), "response", "gain")


def common_mode_gains(spark, d):
    s = catalog.samples(spark, d)
    return _rounded(calibration.common_mode_gains(s, blocks.common_mode(s, 8), F.col("det") % 3), "response", "gain")


def _track(spark):
    """Two objects on straight paths over January 2024, given every day."""
    t = F.col("id") * 86400 + 1704067200
    a = spark.range(32).select(F.lit("a").alias("name"), t.cast("double").alias("t"), (F.col("id") * 0.2).alias("lon"), (F.col("id") * 0.04 - 0.6).alias("lat"))
    b = spark.range(32).select(F.lit("b").alias("name"), t.cast("double").alias("t"), (6.0 - F.col("id") * 0.15).alias("lon"), (0.5 - F.col("id") * 0.03).alias("lat"))
    return a.unionByName(b)


def object_cut(spark, d):
    """Runs of samples within 0.4 rad of a moving object."""
    t = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    s = catalog.samples(spark, d).withColumn("t", t)
    near = calibration.near_objects(s, _track(spark), "t", 86400.0, (F.col("det") % 60) / 10.0, (F.col("det") % 11) / 10.0 - 0.5, 0.4)
    return intervals.runs(near, "near")


def cut_polynomials(spark, d):
    s = catalog.samples(spark, d)
    got = calibration.cut_polynomials(s, intervals.runs(s, "cut"), 3)
    return _rounded(got, "p0", "p1", "p2", "p3", digits=5)


def loud_blocks(spark, d):
    s = catalog.samples(spark, d)
    return _rounded(calibration.loud_blocks(s, mapping.white_weights(s), 8, 1.2), "var", digits=4)


def shared_ranges(spark, d):
    obs = catalog.observations(spark, d)
    members = obs.select((F.floor(F.col("ctime") / 86400)).cast("long").alias("grp"), F.col("ctime").alias("t1"), (F.col("ctime") + F.col("dur") * 40).alias("t2"))
    return calibration.shared_ranges(members, "grp", 36000.0)


def depth1_maps(spark, d):
    """A map for each scan period: observations matched at their middle, their samples gathered by azimuth cell."""
    obs = catalog.observations(spark, d)
    periods = grouping.scan_periods(obs, ["bel"], 7200.0, 400.0, ["baz"], ["obs_key"])
    mid = obs.select("obs_key", F.col("bel").alias("el"), "baz", "nsamp", (F.col("ctime") + F.col("dur") / 2).alias("mid"))
    hits = joins.bucketed_range_join(mid, periods, "mid", "t0", "t1", 86400.0).where("el = bel")
    return hits.groupBy("bel", "session", F.floor(F.col("baz") / 60).cast("int").alias("px")).agg(F.count("*").alias("n"), F.sum("nsamp").alias("hits"))


def pixel_bounds(spark, d):
    """The box of the pixels of a strip that wraps around the map's edge."""
    obs = catalog.observations(spark, d).where("baz >= 290 or baz < 45")
    return calibration.pixel_bounds(obs.select(((F.col("bel") - 30) / 5).cast("int").alias("y"), (F.col("baz") / 5).cast("int").alias("x")).distinct(), 72)


def box_tiles(spark, d):
    obs = catalog.observations(spark, d)
    y0, x0 = ((F.col("bel") - 35)).cast("int"), F.col("baz").cast("int")
    boxes = obs.select("flavor", y0.alias("y0"), (y0 + 6).alias("y1"), x0.alias("x0"), (x0 + 20).alias("x1"))
    return calibration.box_tiles(boxes, 16, 24, 352)


HARM = ", ".join(f"2 * avg(value * cos({k} * phase)) as c{k}, 2 * avg(value * sin({k} * phase)) as s{k}" for k in (1, 2))
BLOCK_FIT = "bl as (select det, samp // 16 as block, covar_pop(value, hour(ts)) / nullif(var_pop(hour(ts)), 0) as slope, avg(value) as v, avg(hour(ts)) as m from samp group by 1, 2 having count(*) = 16)"
QUERIES = {
    f.__name__: f
    for f in (subtract_harmonics, demodulate, el_response, el_gains, common_mode_gains, object_cut, cut_polynomials, loud_blocks, shared_ranges, depth1_maps, pixel_bounds, box_tiles)
}
ORACLE_SQL = {
    "subtract_harmonics": q(SAMP, PHASED, f"co as (select det, {HARM} from ph group by det)", """r as (select det, value - (c1 * cos(phase) + s1 * sin(phase)) - (c2 * cos(2 * phase) + s2 * sin(2 * phase)) as v
        from ph join co using (det))""", select="select det, round(sum(v * v) + 1.23e-9, 4) as power from r group by det"),
    "demodulate": q(SAMP, PHASED, """b as (select det, samp // 8 as block, avg(value) as t, 2 * avg(value * cos(4 * phase)) as q, 2 * avg(value * sin(4 * phase)) as u
        from ph group by 1, 2 having count(*) = 8)""", select="""select det, 0 as comp, block, round(t + 1.23e-9, 6) as value from b union all select det, 1, block, round(q + 1.23e-9, 6) from b
        union all select det, 2, block, round(u + 1.23e-9, 6) from b"""),
    "el_response": q(SAMP, BLOCK_FIT, select="select det, block, round(slope + 1.23e-9, 6) as slope, round(v - slope * m + 1.23e-9, 6) as offset from bl"),
    "el_gains": q(SAMP, BLOCK_FIT, "o as (select det, det % 3 as band, median(slope) as response from bl where slope is not null group by det having abs(median(slope)) > 0.5), m as (select band, median(response) as mid from o group by band)",
        select="select det, band, round(response + 1.23e-9, 6) as response, round(mid / response + 1.23e-9, 6) as gain from o join m using (band)"),
    "common_mode_gains": q(SAMP, """g as (select samp, median(value) as m from samp group by samp, det // 8), c as (select samp, median(m) as m from g group by samp),
        o as (select det, det % 3 as band, sum(value * m) / sum(m * m) as response from samp join c using (samp) group by det), k as (select band, median(response) as mid from o where abs(response) > 0 group by band)""",
        select="select det, band, round(response + 1.23e-9, 6) as response, round(mid / response + 1.23e-9, 6) as gain from o join k using (band) where abs(response) > 0"),
    "object_cut": q(SAMP, """tr as (select n, k, case n when 'a' then k * 0.2 else 6.0 - k * 0.15 end::double as lon, case n when 'a' then k * 0.04 - 0.6 else 0.5 - k * 0.03 end::double as lat from (select cast(range as double) as k from range(32)) cross join (values ('a'), ('b')) as o(n)),
        s as (select det, samp, (det % 60) / 10.0 as x, (det % 11) / 10.0 - 0.5 as y, (floor(epoch(ts)) - 1704067200) / 86400 as t from samp),
        h as (select distinct det, samp from s join tr a on floor(s.t) = a.k join tr b on a.n = b.n and b.k = a.k + 1
        where 2 * asin(sqrt(sin((a.lat + (b.lat - a.lat) * (t - a.k) - y) / 2) ** 2 + cos(y) * cos(a.lat + (b.lat - a.lat) * (t - a.k)) * sin((a.lon + (b.lon - a.lon) * (t - a.k) - x) / 2) ** 2)) <= 0.4),
        f as (select det, samp, samp - row_number() over (partition by det order by samp) as g from h)""",
        select="select det, cast(min(samp) as integer) as lo, cast(max(samp) + 1 as integer) as hi from f group by det, g"),
    "cut_polynomials": q(SAMP, CUTS, "x as (select s.det, lo, value, (2 * samp + 1 - lo - hi) / (hi - lo) as x from samp s join cuts c on s.det = c.det and samp >= lo and samp < hi)",
        select="""select det, lo, count(*) as n, round(sum(value) + 1.23e-9, 5) as p0, round(sum(value * x) + 1.23e-9, 5) as p1, round(sum(value * (3 * x * x - 1) / 2) + 1.23e-9, 5) as p2,
        round(sum(value * (5 * x * x * x - 3 * x) / 2) + 1.23e-9, 5) as p3 from x group by det, lo"""),
    "loud_blocks": q(SAMP, IVAR, "b as (select det, samp // 8 as block, var_pop(value) as var from samp group by 1, 2 having count(*) = 8)",
        select="select det, block, round(var + 1.23e-9, 4) as var from b join ivar using (det) where var * ivar > 1.2 * 1.2"),
    "shared_ranges": q(OBS, select="""select cast(floor(ctime / 86400) as bigint) as grp, max(ctime) as t1, min(ctime + dur * 40) as t2, count(*) as n,
        min(ctime + dur * 40) > max(ctime) and max(dur * 40) - min(dur * 40) <= 36000 as ok from obs group by 1"""),
    "depth1_maps": q(OBS, PERIODS.format(ttol=7200, atol=400), select="""select p.bel, session, cast(floor(baz / 60) as integer) as px, count(*) as n, cast(sum(nsamp) as bigint) as hits from obs o
        join periods p on p.bel = o.bel and ctime + dur / 2 >= t0 and ctime + dur / 2 < t1 group by 1, 2, 3"""),
    "pixel_bounds": q(OBS, "h as (select distinct cast((bel - 30) / 5 as integer) as y, cast(floor(baz / 5) as integer) as x from obs where baz >= 290 or baz < 45)",
        "c as (select distinct x from h), g as (select x, coalesce(lead(x) over (order by x), (select min(x) from c) + 72) - x as gap, coalesce(lead(x) over (order by x), (select min(x) from c)) as after from c)",
        select="select (select min(y) from h) as y0, (select max(y) + 1 from h) as y1, after as x0, 72 - gap + 1 as width from g order by gap desc, x desc limit 1"),
    "box_tiles": q(OBS, "b as (select flavor, cast(bel - 35 as integer) as y0, cast(baz as integer) as x0 from obs)",
        "t as (select flavor, unnest(range(cast(greatest(y0, 0) // 16 as bigint), cast((least(y0 + 6, 24) - 1) // 16 + 1 as bigint))) as ty, x0 from b where y0 + 6 > 0 and y0 < 24)",
        select="select distinct flavor, ty, tx % 22 as tx from (select flavor, ty, unnest(range(cast(x0 // 16 as bigint), cast((x0 + 19) // 16 + 1 as bigint))) as tx from t)"),
}
