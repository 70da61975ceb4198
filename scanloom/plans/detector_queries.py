"""Queries of detector metadata, sky predicates and spectra, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scanloom.operators import detectors, intervals, sky, spectra
from scanloom.plans.sql_parts import CUTS, OBS, SAMP, q
from scanloom.sources import catalog


def id_names(spark, d):
    """Ids and names of observations, detector sets and detectors, taken apart."""
    key = F.col("s_suppkey")
    obs = F.format_string("obs_%d_lati1", 1700000000 + key * 60)
    detset, det = F.format_string("ufm_mv%d_17_tune", key % 9), F.format_string("Mv_f%03d_Cr%02d", key % 3 * 60 + 30, key % 50)
    parts = {"t": detectors.obs_time(obs), "wafer": detectors.wafer_name(detset), "band": detectors.band_of_name(det)}
    return catalog.table(spark, d, "supplier").select("s_suppkey", *(c.alias(n) for n, c in parts.items()))


def detector_table(spark, d):
    """suppliers as observations of one detector set each, parts as detectors; some lack a match, a wafer or a slot."""
    part, key = catalog.table(spark, d, "part"), F.col("p_partkey")
    wafer = F.format_string("ufm_mv%d", key % 8)
    detset = F.concat(wafer, F.format_string("_%d", key % 3))
    det = F.format_string("det_%d", key)
    matches = part.where(key % 13 != 0).select(detset.alias("detset"), F.format_string("ch_%d", key).alias("channel"), det.alias("det"))
    band, kind = F.when(F.col("p_size") % 2 == 0, "f090").otherwise("f150"), F.when(F.col("p_size") % 10 == 0, "DARK").otherwise("OPTC")
    row, col = (key % 20).cast("int").alias("row"), (key % 7).cast("int").alias("col")
    wafers = part.where(key % 11 != 0).select(wafer.alias("wafer"), det.alias("det"), band.alias("band"), kind.alias("type"), row, col)
    slots = spark.range(23).select(F.format_string("ufm_mv%d_%d", F.col("id") % 8, F.col("id") % 3).alias("detset"), F.format_string("ws%d", F.col("id") % 7).alias("slot"))
    s = F.col("s_suppkey")
    sets = catalog.table(spark, d, "supplier").select(F.format_string("obs_%d", s).alias("obs_id"), F.format_string("ufm_mv%d_%d", s % 8, s % 3).alias("detset"))
    return detectors.detector_table(sets, slots, matches, wafers)


def index_files(spark, d):
    line = catalog.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    index = line.select(F.col("l_orderkey").alias("obs_key"), F.col("l_linenumber").alias("file_id"), F.format_string("f%d.h5", F.col("l_partkey")).alias("name"), F.col("l_linestatus").alias("dataset"))
    return detectors.with_file(catalog.observations(spark, d).select("obs_key"), index, ["obs_key"])


def _parts(spark, d):
    """Observations in a part for each slot, with some samples missing at both ends."""
    obs = catalog.observations(spark, d).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("obs_key") % 3)))
    off = (F.col("obs_key") * 7 + F.col("part") * 3) % 5
    late = F.when(F.col("obs_key") % 4 == 0, F.col("part") * 0.3).otherwise(0.0)
    return obs.select(
        "obs_key", "part", (F.col("ctime") + late).alias("start"), (F.col("ctime") + F.col("dur") + late).alias("stop"),
        F.col("nsamp").alias("n_raw"), off.alias("offset"), (F.col("nsamp") - off - F.col("part") * 4).alias("count"),
    )


PARTS = """parts as (select obs_key, part, ctime + late as start, ctime + dur + late as stop, nsamp as n_raw, off as "offset", nsamp - off - part * 4 as count
    from (select *, (obs_key * 7 + part * 3) % 5 as off, case when obs_key % 4 = 0 then part * cast(0.3 as double) else 0 end as late
    from (select *, unnest(range(0, obs_key % 3 + 1)) as part from obs)))"""


def shared_samples(spark, d):
    return detectors.shared_samples(_parts(spark, d), "obs_key").select("obs_key", "part", "i1", "i2", "fits")


def file_groups(spark, d):
    parts = _parts(spark, d).withColumn("files", F.format_string("f%d", F.col("obs_key") % 50))
    return detectors.file_groups(parts.withColumn("part", F.col("obs_key") * 10 + F.col("part")).withColumn("ndet", F.col("n_raw") % 90))


def stored_cuts(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    numbers = F.sum(2 * (F.col("c_custkey") % 4)).over(w)
    ends = catalog.table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("det"), numbers.alias("end"))
    total = ends.groupBy("file").agg(F.max("end").alias("n")).where("n > 0")
    k = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") / 2).cast("long") - 1))
    ranges = total.select("file", k.alias("k")).select("file", "k", (F.col("k") * 10).alias("lo"), (F.col("k") * 10 + 3 + F.col("k") % 5).alias("hi"))
    return detectors.stored_cuts(ends, ranges, "file")


def reference_ids(spark, d):
    obs = catalog.observations(spark, d)
    return detectors.reference_ids(obs.select("obs_key", F.concat_ws(":", "obs_id", "slots", "flavor").alias("id")), "id", "obs_key")


def focal_plane_extent(spark, d):
    key = F.col("p_partkey")
    plane = catalog.table(spark, d, "part").select(
        F.concat(F.lit("mv"), (key % 7).cast("string")).alias("wafer"),
        (F.col("p_size") * 0.002).alias("xi"), (F.col("p_retailprice") * 1e-5).alias("eta"),
        F.when(key % 17 == 0, float("nan")).otherwise(0.0).alias("gamma"),
    )
    out = detectors.focal_plane_extent(plane, "wafer")
    return out.select("wafer", *(F.round(c, 9).alias(c) for c in ("xi", "eta", "radius")))


def cut_of_any(spark, d):
    """Samples that some detector of a group cuts."""
    cuts = intervals.runs(catalog.samples(spark, d), "cut")
    return intervals.united(cuts.withColumn("grp", F.col("det") % 10), det="grp").select("grp", "lo", "hi")


def _sweeps(spark, d):
    obs = catalog.observations(spark, d)
    k = [F.lit(float(i)) for i in range(6)]
    ras = F.array(*(F.radians(F.col("baz")) + i * i * 0.01 + i * 0.05 for i in k))
    decs = F.array(*((F.col("bel") - 70) * 0.02 + i * (F.col("bel") - 30) * 0.004 for i in k))
    return obs.select("obs_key", "dur", "baz", ras.alias("ras"), decs.alias("decs"))


SWEEPS = """sweeps as (select obs_key, dur, baz, list_transform([0, 1, 2, 3, 4, 5]::double[], lambda i: radians(baz) + i * i * 0.01::double + i * 0.05::double) as ras,
    list_transform([0, 1, 2, 3, 4, 5]::double[], lambda i: (bel - 70) * 0.02::double + i * (bel - 30) * 0.004::double) as decs from obs)"""
POINT = 1.0, -0.3


def point_hits(spark, d):
    args = F.lit(POINT[0]), F.lit(POINT[1]), F.col("ras"), F.col("decs"), F.col("dur"), F.lit(math.radians(6))
    return _sweeps(spark, d).select("obs_key", sky.point_hit(*args).alias("hit"))


def galaxy_hits(spark, d):
    hit = sky.galaxy_hit(F.col("ras"), F.col("decs"), F.col("dur"), F.lit(math.radians(0.3)))
    return _sweeps(spark, d).select("obs_key", hit.alias("hit"))


def azimuth_sides(spark, d):
    az1, az2 = sky.one_side(F.radians("baz") - 0.4, F.radians("baz") + 0.5)
    return catalog.observations(spark, d).select("obs_key", F.round(az1, 9).alias("az1"), F.round(az2, 9).alias("az2"))


def _spectra(spark, d):
    """Samples as spectra in whole numbers, whose sums are exact in any order."""
    return catalog.samples(spark, d).select(F.col("det").alias("grp"), F.col("samp").alias("bin"), (F.round(F.col("value") * 100) + 1).alias("power"))


def power_spikes(spark, d):
    return spectra.spikes(_spectra(spark, d), "grp", tol=15000)


def power_floors(spark, d):
    return spectra.floors(_spectra(spark, d), "grp", tol=10, off=1.5)


def log_edges(spark, d):
    return catalog.observations(spark, d).select("obs_key", F.explode(spectra.log_edges(F.col("nsamp"), size=3)).alias("edge"))


QUERIES = {
    f.__name__: f
    for f in (
        id_names, detector_table, index_files, shared_samples, file_groups, stored_cuts, reference_ids, focal_plane_extent,
        cut_of_any, point_hits, galaxy_hits, azimuth_sides, power_spikes, power_floors, log_edges,
    )
}
PAD = math.radians(1)
SPEC = "spec as (select det as grp, samp as bin, round(value * 100) + 1 as power from samp)"
ORACLE_SQL = {
    "id_names": """select s_suppkey, cast(1700000000 + s_suppkey * 60 as double) as t, 'ufm_mv' || cast(s_suppkey % 9 as varchar) as wafer,
        'f' || lpad(cast(s_suppkey % 3 * 60 + 30 as varchar), 3, '0') as band from supplier""",
    "detector_table": """with slots as (select 'ufm_mv' || (i % 8) || '_' || (i % 3) as detset, 'ws' || (i % 7) as slot from range(23) r(i)),
        p as (select p_partkey as k, p_size, 'ufm_mv' || (p_partkey % 8) || '_' || (p_partkey % 3) as detset from part where p_partkey % 13 <> 0 and p_partkey % 11 <> 0),
        s as (select 'obs_' || s_suppkey as obs_id, 'ufm_mv' || (s_suppkey % 8) || '_' || (s_suppkey % 3) as detset from supplier)
        select obs_id || ':' || slot || ':' || case when p_size % 2 = 0 then 'f090' else 'f150' end || ':' || case when p_size % 10 = 0 then 'DARK' else 'OPTC' end as subid,
        'ch_' || k as channel, 'det_' || k as det, detset, '?_?r' || lpad(cast(k % 20 as varchar), 2, '0') || 'c' || lpad(cast(k % 7 as varchar), 2, '0') as pix
        from s join p using (detset) join slots using (detset)""",
    "index_files": q(OBS, "f as (select *, row_number() over (partition by l_orderkey order by l_linenumber, 'f' || l_partkey || '.h5', l_linestatus) as r from lineitem where l_returnflag = 'R')",
        select="select obs_key, 'f' || l_partkey || '.h5' as file, l_linestatus as dataset from obs left join f on obs_key = l_orderkey and r = 1"),
    "shared_samples": q(OBS, PARTS, """a as (select *, (stop - start) / (n_raw - 1) as dt from parts), b as (select *, max(start + dt * "offset") over w as t1, min(start + dt * ("offset" + count)) over w as t2 from a window w as (partition by obs_key)),
        c as (select *, (t1 - start) / dt as x1, (t2 - start) / dt as x2 from b),
        e as (select *, x1 - first(x1) over w as sh, abs((x2 - x1) - first(x2 - x1) over w) as other from c window w as (partition by obs_key order by part rows between unbounded preceding and unbounded following))""",
        select="""select obs_key, part, cast(round_even(x1, 0) as bigint) as i1, cast(round_even(x2, 0) as bigint) as i2,
        t2 > t1 and max(greatest(abs(sh - floor(sh + 0.5)), other)) over (partition by obs_key) <= 0.1::double as fits from e"""),
    "file_groups": q(OBS, PARTS, select="""select 'f' || (obs_key % 50) as files, "offset", count, count(*) as n_parts, min(obs_key * 10 + part) as first_part, cast(sum(n_raw % 90) as bigint) as ndet from parts group by 1, 2, 3"""),
    "stored_cuts": """with c as (select c_nationkey as file, c_custkey as det, c_custkey % 4 as n, coalesce(sum(c_custkey % 4) over (partition by c_nationkey order by c_custkey rows between unbounded preceding and 1 preceding), 0) as k0 from customer)
        select file, det, cast(k * 10 as bigint) as lo, cast(k * 10 + 3 + k % 5 as bigint) as hi from (select file, det, unnest(range(cast(k0 as bigint), cast(k0 + n as bigint))) as k from c)""",
    "reference_ids": q(OBS, select="select slots || ':' || flavor as tail, arg_min(obs_id || ':' || slots || ':' || flavor, obs_key) as ref, count(*) as n from obs group by 1"),
    "focal_plane_extent": """with p as (select 'mv' || (p_partkey % 7) as wafer, p_size * 0.002::double as xi, p_retailprice * 1e-5::double as eta from part where p_partkey % 17 <> 0),
        m as (select wafer, avg(xi) as x, avg(eta) as y from p group by wafer)
        select wafer, round(any_value(x), 9) as xi, round(any_value(y), 9) as eta, round(max(2 * asin(least(sqrt(power(sin((eta - y) / 2), 2) + cos(eta) * cos(y) * power(sin((xi - x) / 2), 2)), 1))), 9) as radius
        from p join m using (wafer) group by wafer""",
    "cut_of_any": q(SAMP, CUTS, """s as (select distinct det % 10 as grp, unnest(range(lo, hi)) as samp from cuts), g as (select *, samp - row_number() over (partition by grp order by samp) as g from s)""",
        select="select grp, cast(min(samp) as integer) as lo, cast(max(samp) + 1 as integer) as hi from g group by grp, g.g"),
    "point_hits": q(OBS, SWEEPS, f"""pt as (select obs_key, dur, decs, unnest(ras) as y, unnest(decs) as x from sweeps),
        tm as (select a.obs_key, a.x, any_value(a.dur) as dur, any_value(a.decs) as decs, any_value(a.y) * coalesce(product(case when a.x <> b.x then ({POINT[1]}::double - b.x) / (a.x - b.x) end), 1) as term
            from pt a join pt b using (obs_key) where a.decs[6] > a.decs[1] group by a.obs_key, a.x),
        cv as (select obs_key, any_value(dur) as dur, any_value(decs) as decs, sum(term) as curve from tm group by obs_key),
        wd as (select *, curve + radians(15) / 7200 * dur as middle, radians(6) / cos({POINT[1]}::double) + radians(1) as wide from cv),
        h as (select *, {POINT[0]}::double - floor(({POINT[0]}::double - middle) / (2 * pi()) + 0.5) * 2 * pi() as ra from wd)""",
        select=f"""select obs_key, coalesce(decs[6] - decs[1] > radians(0.1) and {POINT[1]}::double > decs[1] - radians(7) and {POINT[1]}::double < decs[6] + radians(7)
        and ra > curve - wide and ra < curve + radians(15) / 3600 * dur + wide, false) as hit from (select obs_key from obs) left join h using (obs_key)"""),
    "galaxy_hits": q(OBS, SWEEPS, f"""pt as (select obs_key, dur, unnest(ras) as a, unnest(decs) as d from sweeps), two as (select obs_key, a, d from pt union all select obs_key, a + radians(15) / 3600 * dur, d from pt),
        l as (select obs_key, asin(sin(d) * sin(radians(27.12825)) + cos(d) * cos(radians(27.12825)) * cos(a - radians(192.859508))) as b from two)""",
        select="select obs_key, min(b) * max(b) < 0 or min(abs(b)) + radians(0.3) + radians(1) < radians(5) as hit from l group by obs_key"),
    "azimuth_sides": q(OBS, "m as (select *, radians(baz) - 0.4::double as a1, radians(baz) + 0.5::double as a2 from obs)",
        select="select obs_key, round(greatest(a1, floor(0.5 * (a1 + a2) / pi()) * pi()), 9) as az1, round(least(a2, ceil(0.5 * (a1 + a2) / pi()) * pi()), 9) as az2 from m"),
    "power_spikes": q(SAMP, SPEC, """s as (select distinct grp, unnest(range(greatest(bin - 2, 0), least(bin + 3, nsamp))) as b from spec join ns on grp = det where power > 15000),
        g as (select *, b - row_number() over (partition by grp order by b) as g from s)""",
        select="select grp, cast(min(b) as integer) as lo, cast(max(b) + 1 as integer) as hi from g group by grp, g.g"),
    "power_floors": q(SAMP, SPEC, """pk as (select grp, greatest(1, arg_min(bin, (-power, bin))) as peak from spec group by grp), bh as (select grp, power, bin - peak as k, peak from spec join pk using (grp) where bin >= peak),
        lo as (select grp, min(power) as least from bh group by grp), st as (select grp, floor(min(k) * 1.5) as start from bh join lo using (grp) where power < least * 10 group by grp)""",
        select="select grp, cast(any_value(start) + any_value(peak) as bigint) as start, avg(case when k >= start then power end) as level from bh join st using (grp) group by grp"),
    "log_edges": q(OBS, "k as (select obs_key, nsamp / 2.0 * 3 / power(2, unnest(range(64))) as e from obs)",
        select="select obs_key, cast(floor(e) as bigint) as edge from k where e >= 10 union all select obs_key, 0 from obs"),
}
