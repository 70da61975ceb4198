"""Queries of samples: intervals, blocks, maps, distribution and dense models, each with its SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import angles, linalg
from scanloom.operators import balance, blocks, intervals, mapping, noise, solver
from scanloom.plans.sql_parts import CUTS, IVAR, OBS, SAMP, WIDE, q
from scanloom.sources import catalog
from scanloom.sources.shared import new_path


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return catalog.samples(spark, d)


def _nsamp(spark: SparkSession, d: str) -> DataFrame:
    return catalog.table(spark, d, "events").groupBy(F.col("user_id").alias("det")).agg(F.count("*").alias("nsamp"))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return intervals.runs(_samples(spark, d), "cut")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Cuts padded in two ways and united."""
    at = _cuts(spark, d).join(_nsamp(spark, d), "det")
    n = F.col("nsamp").cast("int")
    a = at.select("det", F.greatest(F.col("lo") - 1, F.lit(0)).alias("lo"), F.least(F.col("hi") + 1, n).alias("hi"))
    b = at.select("det", "lo", F.least(F.col("hi") + 3, n).alias("hi"))
    return intervals.united(a.unionByName(b))


def _rounded(df: DataFrame, *names: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Rounded columns; a nudge moves values that are often exact ties off the tie, here as in the SQL."""
    return df.withColumns({n: F.round(F.col(n) + nudge, digits) for n in names})


def binned_map(spark, d):
    """The flagship: hits, weight and weighted mean by (day, hour), detectors weighted by their inverse variance."""
    s = catalog.table(spark, d, "events").select(
        F.col("user_id").alias("det"), "value", F.dayofmonth("ts").alias("py"), F.hour("ts").alias("px")
    )
    out = mapping.binned(s, mapping.white_weights(s), ["py", "px"])
    return _rounded(out.select("py", "px", "hits", "m", "ivar"), "m", "ivar")


def runs(spark, d):
    return _cuts(spark, d)


def cut_union(spark, d):
    return _merged(spark, d)


def cut_invert(spark, d):
    return intervals.inverted(_merged(spark, d), _nsamp(spark, d))


def cut_clip(spark, d):
    return intervals.clipped(_merged(spark, d), 10, 40)


def cut_resample(spark, d):
    return intervals.resampled(_merged(spark, d), 1000, 333)


def split_ranges(spark, d):
    return intervals.split_ranges(_merged(spark, d), 3)


def det_cut_quality(spark, d):
    """Detectors by cut fraction and density of ranges, as good below one quarter and one tenth."""
    sums = intervals.cut_sums(_cuts(spark, d), _nsamp(spark, d))
    good = (F.col("ncut") < 0.25 * F.col("nsamp")) & (F.col("nrange") < 0.2 * F.col("nsamp"))
    return sums.select("det", "nsamp", "ncut", "nrange", good.alias("good"))


def cut_borders(spark, d):
    at = _merged(spark, d).join(_nsamp(spark, d), "det")
    return intervals.with_borders(at, 4, nsamp=F.col("nsamp").cast("int")).select("det", "lo", "hi", "l0", "r1")


def cut_extract(spark, d):
    s = _samples(spark, d).select("det", "samp", "value")
    return intervals.in_ranges(s, _merged(spark, d), "lo", "hi").select("det", "samp", "value")


def cut_clear(spark, d):
    out = intervals.cleared(_samples(spark, d).select("det", "samp", "value"), _merged(spark, d))
    return _rounded(out.groupBy("det").agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") == 0, 1)).alias("zero")), "total")


def gapfill(spark, d):
    s = _samples(spark, d).select("det", "samp", "value")
    out = intervals.gap_filled(s, _merged(spark, d), 5, _nsamp(spark, d))
    return _rounded(out.select("det", "samp", "value"), "value", nudge=1.23e-9)


def dejump(spark, d):
    s = _samples(spark, d).select("det", "samp", "value")
    out = intervals.dejumped(s, _merged(spark, d), 5, _nsamp(spark, d))
    return _rounded(out.select("det", "samp", "value"), "value")


def downgrade(spark, d):
    return _rounded(blocks.block_means(_samples(spark, d), 10), "value")


def downgrade_inclusive(spark, d):
    return _rounded(blocks.block_means(_samples(spark, d), 16, inclusive=True, op=F.max), "value")


def decimate(spark, d):
    return blocks.decimated(_samples(spark, d), 3, 4).select("det", "samp", "value")


def apply_window(spark, d):
    out = blocks.tapered(_samples(spark, d), 8, _nsamp(spark, d))
    return _rounded(out.select("det", "samp", "value"), "value")


def deoffset(spark, d):
    return _rounded(blocks.deoffset(_samples(spark, d), 10).select("det", "samp", "value"), "value")


def deslope(spark, d):
    out = blocks.desloped(_samples(spark, d), 10, _nsamp(spark, d))
    return _rounded(out.select("det", "samp", "value"), "value", nudge=1.23e-9)


def common_deslope(spark, d):
    out = blocks.desloped(_samples(spark, d), 10, _nsamp(spark, d), common=True)
    return _rounded(out.select("det", "samp", "value"), "value", nudge=1.23e-9)


def rms_der(spark, d):
    return _rounded(blocks.difference_rms(_samples(spark, d), 16), "rms")


def rms_block(spark, d):
    return _rounded(blocks.block_rms(_samples(spark, d), 16), "rms")


def sensitivity_cut(spark, d):
    return _rounded(blocks.sensitive(blocks.block_rms(_samples(spark, d), 16), 40.0, spread=0.9), "rms")


def robust_mean(spark, d):
    s = catalog.table(spark, d, "events").select("event_type", "value")
    return _rounded(blocks.robust_mean(s, ["event_type"], "value"), "mean", "err")


def cumsum0(spark, d):
    orders = catalog.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit(1).cast("long").alias("n"))
    return orders.select("o_orderkey", blocks.exclusive_sum("n", ["o_orderkey"], ["o_custkey"]).alias("before"))


def find_scanning(spark, d):
    return blocks.scanning_range(_samples(spark, d), 4, 0.5)


def common_mode(spark, d):
    return _rounded(blocks.common_mode(_samples(spark, d), 8), "value")


def pair_rotate(spark, d):
    return _rounded(blocks.pair_rotated(_samples(spark, d)), "plus", "minus")


def detwise_adjoint(spark, d):
    return _rounded(blocks.detwise_adjoint(_samples(spark, d), F.col("samp") / 100), "a", "b", digits=4)


def _pointed(spark, d):
    """Samples with a place on a map of 30 x 24 pixels, and a polarisation angle."""
    t = F.hour("ts") * 3600 + F.minute("ts") * 60
    return _samples(spark, d).select(
        "det",
        "samp",
        "value",
        ((F.dayofmonth("ts") - 1) + F.hour("ts") / 24).alias("y"),
        (t / 3600.0).alias("x"),
        ((F.col("det") % 12) * math.pi / 12).alias("psi"),
    )


POINTED = """pt as (select det, samp, value, (day(ts) - 1) + hour(ts) / 24 as y, (hour(ts) * 3600 + minute(ts) * 60) / 3600.0 as x,
    (det % 12) * pi() / 12 as psi from samp)"""
CORNERS = """cor as (select pt.*, floor(y) + dy as py, (cast(floor(x) as bigint) + dx) % 24 as px,
    (case dy when 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case dx when 1 then x - floor(x) else 1 - (x - floor(x)) end) as w
    from pt cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) as c(dy, dx))"""


def _corners(spark, d):
    return mapping.bilinear(_pointed(spark, d), F.col("y"), F.col("x"), 24)


def tod2map_bilinear(spark, d):
    got = _corners(spark, d).groupBy("py", "px").agg(F.sum(F.col("w") * F.col("value")).alias("rhs"), F.sum("w").alias("hits"))
    return _rounded(got, "rhs", "hits", digits=4, nudge=1.23e-7)


def map_div(spark, d):
    got = mapping.polarised(_corners(spark, d), F.col("psi"), ["py", "px"], F.col("w"))
    return _rounded(got, *linalg.SYM3, digits=5, nudge=1.23e-8).select("py", "px", "hits", *linalg.SYM3)


def map_tqu(spark, d):
    """The closed-form T, Q, U of each coarse pixel: the inverse weights times the weighted sums."""
    p = _pointed(spark, d).select("psi", "value", F.floor(F.col("y") / 5).cast("int").alias("py"), F.floor(F.col("x") / 6).cast("int").alias("px"))
    got = mapping.polarised(p, F.col("psi"), ["py", "px"], F.lit(1.0))
    inverse = linalg.inv3({k: F.col(k) for k in linalg.SYM3}, 1e-6)
    t, q_, u = linalg.times_vector(inverse, F.col("rt"), F.col("rq"), F.col("ru"))
    return _rounded(got.select("py", "px", "hits", t.alias("t"), q_.alias("q"), u.alias("u")), "t", "q", "u", digits=4)


def map_time(spark, d):
    s = _samples(spark, d).select("det", "value", F.dayofmonth("ts").alias("py"), F.hour("ts").alias("px"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return _rounded(mapping.time_map(s, mapping.white_weights(s), ["py", "px"], "t"), "t", digits=3)


def map_xlink(spark, d):
    """Cross-linking on a coarse grid: every eighth sample, polarisation angle 0."""
    p = _pointed(spark, d).where("samp % 8 = 0").select("value", F.floor(F.col("y") / 8).cast("int").alias("py"), F.floor(F.col("x") / 8).cast("int").alias("px"))
    return mapping.polarised(p, F.lit(0.0), ["py", "px"], F.lit(1.0)).select("py", "px", "hits", "tt", "tq", "tu")


def tile_reduce(spark, d):
    pixels = _corners(spark, d).groupBy("py", "px").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return _rounded(mapping.tiles(pixels, 8, {"w": F.sum("w"), "n": F.sum("n"), "pixels": F.count("*")}), "w", digits=4)


def map2tod(spark, d):
    """What each detector sees of the binned map, as the sum of squares of the residuals."""
    s = _samples(spark, d).select("det", "samp", "value", F.dayofmonth("ts").alias("py"), F.hour("ts").alias("px"))
    sky = mapping.binned(s, mapping.white_weights(s), ["py", "px"])
    seen = mapping.scanned(s, sky, ["py", "px"], "m")
    left = F.col("value") - F.col("model")
    return _rounded(seen.groupBy("det").agg(F.count("*").alias("n"), F.sum(left * left).alias("chisq")), "chisq", digits=3)


def obs_band_info(spark, d):
    s = _samples(spark, d).select("det", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.dayofmonth("ts").alias("obs"), (F.col("det") % 3).alias("band"))
    return _rounded(mapping.observation_info(s, mapping.white_weights(s), ["obs", "band"]), "sens")


def white_noise(spark, d):
    return _rounded(mapping.white_weights(_samples(spark, d), 16), "ivar", digits=9)


def distribute_simple(spark, d):
    return balance.round_robin(catalog.observations(spark, d).select("obs_id", "obs_key"), 7, "obs_key").select("obs_id", "owner")


def distribute_plain(spark, d):
    return balance.equal_buckets(catalog.observations(spark, d).select("obs_key", "baz"), 7, "baz", "obs_key").select("obs_key", "owner")


def distribute_ra(spark, d):
    return balance.weight_buckets(catalog.observations(spark, d).select("obs_key", "baz", "nsamp"), 5, "nsamp", "baz", "obs_key").select("obs_key", "owner")


def hitmap_wrap(spark, d):
    obs = catalog.observations(spark, d)
    y0, x0 = ((F.col("bel") - 30) / 5).cast("int"), (F.col("baz") / 10).cast("int")
    got = balance.hit_maps(obs, ["flavor"], (y0, y0 + 2), (x0, x0 + 5), 36, F.col("nsamp"))
    return got.select("flavor", "y", F.col("x").cast("int").alias("x"), "hits")


def smartsplit(spark, d):
    """Months assigned to two splits of balanced coverage; hits are summed by Spark, months are few."""
    obs = catalog.observations(spark, d)
    month = F.floor(F.col("ctime") / 2629743.84).cast("long")
    hits = obs.groupBy(month.alias("month"), F.floor(F.col("baz") / 30).cast("int").alias("pix")).agg(F.sum("nsamp").alias("hits"))
    by: dict[int, dict] = {}
    for r in hits.collect():  # months x 12 pixels
        by.setdefault(r["month"], {})[r["pix"]] = float(r["hits"])
    months = sorted(by)
    owner = balance.smart_split([by[m] for m in months], 2)
    return spark.createDataFrame([(m, o) for m, o in zip(months, owner)], "month long, split int")


def sky_positions(spark, d):
    """Right ascension and declination of the observations' centres, by the plain rotation, as counts on the sky."""
    obs = catalog.observations(spark, d)
    az, el = angles.fix_overpole(F.col("baz"), F.col("bel"))
    ra, dec = angles.horizon_to_equatorial(F.radians(az), F.radians(el), F.col("ctime"), -0.4008, -1.183)
    cell = (F.floor(F.degrees(ra) / 90).cast("int"), F.floor(F.degrees(dec) / 30).cast("int"))
    return obs.groupBy(cell[0].alias("ra"), cell[1].alias("dec")).agg(F.count("*").alias("n"))


def overpole_rewind(spark, d):
    obs = catalog.observations(spark, d)
    az, el = angles.fix_overpole(F.col("baz"), F.col("bel") * 3)
    return obs.select("obs_id", angles.rewind(az, 360.0).alias("az"), el.alias("el"))


def _matrix(spark, d):
    e = catalog.table(spark, d, "embeddings")
    return e.select(F.col("label").cast("int").alias("grp"), F.col("vec_id").alias("det"), F.col("embedding").cast("array<double>").alias("value"))


def measure_cov(spark, d):
    s = _samples(spark, d).select("det", "samp", "value", (F.col("det") % 25).alias("grp"))
    return _rounded(noise.covariance(s, "det", "samp", "value", ["grp"]), "cov", digits=2, nudge=1.23e-5)


def pca1(spark, d):
    return noise.group_modes(_matrix(spark, d)).withColumns({"weight": F.round("weight", 6), "share": F.round("share", 6)})


def lowpass(spark, d):
    out = noise.filtered(_matrix(spark, d), 0.1)
    return out.select("grp", "det", F.transform("value", lambda x: F.round(x, 6)).alias("value"))


def noise_detvecs(spark, d):
    return _rounded(noise.noise_weights(_matrix(spark, d), [0.1, 0.25]), "ivar")


def cg_map(spark, d):
    """Sky and offsets of 16-sample blocks by conjugate gradients; the sky's pixels."""
    s = _samples(spark, d).join(mapping.white_weights(_samples(spark, d)), "det")
    pix = (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("long")
    off = (F.col("det") * 1_000_000 + F.floor(F.col("samp") / 16)).cast("long")
    folder = new_path(spark, "cg")
    got = solver.solve(s.select(pix.alias("pix"), off.alias("off"), "ivar", "value"), folder, prior=1.0, steps=12, error=1e-6)
    return got.vector.where("signal = 0").select("idx", F.round("value", 3).alias("value"))


MEANS = """bord as (select m.det, lo, hi, greatest(lo - 5, coalesce(lag(hi) over w, 0)) as l0, least(hi + 5, lead(lo) over w, nsamp) as r1
    from merged m join ns using (det) window w as (partition by m.det order by lo)),
    sides as (select b.det, b.lo, b.hi, l0, r1, avg(value) filter (where s.samp >= l0 and s.samp < lo) as a, avg(value) filter (where s.samp >= hi and s.samp < r1) as b
    from bord b left join samp s on s.det = b.det and s.samp >= l0 and s.samp < r1 group by b.det, b.lo, b.hi, l0, r1),
    means as (select det, lo, hi, l0, r1, coalesce(a, b, 0) as l, coalesce(b, a, 0) as r from sides)"""
EDGED = """mids as (select *, (l0 + lo - 1) / 2 as ml, greatest((hi + r1 - 1) / 2, (l0 + lo - 1) / 2 + 1) as mr from means),
    edged as (select det, lo, hi, l + (r - l) / (mr - ml) * (lo - 1 - ml) as l, l + (r - l) / (mr - ml) * (hi - ml) as r from mids)"""
EDGES = """edges as (select det, nsamp, avg(value) filter (where samp < 10) as v1, avg(value) filter (where samp >= nsamp - 10) as v2
    from samp join ns using (det) group by det, nsamp)"""
POL = "count(*) as hits, sum(w) as tt, sum(w * cos(2 * psi)) as tq, sum(w * sin(2 * psi)) as tu, sum(w * cos(2 * psi) ** 2) as qq, sum(w * cos(2 * psi) * sin(2 * psi)) as qu, sum(w * sin(2 * psi) ** 2) as uu"

QUERIES = {
    f.__name__: f
    for f in (
        binned_map, runs, cut_union, cut_invert, cut_clip, cut_resample, split_ranges, det_cut_quality, cut_borders, cut_extract, cut_clear,
        gapfill, dejump, downgrade, downgrade_inclusive, decimate, apply_window, deoffset, deslope, common_deslope, rms_der, rms_block,
        sensitivity_cut, robust_mean, cumsum0, find_scanning, common_mode, pair_rotate, detwise_adjoint, tod2map_bilinear, map_div, map_tqu,
        map_time, map_xlink, tile_reduce, map2tod, obs_band_info, white_noise, distribute_simple, distribute_plain, distribute_ra,
        hitmap_wrap, smartsplit, sky_positions, overpole_rewind, measure_cov, pca1, lowpass, noise_detvecs, cg_map,
    )
}

ORACLE_SQL = {
    "binned_map": """with n as (select user_id, 1 / var_pop(value) as ivar from events group by user_id having var_pop(value) > 0)
        select cast(day(ts) as integer) as py, cast(hour(ts) as integer) as px, count(*) as hits, round(sum(ivar * value) / sum(ivar), 6) as m,
        round(sum(ivar), 6) as ivar from events join n on events.user_id = n.user_id group by 1, 2""",
    "runs": q(SAMP, CUTS, select="select det, lo, hi from cuts"),
    "cut_union": q(SAMP, CUTS, WIDE, select="select det, lo, hi from merged"),
    "cut_invert": q(SAMP, CUTS, WIDE, """parts as (select det, coalesce(lag(hi) over (partition by det order by lo), 0) as lo, lo as hi from merged
        union all select ns.det, coalesce(max(hi), 0), cast(nsamp as integer) from ns left join merged using (det) group by ns.det, nsamp)""",
        select="select det, lo, hi from parts where hi > lo"),
    "cut_clip": q(SAMP, CUTS, WIDE, select="select det, greatest(lo - 10, 0) as lo, least(hi - 10, 30) as hi from merged where least(hi - 10, 30) > greatest(lo - 10, 0)"),
    "cut_resample": q(SAMP, CUTS, WIDE, select="""select det, cast(floor(lo * 333 / 1000.0) as integer) as lo, cast(least(ceil(hi * 333 / 1000.0), 333) as integer) as hi from merged"""),
    "split_ranges": q(SAMP, CUTS, WIDE, """p as (select *, cast(ceil((hi - lo) / 3.0) as bigint) as n from merged), k as (select *, unnest(range(0, n)) as k from p)""",
        select="select det, cast(lo + k * (hi - lo) // n as integer) as lo, cast(lo + (k + 1) * (hi - lo) // n as integer) as hi from k"),
    "det_cut_quality": q(SAMP, CUTS, """s as (select ns.det, nsamp, cast(coalesce(sum(hi - lo), 0) as bigint) as ncut, count(lo) as nrange from ns left join cuts using (det) group by ns.det, nsamp)""",
        select="select *, ncut < 0.25 * nsamp and nrange < 0.2 * nsamp as good from s"),
    "cut_borders": q(SAMP, CUTS, WIDE, select="""select m.det, lo, hi, greatest(lo - 4, coalesce(lag(hi) over w, 0)) as l0, cast(least(hi + 4, lead(lo) over w, nsamp) as integer) as r1
        from merged m join ns using (det) window w as (partition by m.det order by lo)"""),
    "cut_extract": q(SAMP, CUTS, WIDE, select="select s.det, samp, value from samp s join merged m on s.det = m.det and samp >= lo and samp < hi"),
    "cut_clear": q(SAMP, CUTS, WIDE, """c as (select s.det, case when exists (select 1 from merged m where m.det = s.det and samp >= lo and samp < hi) then 0 else value end as v from samp s)""",
        select="select det, round(sum(v), 6) as total, count(*) filter (where v = 0) as zero from c group by det"),
    "gapfill": q(SAMP, CUTS, WIDE, MEANS, EDGED, select="""select s.det, samp, round(case when m.lo is null then value else l + (r - l) * ((samp - lo + 1) / (hi - lo + 1)) end + 1.23e-9, 6) as value
        from samp s left join edged m on m.det = s.det and samp >= lo and samp < hi"""),
    "dejump": q(SAMP, CUTS, WIDE, MEANS, select="""select s.det, samp, round(value - coalesce(sum(r - l) over (partition by s.det order by samp rows unbounded preceding), 0), 6) as value
        from samp s left join means m on m.det = s.det and samp = lo"""),
    "downgrade": q(SAMP, select="select det, samp // 10 as block, round(avg(value), 6) as value, count(*) as n from samp group by 1, 2 having count(*) = 10"),
    "downgrade_inclusive": q(SAMP, select="select det, samp // 16 as block, round(max(value), 6) as value, count(*) as n from samp group by 1, 2"),
    "decimate": q(SAMP, "k as (select det, samp // 3 as samp, value, max(samp // 3) over (partition by det) + 1 as n from samp where samp % 3 = 0)",
        select="select det, samp, value from k where samp < n - n % 4"),
    "apply_window": q(SAMP, "e as (select *, least(samp, nsamp - 1 - samp) as edge from samp join ns using (det))",
        select="select det, samp, round(value * case when edge < 8 then 0.5 * (1 - cos((edge + 1) * pi() / 8)) else 1 end, 6) as value from e"),
    "deoffset": q(SAMP, "b as (select det, avg(value) as v from samp group by det, samp // 10 having count(*) = 10), m as (select det, median(v) as mid from b group by det)",
        select="select s.det, samp, round(value - coalesce(mid, 0), 6) as value from samp s left join m using (det)"),
    "deslope": q(SAMP, EDGES, select="select s.det, samp, round(value - (v1 + (v2 - v1) * samp / greatest(nsamp - 1, 1)) + 1.23e-9, 6) as value from samp s join edges using (det)"),
    "common_deslope": q(SAMP, EDGES, "c as (select median(v1) as v1, median(v2) as v2 from edges)",
        select="select s.det, samp, round(value - (v1 + (v2 - v1) * samp / greatest(nsamp - 1, 1)) + 1.23e-9, 6) as value from samp s join ns using (det) cross join c"),
    "sky_positions": q(OBS, """h as (select radians(case when bel > 90 then baz + 180 else baz end) as az, radians(case when bel > 90 then 180 - bel else bel end) as el,
            0.7790572732640::double + 1.00273781191135448::double * (ctime - 946728000.0::double) / 86400 as turns, -0.4008::double as lat from obs),
        e as (select degrees(asin(greatest(-1, least(1, sin(el) * sin(lat) + cos(el) * cos(lat) * cos(az))))) as dec,
            degrees((turns - floor(turns)) * 2 * pi() - 1.183::double - atan2(-sin(az) * cos(el), sin(el) * cos(lat) - cos(el) * sin(lat) * cos(az))) as ra from h)""",
        select="select cast(floor((ra - floor(ra / 360) * 360) / 90) as integer) as ra, cast(floor(dec / 30) as integer) as dec, count(*) as n from e group by 1, 2"),
    "rms_der": q(SAMP, """f as (select det, samp // 16 as b, value - 3 * lag(value) over w + 3 * lag(value, 2) over w - lag(value, 3) over w as x
        from samp window w as (partition by det, samp // 16 order by samp)), s as (select det, stddev_pop(x) as s from f group by det, b having count(*) = 16)""",
        select="select det, round(median(s) / sqrt(20), 6) as rms from s group by det"),
    "rms_block": q(SAMP, "s as (select det, stddev_pop(value) as s from samp group by det, samp // 16 having count(*) = 16)",
        select="select det, round(median(s), 6) as rms from s group by det"),
    "sensitivity_cut": q(SAMP, """s as (select det, stddev_pop(value) as s from samp group by det, samp // 16 having count(*) = 16),
        r as (select det, median(s) as rms from s group by det), k as (select * from r where rms >= 40 and rms < 400000), m as (select median(rms) as mid from k)""",
        select="select det, round(rms, 6) as rms from k cross join m where rms > mid * 0.9 and rms < mid / 0.9"),
    "robust_mean": """with p as (select event_type, value, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by value) - 1 as k from events)
        select event_type, round(avg(value), 6) as mean, round(stddev_pop(value) / sqrt(count(*)), 6) as err, count(*) as n from p
        where k >= floor(n * 0.1) and k < n - floor(n * 0.1) group by event_type""",
    "cumsum0": "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as before from orders",
    "find_scanning": q(SAMP, """b as (select det, samp // 4 as block, avg(value) as v from samp group by 1, 2 having count(*) = 4),
        s as (select det, block, abs(lead(v) over w - lag(v) over w) / 2 as speed from b window w as (partition by det order by block)),
        m as (select *, avg(speed) over (partition by det) as mean from s)""", select="select det, min(block) as first, max(block) as last from m where speed > 0.5 * mean group by det"),
    "common_mode": q(SAMP, "g as (select samp, median(value) as m from samp group by samp, det // 8)", select="select samp, round(median(m), 6) as value from g group by samp"),
    "pair_rotate": q(SAMP, select="""select a.det // 2 as pair, a.samp, round((a.value + b.value) / sqrt(2), 6) as plus, round((a.value - b.value) / sqrt(2), 6) as minus
        from samp a join samp b on a.det % 2 = 0 and b.det = a.det + 1 and a.samp = b.samp"""),
    "detwise_adjoint": q(SAMP, select="select det, round(sum(value * (samp / 100)), 4) as a, round(sum(value), 4) as b from samp group by det"),
    "tod2map_bilinear": q(SAMP, POINTED, CORNERS, select="select cast(py as integer) as py, cast(px as integer) as px, round(sum(w * value) + 1.23e-7, 4) as rhs, round(sum(w) + 1.23e-7, 4) as hits from cor where w > 0 group by 1, 2"),
    "map_div": q(SAMP, POINTED, CORNERS, f"m as (select cast(py as integer) as py, cast(px as integer) as px, {POL} from cor where w > 0 group by 1, 2)",
        select="select py, px, hits, round(tt + 1.23e-8, 5) as tt, round(tq + 1.23e-8, 5) as tq, round(tu + 1.23e-8, 5) as tu, round(qq + 1.23e-8, 5) as qq, round(qu + 1.23e-8, 5) as qu, round(uu + 1.23e-8, 5) as uu from m"),
    "map_tqu": q(SAMP, POINTED, f"""m as (select cast(floor(y / 5) as integer) as py, cast(floor(x / 6) as integer) as px, sum(value) as rt, sum(value * cos(2 * psi)) as rq,
        sum(value * sin(2 * psi)) as ru, {POL} from (select *, 1.0::double as w from pt) group by 1, 2),
        v as (select *, tt * (qq * uu - qu * qu) - tq * (tq * uu - qu * tu) + tu * (tq * qu - qq * tu) as det from m)""",
        select="""select py, px, hits, case when abs(det) > 1e-6 then round(((qq * uu - qu * qu) * rt + (tu * qu - tq * uu) * rq + (tq * qu - tu * qq) * ru) / det, 4) else 0 end as t,
        case when abs(det) > 1e-6 then round(((tu * qu - tq * uu) * rt + (tt * uu - tu * tu) * rq + (tq * tu - tt * qu) * ru) / det, 4) else 0 end as q,
        case when abs(det) > 1e-6 then round(((tq * qu - tu * qq) * rt + (tq * tu - tt * qu) * rq + (tt * qq - tq * tq) * ru) / det, 4) else 0 end as u from v"""),
    "map_time": q(SAMP, IVAR, "z as (select min(floor(epoch(ts))) as t0 from samp)",
        select="select cast(day(ts) as integer) as py, cast(hour(ts) as integer) as px, round(sum(ivar * (floor(epoch(ts)) - t0)) / sum(ivar), 3) as t from samp join ivar using (det) cross join z group by 1, 2"),
    "map_xlink": q(SAMP, POINTED, select="select cast(floor(y / 8) as integer) as py, cast(floor(x / 8) as integer) as px, count(*) as hits, cast(count(*) as double) as tt, cast(count(*) as double) as tq, cast(0 as double) as tu from pt where samp % 8 = 0 group by 1, 2"),
    "tile_reduce": q(SAMP, POINTED, CORNERS, "p as (select py, px, sum(w) as w, count(*) as n from cor where w > 0 group by 1, 2)",
        select="select cast(floor(py / 8) as integer) as ty, cast(floor(px / 8) as integer) as tx, round(sum(w), 4) as w, cast(sum(n) as bigint) as n, count(*) as pixels from p group by 1, 2"),
    "map2tod": q(SAMP, IVAR, "m as (select day(ts) as py, hour(ts) as px, sum(ivar * value) / sum(ivar) as m from samp join ivar using (det) group by 1, 2)",
        select="select det, count(*) as n, round(sum((value - coalesce(m, 0)) ** 2), 3) as chisq from samp left join m on py = day(ts) and px = hour(ts) group by det"),
    "obs_band_info": q(SAMP, IVAR, "g as (select cast(day(ts) as integer) as obs, det % 3 as band, det, min(floor(epoch(ts))) as t0, max(floor(epoch(ts))) as t1, count(*) as n, any_value(ivar) as ivar from samp join ivar using (det) group by 1, 2, 3)",
        select="select obs, band, cast(min(t0) as bigint) as ctime, cast(max(t1) - min(t0) as bigint) as dur, cast(sum(n) as bigint) as nsamp, count(*) as ndet, round(1 / sqrt(sum(ivar)), 6) as sens from g group by 1, 2"),
    "white_noise": q(SAMP, "b as (select det, var_pop(value) as v from samp group by det, samp // 16 having count(*) = 16)", select="select det, round(1 / median(v), 9) as ivar from b group by det having median(v) > 0"),
    "distribute_simple": q(OBS, select="select obs_id, cast((row_number() over (order by obs_key) - 1) % 7 as integer) as owner from obs"),
    "distribute_plain": q(OBS, select="select obs_key, cast((row_number() over (order by baz, obs_key) - 1) * 7 // count(*) over () as integer) as owner from obs"),
    "distribute_ra": q(OBS, "c as (select obs_key, coalesce(sum(nsamp) over (order by baz, obs_key rows between unbounded preceding and 1 preceding), 0) as b, sum(nsamp) over () as a from obs)",
        select="select obs_key, cast(least(b * 5 // a, 4) as integer) as owner from c"),
    "hitmap_wrap": q(OBS, "o as (select flavor, nsamp, cast((bel - 30) / 5 as integer) as y0, cast(floor(baz / 10) as integer) as x0 from obs)",
        select="select flavor, y0 + dy as y, (x0 + dx) % 36 as x, cast(sum(nsamp) as bigint) as hits from o cross join (select cast(range as integer) as dy from range(2)) cross join (select cast(range as integer) as dx from range(5)) group by all"),
    "overpole_rewind": q(OBS, "o as (select obs_id, case when bel * 3 > 90 then baz + 180 else baz end as a, case when bel * 3 > 90 then 180 - bel * 3 else bel * 3 end as el from obs)",
        select="select obs_id, (a + 180) % 360 - 180 as az, el from o"),
    "measure_cov": q(SAMP, "s as (select *, det % 25 as grp from samp)",
        select="select a.grp, a.det as d1, b.det as d2, round(sum(a.value * b.value) + 1.23e-5, 2) as cov, count(*) as n from s a join s b on a.grp = b.grp and a.samp = b.samp and b.det >= a.det group by all"),
}
