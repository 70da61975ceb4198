"""Queries of streams in Fourier space and of noise in frequency bins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.operators import calibrate, intervals, spectra, streams
from scanloom.plans.sample_queries import EDGED, MEANS
from scanloom.plans.sql_parts import CUTS, SAMP, WIDE, q
from scanloom.sources import catalog

KNEE, RATE, TAU = 0.05, 10.0, 0.02


def stream_spectrum(spark, d):
    x = streams.spectrum(catalog.samples(spark, d))
    return x.select("det", "bin", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


def stream_lowpass(spark, d):
    x = streams.spectrum(catalog.samples(spark, d))
    out = streams.signal(streams.times(x, streams.lowpass_gain(streams.frequency(), KNEE)))
    return out.select("det", "samp", F.round("value", 5).alias("value"))


def stream_deconvolved(spark, d):
    x = streams.spectrum(catalog.samples(spark, d))
    tau = (F.col("det") % 5 + 1) * TAU
    return streams.signal(streams.deconvolved(x, tau, RATE)).select("det", "samp", F.round("value", 5).alias("value"))


def stream_resampled(spark, d):
    out = streams.resampled(catalog.samples(spark, d), F.floor(F.col("n") / 3) + 1)
    return out.select("det", "samp", F.round("value", 5).alias("value"))


def stream_friendly(spark, d):
    n = catalog.samples(spark, d).groupBy("det").agg(F.count("*").alias("n"))
    return n.select("det", streams.friendly_length(F.col("n")).alias("n"))


def binned_power(spark, d):
    p = spectra.binned_power(streams.spectrum(catalog.samples(spark, d)), count=20, least=4)
    return p.select("det", "lo", "hi", F.round("power", 3).alias("power"))


def uncorrelated_noise(spark, d):
    p = spectra.binned_power(streams.spectrum(catalog.samples(spark, d)), count=20, least=4)
    return spectra.uncorrelated_noise(p).select("det", F.round(1 / F.col("ivar"), 3).alias("variance"))


def owned_stretches(spark, d):
    """Flagged ranges and wider ones around each, over even bins of 40 samples: which of them owns each stretch."""
    s = catalog.samples(spark, d)
    cuts = intervals.runs(s, "cut").select("det", F.col("lo").cast("long"), F.col("hi").cast("long"))
    even = s.where("samp % 40 = 0").select("det", F.lit(0).alias("list"), F.floor(F.col("samp") / 40).alias("number"), F.col("samp").alias("lo"), (F.col("samp") + 40).alias("hi"))
    wide = cuts.where("lo % 2 = 0").select("det", F.lit(1).alias("list"), F.col("lo").alias("number"), (F.col("lo") - 5).alias("lo"), (F.col("hi") + 9).alias("hi"))
    near = cuts.select("det", F.lit(2).alias("list"), F.col("lo").alias("number"), "lo", "hi")
    return spectra.owned_stretches(even.unionByName(wide).unionByName(near), "det")


def _calibrated(spark, d):
    s = catalog.samples(spark, d)
    cuts = intervals.runs(s, "cut")
    n = s.groupBy("det").agg(F.count("*").cast("int").alias("n"))
    wide = cuts.join(n, "det")
    wide = wide.select("det", F.greatest(F.col("lo") - 1, F.lit(0)).alias("lo"), F.least(F.col("hi") + 1, "n").alias("hi")).union(wide.select("det", "lo", F.least(F.col("hi") + 3, "n").alias("hi")))
    detectors = n.select("det", (1 + F.col("det") % 4 * 0.25).alias("gain"), ((F.col("det") % 5 + 1) * TAU).alias("tau"))
    none = cuts.limit(0)
    return calibrate.calibrated(s, detectors, intervals.united(wide), none, RATE, 0.001, edge=5, size=16, most_share=1.1, most_density=1.1, friendly=False)


def calibrated_samples(spark, d):
    """Gains, filled gaps, slopes and time constants; all detectors that are sensitive."""
    return _calibrated(spark, d)[0].select("det", "samp", F.round("value", 4).alias("value"))


def calibrated_detectors(spark, d):
    told = _calibrated(spark, d)[1]
    return told.select("det", F.round("share", 9).alias("share"), F.round("density", 9).alias("density"))


QUERIES = {
    f.__name__: f
    for f in (calibrated_samples, calibrated_detectors, stream_spectrum, stream_lowpass, stream_deconvolved, stream_resampled, stream_friendly, binned_power, uncorrelated_noise, owned_stretches)
}

DFT = """ps as (select det, samp, value, nsamp as n from samp join ns using (det)), kk as (select det, nsamp as n, unnest(range(0, nsamp // 2 + 1)) as bin from ns),
    dft as (select kk.det, kk.n, bin, sum(value * cos(2 * pi() * (bin * samp % kk.n) / kk.n)) as re, -sum(value * sin(2 * pi() * (bin * samp % kk.n) / kk.n)) as im
        from kk join ps on ps.det = kk.det group by all)"""


def _back(of: str, size: str = "n") -> str:
    """The inverse of a spectrum `of` (det, n, bin, re, im) at `size` samples."""
    return f"""jj as (select det, nsamp as n, unnest(range(0, {size.replace('n', 'nsamp')})) as samp, {size.replace('n', 'nsamp')} as m from ns),
        inv as (select jj.det, jj.samp, sum(case when bin = 0 or 2 * bin = m then re * cos(2 * pi() * (bin * jj.samp % m) / m)
            else 2 * (re * cos(2 * pi() * (bin * jj.samp % m) / m) - im * sin(2 * pi() * (bin * jj.samp % m) / m)) end) / any_value(jj.m) as value
            from jj join {of} x on x.det = jj.det where 2 * bin <= m group by all)"""


_OUT = "select det, samp, round(value, 5) as value from inv"
_EDGES = """e0 as (select n, unnest(range(0, 21)) as k from (select distinct n from dft)), e1 as (select n, k, cast(floor(exp(k * ln(n // 2 + 2.0) / 20) - 1 + 1e-9::double) as bigint) as e from e0),
    e2 as (with recursive g as (select distinct n, -1 as k, 0::bigint as e, true as kept from e1
        union all select g.n, e1.k, case when e1.e - g.e >= 4 then e1.e else g.e end, e1.e - g.e >= 4 from g join e1 on e1.n = g.n and e1.k = g.k + 1)
        select n, e from g where kept and (k = -1 or n // 2 + 1 - e >= 4)),
    e3 as (select n, e as lo, coalesce(lead(e) over (partition by n order by e), n // 2 + 1) as hi from e2),
    bp as (select det, dft.n, lo, hi, avg(re * re + im * im) / any_value(dft.n) as power from dft join e3 on e3.n = dft.n and bin >= lo and bin < hi group by all)"""
ORACLE_SQL = {
    "stream_spectrum": q(SAMP, DFT, select="select det, bin, round(re, 4) + 0.0 as re, round(case when bin = 0 then 0 else im end, 4) + 0.0 as im from dft"),
    "stream_lowpass": q(SAMP, DFT, f"lo as (select det, n, bin, re / (1 + power(bin / n / {KNEE}::double, 8)) as re, im / (1 + power(bin / n / {KNEE}::double, 8)) as im from dft)", _back("lo"), select=_OUT),
    "stream_deconvolved": q(SAMP, DFT, f"""dc as (select det, n, bin, re - im * w as re, im + re * w as im from (select *, 2 * pi() * bin * {RATE}::double / n * (det % 5 + 1) * {TAU}::double as w from dft))""", _back("dc"), select=_OUT),
    "stream_resampled": q(SAMP, DFT, "rs as (select det, n, bin, re * (n // 3 + 1) / n as re, im * (n // 3 + 1) / n as im from dft where bin <= least(n, n // 3 + 1) // 2)", _back("rs", "n // 3 + 1"), select=_OUT),
    "calibrated_samples": q(SAMP, CUTS, WIDE, MEANS, EDGED, """fl as (select s.det, samp, (1 + s.det % 4 * 0.25::double) * case when m.lo is null then value else l + (r - l) * ((samp - lo + 1) / (hi - lo + 1)) end as value
            from samp s left join edged m on m.det = s.det and samp >= lo and samp < hi),
        eg as (select det, nsamp, avg(value) filter (where samp < 5) as v1, avg(value) filter (where samp >= nsamp - 5) as v2 from fl join ns using (det) group by det, nsamp),
        ds as (select det, samp, value - (v1 + (v2 - v1) * samp / greatest(nsamp - 1, 1)) as value from fl join eg using (det))""", DFT.replace("from samp join ns", "from ds join ns"),
        f"""dc as (select det, n, bin, re - im * w as re, im + re * w as im from (select *, 2 * pi() * bin * {RATE}::double / n * (det % 5 + 1) * {TAU}::double as w from dft))""", _back("dc"),
        """bl as (select det, samp, value, samp // 16 as b from inv), d3 as (select det, b, value - 3 * lag(value, 1) over w + 3 * lag(value, 2) over w - lag(value, 3) over w as d from bl window w as (partition by det, b order by samp)),
        bs as (select det, b, stddev_pop(d) as s from d3 group by det, b having count(*) = 16), rm as (select det, median(s) / sqrt(20) / sqrt(10) as rms from bs group by det),
        ok as (select det from rm, (select median(rms) as mid from rm where rms >= 0.001 and rms < 10) where rms >= 0.001 and rms < 10 and rms > mid * 0.2 and rms < mid / 0.2)""",
        select="select det, samp, round(value, 4) as value from inv where det in (select det from ok)"),
    "calibrated_detectors": q(SAMP, CUTS, WIDE, "sh as (select det, sum(hi - lo) as s, count(*) as k from merged group by det)",
        select="select ns.det, round(coalesce(s, 0) / nsamp, 9) as share, round(coalesce(k, 0) / nsamp, 9) as density from ns left join sh using (det)"),
    "stream_friendly": q(SAMP, """pw as (select cast(p2.x * p3.x * p5.x * p7.x as double) as v from (select power(2, i) as x from range(20) r(i)) p2, (select power(3, i) as x from range(12) r(i)) p3,
        (select power(5, i) as x from range(8) r(i)) p5, (select power(7, i) as x from range(7) r(i)) p7)""", select="select det, cast((select max(v) from pw where v <= nsamp) as bigint) as n from ns"),
    "binned_power": q(SAMP, DFT, _EDGES, select="select det, lo, hi, round(power, 3) as power from bp"),
    "uncorrelated_noise": q(SAMP, DFT, _EDGES, select="select det, round(1 / (sum((hi - lo) / power) / sum(hi - lo)), 3) as variance from bp group by det"),
    "owned_stretches": q(SAMP, CUTS, """rg as (select det, 0 as list, samp // 40 as number, samp as lo, samp + 40 as hi from samp where samp % 40 = 0
            union all select det, 1, lo, lo - 5, hi + 9 from cuts where lo % 2 = 0 union all select det, 2, lo, lo, hi from cuts),
        ed as (select distinct det, x from (select det, lo as x from rg union all select det, hi from rg)), st as (select det, x as a, lead(x) over (partition by det order by x) as b from ed),
        ow as (select st.det, a, any_value(b) as b, arg_max({'l': list, 'n': number}, (lo, list, number)) as o from st join rg on rg.det = st.det and lo <= a and hi > a where b is not null group by st.det, a),
        fl as (select *, case when lag(b) over w = a and lag(o) over w = o then 0 else 1 end as f from ow window w as (partition by det order by a)),
        gr as (select *, sum(f) over (partition by det order by a) as g from fl)""",
        select="select det, min(a) as lo, max(b) as hi, any_value(o.l) as list, any_value(o.n) as number from gr group by det, g"),
}
