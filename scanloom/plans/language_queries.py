"""Queries of the selection language and of real sweeps, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators import language, selection, sky
from scanloom.plans.sql_parts import OBS, SUB, TAGS, q
from scanloom.sources import catalog
from scanloom.sources.shared import new_path


def described(spark: SparkSession, d: str) -> DataFrame:
    """Observations with telescope, tube, type, roll, throws and half-wave plate."""
    key = F.col("obs_key")
    telescope = F.when(key % 4 == 0, "lat").otherwise(F.concat(F.lit("satp"), (key % 4).cast("string")))
    return catalog.observations(spark, d).withColumns({
        "telescope": telescope,
        "tube": F.get(F.array(*map(F.lit, language.TUBES)), (key % 13).cast("int")),
        "type": F.when(key % 10 == 0, "cal").otherwise("obs"),
        "subtype": F.when(key % 3 == 0, "cmb").otherwise("planet"),
        "roll": ((key % 5 - 2) * 10).cast("double"),
        "waz": (key % 4 * 10 + 20).cast("double"),
        "wel": (key % 2).cast("double"),
        "fhwp": F.when(key % 5 == 0, 2.0).when(key % 5 > 1, 0.0),
    })


def _sub(spark, d):
    return selection.expand_sub_observations(described(spark, d))


def _tags(spark, d):
    known = catalog.tags(spark, d)
    more = known.where("tag = 'R' and obs_key % 5 < 2").select("obs_key", F.when(F.col("obs_key") % 5 == 0, "moon").otherwise("jupiter").alias("tag"))
    return known.union(more)


DESCRIBED = (
    OBS.replace("obs as (", "plain as (", 1),
    f"""obs as (select *, case when obs_key % 4 = 0 then 'lat' else 'satp' || (obs_key % 4) end as telescope,
    {list(language.TUBES)}[obs_key % 13 + 1] as tube, case when obs_key % 10 = 0 then 'cal' else 'obs' end as type,
    case when obs_key % 3 = 0 then 'cmb' else 'planet' end as subtype, cast((obs_key % 5 - 2) * 10 as double) as roll,
    cast(obs_key % 4 * 10 + 20 as double) as waz, cast(obs_key % 2 as double) as wel,
    case when obs_key % 5 = 0 then 2.0::double when obs_key % 5 > 1 then 0.0::double end as fhwp from plain)""",
)
#: Tags as _tags() has them.
MORE_TAGS = TAGS.replace("tags as (", "flags as (", 1) + """, tags as (select * from flags union all
    select obs_key, case when obs_key % 5 = 0 then 'moon' else 'jupiter' end from flags where tag = 'R' and obs_key % 5 < 2)"""
_HOUR = "((ctime / 3600) % 24) between 11 and 23"
_SIDE = "((baz + 180) % 360 - 180)"
_YEAR = "((ctime - 1735689600.0) / 31556926.08 + 2025)"
_HAS = "exists (select 1 from tags where tags.obs_key = sub.obs_key and tag = '{}')"

#: name -> (selection, the same as a condition in SQL on `sub`)
ON_SUB = {
    "said_ids": ("obs_5|obs_8:ws1:f090|~obs_3,nsamp<1500", "(obs_id = 'obs_5' or (obs_id = 'obs_8' and slot = 'ws1' and band = 'f090') or obs_id <> 'obs_3') and nsamp < 1500 and det_type = 'OPTC'"),
    "said_one_id": ("obs_8:ws1:f090", "obs_id = 'obs_8' and slot = 'ws1' and band = 'f090' and det_type = 'OPTC'"),
    "said_wafer": ("ws1|(ws2&f150)", "(slot = 'ws1' or (slot = 'ws2' and band = 'f150')) and det_type = 'OPTC'"),
    "said_bands": ("f030|f040|f090|f150|f220|f280,-f150", "band in ('f030', 'f040', 'f090', 'f220', 'f280') and det_type = 'OPTC'"),
    "said_negation": ("~(f090|(ws0&night)),-ws2", f"not (band = 'f090' or (slot = 'ws0' and not ({_HOUR}))) and slot <> 'ws2' and det_type = 'OPTC'"),
    "said_dark": ("dark,f280", "det_type = 'DARK' and band = 'f280'"),
    "said_both_types": ("+dark,DARK|optc,ws0", "slot = 'ws0'"),
    "said_telescope": ("lat|satp1|~satp2", "(telescope in ('lat', 'satp1') or telescope <> 'satp2') and det_type = 'OPTC'"),
    "said_tube": ("c1|i1|o6,+i3", "tube in ('c1', 'i1', 'o6') and det_type = 'OPTC'"),
    "said_type": ("obs,~cmb", "type = 'obs' and not (type = 'obs' and subtype = 'cmb') and det_type = 'OPTC'"),
    "said_cmb_day": ("cmb,day", f"type = 'obs' and subtype = 'cmb' and {_HOUR} and det_type = 'OPTC'"),
    "said_night": ("night", f"not ({_HOUR}) and det_type = 'OPTC'"),
    "said_spin": ("spin", "fhwp <> 0 and det_type = 'OPTC'"),
    "said_rising": ("rising&bel>40", f"{_SIDE} > 10 and bel > 40 and det_type = 'OPTC'"),
    "said_setting": ("setting|bel<35", f"({_SIDE} < -10 or bel < 35) and det_type = 'OPTC'"),
    "said_aliases": ("yr>1996.5,yr<=1999,abs(baz-180)<90,waz>=30,wel=1,roll>-15,dur between 900 and 2000,nsamp%200=0,t>8e8,-bel<-30",
        f"{_YEAR} > 1996.5 and {_YEAR} <= 1999 and abs(baz - 180) < 90 and waz >= 30 and wel = 1 and roll > -15 and dur between 900 and 2000 and nsamp % 200 = 0 and ctime > 8e8 and -bel < -30 and det_type = 'OPTC'"),
    "said_moments": ("t+8e8<tcorot|t+8e8>twire,t+8e8<taso|t>tfoc2", "(ctime + 8e8 < 1749513600 or ctime + 8e8 > 1777208400) and (ctime + 8e8 < 1770000000 or ctime > 1756684800) and det_type = 'OPTC'"),
    "said_tags": ("R,-N", f"{_HAS.format('R')} and not {_HAS.format('N')} and det_type = 'OPTC'"),
    "said_tag_or": ("(A|~O)&flavor='mf',+R", f"({_HAS.format('A')} or not {_HAS.format('O')}) and flavor = 'mf' and det_type = 'OPTC'"),
    "said_planet": ("planet,~moon", f"({_HAS.format('moon')} or {_HAS.format('jupiter')}) and not {_HAS.format('moon')} and det_type = 'OPTC'"),
    "said_quoted": ("flavor in ('lf', \"uhf\"),slots='ws0,ws1',subobs_id not like '%:DARK'", "flavor in ('lf', 'uhf') and slots = 'ws0,ws1' and subobs_id not like '%:DARK' and det_type = 'OPTC'"),
    "said_nothing": ("", "det_type = 'OPTC'"),
}
#: The same on observations, where conditions on bands only say what can have them.
ON_OBS = {
    "said_of_observations": ("f090,-ws0,ws1,dark", "flavor = 'mf' and contains(slots, 'ws1')"),
    "said_pair_of_bands": ("f220|f030,-f030", "flavor in ('uhf', 'lf')"),
}
#: good and bad, with preprocessing results of some slots.
PREPARED = {"said_good": ("ws1", True), "said_good_and_bad": ("+bad,ws1", False), "said_neither": ("-good,ws1", None)}


def _said(text):
    def run(spark, d):
        out = language.select(_sub(spark, d), text, _tags(spark, d))
        return out.groupBy("obs_key").agg(F.count("*").alias("n"), F.min("subobs_id").alias("first"))

    return run


def _said_of_obs(text):
    return lambda spark, d: language.select(described(spark, d), text, _tags(spark, d)).select("obs_key")


def _prepared(text):
    def run(spark, d):
        slot = F.concat(F.lit("ws"), (F.col("l_linenumber") % 3).cast("string"))
        pre = catalog.table(spark, d, "lineitem").where("l_quantity >= 25").select(F.col("l_orderkey").alias("obs_key"), slot.alias("slot"))
        return language.select(_sub(spark, d), text, _tags(spark, d), pre).select("subobs_id")

    return run


def said_id_file(spark, d):
    """The sub-observations that a text file lists, of which some do not exist."""
    key = F.col("o_orderkey")
    lines = catalog.table(spark, d, "orders").select(F.concat(F.lit("obs_"), key, F.lit(":ws"), key % 5, F.lit(":f090 of "), F.col("o_orderstatus")))
    lines.write.text(path := new_path(spark, "ids"))
    return language.select(_sub(spark, d), f"@{path},nsamp>1200").select("subobs_id")


def said_slice(spark, d):
    return language.select(described(spark, d), "lat,5:-7:3,1::2").select("obs_id")


def tracks(spark, d):
    """The events of each type as an object that moves over the sky, at irregular times, once around in 40 days."""
    e = catalog.table(spark, d, "events")
    t = (catalog.seconds(F.col("ts")) - 1704067200) * 90 + 788918400
    place = (F.length("event_type") * 0.7 + (t - 788918400) * (2 * math.pi / (40 * 90 * 86400))) % (2 * math.pi)
    return e.select(F.col("event_type").alias("name"), t.alias("t"), place.alias("ra"), (F.sin(place) * 0.4).alias("dec"))


TRACKS = """ev as (select event_type as name, (epoch_us(ts) / 1e6 - 1704067200) * 90 + 788918400 as t from events),
    pl as (select name, t, (length(name) * 0.7::double + (t - 788918400) * (2 * pi() / (40 * 90 * 86400))) % (2 * pi()) as ra from ev),
    tr as (select distinct on (name, t) name, t, ra, sin(ra) * 0.4::double as dec from pl),
    st as (select *, lead(t) over w as t2, lead(ra) over w as ra2, lead(dec) over w as dec2 from tr window w as (partition by name order by t)),
    sp as (select obs_key, name, (ctime - t) / (t2 - t) as f, ra, dec, (ra2 - ra + pi()) - floor((ra2 - ra + pi()) / (2 * pi())) * 2 * pi() - pi() as step, dec2
           from obs join st on ctime >= t and ctime < t2),
    pl_at as (select obs_key, name, ra + f * step as ra, dec + f * (dec2 - dec) as dec from sp)"""


def track_positions(spark, d):
    at = sky.positions_at(described(spark, d), tracks(spark, d), "obs_key", "ctime")
    return at.select("obs_key", "name", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


def _swept(spark, d):
    """A row for each wafer slot of an observation, with the path of its sweeps."""
    slots = described(spark, d).withColumn("slot", F.explode(F.split("slots", ",")))
    return sky.with_sweep(slots)


_WAFERS = ", ".join(f"('{t}', '{w}', {x}::double, {y}::double)" for t, wafers in sky.LARGE_WAFERS.items() for w, (x, y) in wafers.items())
_LAT, _LON = f"{sky.LATITUDE!r}::double", f"{sky.LONGITUDE!r}::double"
SWEPT = f"""wf as (select tube, slot, radians(x) as xi, radians(y) as eta from (values {_WAFERS}) as w(tube, slot, x, y)),
    sl as (select *, unnest(string_split(slots, ',')) as slot from obs),
    of_ as (select sl.*, xi, eta, sqrt(1 - xi * xi - eta * eta) as c, radians({sky.LARGE_RADIUS}::double) as radius from sl join wf using (tube, slot)),
    ce as (select *, radians(baz) + atan2(xi, c * cos(radians(bel)) - eta * sin(radians(bel))) as mid, asin(eta * cos(radians(bel)) + c * sin(radians(bel))) as el from of_),
    lim as (select *, greatest(mid - radians(waz) / 2, floor(mid / pi()) * pi()) as az1, least(mid + radians(waz) / 2, ceil(mid / pi()) * pi()) as az2 from ce),
    pa as (select *, unnest(range(6)) as k, az1 + (az2 - az1) * (k / 5.0::double) as az from lim),
    eq as (select *, asin(greatest(-1, least(1, sin(el) * sin({_LAT}) + cos(el) * cos({_LAT}) * cos(az)))) as dec,
        0.7790572732640::double + 1.00273781191135448::double * (ctime - 946728000.0::double) / 86400 as turns,
        atan2(-sin(az) * cos(el), sin(el) * cos({_LAT}) - cos(el) * sin({_LAT}) * cos(az)) as hour from pa),
    ra_ as (select *, (turns - floor(turns)) * 2 * pi() + {_LON} - hour as raw from eq),
    wr as (select *, raw - floor(raw / (2 * pi())) * 2 * pi() as ra from ra_),
    fi as (select *, first(ra) over (partition by obs_key, slot order by k) as ra0 from wr),
    sw as (select *, ra0 + (ra - ra0 + pi()) - floor((ra - ra0 + pi()) / (2 * pi())) * 2 * pi() - pi() as y, dec as x from fi)"""


def sweep_paths(spark, d):
    s = _swept(spark, d).select("obs_key", "slot", F.posexplode(F.arrays_zip("ras", "decs")).alias("k", "p"))
    # whole turns apart is the same place
    return s.select("obs_key", "slot", F.col("k").cast("int").alias("k"), F.round(F.sin("p.ras"), 6).alias("sin_ra"), F.round(F.cos("p.ras"), 6).alias("cos_ra"), F.round("p.decs", 6).alias("dec"))


def _sky_said(text, *columns):
    def run(spark, d):
        out = language.select(_swept(spark, d), text, tracks=tracks(spark, d))
        return out.select("obs_key", "slot")

    return run


#: name -> (selection, the elevations or places that it takes, the condition in SQL on `el`)
SKY = {
    "said_hits": ("hits(83.6,-22)", None),
    "said_hits_gal": ("hits('gal',10)|~night", None),
    "said_hits_objects": ("hits('click,view',2)", None),
    "said_hits_planet": ("hits('planet')", None),
    "said_maxel": ("maxel(120,-30)>0.5,minel(120,-30)>0.3", None),
    "said_maxel_object": ("maxel('click')>0.6", None),
}


def _curve(at: str) -> str:
    """Of `at` (obs_key, slot, ra0, dec0: places to look at) those that the sweeps hit, with pad (rad) of that table."""
    return f"""lim2 as (select obs_key, slot, min(x) as lo, max(x) as hi, any_value(dur) as dur, any_value(radius) as radius, count(distinct x) as nx from sw group by all),
        tg as (select sw.obs_key, sw.slot, sw.k, sw.x, sw.y, p.name, p.ra as pra, p.dec as pdec, p.pad from sw join {at} p using (obs_key)),
        tm as (select a.obs_key, a.slot, a.name, a.k, any_value(a.y) * product(case when a.k <> b.k then (a.pdec - b.x) / nullif(a.x - b.x, 0) else 1 end) as term,
            any_value(a.pra) as pra, any_value(a.pdec) as pdec, any_value(a.pad) as pad from tg a join tg b using (obs_key, slot, name) group by a.obs_key, a.slot, a.name, a.k),
        cv as (select obs_key, slot, name, sum(term) as curve, any_value(pra) as pra, any_value(pdec) as pdec, any_value(pad) as pad from tm group by all),
        hw as (select cv.*, lim2.* exclude (obs_key, slot), radius / cos(pdec) + pad as wide, curve + radians(15) / 7200 * dur as middle from cv join lim2 using (obs_key, slot)),
        hr as (select *, pra - floor((pra - middle) / (2 * pi()) + 0.5) * 2 * pi() as w from hw),
        hit as (select distinct obs_key, slot from hr where nx = 6 and hi - lo > radians(0.1) and pdec > lo - radius - pad and pdec < hi + radius + pad
            and w > curve - wide and w < curve + radians(15) / 3600 * dur + wide)"""


def _elevation(ra: str, dec: str, t: str) -> str:
    turns = f"(0.7790572732640::double + 1.00273781191135448::double * ({t} - 946728000.0::double) / 86400)"
    return f"asin(sin({dec}) * sin({_LAT}) + cos({dec}) * cos({_LAT}) * cos(({turns} - floor({turns})) * 2 * pi() + {_LON} - {ra}))"


def _over(kind: str, ra: str, dec: str) -> str:
    return f"{kind}({_elevation(ra, dec, 'ctime')}, {_elevation(ra, dec, 'ctime + dur')})"


_ONE = "pt as (select obs_key, 'p' as name, radians(83.6::double) as ra, radians(-22::double) as dec, radians(1) as pad from obs)"
_GAL = """dr as (select obs_key, slot, ctime, radius, y, x from sw union all select obs_key, slot, ctime, radius, y + radians(15) / 3600 * dur, x from sw),
    la as (select obs_key, slot, ctime, radius, asin(sin(x) * sin(radians(27.12825)) + cos(x) * cos(radians(27.12825)) * cos(y - radians(192.859508))) as b from dr),
    ga as (select obs_key, slot, any_value(ctime) as ctime, min(b) * max(b) < 0 or min(abs(b)) + any_value(radius) + radians(1) < radians(10) as gal from la group by obs_key, slot)"""


QUERIES = {name: _said(text) for name, (text, _) in ON_SUB.items()}
QUERIES |= {name: _said_of_obs(text) for name, (text, _) in ON_OBS.items()}
QUERIES |= {name: _prepared(text) for name, (text, _) in PREPARED.items()}
QUERIES |= {name: _sky_said(text) for name, (text, _) in SKY.items()}
QUERIES |= {f.__name__: f for f in (said_id_file, said_slice, track_positions, sweep_paths)}

_IN_PRE = "exists (select 1 from lineitem where l_orderkey = obs_key and l_quantity >= 25 and 'ws' || (l_linenumber % 3) = slot)"
ORACLE_SQL = {
    name: q(*DESCRIBED, SUB, MORE_TAGS, select=f"select obs_key, count(*) as n, min(subobs_id) as first from sub where {where} group by obs_key")
    for name, (_, where) in ON_SUB.items()
}
ORACLE_SQL |= {name: q(*DESCRIBED, select=f"select obs_key from obs where {where}") for name, (_, where) in ON_OBS.items()}
ORACLE_SQL |= {
    name: q(*DESCRIBED, SUB, select=f"select subobs_id from sub where slot = 'ws1' and det_type = 'OPTC' and {_IN_PRE if good else 'true' if good is False else 'false'}")
    for name, (_, good) in PREPARED.items()
}
ORACLE_SQL |= {
    "said_id_file": q(*DESCRIBED, SUB, select="select subobs_id from sub where nsamp > 1200 and band = 'f090' and det_type = 'OPTC' and slot = 'ws' || (obs_key % 5)"),
    "said_slice": q(*DESCRIBED, """a as (select obs_id, row_number() over (order by obs_id) - 1 as k, count(*) over () as n from obs where telescope = 'lat'),
        b as (select obs_id, row_number() over (order by k) - 1 as j from a where k >= 5 and k < n - 7 and (k - 5) % 3 = 0)""",
        select="select obs_id from b where j >= 1 and (j - 1) % 2 = 0"),
    "track_positions": q(*DESCRIBED, TRACKS, select="select obs_key, name, round(ra, 6) as ra, round(dec, 6) as dec from pl_at"),
    "sweep_paths": q(*DESCRIBED, SWEPT, select="select obs_key, slot, cast(k as int) as k, round(sin(y), 6) as sin_ra, round(cos(y), 6) as cos_ra, round(dec, 6) as dec from sw"),
    "said_hits": q(*DESCRIBED, SWEPT, _ONE, _curve("pt"), select="select obs_key, slot from hit"),
    "said_hits_gal": q(*DESCRIBED, SWEPT, _GAL, select=f"select obs_key, slot from ga where gal or {_HOUR}"),
    "said_hits_objects": q(*DESCRIBED, SWEPT, TRACKS, "pt as (select *, radians(2) as pad from pl_at where name in ('click', 'view'))", _curve("pt"), select="select obs_key, slot from hit"),
    "said_hits_planet": q(*DESCRIBED, SWEPT, TRACKS, "pt as (select *, radians(1) as pad from pl_at)", _curve("pt"), select="select obs_key, slot from hit"),
    "said_maxel": q(*DESCRIBED, "s as (select *, unnest(string_split(slots, ',')) as slot from obs)",
        select=f"select obs_key, slot from s where {_over('greatest', 'radians(120)', 'radians(-30)')} > 0.5 and {_over('least', 'radians(120)', 'radians(-30)')} > 0.3"),
    "said_maxel_object": q(*DESCRIBED, TRACKS, "s as (select obs_key, ctime, dur, unnest(string_split(slots, ',')) as slot from obs)",
        select=f"select obs_key, slot from s join pl_at using (obs_key) where name = 'click' and {_over('greatest', 'pl_at.ra', 'pl_at.dec')} > 0.6"),
}
