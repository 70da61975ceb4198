"""Queries of data splits and of small functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import tables
from scanloom.operators import blocks, intervals, mapping, splits
from scanloom.plans.sql_parts import CUTS, IVAR, OBS, SAMP, q
from scanloom.sources import catalog


def _with_long_ids(spark, d):
    """Observations under ids with time, tube, wafer and band; those of every fifth key end behind the tube."""
    obs = catalog.observations(spark, d)
    tube = F.concat(F.when(F.col("flavor") == "lf", "i").otherwise("o"), (F.col("obs_key") % 6 + 1).cast("string"))
    head = F.concat(F.lit("obs_"), F.format_string("%010d", F.col("ctime").cast("long")), F.lit("_lat"), tube, F.lit("_111"))
    tail = F.concat(F.lit(":ws"), (F.col("obs_key") % 3).cast("string"), F.lit(":f"), F.when(F.col("flavor") == "lf", "030").otherwise("090"))
    return obs.withColumn("long_id", F.when(F.col("obs_key") % 5 == 0, head).otherwise(F.concat(head, tail)))


LONG = """ids as (select *, 'obs_' || lpad(cast(cast(ctime as bigint) as varchar), 10, '0') || '_lat' || case flavor when 'lf' then 'i' else 'o' end
    || cast(obs_key % 6 + 1 as varchar) || '_111' || case when obs_key % 5 = 0 then '' else ':ws' || cast(obs_key % 3 as varchar)
    || case flavor when 'lf' then ':f030' else ':f090' end end as long_id from obs)"""


def id_tokens(spark, d):
    return _with_long_ids(spark, d).select("obs_key", *(splits.id_part(F.col("long_id"), n).alias(n) for n in splits.ID_PARTS))


def split_by_parts(spark, d):
    out = splits.numbered(_with_long_ids(spark, d), splits.by_parts(F.col("long_id"), "tube", "band"))
    return out.select("obs_key", "label", "split")


def split_by_days(spark, d):
    out = splits.numbered(catalog.observations(spark, d), splits.by_days(F.col("ctime"), 30))
    return out.select("obs_key", "label", "split")


def split_crosslink(spark, d):
    return catalog.observations(spark, d).select("obs_key", splits.by_direction(F.col("baz")).alias("split"))


def table_interpolation(spark, d):
    """Values of a short table at fractional places, on it and beyond its ends."""
    table = F.array(*(F.lit(float(v)) for v in (1, 4, 2, 8, 16)))
    x = F.col("o_orderkey") % 23 / F.lit(4.0) - F.lit(0.5)
    at = catalog.table(spark, d, "orders").select("o_orderkey", x.alias("x"))
    got = at.select("o_orderkey", tables.linear(table, F.col("x")).alias("lin"), tables.logarithmic(table, F.col("x")).alias("log"))
    return got.withColumn("log", F.round("log", 6))


def inverse_weights(spark, d):
    out = blocks.inverse_weights(mapping.white_weights(catalog.samples(spark, d)), "det", tol=0.9)
    return out.select("det", F.round("inverse", 6).alias("inverse"))


def repeated_cuts(spark, d):
    return intervals.repeated(intervals.runs(catalog.samples(spark, d), "cut"), 100_000, 3)


def last_crossing(spark, d):
    return blocks.last_crossing(catalog.samples(spark, d), F.lit(50.0), 120.0)


QUERIES = {
    f.__name__: f
    for f in (id_tokens, split_by_parts, split_by_days, split_crosslink, table_interpolation, inverse_weights, repeated_cuts, last_crossing)
}
RANKED = "select obs_key, label, cast(dense_rank() over (order by label) - 1 as bigint) as split from lab"
ORACLE_SQL = {
    "id_tokens": q(OBS, LONG, select="""select obs_key, substr(long_id, 1, 3) as pre, substr(long_id, 5, 10) as tid, substr(long_id, 19, 2) as tube,
        case when length(long_id) > 25 then substr(long_id, 26, 3) end as wslot, case when length(long_id) > 29 then substr(long_id, 30, 4) end as band from ids"""),
    "split_by_parts": q(OBS, LONG, "lab as (select obs_key, concat_ws('_', substr(long_id, 19, 2), case when length(long_id) > 29 then substr(long_id, 30, 4) end) as label from ids)", select=RANKED),
    "split_by_days": q(OBS, "lab as (select obs_key, cast(floor(ctime / (30 * 86400)) as bigint) as label from obs)", select=RANKED),
    "split_crosslink": q(OBS, select="select obs_key, cast(baz >= 180 as integer) as split from obs"),
    "table_interpolation": """with t as (select [1.0, 4.0, 2.0, 8.0, 16.0]::double[] as t), x as (select o_orderkey, o_orderkey % 23 / 4.0 - 0.5 as x from orders),
        k as (select *, cast(least(greatest(floor(x), 0), 3) as integer) as k from x), s as (select *, (ln(x + 1) - ln(k + 1)) / (ln(k + 2) - ln(k + 1)) as s from k)
        select o_orderkey, t[k + 1] * (1 - (x - k)) + t[k + 2] * (x - k) as lin, round(exp(ln(t[k + 1]) * (1 - s) + ln(t[k + 2]) * s), 6) as log from s cross join t""",
    "inverse_weights": q(SAMP, IVAR, "p as (select *, row_number() over (order by det) - 1 as pos from ivar where ivar <> 0), m as (select avg(ivar) as mean from p where pos % 100 = 0)",
        select="select det, round(case when ivar > mean * 0.9 then 1 / ivar else 0 end, 6) as inverse from ivar cross join m"),
    "repeated_cuts": q(SAMP, CUTS, select="select det + k * 100000 as det, lo, hi from cuts cross join (values (0), (1), (2)) as c(k)"),
    "last_crossing": q(SAMP, "c as (select det, samp, sign(value - 50) as s, lead(sign(value - 50)) over w as s2, abs(lead(value) over w - value) as jump from samp window w as (partition by det order by samp))",
        select="select det, max(samp) as samp from c where s2 <> s and jump <= 60 group by det"),
}
