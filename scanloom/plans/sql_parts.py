"""Common table expressions of the SQL that mirrors the registered queries (DuckDB's dialect)."""

OBS = """obs as (select o_orderkey as obs_key, 'obs_' || o_orderkey as obs_id,
    cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 86400 + o_orderkey % 24 * 3600
         + o_orderkey % 60 * 60 as double) as ctime,
    case when o_orderpriority like '1%' then 'lf' when o_orderpriority like '2%' or o_orderpriority like '3%' then 'mf'
         else 'uhf' end as flavor,
    case o_orderkey % 3 when 0 then 'ws0' when 1 then 'ws0,ws1' else 'ws0,ws1,ws2' end as slots,
    cast(600 + o_orderkey % 7 * 300 as double) as dur, cast(1000 + o_orderkey % 11 * 100 as bigint) as nsamp,
    cast(o_custkey % 360 as double) as baz, cast(30 + o_custkey % 6 * 5 as double) as bel from orders)"""
TAGS = """tags as (select distinct obs_key, tag from (select l_orderkey as obs_key, l_returnflag as tag from lineitem
    union all select l_orderkey, l_linestatus from lineitem))"""
SUB = """bands as (select * from (values ('lf', 'f030'), ('lf', 'f040'), ('lf', 'DARK'), ('mf', 'f090'), ('mf', 'f150'),
    ('mf', 'DARK'), ('uhf', 'f220'), ('uhf', 'f280'), ('uhf', 'DARK')) as b(flavor, band)),
    types as (select * from (values ('OPTC', ''), ('DARK', ':DARK')) as t(det_type, tail)),
    slot as (select *, unnest(string_split(slots, ',')) as slot from obs),
    sub as (select s.*, band, det_type, obs_id || ':' || slot || ':' || band || tail as subobs_id,
        case when s.flavor = 'lf' then case det_type when 'OPTC' then 118 else 4 end
             else case det_type when 'OPTC' then 864 else 18 end end as ndet
        from slot s join bands b on s.flavor = b.flavor cross join types)"""
SAMP = """samp as (select user_id as det, row_number() over (partition by user_id order by ts, event_id) - 1 as samp, ts, value,
    event_type = 'error' as cut from events),
    ns as (select det, count(*) as nsamp from samp group by det)"""
CUTS = """flagged as (select det, samp - row_number() over (partition by det order by samp) as g, samp from samp where cut),
    cuts as (select det, cast(min(samp) as integer) as lo, cast(max(samp) + 1 as integer) as hi from flagged group by det, g)"""
WIDE = """wide as (select det, greatest(lo - 1, 0) as lo, least(hi + 1, cast(nsamp as integer)) as hi from cuts join ns using (det)
    union all select det, lo, least(hi + 3, cast(nsamp as integer)) from cuts join ns using (det)),
    reach as (select *, max(hi) over (partition by det order by lo, hi rows between unbounded preceding and 1 preceding) as r from wide),
    island as (select *, sum(case when r >= lo then 0 else 1 end) over (partition by det order by lo, hi rows unbounded preceding) as i from reach),
    merged as (select det, min(lo) as lo, max(hi) as hi from island group by det, i)"""
IVAR = """ivar as (select det, 1 / var_pop(value) as ivar from samp group by det having var_pop(value) > 0)"""


def q(*parts: str, select: str) -> str:
    return "with " + ", ".join(parts) + " " + select
