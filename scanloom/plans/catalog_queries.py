"""Queries of the catalog: expansion, tags, selections, joins and groups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators import grouping, joins, selection
from scanloom.plans.sql_parts import OBS, SAMP, SUB, TAGS, q
from scanloom.sources import catalog

HOUR = "((ctime / 3600) % 24)"


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.observations(spark, d)


def _sub(spark: SparkSession, d: str) -> DataFrame:
    out = selection.expand_sub_observations(_obs(spark, d))
    return out.withColumn("ndet", selection.det_count(F.col("flavor"), F.col("det_type")))


def _epochs(spark: SparkSession) -> DataFrame:
    """Half-year epochs of 1995 to 1999; what is later has none."""
    years = spark.range(10).select(F.col("id").cast("int").alias("epoch_no"))
    start = lambda k: ((k * 15768000) + 788918400).cast("double")
    return years.select("epoch_no", start(F.col("epoch_no")).alias("lo"), start(F.col("epoch_no") + 1).alias("hi"))


EPOCHS = """epochs as (select cast(k as integer) as epoch_no, cast(k * 15768000 + 788918400 as double) as lo,
    cast((k + 1) * 15768000 + 788918400 as double) as hi from range(10) as r(k))"""


def subobs_expand(spark, d):
    return _sub(spark, d).select("subobs_id", "slot", "band", "det_type", "ndet")


def distinct_tags(spark, d):
    return catalog.tags(spark, d).groupBy("tag").agg(F.count("*").alias("n"))


def tag_semi(spark, d):
    return selection.with_tag(_obs(spark, d), catalog.tags(spark, d), "R").select("obs_id", "ctime")


def tag_anti(spark, d):
    return selection.without_tag(_obs(spark, d), catalog.tags(spark, d), "R").select("obs_id", "ctime")


def tags_column(spark, d):
    return selection.with_tag_list(_obs(spark, d), catalog.tags(spark, d)).select("obs_id", "tags")


#: A tag of each kind that is left out or only looks like one.
KINDS = ("uid-7", "x_SCAN_y", "12-34", "123", "3.5", "ws1", "ws12", "i1_ws0", "1f-0-9c-7-ab", "1f-0-9c", "rising", "rising2")


def filtered_tags(spark, d):
    """Tags without the dull ones; every observation of the tag R gets a tag of each kind."""
    known = catalog.tags(spark, d)
    more = known.where("tag = 'R'").select("obs_key", F.explode(F.array(*map(F.lit, KINDS))).alias("tag"))
    return selection.with_tag_list(_obs(spark, d), known.union(more), dull=selection.DULL_TAGS).select("obs_id", "tags")


def idlist_order(spark, d):
    key = F.col("o_orderkey")
    ids = catalog.table(spark, d, "orders").where(key % 97 == 5)
    ids = ids.select(F.concat(F.lit("obs_"), key.cast("string")).alias("id"), (-key).alias("pos"))
    return selection.in_listed_order(_obs(spark, d), ids).select("obs_id", "pos")


def slice_positional(spark, d):
    return catalog.positional_slice(_obs(spark, d), ["obs_key"], 10, -20, 7).select("obs_key", "pos")


def select_day(spark, d):
    return _obs(spark, d).where(selection.day(F.col("ctime"))).select("obs_id", "ctime")


def select_night(spark, d):
    return _obs(spark, d).where(selection.night(F.col("ctime"))).select("obs_id", "ctime")


def select_bands(spark, d):
    cond = F.col("band").isin("f090", "f280") & (F.col("det_type") == "OPTC") & (F.col("slot") == "ws1")
    return _sub(spark, d).where(cond).select("subobs_id", "ndet")


def select_or_not(spark, d):
    cond = (F.col("slot") == "ws2") | ~F.col("band").isin("f030", "f040", "DARK")
    return _sub(spark, d).where(cond & selection.night(F.col("ctime"))).groupBy("flavor", "slot").agg(F.count("*").alias("n"))


def select_year(spark, d):
    yr = selection.year(F.col("ctime"))
    return _obs(spark, d).where((yr > 1997.5) & (yr < 1998.25)).select("obs_id", F.round(yr, 4).alias("yr"))


def select_rising(spark, d):
    az = F.col("baz")
    state = F.when(selection.rising(az), "rising").when(selection.setting(az), "setting").otherwise("neither")
    return _obs(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum("nsamp").alias("nsamp"))


def good_default(spark, d):
    """Observations with preprocessing results: orders that have a line of quantity 45 or more."""
    pre = catalog.table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("obs_key"))
    return selection.good_only(_obs(spark, d), pre).select("obs_id", "flavor")


def epoch_join(spark, d):
    return joins.epoch_join(_obs(spark, d).select("obs_key", "ctime"), _epochs(spark), "ctime", "obs_key", 15768000.0).select(
        "obs_key", "epoch_no"
    )


def period_lookup(spark, d):
    """Observations whose middle is in a scan period of their elevation; others drop out."""
    obs = _obs(spark, d)
    periods = grouping.scan_periods(obs, ["bel"], 7200.0, 400.0, ["baz"], ["obs_key"]).where("n > 1")
    mid = obs.select("obs_key", F.col("bel").alias("el"), (F.col("ctime") + F.col("dur") / 2).alias("mid"))
    hits = joins.bucketed_range_join(mid, periods, "mid", "t0", "t1", 86400.0).where("el = bel")
    return hits.select("obs_key", "session", "t0", "t1")


def meta_star(spark, d):
    """Lines as detectors: joined with part and supplier calibration, and filtered by its quality."""
    lines = catalog.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    cal = catalog.table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        (F.col("p_size") - 3).alias("bg"),
        (F.col("p_size") % 7).alias("r_tes"),
        (F.col("p_size") / F.lit(50.0)).alias("r_frac"),
        F.col("p_retailprice").alias("s_i"),
        F.col("p_retailprice").alias("phase_to_pW"),
        F.col("p_retailprice").alias("tau_eff"),
    )
    sup = catalog.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    good = joins.star_join(lines, (cal.where(joins.good_detector()), "l_partkey"), (sup, "l_suppkey"))
    return good.groupBy("s_nationkey").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity")
    )


def acal_fallback(spark, d):
    """A factor by (nation, segment) where one is known, else by nation, else null."""
    cust = catalog.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    first = cust.where("nation % 3 = 0").groupBy("nation", "segment").agg(F.max("c_custkey").alias("factor"))
    second = cust.where("nation % 3 <= 1").groupBy("nation").agg(F.min("c_custkey").alias("factor"))
    return joins.two_key_lookup(cust, first, ["nation", "segment"], second, ["nation"], "factor").select("c_custkey", "factor")


def zip_join(spark, d):
    left = catalog.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    right = catalog.table(spark, d, "part").select("p_partkey", "p_size")
    return joins.zip_join(left, ["c_custkey"], right, ["p_size", "p_partkey"]).select("pos", "c_custkey", "p_partkey")


def axis_intersect(spark, d):
    return joins.intersect_labels(
        catalog.table(spark, d, "part").select(F.col("p_partkey").alias("key")),
        catalog.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("key")),
        "key",
    )


def merge_catalogs(spark, d):
    """Two metadata sources as one: nations and regions as files, customers and nations as their index."""
    nation, region = catalog.table(spark, d, "nation"), catalog.table(spark, d, "region")
    a = (
        catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("file_id")),
        nation.select(F.col("n_nationkey").cast("long").alias("file_id"), F.col("n_name").alias("name")),
    )
    b = (
        nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_regionkey").cast("long").alias("file_id")),
        region.select(F.col("r_regionkey").cast("long").alias("file_id"), F.col("r_name").alias("name")),
    )
    index, files = catalog.merge_sources([a, b])
    return index.join(files, "file_id").groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def keep_last(spark, d):
    orders = catalog.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return joins.keep_last(orders, "o_custkey", "o_orderkey")


def files_of_observations(spark, d):
    """Files by observation, ordered by their start: the lines of an order."""
    lines = catalog.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    got = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("f"))
    name = lambda x: F.concat_ws("/", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))
    return got.select("l_orderkey", F.array_join(F.transform("f", name), ",").alias("files"))


def json_attribute(spark, d):
    k = F.from_json("props", "k int")["k"]
    return catalog.table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


def _group_query(mode: str):
    def run(spark, d):
        sub = _sub(spark, d)
        keyed = sub.withColumn("grp", grouping.group_key(F.col("subobs_id"), mode))
        return keyed.groupBy("grp").agg(F.count("*").alias("n"), F.sum("ndet").alias("ndet"))

    return run


def group_info(spark, d):
    sub = _sub(spark, d).withColumn("grp", grouping.group_key(F.col("subobs_id"), "oband"))
    out = grouping.group_info(sub, "grp")
    return out.withColumn("rate", F.round("rate", 6))


def time_split(spark, d):
    sub = _sub(spark, d).withColumn("grp", grouping.group_key(F.col("subobs_id"), "wafer"))
    info = grouping.group_info(sub, "grp").select("grp", "size", "nsamp")
    return grouping.time_split(info, "grp", F.col("size"), F.col("nsamp"), 1_000_000).select("name", "i0", "i1")


def group_tol(spark, d):
    clusters = grouping.group_by_tolerance(_obs(spark, d), "ctime", 3000.0, ["flavor"], ["obs_key"])
    return clusters.groupBy("flavor", "cluster").agg(F.count("*").alias("n"), F.min("ctime").alias("t0"), F.min_by("obs_id", F.struct("ctime", "obs_key")).alias("name"))


def scan_periods(spark, d):
    return grouping.scan_periods(_obs(spark, d), ["bel"], 7200.0, 100.0, ["baz"], ["obs_key"])


def split_periods(spark, d):
    periods = grouping.scan_periods(_obs(spark, d), ["bel"], 86400.0, 400.0, ["baz"], ["obs_key"])
    return grouping.split_periods(periods, 86400.0).select("bel", "session", "part", F.round("p0", 3).alias("p0"), F.round("p1", 3).alias("p1"))


def period_gaps(spark, d):
    periods = grouping.scan_periods(_obs(spark, d), ["bel"], 7200.0, 400.0, ["baz"], ["obs_key"])
    return grouping.period_gaps(periods, ["bel"], 43200.0)


def det_tuples(spark, d):
    parts = catalog.table(spark, d, "part").select("p_brand", "p_size", "p_partkey")
    out = grouping.det_tuples(parts, ["p_brand", "p_size"], "p_partkey", 2)
    return out.select("p_brand", "p_size", "n", F.array_join(F.col("dets").cast("array<string>"), ",").alias("dets"))


def sessions_of_users(spark, d):
    """Batch sessions of samples: a pause of more than six hours of a detector begins another."""
    s = catalog.samples(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    got = grouping.group_by_tolerance(s, "t", 6 * 3600 * 1e6, ["det"], ["samp"])
    return got.groupBy("det", "cluster").agg(F.count("*").alias("n"), F.min("samp").alias("first"))


PERIODS = """lagged as (select *, lag(ctime + dur) over w as e, lag(baz) over w as b from obs window w as (partition by bel order by ctime, obs_key)),
    marked as (select *, sum(case when ctime - e > {ttol} or abs(baz - b) > {atol} then 1 else 0 end)
        over (partition by bel order by ctime, obs_key rows unbounded preceding) as session from lagged),
    periods as (select bel, cast(session as bigint) as session, min(ctime) as t0, max(ctime + dur) as t1, count(*) as n from marked group by bel, session)"""
_TAIL = "from sub group by 1"
_KEYS = {
    "obs": "obs_id",
    "oband": "obs_id || ':' || band",
    "wafer": "obs_id || ':' || slot",
    "wband": "obs_id || ':' || slot || ':' || band",
    "none": "subobs_id",
}

QUERIES = {
    f.__name__: f
    for f in (
        subobs_expand, distinct_tags, tag_semi, tag_anti, tags_column, filtered_tags, idlist_order, slice_positional, select_day,
        select_night, select_bands, select_or_not, select_year, select_rising, good_default, epoch_join, period_lookup, meta_star,
        acal_fallback, zip_join, axis_intersect, merge_catalogs, keep_last, files_of_observations, json_attribute, group_info, time_split,
        group_tol, scan_periods, split_periods, period_gaps, det_tuples, sessions_of_users,
    )
} | {f"group_obs_{m}": _group_query(m) for m in grouping.MODES}

ORACLE_SQL = {
    "subobs_expand": q(OBS, SUB, select="select subobs_id, slot, band, det_type, ndet from sub"),
    "distinct_tags": q(TAGS, select="select tag, count(*) as n from tags group by tag"),
    "tag_semi": q(OBS, select="select obs_id, ctime from obs where obs_key in (select l_orderkey from lineitem where l_returnflag = 'R' or l_linestatus = 'R')"),
    "tag_anti": q(OBS, select="select obs_id, ctime from obs where not exists (select 1 from lineitem where l_orderkey = obs_key and (l_returnflag = 'R' or l_linestatus = 'R'))"),
    "tags_column": q(OBS, TAGS, select="select obs_id, string_agg(tag, ',' order by tag) as tags from obs left join tags using (obs_key) group by obs_id"),
    "filtered_tags": q(OBS, TAGS, f"""more as (select * from tags union select obs_key, unnest({list(KINDS)}) from tags where tag = 'R'),
        kept as (select * from more where not (starts_with(tag, 'uid-') or contains(tag, '_SCAN_') or regexp_matches(tag, '^[0-9]+-[0-9]+$') or regexp_matches(tag, '^([A-Za-z0-9_][0-9]_)?ws[0-9]$')
        or regexp_matches(tag, '^[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+$') or tag in ('rising', 'setting')))""",
        select="select obs_id, string_agg(tag, ',' order by tag) as tags from obs left join kept using (obs_key) group by obs_id"),
    "idlist_order": "select 'obs_' || o_orderkey as obs_id, -o_orderkey as pos from orders where o_orderkey % 97 = 5",
    "slice_positional": """with p as (select o_orderkey as obs_key, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)
        select obs_key, pos from p where pos >= 10 and pos < n - 20 and (pos - 10) % 7 = 0""",
    "select_day": q(OBS, select=f"select obs_id, ctime from obs where {HOUR} between 11 and 23"),
    "select_night": q(OBS, select=f"select obs_id, ctime from obs where not ({HOUR} between 11 and 23)"),
    "select_bands": q(OBS, SUB, select="select subobs_id, ndet from sub where band in ('f090', 'f280') and det_type = 'OPTC' and slot = 'ws1'"),
    "select_or_not": q(OBS, SUB, select=f"""select flavor, slot, count(*) as n from sub
        where (slot = 'ws2' or band not in ('f030', 'f040', 'DARK')) and not ({HOUR} between 11 and 23) group by all"""),
    "select_year": q(OBS, select="""select obs_id, round((ctime - 1735689600.0) / 31556926.08 + 2025, 4) as yr from obs
        where (ctime - 1735689600.0) / 31556926.08 + 2025 > 1997.5 and (ctime - 1735689600.0) / 31556926.08 + 2025 < 1998.25"""),
    "select_rising": q(OBS, select="""select case when (baz + 180) % 360 - 180 > 10 then 'rising' when (baz + 180) % 360 - 180 < -10 then 'setting'
        else 'neither' end as state, count(*) as n, cast(sum(nsamp) as bigint) as nsamp from obs group by 1"""),
    "good_default": q(OBS, select="select obs_id, flavor from obs where obs_key in (select l_orderkey from lineitem where l_quantity >= 45)"),
    "epoch_join": q(OBS, EPOCHS, select="""select obs_key, coalesce((select min(epoch_no) from epochs where ctime >= lo and ctime < hi), 9) as epoch_no from obs"""),
    "period_lookup": q(OBS, PERIODS.format(ttol=7200, atol=400), select="""select obs_key, session, t0, t1 from obs o join periods p on p.bel = o.bel
        and ctime + dur / 2 >= t0 and ctime + dur / 2 < t1 where n > 1"""),
    "meta_star": """select s_nationkey, count(*) as n, cast(sum(cast(l_quantity as decimal(18, 2))) as double) as quantity from lineitem
        join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
        where p_size - 3 >= 0 and p_size % 7 > 0 and p_size / 50.0 between 0.05 and 0.8 group by s_nationkey""",
    "acal_fallback": """with a as (select c_nationkey, c_mktsegment, max(c_custkey) as f from customer where c_nationkey % 3 = 0 group by all),
        b as (select c_nationkey, min(c_custkey) as f from customer where c_nationkey % 3 <= 1 group by all)
        select c_custkey, coalesce(a.f, b.f) as factor from customer c left join a on a.c_nationkey = c.c_nationkey and a.c_mktsegment = c.c_mktsegment
        left join b on b.c_nationkey = c.c_nationkey""",
    "zip_join": """with a as (select c_custkey, row_number() over (order by c_custkey) - 1 as pos from customer),
        b as (select p_partkey, row_number() over (order by p_size, p_partkey) - 1 as pos from part) select pos, c_custkey, p_partkey from a join b using (pos)""",
    "axis_intersect": "select p_partkey as key from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)",
    "merge_catalogs": """with f as (select n_nationkey as file_id, n_name as name from nation union all
          select r_regionkey + (select max(n_nationkey) + 1 from nation), r_name from region),
        i as (select c_custkey as key, c_nationkey as file_id from customer union all
          select n_nationkey, n_regionkey + (select max(n_nationkey) + 1 from nation) from nation)
        select cast(file_id as bigint) as file_id, name, count(*) as n, cast(min(key) as bigint) as first from i join f using (file_id) group by all""",
    "keep_last": "select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey",
    "files_of_observations": """with l as (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) select l_orderkey,
        string_agg(l_linenumber || '/' || l_partkey, ',' order by l_linenumber, l_partkey) as files from l group by l_orderkey""",
    "json_attribute": """select event_type, cast(sum(cast(json_extract_string(props, '$.k') as integer)) as bigint) as k,
        count(json_extract_string(props, '$.k')) as n from events group by event_type""",
    "group_info": q(OBS, SUB, select="""select obs_id || ':' || band as grp, count(*) as n, cast(sum(ndet) as bigint) as ndet, max(ndet) as ndet_max,
        max(nsamp) as nsamp, round(min(nsamp / dur), 6) as rate, max(dur) as dur, cast(sum(ndet * nsamp) as bigint) as size from sub group by 1"""),
    "time_split": q(OBS, SUB, """g as (select obs_id || ':' || slot as grp, sum(ndet * nsamp) as size, max(nsamp) as nsamp from sub group by 1),
        p as (select grp, nsamp, cast(size // 1000000 + 1 as bigint) as np from g)""",
        select="""select case when np = 1 then grp else grp || ':split' || part end as name, part * nsamp // np as i0, (part + 1) * nsamp // np as i1
        from (select *, unnest(range(0, np)) as part from p)"""),
    "group_tol": q(OBS, """l as (select *, ctime - lag(ctime) over (partition by flavor order by ctime, obs_key) as gap from obs),
        m as (select *, cast(sum(case when gap > 3000 then 1 else 0 end) over (partition by flavor order by ctime, obs_key rows unbounded preceding) as bigint) as cluster from l)""",
        select="select flavor, cluster, count(*) as n, min(ctime) as t0, arg_min(obs_id, (ctime, obs_key)) as name from m group by flavor, cluster"),
    "scan_periods": q(OBS, PERIODS.format(ttol=7200, atol=100), select="select bel, session, t0, t1, n from periods"),
    "split_periods": q(OBS, PERIODS.format(ttol=86400, atol=400), """s as (select *, greatest(cast(ceil((t1 - t0) / 86400.0) as integer), 1) as np from periods)""",
        select="""select bel, session, cast(part as integer) as part, round(t0 + (t1 - t0) / np * part, 3) as p0, round(t0 + (t1 - t0) / np * (part + 1), 3) as p1
        from (select *, unnest(range(0, np)) as part from s)"""),
    "period_gaps": q(OBS, PERIODS.format(ttol=7200, atol=400), """r as (select bel, t0, max(t1) over (partition by bel order by t0, t1 rows between unbounded preceding and 1 preceding) as g0 from periods)""",
        select="select bel, g0, t0 as g1 from r where t0 - g0 > 43200"),
    "det_tuples": """select p_brand, p_size, cast(count(*) as integer) as n, string_agg(p_partkey, ',' order by p_partkey) as dets
        from part group by p_brand, p_size having count(*) >= 2""",
    "sessions_of_users": q(SAMP, """l as (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by det order by samp) as gap from samp),
        m as (select *, cast(sum(case when gap > 21600000000 then 1 else 0 end) over (partition by det order by samp rows unbounded preceding) as bigint) as cluster from l)""",
        select="select det, cluster, count(*) as n, min(samp) as first from m group by det, cluster"),
} | {f"group_obs_{m}": q(OBS, SUB, select=f"select {k} as grp, count(*) as n, cast(sum(ndet) as bigint) as ndet {_TAIL}") for m, k in _KEYS.items()}
