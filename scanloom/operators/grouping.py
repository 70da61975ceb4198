"""Groups of observations: by id, by time within a tolerance, sessions of equal pointing, and time splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.catalog import ranged

#: Parts of obs:slot:band[:type] that make the group key (fixed values).
MODES = {"obs": (0,), "oband": (0, 2), "wafer": (0, 1), "wband": (0, 1, 2), "none": (0, 1, 2, 3)}


def group_key(subobs_id: Column, mode: str) -> Column:
    parts = F.split(subobs_id, ":")
    return F.concat_ws(":", *(F.get(parts, k) for k in MODES[mode]))


def islands(df: DataFrame, order: list[str], carried: dict[str, Column], starts: Callable[[Column, Column], Column], by: list[str], name: str) -> DataFrame:
    """df with a number from 0 that grows where starts(this row, the one before) holds, within the partitions `by`; both are
    structs of the `carried` columns, and `order` is unique there.

    The rows are dealt out by ranges of `by` and `order`, so that no task needs a whole partition; the ends of the ranges
    meet, a row for each range and value of `by`."""
    dealt = ranged(df.withColumn("__now", F.struct(*(c.alias(k) for k, c in carried.items()))), *by, *order)
    w = Window.partitionBy("__part", *by).orderBy(*order)
    begins = lambda now, before: F.coalesce(starts(F.col(now), F.col(before)), F.lit(False)).cast("long")
    local = dealt.withColumn("__before", F.lag("__now").over(w)).withColumn("__new", begins("__now", "__before"))
    key = F.struct(*order)
    ends = local.groupBy("__part", *by).agg(F.sum("__new").alias("__n"), F.min_by("__now", key).alias("__first"), F.max_by("__now", key).alias("__last"))
    e = Window.partitionBy(*by).orderBy("__part")
    ends = ends.withColumn("__before", F.lag("__last").over(e)).withColumn("__new", begins("__first", "__before"))
    earlier = F.coalesce(F.sum(F.col("__n") + F.col("__new")).over(e.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ends.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), (earlier + F.col("__new")).alias("__base"))
    on = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return local.withColumn("__run", run).join(base, on).select(*df.columns, (F.col("__base") + F.col("__run")).alias(name))


def group_by_tolerance(obs: DataFrame, at: str, tol: float, by: list[str], order: list[str]) -> DataFrame:
    """obs with `cluster`: within `by`, a gap of more than tol begins another."""
    return islands(obs, [at, *order], {"at": F.col(at)}, lambda now, before: now["at"] - before["at"] > tol, by, "cluster")


def scan_periods(obs: DataFrame, by: list[str], ttol: float, atol: float, pointing: list[str], order: list[str]) -> DataFrame:
    """Sessions (by, session, t0, t1, n): a jump of any pointing column by more than atol, or more than ttol between an
    end and the next start, begins another."""

    def jump(now: Column, before: Column) -> Column:
        found = now["start"] - before["end"] > ttol
        for c in pointing:
            found = found | (F.abs(now[c] - before[c]) > atol)
        return found

    carried = {"start": F.col("ctime"), "end": F.col("ctime") + F.col("dur"), **{c: F.col(c) for c in pointing}}
    marked = islands(obs, ["ctime", *order], carried, jump, by, "session")
    return marked.groupBy(*by, "session").agg(
        F.min("ctime").alias("t0"), F.max(F.col("ctime") + F.col("dur")).alias("t1"), F.count("*").alias("n")
    )


def split_periods(periods: DataFrame, maxdur: float) -> DataFrame:
    """Periods cut into the fewest equal parts of at most maxdur."""
    n = F.greatest(F.ceil((F.col("t1") - F.col("t0")) / maxdur).cast("int"), F.lit(1))
    step = (F.col("t1") - F.col("t0")) / n
    out = periods.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("p0", F.col("t0") + step * F.col("part")).withColumn("p1", F.col("t0") + step * (F.col("part") + 1))


def period_gaps(periods: DataFrame, by: list[str], ttol: float) -> DataFrame:
    """Gaps (by, g0, g1) of more than ttol that no period covers, between the first start and the last end."""
    w = Window.partitionBy(*by).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max("t1").over(w)
    return periods.withColumn("g0", until).where(F.col("t0") - F.col("g0") > ttol).select(*by, "g0", F.col("t0").alias("g1"))


def group_info(members: DataFrame, key: str) -> DataFrame:
    """Per group: sums and extremes of detectors and samples, the slowest rate, and size in detector-samples."""
    return members.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum("ndet").alias("ndet"),
        F.max("ndet").alias("ndet_max"),
        F.max("nsamp").alias("nsamp"),
        F.min(F.col("nsamp") / F.col("dur")).alias("rate"),
        F.max("dur").alias("dur"),
        F.sum(F.col("ndet") * F.col("nsamp")).alias("size"),
    )


def time_split(groups: DataFrame, key: str, size: Column, nsamp: Column, maxsize: int) -> DataFrame:
    """Groups cut into floor(size / maxsize) + 1 sample ranges [i0, i1) of nearly equal length."""
    n = F.floor(size / maxsize).cast("int") + 1
    out = groups.withColumn("__n", n).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    out = out.withColumn("i0", F.floor(F.col("part") * nsamp / F.col("__n")).cast("long"))
    out = out.withColumn("i1", F.floor((F.col("part") + 1) * nsamp / F.col("__n")).cast("long"))
    name = F.when(F.col("__n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit(":split"), F.col("part").cast("string")))
    return out.withColumn("name", name).drop("__n")


def det_tuples(dets: DataFrame, by: list[str], det: str, least: int = 0) -> DataFrame:
    """Detectors of one pixel and band as sorted tuples of at least `least` members."""
    out = dets.groupBy(*by).agg(F.array_sort(F.collect_set(det)).alias("dets"))
    return out.withColumn("n", F.size("dets")).where(F.col("n") >= least)
