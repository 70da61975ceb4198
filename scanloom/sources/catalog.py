"""Catalog tables: readers, the driver's tables in the roles of the catalog, id lists and row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.sources.shared import written

#: Bands of each tube flavour (fixed values); DARK stands for detectors without a band.
FLAVOR_BANDS = {"lf": ("f030", "f040", "DARK"), "mf": ("f090", "f150", "DARK"), "uhf": ("f220", "f280", "DARK")}
#: Detectors of a sub-observation by flavour, for OPTC and DARK (fixed values).
DET_COUNTS = {"lf": (118, 4), "mf": (864, 18), "uhf": (864, 18)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Unix seconds as double, microseconds included; the stored times are without a zone and are read as UTC."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()).cast("timestamp")) / F.lit(1e6)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as observations: key, id, time, flavour, wafer slots (comma list), samples, pointing centre and throw (deg)."""
    key = F.col("o_orderkey")
    flavor = F.when(F.col("o_orderpriority").startswith("1"), "lf").when(
        F.col("o_orderpriority").startswith("2") | F.col("o_orderpriority").startswith("3"), "mf"
    )
    slots = F.when(key % 3 == 0, "ws0").when(key % 3 == 1, "ws0,ws1").otherwise("ws0,ws1,ws2")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(
        key.alias("obs_key"),
        F.concat(F.lit("obs_"), key.cast("string")).alias("obs_id"),
        (days * 86400 + key % 24 * 3600 + key % 60 * 60).cast("double").alias("ctime"),
        F.coalesce(flavor, F.lit("uhf")).alias("flavor"),
        slots.alias("slots"),
        (F.lit(600) + key % 7 * 300).cast("double").alias("dur"),
        (F.lit(1000) + key % 11 * 100).cast("long").alias("nsamp"),
        (F.col("o_custkey") % 360).cast("double").alias("baz"),
        (F.lit(30) + F.col("o_custkey") % 6 * 5).cast("double").alias("bel"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_key, tag): the return flags and line statuses of an order's lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("obs_key"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("tag"))
        .distinct()
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: det, samp (place within the detector by time), t (s), value, cut (error events)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("det"),
        (F.row_number().over(w) - 1).cast("long").alias("samp"),
        "ts",
        F.col("value"),
        (F.col("event_type") == "error").alias("cut"),
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos): the first word of each line of a text file, the first of repeated ids, in the order of the file."""
    lines = spark.read.text(path).select(
        F.split(F.trim("value"), r"\s+")[0].alias("id"), F.monotonically_increasing_id().alias("line")
    )
    return lines.where("id <> '' and not startswith(id, '#')").groupBy("id").agg(F.min("line").alias("pos"))


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by ranges of `keys`, with the number of its range in __part. The ranges come from a sample, which
    differs from one evaluation to the next; so the rows are written once and read by everything that follows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranged")


def with_position(df: DataFrame, *keys: str, name: str = "pos") -> DataFrame:
    """df with each row's place, from 0, in the order of `keys` (which must be unique together).

    The rows are dealt out by range and placed within ranges; only the ranges' counts meet, so no task sorts the
    whole table as a window without partitions would.
    """
    dealt = ranged(df, *keys)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    edge = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.select("__part", F.coalesce(F.sum("__n").over(edge), F.lit(0)).alias("__before"))
    local = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1)
    placed = local.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at"))
    return placed.drop("__part", "__at", "__before")


def positional_slice(df: DataFrame, keys: list[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start:stop:step in the order of `keys`, with Python's rules for negative bounds."""
    placed = with_position(df, *keys)
    if (start or 0) < 0 or (stop or 0) < 0:
        placed = placed.crossJoin(F.broadcast(df.agg(F.count("*").alias("__all"))))
    else:
        placed = placed.withColumn("__all", F.lit(None).cast("long"))
    lo = F.lit(start or 0) if (start or 0) >= 0 else F.greatest(F.col("__all") + start, F.lit(0))
    out = placed.where(F.col("pos") >= lo)
    if stop is not None:
        out = out.where(F.col("pos") < (F.lit(stop) if stop >= 0 else F.col("__all") + stop))
    return out.where((F.col("pos") - lo) % step == 0).drop("__all")


def merge_sources(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(index, files) of several metadata sources as one: file ids are moved past those of the sources before."""
    maps, files = [], []
    offset = None
    for index, names in parts:
        shift = F.lit(0).cast("long") if offset is None else F.coalesce(F.col("__off"), F.lit(0).cast("long"))
        one = names.agg(F.lit(0).cast("long").alias("__off")) if offset is None else offset
        maps.append(index.crossJoin(F.broadcast(one)).withColumn("file_id", F.col("file_id") + shift).drop("__off"))
        files.append(names.crossJoin(F.broadcast(one)).withColumn("file_id", F.col("file_id") + shift).drop("__off"))
        top = files[-1].agg((F.max("file_id") + 1).alias("__top"))
        offset = one.crossJoin(top).select(F.greatest("__off", F.coalesce("__top", "__off")).alias("__off"))
    index, names = maps[0], files[0]
    for m, f in zip(maps[1:], files[1:]):
        index, names = index.unionByName(m, allowMissingColumns=True), names.unionByName(f, allowMissingColumns=True)
    return index, names
