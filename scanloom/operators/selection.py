"""Selections of observations as columns. Conditions are combined with &, | and ~ like any others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.sources.catalog import DET_COUNTS, FLAVOR_BANDS

#: Tags that say nothing about an observation: ids, scan codes, two numbers, wafer slots and directions (fixed values).
DULL_TAGS = r"^uid-|_SCAN_|^[0-9]+-[0-9]+$|^([A-Za-z0-9_][0-9]_)?ws[0-9]$|^[0-9a-f]+(-[0-9a-f]+){4}$|^(rising|setting)$"


def hour_of_day(ctime: Column) -> Column:
    return F.pmod(ctime / 3600, F.lit(24.0))


def day(ctime: Column) -> Column:
    """From 11 to 23 hours UTC, both included."""
    return hour_of_day(ctime).between(11, 23)


def night(ctime: Column) -> Column:
    return ~day(ctime)


def year(ctime: Column) -> Column:
    """Decimal year; 1735689600 is the beginning of 2025, 31556926.08 the length of a year (fixed values)."""
    return (ctime - F.lit(1735689600.0)) / F.lit(31556926.08) + 2025


def signed_azimuth(az: Column) -> Column:
    return F.pmod(az + 180, F.lit(360.0)) - 180


def rising(az: Column) -> Column:
    return signed_azimuth(az) > 10


def setting(az: Column) -> Column:
    return signed_azimuth(az) < -10


def expand_sub_observations(obs: DataFrame) -> DataFrame:
    """A row for each wafer slot, band of the flavour and detector type of each observation; its id is obs:slot:band,
    with :DARK behind dark ones. Empty slots are dropped; an unknown flavour has the one band f???."""
    bands = F.array(F.lit("f???"))
    for flavor, names in FLAVOR_BANDS.items():
        bands = F.when(F.col("flavor") == flavor, F.array(*map(F.lit, names))).otherwise(bands)
    slots = F.filter(F.split("slots", ","), lambda s: F.length(F.trim(s)) > 0)
    out = obs.withColumn("slot", F.explode(slots)).withColumn("band", F.explode(bands))
    out = out.withColumn("det_type", F.explode(F.array(F.lit("OPTC"), F.lit("DARK"))))
    tail = F.when(F.col("det_type") == "OPTC", "").otherwise(":DARK")
    return out.withColumn("subobs_id", F.concat(F.concat_ws(":", "obs_id", "slot", "band"), tail))


def det_count(flavor: Column, det_type: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (optc, dark) in DET_COUNTS.items():
        out = F.when(flavor == name, F.when(det_type == "OPTC", optc).otherwise(dark)).otherwise(out)
    return out


def with_tag(obs: DataFrame, tags: DataFrame, tag: str, key: str = "obs_key") -> DataFrame:
    return obs.join(tags.where(F.col("tag") == tag).select(key), key, "left_semi")


def without_tag(obs: DataFrame, tags: DataFrame, tag: str, key: str = "obs_key") -> DataFrame:
    return obs.join(tags.where(F.col("tag") == tag).select(key), key, "left_anti")


def with_tag_list(obs: DataFrame, tags: DataFrame, key: str = "obs_key", dull: str | None = None) -> DataFrame:
    """obs with its tags as a sorted comma list, null without a tag; tags that match `dull` are left out."""
    kept = tags if dull is None else tags.where(~F.col("tag").rlike(dull))
    lists = kept.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return obs.join(lists, key, "left")


def good_only(obs: DataFrame, pre_map: DataFrame, key: str = "obs_key") -> DataFrame:
    """Observations that have preprocessing results."""
    return obs.join(pre_map.select(key), key, "left_semi")


def in_listed_order(obs: DataFrame, ids: DataFrame, key: str = "obs_id") -> DataFrame:
    """Listed observations with the place in the list, `pos`; unlisted ones and unknown ids drop out."""
    return obs.join(ids.withColumnRenamed("id", key), key)
