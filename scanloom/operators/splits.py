"""Data splits: labels of observations by parts of their ids, by time and by scan direction, and their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.selection import signed_azimuth
from scanloom.sources.catalog import with_position

#: Places (from 0) and lengths of the parts of an id such as obs_1759107020_lati6_111:ws0:f090 (fixed values).
ID_PARTS = {"pre": (0, 3), "tid": (4, 10), "tube": (18, 2), "wslot": (25, 3), "band": (29, 4)}


def id_part(obs_id: Column, name: str) -> Column:
    """A part of an id; null where the id ends before it or is not of the known form."""
    at, n = ID_PARTS[name]
    return F.when(obs_id.contains("_lat") & (F.length(obs_id) > at), F.substring(obs_id, at + 1, n))


def by_parts(obs_id: Column, *names: str) -> Column:
    return F.array_join(F.array(*(id_part(obs_id, n) for n in names)), "_")


def by_days(ctime: Column, days: float) -> Column:
    return F.floor(ctime / F.lit(days * 86400.0)).cast("long")


def by_direction(az: Column) -> Column:
    """1 for azimuths west of the meridian, else 0."""
    return (signed_azimuth(az) < 0).cast("int")


def numbered(obs: DataFrame, label: Column) -> DataFrame:
    """obs with `label` and its number `split` among the labels in order; the labels alone are sorted and numbered."""
    marked = obs.withColumn("label", label)
    return marked.join(with_position(marked.select("label").distinct(), "label", name="split"), "label")
