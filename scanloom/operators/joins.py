"""Joins of the metadata: epochs and periods, star joins with quality, two-key lookups and label intersection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.catalog import with_position


def bucketed_range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """points joined with the ranges [lo, hi) that hold column `at`.

    Ranges are copied into every bucket of `width` that they meet and points go to theirs, so the join is an equi join
    with a condition; a plain range condition would compare all points with all ranges. `width` should be of the order
    of a range's length: ranges are copied (hi - lo) / width + 1 times.
    """
    spread = ranges.withColumn(
        "__bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    )
    dealt = points.withColumn("__bucket", F.floor(F.col(at) / width))
    on = (dealt["__bucket"] == spread["__bucket"]) & (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))
    return dealt.join(spread, on, how).drop("__bucket")


def epoch_join(points: DataFrame, epochs: DataFrame, at: str, key: str, width: float, order: str = "epoch_no") -> DataFrame:
    """points (unique by `key`) with the first epoch [lo, hi), by `order`, that holds `at`; else the last epoch."""
    hits = bucketed_range_join(points.select(key, at), epochs, at, "lo", "hi", width)
    columns = [c for c in epochs.columns]
    first = hits.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__epoch"))
    last = F.broadcast(epochs.agg(F.max_by(F.struct(*columns), order).alias("__last")))  # one row
    joined = points.join(first, key, "left").crossJoin(last)
    epoch = F.coalesce("__epoch", "__last")
    return joined.select(*points.columns, *(epoch[c].alias(c) for c in columns))


def good_detector(c: dict[str, str] | None = None) -> Column:
    """The quality rule of detector calibration (fixed limits): bias group, resistance, its fraction, and finite values."""
    name = {k: k for k in ("bg", "r_tes", "r_frac", "s_i", "phase_to_pW", "tau_eff")} | (c or {})
    finite = [
        F.col(name[k]).isNotNull() & ~F.isnan(F.col(name[k]).cast("double")) & (F.abs(name[k]) < float("inf"))
        for k in ("s_i", "phase_to_pW", "tau_eff")
    ]
    fraction = F.col(name["r_frac"]).between(0.05, 0.8)
    return reduce(Column.__and__, finite, (F.col(name["bg"]) >= 0) & (F.col(name["r_tes"]) > 0) & fraction)


def star_join(facts: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """Inner joins of facts with dimensions, each by its key; Catalyst broadcasts those that are small."""
    return reduce(lambda df, d: df.join(d[0], d[1]), dimensions, facts)


def two_key_lookup(facts: DataFrame, first: DataFrame, first_keys: list[str], second: DataFrame, second_keys: list[str], value: str) -> DataFrame:
    """`value` by the first keys, else by the second ones, else null."""
    a = first.select(*first_keys, F.col(value).alias("__a"))
    b = second.select(*second_keys, F.col(value).alias("__b"))
    joined = facts.join(a, first_keys, "left").join(b, second_keys, "left")
    return joined.withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def zip_join(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str]) -> DataFrame:
    """Rows of equal place in the two orders side by side; rows without a partner drop out."""
    return with_position(left, *left_keys).join(with_position(right, *right_keys), "pos")


def intersect_labels(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Rows of left whose label is in right, too; right's labels may repeat."""
    return left.join(right.select(label).distinct(), label, "left_semi")


def keep_last(df: DataFrame, value: str, order: str) -> DataFrame:
    """Of rows of equal value the last by `order`."""
    w = Window.partitionBy(value).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
