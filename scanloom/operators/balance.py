"""Distribution of work and balanced data splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.catalog import ranged, with_position


def round_robin(groups: DataFrame, n: int, *order: str) -> DataFrame:
    placed = with_position(groups, *order)
    return placed.withColumn("owner", (F.col("pos") % n).cast("int")).drop("pos")


def equal_buckets(groups: DataFrame, n: int, *order: str) -> DataFrame:
    """n buckets of equal numbers of groups in the order given."""
    total = F.broadcast(groups.agg(F.count("*").alias("__all")))  # one row
    placed = with_position(groups, *order).crossJoin(total)
    return placed.withColumn("owner", F.floor(F.col("pos") * n / F.col("__all")).cast("int")).drop("pos", "__all")


def weight_buckets(groups: DataFrame, n: int, weight: str, *order: str) -> DataFrame:
    """n buckets of equal weight in the order given: a group goes where the weight before it falls.

    The running sum is over ranges: each range's total is added before its own running sum.
    """
    dealt = ranged(groups, *order)
    sums = dealt.groupBy("__part").agg(F.sum(weight).alias("__w"))
    edge = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("__part", F.coalesce(F.sum("__w").over(edge), F.lit(0)).alias("__before"), F.sum("__w").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(sums), "__part")
    before = F.col("__before") + F.coalesce(F.sum(weight).over(own), F.lit(0))
    owner = F.least(F.floor(before * n / F.col("__all")), F.lit(n - 1)).cast("int")
    return out.withColumn("owner", owner).drop("__part", "__before", "__all")


def hit_maps(obs: DataFrame, by: list[str], y: tuple[Column, Column], x: tuple[Column, Column], nx: int, weight: Column) -> DataFrame:
    """Sums of `weight` over the pixel boxes [y0, y1) x [x0, x1) of the observations; x wraps at nx."""
    rows = obs.select(*by, weight.alias("__w"), x[0].alias("__x0"), x[1].alias("__x1"), F.explode(F.sequence(y[0], y[1] - 1)).alias("y"))
    cells = rows.select(*by, "__w", "y", F.explode(F.sequence("__x0", F.col("__x1") - 1)).alias("x"))
    cells = cells.withColumn("x", F.pmod("x", F.lit(nx)))
    return cells.groupBy(*by, "y", "x").agg(F.sum("__w").alias("hits"))


def smart_split(chunks: Sequence[dict[tuple, float]], n: int, rounds: int = 3, floor: float = 0.1) -> list[int]:
    """The split (0 to n - 1) of each time chunk's hits, chosen one after the other and then again `rounds` times.

    A chunk goes where its hits are missed most: the score of a split is the sum over the chunk's pixels of its hits
    times log(target / hits so far), target being the pixel's share of all hits. The choice depends on the order, so
    it runs on the driver; chunks must be few (days or weeks), with their hits summed by Spark before.
    """
    target: dict[tuple, float] = {}
    for c in chunks:
        for p, h in c.items():
            target[p] = target.get(p, 0.0) + h / n
    least = floor * sum(target.values()) / max(1, len(target))
    have: list[dict[tuple, float]] = [{} for _ in range(n)]
    owner = [-1] * len(chunks)

    def put(k: int, s: int, sign: float) -> None:
        for p, h in chunks[k].items():
            have[s][p] = have[s].get(p, 0.0) + sign * h

    order = sorted(range(len(chunks)), key=lambda k: (-sum(chunks[k].values()), k))
    for _ in range(rounds + 1):
        for k in order:
            if owner[k] >= 0:
                put(k, owner[k], -1.0)
            score = [
                sum(h * math.log(max(target[p], least) / max(have[s].get(p, 0.0), least)) for p, h in chunks[k].items())
                for s in range(n)
            ]
            owner[k] = max(range(n), key=lambda s: (score[s], -s))
            put(k, owner[k], 1.0)
    return owner


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _to_each(refs: list[list[float]]) -> Column:
    """Distances of the column state to each reference."""
    return F.array(*(_distance(F.col("state"), F.array(*map(F.lit, r))) for r in refs))


def far_references(items: DataFrame, n: int, key: str) -> list[list[float]]:
    """n states, one after the other the farthest from those before, the first of the least sum; sorted by their means.

    Each is found by one aggregation over the items (key, state array), of which the driver gets the state that wins; of
    equal ones that of the smallest key."""
    total = F.aggregate("state", F.lit(0.0), lambda s, x: s + x)
    refs = [list(items.agg(F.min_by("state", F.struct(total.alias("v"), F.col(key).alias("k")))).first()[0])]
    for _ in range(1, n):
        nearest = F.array_min(_to_each(refs))
        refs.append(list(items.agg(F.min_by("state", F.struct((-nearest).alias("v"), F.col(key).alias("k")))).first()[0]))
    return sorted(refs, key=lambda r: sum(r) / len(r))


def scaled_groups(items: DataFrame, refs: list[list[float]], weight: str, rounds: int = 10) -> DataFrame:
    """items with `owner`: the reference of the least scaled distance. In each round groups that are too heavy get larger
    distances, by their share of the even weight to the power of 1 / round; the owners are those of the last round.

    A round is one aggregation, of which the driver gets a weight for each group. A group without weight counts as a
    thousandth of an even one, so that it can win items again."""
    scales, owner = [1.0] * len(refs), F.lit(0)
    even = (items.agg(F.sum(weight)).first()[0] or 0) / len(refs)
    for k in range(rounds):
        scaled = F.zip_with(_to_each(refs), F.array(*map(F.lit, scales)), lambda d, s: d * s)
        owner = F.transform(F.array(scaled), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)[0]
        if k == rounds - 1:
            break
        got = {r["owner"]: r["w"] for r in items.groupBy(owner.alias("owner")).agg(F.sum(weight).alias("w")).collect()}  # a row for each group
        scales = [s * max((got.get(i) or 0) / even, 1e-3) ** (1 / (k + 1)) for i, s in enumerate(scales)] if even else scales
    return items.withColumn("owner", owner)


def distribute_compact(items: DataFrame, n: int, key: str, weight: str, passes: int = 2, rounds: int = 10) -> DataFrame:
    """items (key, weight, state array) dealt out to n owners of about equal weight that hold near states together.

    The first pass starts from far_references(), each other one from the members nearest to the groups' centres. The items
    stay where they are: passes and rounds are aggregations. As many items as owners, or fewer, get one each."""
    if items.count() <= n:
        return with_position(items, key).withColumn("owner", F.col("pos").cast("int")).drop("pos")
    refs = far_references(items, n, key)
    out = scaled_groups(items, refs, weight, rounds)
    for _ in range(1, passes):
        at = out.select("owner", F.posexplode("state").alias("p", "x")).groupBy("owner", "p").agg(F.avg("x").alias("x"))
        centres = at.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda v: v["x"]).alias("centre"))
        near = out.join(centres, "owner").groupBy("owner").agg(F.min_by("state", F.struct(_distance(F.col("state"), F.col("centre")).alias("d"), F.col(key).alias("k"))).alias("ref"))
        refs = [list(r["ref"]) for r in near.orderBy("owner").collect()]  # a row for each group
        out = scaled_groups(items, refs, weight, rounds)
    return out


def compactness(owned: DataFrame) -> DataFrame:
    """(owner, p, spread): the standard deviation of each owner's states around their mean, by coordinate."""
    return owned.select("owner", F.posexplode("state").alias("p", "x")).groupBy("owner", "p").agg(F.stddev_pop("x").alias("spread"))
