"""Features of power spectra, as rows (group, bin, power) with bins from 0 without gaps."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.intervals import runs, united


def spikes(spectra: DataFrame, group: str, tol: float = 10, pad: int = 2) -> DataFrame:
    """(group, lo, hi): ranges of bins whose power relative to the smooth one is above `tol`, padded and united."""
    found = runs(spectra.withColumn("__over", F.col("power") > tol), "__over", det=group, samp="bin")
    nbin = spectra.groupBy(group).agg(F.count("*").cast("int").alias("__n"))
    wide = found.join(nbin, group).select(group, F.greatest(F.col("lo") - pad, F.lit(0)).alias("lo"), F.least(F.col("hi") + pad, "__n").alias("hi"))
    return united(wide, det=group)


def floors(spectra: DataFrame, group: str, tol: float = 10, off: float = 2) -> DataFrame:
    """(group, start, level): where the flat part of a spectrum starts and its mean power. It starts at `off` times the
    distance, behind the peak, of the first bin below `tol` times the least power there; no bin left gives a null level."""
    peak = spectra.groupBy(group).agg(F.greatest(F.lit(1), F.min(F.struct(-F.col("power"), "bin"))["bin"]).alias("__peak"))
    behind = spectra.join(peak, group).where("bin >= __peak").select(group, "power", (F.col("bin") - F.col("__peak")).alias("__k"), "__peak")
    least = behind.groupBy(group).agg(F.min("power").alias("__least"))
    below = behind.join(least, group).where(F.col("power") < F.col("__least") * tol).groupBy(group)
    starts = below.agg(F.floor(F.min("__k") * F.lit(off)).alias("__start"))
    level = F.avg(F.when(F.col("__k") >= F.col("__start"), F.col("power"))).alias("level")
    return behind.join(starts, group).groupBy(group).agg((F.first("__start") + F.first("__peak")).cast("long").alias("start"), level)


def log_edges(nbin: Column, size: int = 1, least: int = 10, step: float = 2, off: float = 2) -> Column:
    """Edges of bins that get narrower by `step` (above 1) toward 0, from nbin / off down to `least`, in units of `size`:
    as many as it takes, which grows with the logarithm of nbin."""
    edge = lambda k: nbin / off * size / F.pow(F.lit(float(step)), k)
    last = F.ceil(F.log(F.greatest(nbin / off * size / least, F.lit(1.0))) / math.log(step)).cast("int")
    kept = F.filter(F.sequence(F.lit(0), last), lambda k: edge(k) >= least)
    return F.sort_array(F.concat(F.transform(kept, lambda k: F.floor(edge(k))), F.array(F.lit(0).cast("long"))))


def exponential_edges(nbin: Column, count: int = 100, least: int = 10) -> Column:
    """Edges of bins over nbin entries that grow by a constant factor, about `count` of them, each of at least `least`
    entries; what is left at the end belongs to the last one. Fewer than `least` entries are one bin."""
    share = F.log(nbin + 1.0) / count
    raw = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda k: F.floor(F.exp(k * share) - 1 + 1e-9))
    first = F.array(F.lit(0).cast("long"))
    grown = F.aggregate(raw, first, lambda a, e: F.when(e - F.element_at(a, -1) >= least, F.array_append(a, e)).otherwise(a))
    inner = F.filter(F.slice(grown, F.lit(2), F.greatest(F.size(grown) - 1, F.lit(0))), lambda e: nbin - e >= least)
    return F.concat(first, inner, F.array(nbin.cast("long")))


def binned_power(spectra: DataFrame, by: str = "det", count: int = 100, least: int = 10) -> DataFrame:
    """(by, n, lo, hi, power): mean power per sample of streams.spectrum() in exponential_edges()."""
    edges = exponential_edges(F.floor(F.col("n") / 2) + 1, count, least)
    bins = spectra.select("n").distinct().withColumn("e", edges)
    pairs = F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda k: F.struct(F.get("e", k).alias("lo"), F.get("e", k + 1).alias("hi")))
    bins = bins.select("n", F.explode(pairs).alias("p")).select("n", "p.*").withColumn("bin", F.explode(F.sequence("lo", F.col("hi") - 1)))
    power = F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")
    return spectra.join(bins, ["n", "bin"]).groupBy(by, "n", "lo", "hi").agg(power.alias("power"))


def uncorrelated_noise(power: DataFrame, by: str = "det") -> DataFrame:
    """(by, ivar): the inverse variance per sample of noise that is independent between streams, from binned_power(): the
    inverse powers weighted by the widths of their bins; bins without power count as 0."""
    width, inverse = F.col("hi") - F.col("lo"), F.when(F.col("power") > 0, 1 / F.col("power")).otherwise(0.0)
    return power.groupBy(by).agg((F.sum(inverse * width) / F.sum(width)).alias("ivar"))


def whitened(spectra: DataFrame, power: DataFrame, by: str = "det") -> DataFrame:
    """Spectra divided by the power of their bins: the inverse of uncorrelated noise applied."""
    each = power.select(by, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("bin"), F.when(F.col("power") > 0, 1 / F.col("power")).otherwise(0.0).alias("__w"))
    return spectra.join(each, [by, "bin"]).withColumns({"re": F.col("re") * F.col("__w"), "im": F.col("im") * F.col("__w")}).drop("__w")


def owned_stretches(ranges: DataFrame, group: str) -> DataFrame:
    """(group, lo, hi, list, number): which of overlapping ranges (group, list, number, lo, hi) owns each stretch: of those
    that hold it the one that begins last, then that of the higher list and number; it gives the stretch back where it ends.

    One sweep over the ends of a group's ranges with a heap, so the work grows with n log n; a group is one observation,
    whose ranges are at most as many as its frequencies. Empty ranges own nothing, stretches that none holds are left out."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((a, b, k, n) for a, b, k, n in zip(pdf["lo"], pdf["hi"], pdf["list"], pdf["number"]) if a < b)
        edges = sorted({x for r in rows for x in r[:2]})
        heap, out, at = [], [], 0
        for a, b in zip(edges, edges[1:]):
            while at < len(rows) and rows[at][0] <= a:
                lo, hi, k, n = rows[at]
                heapq.heappush(heap, (-lo, -k, -n, hi))
                at += 1
            while heap and heap[0][3] <= a:
                heapq.heappop(heap)
            if heap:
                own = (-heap[0][1], -heap[0][2])
                if out and out[-1][1] == a and out[-1][2:] == own:
                    out[-1] = (out[-1][0], b, *own)
                else:
                    out.append((a, b, *own))
        found = pd.DataFrame(out, columns=["lo", "hi", "list", "number"])
        found.insert(0, group, pdf[group].iloc[0])
        return found

    rows = ranges.select(group, "lo", "hi", "list", "number")
    return rows.groupBy(group).applyInPandas(sweep, rows.schema)
