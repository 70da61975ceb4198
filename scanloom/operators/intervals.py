"""Interval algebra of cuts: half-open sample ranges [lo, hi) of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.sources.catalog import with_position


def runs(samples: DataFrame, flag: str, det: str = "det", samp: str = "samp") -> DataFrame:
    """Runs of flagged samples; samples are numbered without gaps. Only the flagged ones are windowed."""
    w = Window.partitionBy(det).orderBy(samp)
    flagged = samples.where(flag).withColumn("__run", F.col(samp) - F.row_number().over(w))
    return flagged.groupBy(det, "__run").agg(F.min(samp).cast("int").alias("lo"), (F.max(samp) + 1).cast("int").alias("hi")).drop("__run")


def united(cuts: DataFrame, det: str = "det") -> DataFrame:
    """Union of the ranges of each detector; touching ranges become one, empty ones vanish."""
    w = Window.partitionBy(det).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = cuts.where("hi > lo").withColumn("__new", F.when(reach >= F.col("lo"), 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(det, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__island")


def inverted(cuts: DataFrame, dets: DataFrame, det: str = "det", nsamp: str = "nsamp") -> DataFrame:
    """What united cuts leave of [0, nsamp) of each detector of dets (det, nsamp); detectors without a cut are whole."""
    w = Window.partitionBy(det).orderBy("lo")
    edges = dets.select(det, F.col(nsamp).cast("int").alias("__n")).join(cuts.select(det, "lo", "hi"), det, "left")
    edges = edges.withColumns({"__before": F.coalesce(F.lag("hi").over(w), F.lit(0)), "__after": F.lead("lo").over(w)})
    gap = F.struct(F.col("__before").alias("lo"), F.coalesce("lo", "__n").alias("hi"))
    tail = F.when(F.col("__after").isNull() & F.col("hi").isNotNull(), F.struct(F.col("hi").alias("lo"), F.col("__n").alias("hi")))
    return edges.select(det, F.explode(F.array(gap, tail)).alias("g")).where("g.hi > g.lo").select(det, "g.lo", "g.hi")


def clipped(cuts: DataFrame, start: int, stop: int) -> DataFrame:
    """Ranges within [start, stop), counted from start; what becomes empty drops out."""
    lo = F.greatest(F.col("lo") - start, F.lit(0))
    hi = F.least(F.col("hi") - start, F.lit(stop - start))
    return cuts.withColumns({"lo": lo, "hi": hi}).where("hi > lo")


def resampled(cuts: DataFrame, nsamp: int, n: int) -> DataFrame:
    """Ranges at another sampling: starts are floored, ends rounded up and capped."""
    lo = F.floor(F.col("lo") * F.lit(n) / nsamp).cast("int")
    hi = F.least(F.ceil(F.col("hi") * F.lit(n) / nsamp), F.lit(n)).cast("int")
    return cuts.withColumns({"lo": lo, "hi": hi})


def split_ranges(cuts: DataFrame, longest: int) -> DataFrame:
    """Ranges cut into the fewest nearly equal parts of at most `longest` samples."""
    size = F.col("hi") - F.col("lo")
    n = F.ceil(size / longest).cast("int")
    out = cuts.where("hi > lo").withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), n - 1)))
    lo = F.col("lo") + F.floor(F.col("__k") * size / F.col("__n")).cast("int")
    hi = F.col("lo") + F.floor((F.col("__k") + 1) * size / F.col("__n")).cast("int")
    return out.select(*[c for c in cuts.columns if c not in ("lo", "hi")], lo.alias("lo"), hi.alias("hi"))


def cut_sums(cuts: DataFrame, dets: DataFrame, det: str = "det") -> DataFrame:
    """Cut samples and ranges of each detector of dets, 0 without a cut."""
    sums = cuts.groupBy(det).agg(F.sum(F.col("hi") - F.col("lo")).alias("__cut"), F.count("*").alias("__n"))
    return dets.join(sums, det, "left").select(
        *dets.columns, F.coalesce("__cut", F.lit(0)).alias("ncut"), F.coalesce("__n", F.lit(0)).alias("nrange")
    )


def with_borders(cuts: DataFrame, n: int, det: str = "det", nsamp: Column | None = None) -> DataFrame:
    """Each range with up to n samples left [l0, lo) and right [hi, r1) of it that no neighbour cuts."""
    w = Window.partitionBy(det).orderBy("lo")
    l0 = F.greatest(F.col("lo") - n, F.coalesce(F.lag("hi").over(w), F.lit(0)))
    r1 = F.least(F.col("hi") + n, F.lead("lo").over(w), *([] if nsamp is None else [nsamp]))
    return cuts.withColumns({"l0": l0.cast("int"), "r1": r1.cast("int")})


def in_ranges(samples: DataFrame, ranges: DataFrame, lo: str, hi: str, det: str = "det", samp: str = "samp", width: int = 64) -> DataFrame:
    """Samples joined with the ranges that hold them, by buckets of `width` samples of their detector."""
    spread = ranges.where(F.col(hi) > F.col(lo)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    dealt = samples.withColumn("__b", F.floor(F.col(samp) / width))
    return dealt.join(spread, [det, "__b"]).where((F.col(samp) >= F.col(lo)) & (F.col(samp) < F.col(hi))).drop("__b")


def border_means(samples: DataFrame, cuts: DataFrame, n: int, nsamp: DataFrame) -> DataFrame:
    """cuts with the means of the n samples left [l0, lo) and right [hi, r1) of each range; one that is missing is the
    other's."""
    edges = with_borders(cuts.join(nsamp, "det"), n, nsamp=F.col("nsamp"))
    keys = ["det", "lo", "hi"]
    left = in_ranges(samples.select("det", "samp", "value"), edges.select(*keys, "l0", F.col("lo").alias("l1")), "l0", "l1")
    right = in_ranges(samples.select("det", "samp", "value"), edges.select(*keys, F.col("hi").alias("r0"), "r1"), "r0", "r1")
    a = left.groupBy(*keys).agg(F.avg("value").alias("left"))
    b = right.groupBy(*keys).agg(F.avg("value").alias("right"))
    out = edges.select(*keys, "l0", "r1").join(a, keys, "left").join(b, keys, "left")
    both = {"left": F.coalesce("left", "right", F.lit(0.0)), "right": F.coalesce("right", "left", F.lit(0.0))}
    return out.withColumns(both)


def at_edges(means: DataFrame) -> DataFrame:
    """border_means() as they would be next to the range, at lo - 1 and at hi, if the values followed a line."""
    at_left = (F.col("l0") + F.col("lo") - 1) / 2
    at_right = F.greatest((F.col("hi") + F.col("r1") - 1) / 2, at_left + 1)
    slope = (F.col("right") - F.col("left")) / (at_right - at_left)
    on_line = lambda at: F.col("left") + slope * (at - at_left)
    return means.withColumns({"left": on_line(F.col("lo") - 1), "right": on_line(F.col("hi"))})


def gap_filled(samples: DataFrame, cuts: DataFrame, n: int, nsamp: DataFrame) -> DataFrame:
    """Values inside the ranges replaced by the line through the border means, each taken at the middle of its samples."""
    means = at_edges(border_means(samples, cuts, n, nsamp))
    inside = in_ranges(samples.select("det", "samp"), means, "lo", "hi")
    share = (F.col("samp") - F.col("lo") + 1) / (F.col("hi") - F.col("lo") + 1)
    line = inside.select("det", "samp", (F.col("left") + (F.col("right") - F.col("left")) * share).alias("__line"))
    return samples.join(line, ["det", "samp"], "left").withColumn("value", F.coalesce("__line", "value")).drop("__line")


def dejumped(samples: DataFrame, cuts: DataFrame, n: int, nsamp: DataFrame) -> DataFrame:
    """Level steps over the ranges removed: each sample loses the steps of all ranges that begin before it."""
    steps = border_means(samples, cuts, n, nsamp).select("det", F.col("lo").alias("samp"), (F.col("right") - F.col("left")).alias("step"))
    both = samples.join(steps, ["det", "samp"], "left")
    w = Window.partitionBy("det").orderBy("samp").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.col("value") - F.coalesce(F.sum("step").over(w), F.lit(0.0))).drop("step")


def cleared(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """Values inside the ranges set to 0."""
    inside = in_ranges(samples.select("det", "samp"), cuts, "lo", "hi").select("det", "samp", F.lit(True).alias("__in")).distinct()
    return samples.join(inside, ["det", "samp"], "left").withColumn("value", F.when(F.col("__in"), 0.0).otherwise(F.col("value"))).drop("__in")


def repeated(cuts: DataFrame, ndet: int, times: int, det: str = "det") -> DataFrame:
    """cuts for `times` copies of ndet detectors, those of copy k numbered from k * ndet."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return cuts.withColumn("__k", copies).withColumn(det, F.col(det) + F.col("__k") * ndet).drop("__k")


def inserted(samples: DataFrame, values: DataFrame) -> DataFrame:
    """samples with the values (det, samp, value) put in their places; the inverse of taking them out."""
    new = values.select("det", "samp", F.col("value").alias("__new"))
    return samples.join(new, ["det", "samp"], "left").withColumn("value", F.coalesce("__new", "value")).drop("__new")


def step_scale(samples: DataFrame, det_step: int = 10, step: int = 100) -> DataFrame:
    """One row `rms`: the root of the median square of the differences between every step-th sample, over every det_step-th
    detector (of all of them, by number)."""
    w = Window.partitionBy("det").orderBy("samp")
    dets = samples.select("det").distinct()
    chosen = with_position(dets, "det", name="__at").where(F.col("__at") % det_step == 0).select("det")
    thin = samples.where(F.col("samp") % step == 0).join(chosen, "det")
    diff = thin.withColumn("__d", F.col("value") - F.lag("value").over(w)).where("__d is not null")
    return diff.agg(F.sqrt(F.median(F.col("__d") * F.col("__d"))).alias("rms"))


def extremes_clipped(samples: DataFrame, cuts: DataFrame, n: int, nsamp: DataFrame, tol: float = 100, det_step: int = 10, step: int = 100) -> DataFrame:
    """Values inside the ranges kept within `tol` times step_scale() of the line that gap_filled() would put there; all
    others stay as they are, and so do all if there is no scale."""
    filled = gap_filled(samples, cuts, n, nsamp)
    rms = step_scale(filled, det_step, step)
    line = in_ranges(filled.select("det", "samp", "value"), cuts, "lo", "hi").select("det", "samp", F.col("value").alias("__line"))
    inside = samples.join(line, ["det", "samp"]).crossJoin(F.broadcast(rms))  # one row
    off, most = F.col("value") - F.col("__line"), F.col("rms") * tol
    clipped = F.col("__line") + F.greatest(-most, F.least(most, off))
    return inserted(samples, inside.select("det", "samp", F.when(F.col("rms").isNull(), F.col("value")).otherwise(clipped).alias("value")))
