"""Maps with several kinds of unknowns: sky, offsets, cut samples, elevation response, samples of their own.

A signal says what each sample sees of it: up to a few taps, each the key of an unknown and the weights of its amplitudes
(three for T, Q, U, order + 1 for a polynomial). All signals stand in one vector (signal, key, value array<double>), which
is the zipped vector of the map equation (P' N^-1 P + Q) x = P' N^-1 d; Q comes from the signals' priors.

With white noise the equation's matrix is summed once, in blocks between the unknowns that samples see together, and the
steps of the conjugate gradients read those blocks and no samples. The blocks lie in buckets of the unknown that they are
multiplied with, as the vector does, so a step shuffles products that are summed already and no blocks; unknowns of
signals that have FEW at most are broadcast. With correlated noise each step projects the vector on
the samples, weighs them and gathers them again. Vectors are written to the shared folder at each step, those of the step
before are deleted, and only scalars come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.calibration import legendre
from scanloom.operators.intervals import in_ranges, split_ranges
from scanloom.sources.shared import bucketed, forget, written

#: From an amplitude's white weight and what the signal says of its unknown to the weight of its being zero.
Prior = Callable[[Column, Column], Column]
#: From samples, with their weights in `w`, and the name of a column to that column weighed by the inverse noise, as `nv`.
Noise = Callable[[DataFrame, str], DataFrame]
#: Unknowns of a signal that are broadcast in the steps.
FEW = 20_000


@dataclass(frozen=True)
class Tap:
    """The unknown that a sample sees (a long; null: none) and the weights of its amplitudes."""

    key: Column
    basis: tuple[Column, ...]


@dataclass(frozen=True)
class Signal:
    """`about` is a column that samples of one unknown share; the prior is given its largest value."""

    name: str
    taps: tuple[Tap, ...]
    prior: Prior | None = None
    about: Column | None = None

    @property
    def width(self) -> int:
        return len(self.taps[0].basis)

    def only(self, condition: Column) -> Signal:
        """The signal where the condition holds; elsewhere, and where it is null, samples do not see it."""
        return replace(self, taps=tuple(Tap(F.when(condition, t.key), t.basis) for t in self.taps))


@dataclass
class Solution:
    """The unknowns, and the errors relative to the first after each step."""

    vector: DataFrame
    errors: list[float]


def constant(name: str, key: Column, prior: Prior | None = None, about: Column | None = None) -> Signal:
    """One amplitude for each key: pixels, offsets of blocks, or samples of their own (cut, near a source, or loud)."""
    return Signal(name, (Tap(key, (F.lit(1.0),)),), prior, about)


def polarised_sky(pixel: Column, psi: Column, prior: Prior | None = None, about: Column | None = None) -> Signal:
    """T, Q and U of the nearest pixel."""
    return Signal("sky", (Tap(pixel, (F.lit(1.0), F.cos(2 * psi), F.sin(2 * psi))),), prior, about)


def bilinear_sky(y: Column, x: Column, nx: int) -> Signal:
    """The four pixels around (y, x), y at least 0, x periodic with nx pixels; keys are py * nx + px."""
    fy, fx = F.floor(y), F.floor(x)
    taps = []
    for dy in (0, 1):
        for dx in (0, 1):
            w = (y - fy if dy else 1 - (y - fy)) * (x - fx if dx else 1 - (x - fx))
            taps.append(Tap(F.when(w > 0, (fy + dy) * nx + F.pmod(fx + dx, F.lit(nx))), (w,)))
    return Signal("sky", tuple(taps))


def with_cut_blocks(samples: DataFrame, cuts: DataFrame, size: int = 400) -> DataFrame:
    """samples (det, samp, ...) with the block (lo, hi) of a cut that they are in, else nulls. Ranges of cuts, which do not
    overlap, are split into nearly equal blocks of at most `size` samples."""
    inside = in_ranges(samples.select("det", "samp"), split_ranges(cuts, size), "lo", "hi")
    return samples.drop("lo", "hi").join(inside.select("det", "samp", "lo", "hi"), ["det", "samp"], "left")


def cut_polynomial(key: Column, order: int = 3, prior: Prior | None = None) -> Signal:
    """Legendre polynomials over the block (lo, hi) of samples of with_cut_blocks; a block of n samples has the first n."""
    lo, hi = F.col("lo"), F.col("hi")
    x = (2 * F.col("samp") + 1 - lo - hi) / (hi - lo)
    basis = tuple(F.when(hi - lo > k, p).otherwise(0.0) for k, p in enumerate(legendre(x, order)))
    return Signal("cut", (Tap(F.when(lo.isNotNull(), key), basis),), prior)


def with_elevation_basis(samples: DataFrame, by: Sequence[str], el: Column, order: int = 1) -> DataFrame:
    """samples with el1 ... el_order: the elevation, and its products with the one before, each scaled to -1 ... 1 in its
    observation (`by`); 0 where it is constant. There is no order 0, which is the offset."""
    out = samples
    for k in range(1, order + 1):
        raw = el if k == 1 else F.col(f"el{k - 1}") * F.col("el1")
        out = out.withColumn("__raw", raw.cast("double"))
        ends = out.groupBy(*by).agg(F.min("__raw").alias("__a"), F.max("__raw").alias("__b"))
        a, b = F.col("__a"), F.col("__b")
        out = out.join(ends, list(by)).withColumn(f"el{k}", F.when(b > a, (2 * F.col("__raw") - a - b) / F.nullif(b - a, F.lit(0.0))).otherwise(0.0))
        out = out.drop("__raw", "__a", "__b")
    return out


def elevation(key: Column, order: int = 1, prior: Prior | None = None) -> Signal:
    """The response of each key, one detector in one observation, to the basis of with_elevation_basis."""
    return Signal("elevation", (Tap(key, tuple(F.col(f"el{k}") for k in range(1, order + 1))),), prior)


def relative_prior(strength: float) -> Prior:
    """Zero, with `strength` times the weight of the amplitude's samples."""
    return lambda d, about: strength * d


def disk_prior(strength: float = 1e5) -> Prior:
    """Zero outside a disk: `about` is 1 for pixels beyond its radius and 0 inside."""
    return lambda d, about: strength * d * about


def edge_prior(strength: float = 0.1, edge: float = 100.0) -> Prior:
    """Zero, by strength inside a mask and `edge` times that at its edge: `about` goes from 0 there to 1 inside."""
    return lambda d, about: strength * F.pow(F.lit(edge), 1 - about) * d


def variance_prior(strength: float = 10.0) -> Prior:
    """Zero, by strength over the variance in `about`."""
    return lambda d, about: F.coalesce(strength / F.nullif(about, F.lit(0.0)), F.lit(0.0))


def white(samples: DataFrame, name: str) -> DataFrame:
    return samples.withColumn("nv", F.col("w") * F.col(name))


def common_mode_noise(at: Sequence[str], mode: Column, power: Column) -> Noise:
    """White noise and, among the samples of one time of one observation (`at`), a common mode: N = 1 / w + mode power
    mode', inverted by the Woodbury formula. A time has as many rows as the observation has detectors."""

    def weigh(samples: DataFrame, name: str) -> DataFrame:
        time = Window.partitionBy(*at)
        seen = F.sum(mode * F.col("w") * F.col(name)).over(time)
        own = F.sum(mode * mode * F.col("w")).over(time)
        return samples.withColumn("nv", F.col("w") * (F.col(name) - mode * power * seen / (1 + power * own)))

    return weigh


def prepared(samples: DataFrame, signals: Sequence[Signal]) -> DataFrame:
    """samples with w and v, the weight `ivar` and the value, or 0 for both where one is null, NaN or the weight is not
    positive, and the key and the basis of every tap."""
    good = (F.col("ivar") > 0) & ~F.isnan("ivar") & F.col("value").isNotNull() & ~F.isnan("value")
    cols = {"w": F.when(good, F.col("ivar")).otherwise(0.0), "v": F.when(good, F.col("value")).otherwise(0.0)}
    for i, (_, s, t) in enumerate(_taps(signals)):
        cols[f"__k{i}"] = t.key.cast("long")
        cols[f"__b{i}"] = F.array(*(b.cast("double") for b in t.basis))
        cols[f"__a{i}"] = (F.lit(0.0) if s.about is None else s.about).cast("double")
    return samples.select("*", *(c.alias(n) for n, c in cols.items()))


def _taps(signals: Sequence[Signal]) -> list[tuple[int, Signal, Tap]]:
    return [(n, s, t) for n, s in enumerate(signals) for t in s.taps]


def _seen(data: DataFrame, signals: Sequence[Signal], *more: Column) -> DataFrame:
    """A row for each tap with a key of each sample: u (signal, key, basis, about), and more columns."""
    each = F.array(
        *(
            F.struct(F.lit(n).alias("signal"), F.col(f"__k{i}").alias("key"), F.col(f"__b{i}").alias("basis"), F.col(f"__a{i}").alias("about"))
            for i, (n, _, _) in enumerate(_taps(signals))
        )
    )
    return data.select(F.explode(F.filter(each, lambda t: t["key"].isNotNull())).alias("u"), *more)


def _summed(rows: DataFrame, keys: list[str], arrays: Column, width: int) -> DataFrame:
    """Sums of arrays by element, of at most `width` elements."""
    sums = [F.sum(F.get(arrays, F.lit(j))).alias(f"__s{j}") for j in range(width)]
    got = rows.groupBy(*keys).agg(*sums)
    return got.select(*keys, F.filter(F.array(*(F.col(f"__s{j}") for j in range(width))), lambda v: v.isNotNull()).alias("value"))


def gathered(data: DataFrame, signals: Sequence[Signal], name: str) -> DataFrame:
    """P': a column of prepared samples summed into the unknowns (signal, key, value)."""
    rows = _seen(data, signals, F.col(name).alias("nv"))
    rows = rows.select("u.signal", "u.key", F.transform("u.basis", lambda b: b * F.col("nv")).alias("x"))
    return _summed(rows, ["signal", "key"], F.col("x"), max(s.width for s in signals))


def projected(data: DataFrame, signals: Sequence[Signal], x: DataFrame) -> DataFrame:
    """P: prepared samples with what the unknowns add up to, as `model`. The vector meets the samples tap by tap;
    Catalyst broadcasts the unknowns of a signal if they are small, and shuffles by key if not."""
    model = F.lit(0.0)
    for i, (n, s, _) in enumerate(_taps(signals)):
        own = x.where(F.col("signal") == n).select(F.col("key").alias(f"__k{i}"), F.col("value").alias(f"__x{i}"))
        data = data.join(own, f"__k{i}", "left")
        for j in range(s.width):
            model = model + F.coalesce(F.get(f"__b{i}", F.lit(j)) * F.get(f"__x{i}", F.lit(j)), F.lit(0.0))
    return data.withColumn("model", model).drop(*(f"__x{i}" for i in range(len(_taps(signals)))))


def _diagonal(data: DataFrame, signals: Sequence[Signal]) -> DataFrame:
    """(signal, key, d, q): the white weight of each amplitude and its prior's."""
    rows = _seen(data, signals, "w").select("u.signal", "u.key", "u.about", F.transform("u.basis", lambda b: b * b * F.col("w")).alias("x"))
    width = max(s.width for s in signals)
    sums = [F.sum(F.get("x", F.lit(j))).alias(f"__s{j}") for j in range(width)]
    got = rows.groupBy("signal", "key").agg(F.max("about").alias("about"), *sums)
    d = F.filter(F.array(*(F.col(f"__s{j}") for j in range(width))), lambda v: v.isNotNull())
    got = got.select("signal", "key", "about", d.alias("d"))
    q = F.transform("d", lambda _: F.lit(0.0))
    penalty = lambda prior: F.transform("d", lambda v: prior(v, F.col("about")).cast("double"))
    for n, s in enumerate(signals):
        if s.prior is not None:
            q = F.when(F.col("signal") == n, penalty(s.prior)).otherwise(q)
    return got.select("signal", "key", "d", q.alias("q"))


def matrix(data: DataFrame, signals: Sequence[Signal]) -> DataFrame:
    """P' W P of white noise (signal, key, signal2, key2, value): blocks between unknowns that samples see together, by
    rows. It has at most the square of the taps of a sample for each sample, and far fewer where samples repeat."""
    rows = _seen(data, signals, "w", *(F.col(f"__{c}{i}") for i in range(len(_taps(signals))) for c in "kba"))
    pairs = _seen(rows, signals, F.col("u").alias("a"), "w").select(F.col("a"), F.col("u").alias("b"), "w")
    block = F.flatten(F.transform("a.basis", lambda p: F.transform("b.basis", lambda r: p * r * F.col("w"))))
    pairs = pairs.select("a.signal", "a.key", F.col("b.signal").alias("signal2"), F.col("b.key").alias("key2"), block.alias("x"))
    return _summed(pairs, ["signal", "key", "signal2", "key2"], F.col("x"), max(s.width for s in signals) ** 2)


def _products(blocks: DataFrame, x: DataFrame) -> DataFrame:
    """(signal, key, x): blocks times what they stand on of a vector (signal2, key2, p)."""
    n = F.size("p")
    row = lambda i: _dot(F.slice("value", i * n + 1, n), F.col("p"))
    got = F.transform(F.sequence(F.lit(0), (F.size("value") / n).cast("int") - 1), row)
    return blocks.join(x, ["signal2", "key2"]).select("signal", "key", got.alias("x"))


def _times(near: DataFrame, far: DataFrame, x: DataFrame, few: list[int], width: int) -> DataFrame:
    """The matrix times a vector: `near` are the blocks on unknowns of the signals `few`, in buckets of their rows, and `far`
    all others, in buckets of what they stand on."""
    other = x.select(F.col("signal").alias("signal2"), F.col("key").alias("key2"), F.col("value").alias("p"))
    held = F.col("signal2").isin(few)
    keys, arrays = ["signal", "key"], F.col("x")
    one = _summed(_products(near, F.broadcast(other.where(held))), keys, arrays, width).withColumnRenamed("value", "__near")
    two = _summed(_products(far, other.where(~held)), keys, arrays, width).withColumnRenamed("value", "__far")
    both = x.select(*keys).join(one, keys, "left").join(two, keys, "left")  # the vector has all unknowns
    return both.select(*keys, F.coalesce(F.zip_with("__near", "__far", lambda a, b: a + b), "__near", "__far").alias("value"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)


def _plus(a: Column, factor: float, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, r: p + factor * r)


def solve(
    samples: DataFrame,
    signals: Sequence[Signal],
    noise: Noise | None = None,
    steps: int = 100,
    error: float = 1e-7,
    start: DataFrame | None = None,
) -> Solution:
    """The unknowns of samples (ivar, value, and what the signals' columns read), as (signal, key, value): signal is the
    place in `signals`. Steps end at the error, the squared norm of what is left relative to that of the right side, or
    after `steps`. The diagonal preconditions them; an amplitude without weight is 0. `start` is a vector to begin with,
    of which unknowns that are not there any more are left out. No samples give no unknowns."""
    data = written(prepared(samples, signals), "signals-data")
    keys, width = ["signal", "key"], max(s.width for s in signals)
    scaled = lambda r: F.zip_with(r, F.zip_with("d", "q", lambda d, q: F.when(d + q > 0, 1 / F.nullif(d + q, F.lit(0.0))).otherwise(0.0)), lambda a, b: a * b)
    size = lambda df, r="r": df.agg(F.sum(_dot(F.col(r), scaled(F.col(r))))).first()[0] or 0.0
    b = gathered((noise or white)(data, "v"), signals, "nv").withColumnRenamed("value", "b")
    zero = F.transform("d", lambda _: F.lit(0.0))
    base = written(_diagonal(data, signals).join(b, keys), "signals-base")
    first = size(base, "b")
    tables = [data, base]
    if noise is None:
        few = [r["signal"] for r in base.groupBy("signal").count().where(F.col("count") <= FEW).collect()]  # a row for each signal
        blocks = written(matrix(data, signals), "signals-matrix")
        near = bucketed(blocks.where(F.col("signal2").isin(few)), "signals-near", *keys)
        far = bucketed(blocks.where(~F.col("signal2").isin(few)), "signals-far", "signal2", "key2")
        forget(blocks)
        tables += [near, far]

    def times(x: DataFrame) -> DataFrame:
        """P' N^-1 P x."""
        return _times(near, far, x, few, width) if noise is None else gathered(noise(projected(data, signals, x), "model"), signals, "nv")

    if start is None:
        state = base.select(*keys, "d", "q", zero.alias("x"), F.col("b").alias("r"))
    else:
        at = base.join(start.select(*keys, F.col("value").alias("x0")), keys, "left").withColumn("x", F.coalesce("x0", zero))
        at = at.join(times(at.select(*keys, F.col("x").alias("value"))).withColumnRenamed("value", "ax"), keys, "left")
        left = F.zip_with(F.col("b"), F.zip_with(F.coalesce("ax", zero), F.zip_with("q", "x", lambda q, x: q * x), lambda a, c: a + c), lambda r, a: r - a)
        state = at.select(*keys, "d", "q", "x", left.alias("r"))
    state = bucketed(state.withColumn("p", scaled(F.col("r"))), "signals-state", *keys)
    rz = size(state)
    errors = [rz / first if first else 0.0]
    for _ in range(steps):
        if errors[-1] <= error:
            break
        ap = bucketed(times(state.select(*keys, F.col("p").alias("value"))).withColumnRenamed("value", "ap"), "signals-step", *keys, dealt=True)
        both = state.join(ap, keys, "left").withColumn("ap", F.zip_with(F.coalesce("ap", zero), F.zip_with("q", "p", lambda q, p: q * p), lambda a, c: a + c))
        alpha = rz / both.agg(F.sum(_dot(F.col("p"), F.col("ap")))).first()[0]
        both = both.withColumns({"x": _plus(F.col("x"), alpha, F.col("p")), "r": _plus(F.col("r"), -alpha, F.col("ap"))})
        new = size(both)
        old, state = state, bucketed(both.select(*keys, "d", "q", "x", "r", _plus(scaled(F.col("r")), new / rz, F.col("p")).alias("p")), "signals-state", *keys, dealt=True)
        forget(old, ap)
        rz = new
        errors.append(rz / first)
    forget(*tables)
    return Solution(state.select(*keys, F.col("x").alias("value")), errors)


def evaluated(samples: DataFrame, signals: Sequence[Signal], x: DataFrame) -> DataFrame:
    """samples with `model`, what the unknowns x add up to in each."""
    out = projected(prepared(samples.drop("model"), signals), signals, x)
    return out.select(*(c for c in samples.columns if c != "model"), "model")


def passes(
    samples: DataFrame,
    signals: Sequence[Signal],
    count: int,
    weigh: Callable[[DataFrame], DataFrame],
    noise: Noise | None = None,
    steps: int = 100,
    error: float = 1e-7,
) -> tuple[DataFrame, Solution]:
    """`count` solutions in turn, each from weights that `weigh` puts into ivar from `rest`, what the model of the pass
    before leaves of the values (at first the values), and beginning with the solution before. `weigh` may put in more
    columns, which signals read and the next call finds again: so samples that a pass leaves loud can become, and stay,
    unknowns of their own. Returns the last pass's samples with its model, and its solution."""
    if count < 1:
        raise ValueError("count must be 1 or more")
    now, solution, before = weigh(samples.withColumn("rest", F.col("value"))), None, None
    for k in range(count):
        now = written(now, "signals-pass")
        if before is not None:
            forget(before)
        before = now
        solution = solve(now, signals, noise, steps, error, solution.vector if solution else None)
        done = evaluated(now, signals, solution.vector)
        if k + 1 < count:
            now = weigh(done.withColumn("rest", F.col("value") - F.col("model")).drop("model", "ivar"))
    return done, solution
