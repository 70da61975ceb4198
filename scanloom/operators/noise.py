"""Dense noise models: spectra, eigenmodes and the low-rank inverse.

The functions of arrays take one observation's [detector, sample] matrix. Those of DataFrames take rows (grp, det, value
array) of any number in a group: modes come from the dual matrix, samples x samples, which is summed over the rows with
partial sums and holds as much whatever the number of detectors; each row is then projected where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowpass(tod: np.ndarray, knee: float, alpha: float = 8.0, rate: float = 1.0) -> np.ndarray:
    """Rows multiplied by 1 / (1 + (f / knee)^alpha) in Fourier space; a negative alpha is a high pass."""
    freq = np.fft.rfftfreq(tod.shape[-1], 1 / rate)
    with np.errstate(divide="ignore", over="ignore"):
        gain = 1 / (1 + (freq / knee) ** alpha)
    return np.fft.irfft(np.fft.rfft(tod, axis=-1) * gain, tod.shape[-1], axis=-1)


def resample(tod: np.ndarray, n: int) -> np.ndarray:
    """Rows at n samples by cutting or padding their spectrum."""
    f = np.fft.rfft(tod, axis=-1)
    out = np.zeros((*tod.shape[:-1], n // 2 + 1), complex)
    m = min(f.shape[-1], out.shape[-1])
    out[..., :m] = f[..., :m]
    return np.fft.irfft(out, n, axis=-1) * (n / tod.shape[-1])


def principal(tod: np.ndarray) -> tuple[np.ndarray, float]:
    """The strongest common mode over rows (unit length, largest element positive) and its share of the power."""
    cov = tod @ tod.T
    e, v = np.linalg.eigh(cov)
    mode = v[:, -1]
    return mode * np.sign(mode[np.argmax(np.abs(mode))]), float(e[-1] / max(e.sum(), 1e-300))


def strong_modes(cov: np.ndarray, limit: float = 16.0, single: float = 0.55, share: float = 0.1) -> np.ndarray:
    """Eigenvectors of at least `limit` times the median eigenvalue that no single detector dominates, at most
    `share` of the detectors."""
    e, v = np.linalg.eigh(cov)
    keep = (e >= limit * np.median(e)) & (np.abs(v).max(0) < single)
    picked = np.flatnonzero(keep)[::-1][: max(1, int(share * len(e)))]
    return v[:, picked]


def low_rank_model(ft: np.ndarray, bins: np.ndarray, limit: float = 16.0, single: float = 0.55) -> list[dict]:
    """Per frequency bin the model D + V E V' of the rows' spectra ft: inverse D, V, and Kh with
    N^-1 = D^-1 - (D^-1 V Kh)(D^-1 V Kh)'."""
    out = []
    for a, b in bins:
        part = ft[:, a:b]
        cov = (part @ part.conj().T).real / max(1, b - a)
        v = strong_modes(cov, limit, single)
        amp = v.T @ part
        power = (np.abs(amp) ** 2).mean(1)
        rest = (np.abs(part - v @ amp) ** 2).mean(1)
        d = np.maximum(rest, 1e-3 * np.median(rest) + 1e-30)
        core = np.diag(1 / np.maximum(power, 1e-30)) + v.T @ (v / d[:, None])
        kh = np.linalg.cholesky(np.linalg.inv(core)) if v.shape[1] else np.zeros((0, 0))
        out.append({"bin": (int(a), int(b)), "inverse_d": 1 / d, "v": v, "e": power, "kh": kh})
    return out


def apply_inverse(ft: np.ndarray, model: list[dict]) -> np.ndarray:
    """N^-1 applied to spectra, by bins and with the low-rank form."""
    out = ft.copy()
    for m in model:
        a, b = m["bin"]
        weighted = ft[:, a:b] * m["inverse_d"][:, None]
        q = (m["v"] * m["inverse_d"][:, None]) @ m["kh"]
        out[:, a:b] = weighted - q @ (q.T @ ft[:, a:b])
    return out


def freq_bins(edges: list[float], rate: float, n: int, least: int = 1) -> np.ndarray:
    """Frequency edges as index ranges of n frequencies, of at least `least` entries each."""
    at = [min(n, int(np.ceil(f / (rate / 2) * n))) for f in edges]
    out, start = [], 0
    for stop in [*at, n]:
        if stop - start >= least or (stop == n and stop > start):
            out.append((start, stop))
            start = stop
    return np.array(out, int).reshape(-1, 2)


def filtered(matrix: DataFrame, knee: float) -> DataFrame:
    """(grp, det, value array) low-passed along the samples; detectors do not meet, so no shuffle is needed."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([lowpass(np.asarray(x, float)[None], knee)[0] if len(x) else x for x in rows])

    return matrix.withColumn("value", run("value"))


def _grams(matrix: DataFrame, parts: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(grp, part, n, gram array): x' x summed over a group's rows, for each of the arrays x that parts() makes of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grp, rows in pdf.groupby("grp"):
                for k, x in enumerate(parts(np.stack(rows["value"].to_numpy()).astype(float))):
                    out.append((grp, k, len(x), (x.T @ x).ravel()))
            yield pd.DataFrame(out, columns=["grp", "part", "n", "gram"])

    some = matrix.select("grp", "value").mapInPandas(run, "grp int, part int, n long, gram array<double>")
    cells = some.select("grp", "part", "n", F.posexplode("gram").alias("at", "x"))
    cells = cells.groupBy("grp", "part", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    gram = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"])  # a cell for each two samples
    return cells.groupBy("grp", "part").agg(F.max("n").alias("n"), gram.alias("gram"))


def _dual_modes(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, as many as the detectors' matrix of n rows can have, and their vectors as rows."""
    size = int(round(len(gram) ** 0.5))
    e, v = np.linalg.eigh(np.asarray(gram).reshape(size, size))
    most = min(n, size)
    return np.maximum(e[::-1][:most], 0.0), v.T[::-1][:most]


def group_modes(matrix: DataFrame) -> DataFrame:
    """(grp, det, weight, share): each group's strongest common mode (unit length, largest element positive), from rows
    (grp, det, value array), all arrays of one length; weights are 0 where the rows do not vary."""
    centred = lambda tod: [tod - tod.mean(1, keepdims=True)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grp, gram, n in zip(pdf["grp"], pdf["gram"], pdf["n"]):
                e, v = _dual_modes(gram, n)
                scale = e[0] ** 0.5
                out.append((grp, v[0] / scale if scale else v[0] * 0, float(e[0] / max(e.sum(), 1e-300))))
            yield pd.DataFrame(out, columns=["grp", "mode", "share"])

    modes = _grams(matrix, centred).select("grp", "n", "gram").mapInPandas(solve, "grp int, mode array<double>, share double")
    mean = F.aggregate("value", F.lit(0.0), lambda a, x: a + x) / F.size("value")
    rows = matrix.select("grp", "det", F.transform("value", lambda x: x - mean).alias("value")).join(modes, "grp")
    dot = F.aggregate(F.zip_with("value", "mode", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("grp", "det", dot.alias("weight"), "share")
    turn = rows.groupBy("grp").agg(F.max_by(F.signum("weight"), F.struct(F.abs("weight"), -F.col("det"))).alias("turn"))
    return rows.join(turn, "grp").select("grp", "det", (F.col("weight") * F.col("turn")).alias("weight"), "share")


def noise_weights(matrix: DataFrame, bins: list[float], limit: float = 16.0, single: float = 0.55, share: float = 0.1) -> DataFrame:
    """(grp, det, ivar, nmode): the white level of each detector under its group's low-rank model.

    In each frequency bin modes of at least `limit` times the median eigenvalue (of those that the number of detectors
    and of frequencies allow), which no detector holds `single` of, at most `share` of the detectors and one at least,
    are taken out; what is left of a row, at least a thousandth of the rows' median, is its variance.
    """

    def parts(tod: np.ndarray) -> list[np.ndarray]:
        ft = np.fft.rfft(tod - tod.mean(1, keepdims=True), axis=1)[:, 1:]
        cut = [ft[:, a:b] for a, b in freq_bins(bins, 1.0, ft.shape[1], 4)]
        return [np.concatenate((x.real, x.imag), axis=1) for x in cut]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grp, part, n, gram in zip(pdf["grp"], pdf["part"], pdf["n"], pdf["gram"]):
                e, v = _dual_modes(gram, n)
                strong = (e > 0) & (e >= limit * np.median(e))
                out.append((grp, part, n, e[strong].tolist(), v[strong].ravel()))
            yield pd.DataFrame(out, columns=["grp", "part", "n", "e", "modes"])

    kind = "grp int, part int, n long, e array<double>, modes array<double>"
    found = _grams(matrix, parts).mapInPandas(solve, kind)
    by_group = found.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("part", "n", "e", "modes"))).alias("found"))  # a row for each bin

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Squares of each row in each bin, all and along the strong modes."""
        for pdf in batches:
            out = []
            for grp, det, value, modes in zip(pdf["grp"], pdf["det"], pdf["value"], pdf["found"]):
                for x, m in zip(parts(np.asarray(value, float)[None]), modes):
                    along = np.asarray(m["modes"]).reshape(len(m["e"]), -1) @ x[0] if len(m["e"]) else np.empty(0)
                    out.append((grp, det, m["part"], x.shape[1] // 2, float(x[0] @ x[0]), along**2, along**2 / np.asarray(m["e"])))
            yield pd.DataFrame(out, columns=["grp", "det", "part", "width", "power", "along", "own"])

    kind = "grp int, det long, part int, width int, power double, along array<double>, own array<double>"
    rows = matrix.select("grp", "det", "value").join(by_group, "grp").mapInPandas(project, kind)
    peak = rows.select("grp", "part", F.posexplode("own").alias("k", "own")).groupBy("grp", "part", "k").agg(F.max("own").alias("peak"))
    good = peak.where(F.col("peak") < single**2).groupBy("grp", "part").agg(F.array_sort(F.collect_list("k")).alias("good"))
    most = F.greatest(F.lit(1), F.floor(F.col("n") * share).cast("int"))
    picked = found.join(good, ["grp", "part"], "left").select("grp", "part", F.coalesce(F.slice("good", F.lit(1), most), F.array().cast("array<int>")).alias("picked"))
    picked = picked.withColumn("modes", F.size("picked"))
    taken = F.aggregate("picked", F.lit(0.0), lambda a, k: a + F.get("along", k))
    left = rows.join(picked, ["grp", "part"]).withColumn("rest", (F.col("power") - taken) / F.col("width"))
    floor = left.groupBy("grp", "part").agg((F.percentile_approx("rest", 0.5) * 1e-3 + 1e-30).alias("floor"))
    level = left.join(floor, ["grp", "part"]).withColumn("inverse", 1 / F.greatest("rest", "floor"))
    size = matrix.groupBy("grp").agg(F.max(F.size("value")).alias("size"))
    out = level.groupBy("grp", "det").agg(F.avg("inverse").alias("mean"), F.sum("modes").cast("int").alias("nmode")).join(size, "grp")
    return out.select("grp", "det", (F.col("mean") * F.col("size")).alias("ivar"), "nmode")


def covariance(samples: DataFrame, det: str, samp: str, value: str, by: list[str], tile: int = 1024, chunk: int = 256) -> DataFrame:
    """(by, d1, d2, cov, n): sums of products over shared samples of the detectors of a group, d1 <= d2, and their number.

    A group's detectors are dealt into tiles of about `tile` and its samples into chunks; each two tiles meet chunk by
    chunk as matrices, in one task that holds a chunk of both and their sums. So a sample travels once for each tile of
    its group, and no product leaves its task before it is summed. Pairs of tiles are dealt over all shuffle partitions:
    what they read is small beside the sums that they make. Null values count, but add nothing."""
    keys = [f"__g{i}" for i in range(len(by))]
    rows = samples.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(det).alias("d"), F.col(samp).alias("s"), F.col(value).cast("double").alias("v"))
    rows = rows.where("d is not null and s is not null" + "".join(f" and {k} is not null" for k in keys))
    sizes = rows.select(*keys, "d").distinct().groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = rows.join(sizes, keys).withColumns({"t": F.pmod(F.xxhash64("d"), "tiles").cast("int"), "c": F.xxhash64(F.floor(F.col("s") / chunk))})
    # a tile's chunk is one row, which goes to each tile of its group; null: no value
    packed = dealt.groupBy(*keys, "tiles", "t", "c").agg(F.collect_list(F.struct("d", "s", "v")).alias("r"))
    packed = packed.select(*keys, "tiles", "t", "c", *(F.col(f"r.{k}").alias(k) for k in "dsv"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    sent = packed.select(*keys, "t", "c", "d", "s", "v", other.alias("o")).withColumns({"a": F.least("t", "o"), "b": F.greatest("t", "o")})
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.drop("o").repartition(parts, *keys, "a", "b").sortWithinPartitions(*keys, "a", "b", "c", "t")
    kinds = dict(sent.dtypes)
    kind = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} {kinds['d'][len('array<') : -1]}" for c in ("d1", "d2")), "cov double", "n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, types = None, None, []
        for batch in batches:
            types = [batch.schema.field(c).type for c in keys]
            for k in range(batch.num_rows):
                head = [batch.column(c)[k].as_py() for c in (*keys, "a", "b")]
                if head != now:
                    if sums is not None:
                        yield from sums.rows(now, keys, types)
                    now, sums = head, _TilePair(head[-2] == head[-1])
                sums.add(batch.column("c")[k].as_py(), batch.column("t")[k].as_py() == head[-2], *(batch.column(c)[k].values for c in "dsv"))
        if sums is not None:
            yield from sums.rows(now, keys, types)

    out = sent.mapInArrow(run, kind)
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), F.least("d1", "d2").alias("d1"), F.greatest("d1", "d2").alias("d2"), "cov", "n")


class _TilePair:
    """Sums over the products of two tiles of detectors, chunk by chunk."""

    def __init__(self, same: bool):
        self.same, self.chunk, self.left = same, None, None
        self.ids: tuple[dict, dict] = ({}, {})
        self.sums = np.zeros((3, 0, 0))  # of products, of pairs, of pairs with both values

    def _matrix(self, side: int, times: np.ndarray, d: pa.Array, s: np.ndarray, v: pa.Array) -> np.ndarray:
        """[values, samples, samples with a value] by time and detector; detectors get the next free columns."""
        ids = self.ids[side]
        names, at = np.unique(d.to_numpy(zero_copy_only=False), return_inverse=True)
        cols = np.array([ids.setdefault(x, len(ids)) for x in names.tolist()])[at]
        row, known = np.searchsorted(times, s), v.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((3, len(times), len(ids)))
        np.add.at(out[0], (row, cols), np.where(known, v.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0))
        np.add.at(out[1], (row, cols), 1.0)
        np.add.at(out[2], (row, cols), known)
        return out

    def add(self, chunk: int, first: bool, d: pa.Array, s: pa.Array, v: pa.Array) -> None:
        part = (d, s.to_numpy(zero_copy_only=False), v)
        if first and not self.same:  # the first tile's rows of a chunk come before the second's
            self.chunk, self.left = chunk, part
            return
        if not self.same and (self.left is None or self.chunk != chunk):
            return
        other = part if self.same else self.left
        times = np.unique(part[1] if self.same else np.intersect1d(part[1], other[1]))
        if not self.same:
            part, other = (self._within(times, *p) for p in (part, other))
        a = self._matrix(0, times, *other)
        b = a if self.same else self._matrix(1, times, *part)
        shape = (3, a.shape[2], b.shape[2])
        if shape != self.sums.shape:
            grown = np.zeros(shape)
            grown[:, : self.sums.shape[1], : self.sums.shape[2]] = self.sums
            self.sums = grown
        with np.errstate(invalid="ignore", over="ignore"):
            self.sums[0] += self._products(a[0], b[0], a[2], b[2])
        self.sums[1] += a[1].T @ b[1]
        self.sums[2] += a[2].T @ b[2]

    @staticmethod
    def _within(times: np.ndarray, d: pa.Array, s: np.ndarray, v: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        keep = np.isin(s, times)
        return d.filter(pa.array(keep)), s[keep], v.filter(pa.array(keep))

    @staticmethod
    def _products(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
        """a' b; values that are not finite count only where the other detector has one, too."""
        odd_a, odd_b = ~np.isfinite(a), ~np.isfinite(b)
        out = np.where(odd_a, 0.0, a).T @ np.where(odd_b, 0.0, b)
        for i in np.flatnonzero(odd_a.any(0)):
            at = odd_a[:, i]
            out[i] += np.where(in_b[at] > 0, a[at, i][:, None] * b[at], 0.0).sum(0)
        for j in np.flatnonzero(odd_b.any(0)):
            at = odd_b[:, j]
            out[:, j] += np.where((in_a[at] > 0) & ~odd_a[at], b[at, j][:, None] * a[at], 0.0).sum(0)
        return out

    def rows(self, head: list, keys: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        cov, pairs, known = self.sums
        one, two = (list(self.ids[k]) for k in (0, 0 if self.same else 1))
        i, j = np.nonzero(np.triu(pairs) if self.same else pairs)
        for k in range(0, len(i), 50_000):
            p, q = i[k : k + 50_000], j[k : k + 50_000]
            cols = [pa.array([x] * len(p), kind) for x, kind in zip(head, types)]
            cols += [pa.array(one).take(pa.array(p)), pa.array(two).take(pa.array(q)), pa.array(cov[p, q], mask=known[p, q] == 0), pa.array(np.rint(pairs[p, q]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "d1", "d2", "cov", "n"])
