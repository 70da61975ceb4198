"""Observations in the simple file format: a text list of observations, and one npz file of arrays for each.

A line of the list has path, ndet, nsamp, ctime, duration (minutes), radius (deg) and four points of the sweep (ra, dec in
deg). A file has dets [det], point_offset [det, (x, y)], polangle [det], boresight [(ctime, az, el), samp], tod [det, samp]
and cuts [det, samp], true where a sample is flagged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.sources.shared import new_path

_DETECTORS = "id string, det string, y double, x double, polangle double, ctime array<double>, az array<double>, el array<double>, tod array<double>, cut array<struct<lo:int,hi:int>>, error string"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, ndet, nsamp, ctime, dur, r, ras, decs) of a text list: seconds and radians; id is the file's name without
    folder and ending. Blank lines and those that begin with # are left out; what cannot be read as a number is null."""
    words = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.get("w", F.lit(k)).try_cast("double")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(words.alias("w"))
    file = F.element_at(F.split(F.get("w", F.lit(0)), "/"), -1)
    angle = lambda k: F.radians(number(k))
    return rows.select(
        F.when(file.contains("."), F.regexp_replace(file, r"\.[^.]*$", "")).otherwise("").alias("id"),
        F.get("w", F.lit(0)).alias("path"),
        number(1).cast("int").alias("ndet"),
        number(2).cast("int").alias("nsamp"),
        number(3).alias("ctime"),
        (number(4) * 60).alias("dur"),
        angle(5).alias("r"),
        F.array(*(angle(6 + 2 * k) for k in range(4))).alias("ras"),
        F.array(*(angle(7 + 2 * k) for k in range(4))).alias("decs"),
    )


def _friendly(n: int) -> int:
    while n > 1:
        left = n
        for p in (2, 3, 5, 7):
            while left % p == 0:
                left //= p
        if left == 1:
            return n
        n -= 1
    return n


def _opened(path: str) -> io.IOBase:
    from pyarrow import fs

    if "://" not in path:
        return open(path, "rb")
    store, base = fs.FileSystem.from_uri(path)
    return store.open_input_file(base)


def read_files(info: DataFrame, columns: Sequence[str] = ("boresight", "tod", "cuts"), dets: Sequence[str] | None = None, mul: int = 32) -> DataFrame:
    """A row for each detector of each file of info (id, path): det, y and x (the offsets), polangle, ctime, az, el, tod, the
    flagged ranges `cut`, and error.

    Samples are cut to a multiple of `mul` whose share has no prime factor above 7. Of boresight, tod and cuts only those
    in `columns` are read from the file, others are null; with `dets` only these detectors have rows. A file that cannot be
    read is one row with its id and the error. Files are dealt out one by one, and a task holds one at a time."""

    def rows(id_: str, path: str) -> Iterator[tuple]:
        with _opened(path) as raw, np.load(raw, allow_pickle=False) as f:
            names = [str(d) for d in f["dets"]]
            keep = [k for k, d in enumerate(names) if dets is None or d in dets]
            offsets, angle = f["point_offset"], f["polangle"]
            bore = f["boresight"] if "boresight" in columns else None
            tod = f["tod"] if "tod" in columns else None
            cuts = f["cuts"] if "cuts" in columns else None
            n = next((a.shape[1] for a in (bore, tod, cuts) if a is not None), 0)
            n = _friendly(n // mul) * mul if n >= mul else n
            for k in keep:
                ranges = None
                if cuts is not None:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], cuts[k, :n].astype(np.int8), [0]))))
                    ranges = [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                path_ = (bore[i, :n].astype(float) if bore is not None else None for i in range(3))
                yield (id_, names[k], float(offsets[k, 1]), float(offsets[k, 0]), float(angle[k]), *path_, tod[k, :n].astype(float) if tod is not None else None, ranges, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _DETECTORS.split(", ")]
        for pdf in batches:
            for id_, path in zip(pdf["id"], pdf["path"]):
                out: list[tuple] = []
                try:
                    out.extend(rows(id_, path))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one file is told in its row
                    out = [(id_, *(None,) * (len(names) - 2), f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(out, columns=names)

    files = info.select("id", "path")
    return files.repartition(max(1, files.count()), "id", "path").mapInPandas(run, _DETECTORS)


def write_files(samples: DataFrame, group: str, det: str = "det", samp: str = "samp", value: str = "value", cut: str = "cut", t: str = "t") -> DataFrame:
    """Observations of the simple format from samples (group, det, samp, t, value, cut), one file a group, in the shared
    folder: (id, path, ndet, nsamp). Samples that a detector lacks are 0 and flagged. A group is one observation."""
    folder = new_path(samples.sparkSession, "simple").removeprefix("file://")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        names, rows = np.unique(pdf[det].to_numpy(), return_inverse=True)
        n = int(pdf[samp].max()) + 1
        tod, flags, when = np.zeros((len(names), n)), np.ones((len(names), n), bool), np.zeros(n)
        at = pdf[samp].to_numpy()
        tod[rows, at], flags[rows, at], when[at] = pdf[value], pdf[cut], pdf[t]
        body = io.BytesIO()
        np.savez(body, dets=names.astype(str), point_offset=np.zeros((len(names), 2)), polangle=np.zeros(len(names)), boresight=np.stack((when, when * 0, when * 0)), tod=tod, cuts=flags)
        id_ = f"obs_{pdf[group].iloc[0]}"
        path = f"{folder}/{id_}.npz"
        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(base.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(base) as f:
            f.write(body.getvalue())
        return pd.DataFrame({"id": [id_], "path": [path], "ndet": [len(names)], "nsamp": [n]})

    return samples.groupBy(group).applyInPandas(run, "id string, path string, ndet int, nsamp int")
