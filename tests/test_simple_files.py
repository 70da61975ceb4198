"""The simple file format: lists, files, damaged ones, pruning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.sources import simple


def write(path, ndet=3, n=100, seed=1, **over):
    r = np.random.default_rng(seed)
    body = {
        "dets": np.array([f"d{k}" for k in range(ndet)]), "point_offset": r.normal(size=(ndet, 2)), "polangle": r.normal(size=ndet),
        "boresight": r.normal(size=(3, n)), "tod": r.normal(size=(ndet, n)).astype(np.float32), "cuts": r.uniform(size=(ndet, n)) < 0.3,
    } | over
    np.savez(path, **body)
    return body


def test_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# path ndet nsamp\n\n/a/b/obs_1.x.npz 3 100 1.5e9 10 0.5 1 2 3 4 5 6 7 8\n  rel.npz 4 x 2 3 4 1 2 3 4 5 6 7 8\n")
    a, b = simple.read_list(spark, str(tmp_path / "list.txt")).orderBy("ctime", ascending=False).collect()
    assert (a["id"], a["path"], a["ndet"], a["nsamp"], a["ctime"], a["dur"]) == ("obs_1.x", "/a/b/obs_1.x.npz", 3, 100, 1.5e9, 600)
    assert a["r"] == pytest.approx(math.radians(0.5)) and a["ras"] == pytest.approx([math.radians(x) for x in (1, 3, 5, 7)]) and a["decs"][3] == pytest.approx(math.radians(8))
    assert (b["id"], b["nsamp"]) == ("rel", None)


def test_files(spark, tmp_path):
    one, two = write(tmp_path / "one.npz"), write(tmp_path / "two.npz", 2, 31, 2)
    (tmp_path / "bad.npz").write_bytes(b"PK\x03\x04 cut short")
    np.savez(tmp_path / "part.npz", dets=one["dets"])
    info = spark.createDataFrame([(k, str(tmp_path / f"{k}.npz")) for k in ("one", "two", "bad", "part", "none")], "id string, path string")
    got = {(r["id"], r["det"]): r for r in simple.read_files(info).collect()}
    assert sorted(got, key=str) == sorted([("one", "d0"), ("one", "d1"), ("one", "d2"), ("two", "d0"), ("two", "d1"), ("bad", None), ("part", None), ("none", None)], key=str)
    assert all((r["error"] is None) == (k[0] in ("one", "two")) for k, r in got.items())
    for (id_, det), r in got.items():
        if r["error"]:
            continue
        body, k = {"one": one, "two": two}[id_], int(det[1])
        n = 96 if id_ == "one" else 31  # three times 32; files of less than 32 samples stay whole
        assert r["tod"] == pytest.approx(body["tod"][k, :n].tolist()) and r["el"] == pytest.approx(body["boresight"][2, :n].tolist())
        assert (r["y"], r["x"]) == pytest.approx((body["point_offset"][k, 1], body["point_offset"][k, 0]))
        flags = np.zeros(n, bool)
        for c in r["cut"]:
            assert c["lo"] < c["hi"]
            flags[c["lo"] : c["hi"]] = True
        assert (flags == body["cuts"][k, :n]).all()


def test_pruning(spark, tmp_path):
    write(tmp_path / "one.npz")
    info = spark.createDataFrame([("one", str(tmp_path / "one.npz"))], "id string, path string")
    (r,) = simple.read_files(info, ("cuts",), dets=["d1"]).collect()
    assert r["det"] == "d1" and r["tod"] is None and r["ctime"] is None and r["cut"] is not None
    assert simple.read_files(info.limit(0)).count() == 0


def test_round_trip(spark):
    rows = [(g, d, k, 100.0 + k, float(g * 1000 + d * 100 + k), k % 5 == 0) for g in (1, 2) for d in (3, 4) for k in range(70) if (d, k) != (4, 9)]
    s = spark.createDataFrame(rows, "grp long, det long, samp long, t double, value double, cut boolean")
    info = simple.write_files(s, "grp")
    assert sorted((r["id"], r["ndet"], r["nsamp"]) for r in info.collect()) == [("obs_1", 2, 70), ("obs_2", 2, 70)]
    flat = simple.read_files(info, mul=1).select("id", "det", "cut", F.posexplode("tod").alias("samp", "value")).collect()
    got = {(r["id"], r["det"], r["samp"]): (r["value"], any(c["lo"] <= r["samp"] < c["hi"] for c in r["cut"])) for r in flat}
    for g, d, k, _, v, c in rows:
        assert got[f"obs_{g}", str(d), k] == (v, c)
    assert got["obs_1", "4", 9] == (0.0, True) and len(got) == 280
