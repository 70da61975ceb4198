import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from scanloom.llm.warc import WarcReader, read_archives, write_archives


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, first string").repartition(3)


BIG = "<p>" + "é" * 60 + "</p>"
ROWS = [
    (4, "http://a/\r\nX: y", BIG), (2, None, BIG), (None, "http://n/", BIG), (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"),
    (11, "u", "\r\n\r\n" * 40), (12, "u", "z" * 300_000), (13, "u", "z" * 300_000), (14, "ü ö", "HTTP/1.1 200 OK\r\n\r\n" + BIG), (2, "again", BIG),
]


def want(rows):
    groups = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 100 and i is not None:
            groups[body] = min(groups.get(body, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = groups.get(body)
        revisit = first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    manifest = write_archives(table(spark, ROWS))
    got = read_archives(manifest, payloads=True).collect()
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == want(ROWS)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None
    # every record is a gzip member of its own, readable by any reader
    for m in manifest.collect():
        raw = open(m["path"].removeprefix("file://"), "rb").read()
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == m["n_records"] and len(raw) == m["n_bytes"]


def test_empty(spark):
    assert read_archives(write_archives(table(spark, []))).count() == 0


def test_damage_is_an_error(spark):
    manifest = write_archives(table(spark, ROWS[3:7]).coalesce(1))
    raw = open(manifest.first()["path"].removeprefix("file://"), "rb").read()
    with pytest.raises(ValueError):
        list(WarcReader(io.BytesIO(raw[:-20])))
    whole = gzip.decompress(raw)
    with pytest.raises(ValueError):
        list(WarcReader(io.BytesIO(gzip.compress(whole[: whole.index(b"WARC/1.1", 9)].replace(b"short", b"shirt").replace(b"\r\n\r\n\r\n", b"!\r\n\r\n")))))


def test_hot_payload_is_written_once(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("h" * 500)).otherwise(F.concat(F.lit("k" * 200), "id")).alias("html"))
    got = read_archives(write_archives(pages)).groupBy("record_type").count().collect()
    assert {r[0]: r[1] for r in got} == {"response": 135, "revisit": 265}
