"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

A record whose payload another record already holds is a revisit that refers to it. Archives lie in a folder that all
executors share; a task writes under a name of its attempt and moves the finished file to its final name, so a task
that is run again leaves one file. Reading inflates a member piece by piece, frames the block by its content length
and verifies both digests; at no time is more than one piece and one header held, unless payloads are asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import new_path, spread, written

PIECE = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _gzip_member(*parts: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([*(deflate.compress(p) for p in parts), deflate.flush()])


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    if refers_to is not None:
        head |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": _PROFILE}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return _gzip_member(b"WARC/1.1\r\n" + lines.encode() + b"\r\n", block, b"\r\n\r\n")


def write_archives(
    pages: DataFrame,
    html_col: str = "html",
    url_col: str = "url",
    id_col: str = "page_id",
    least_bytes: int = 100,
    date: str = "2000-01-01T00:00:00Z",
    folder: str | None = None,
) -> DataFrame:
    """Writes a record per row; returns the manifest (path, n_records, n_bytes).

    Of rows with equal payloads of at least least_bytes bytes, those of the smallest id are responses and others
    revisits; shorter payloads are all responses. Null html is an empty payload; a null url is left out; a null id is
    an empty one, a revisit if its payload has another row with an id. No rows: no records. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    src = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        src.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    refers_to = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    rows = src.join(first, "digest", "left").select("id", "url", "payload", "digest", refers_to.alias("refers_to"))
    rows = rows.sortWithinPartitions("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{at.partitionId():05d}.warc.gz"
        draft, out, n, size = f"{name}.{at.taskAttemptId()}", None, 0, 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    out = store.open_output_stream(draft, compression=None)
                out.write(member := _record(*row, date))
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(draft, name)
            path = f"{folder}/part-{at.partitionId():05d}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], ["path", "n_records", "n_bytes"])

    return written(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


class WarcReader:
    """Records of one archive, in order."""

    def __init__(self, stream, keep_payload: bool = False):
        self.stream, self.keep, self.rest = stream, keep_payload, b""

    def _pieces(self) -> Iterator[bytes]:
        """The inflated bytes of one gzip member, piece by piece."""
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            data = self.rest or self.stream.read(PIECE)
            if not data:
                raise ValueError("the archive ends inside a record")
            while data and not inflate.eof:
                yield inflate.decompress(data, PIECE)
                data = inflate.unconsumed_tail
            self.rest = inflate.unused_data

    def __iter__(self) -> Iterator[dict]:
        while True:
            self.rest = self.rest or self.stream.read(PIECE)
            if not self.rest:
                return
            yield self._record()

    def _record(self) -> dict:
        pieces, held = self._pieces(), b""
        while b"\r\n\r\n" not in held:
            held += self._next(pieces)
        head, held = held.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("a record does not begin with a WARC version")
        fields = dict(x.split(": ", 1) for x in lines)
        left, block, payload = int(fields["Content-Length"]), hashlib.sha256(), hashlib.sha256()
        n_payload, in_http, http, kept = 0, True, b"", []
        while left:
            held = held or self._next(pieces)
            part, held = held[:left], held[left:]
            left -= len(part)
            block.update(part)
            if in_http:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                part, in_http = http.split(b"\r\n\r\n", 1)[1], False
            payload.update(part)
            n_payload += len(part)
            if self.keep:
                kept.append(part)
        for more in pieces:
            held += more
        if held != b"\r\n\r\n":
            raise ValueError("a record is not followed by its end")
        self._verify(fields["WARC-Block-Digest"], block)
        revisit = fields["WARC-Type"] == "revisit"
        if not revisit:
            self._verify(fields["WARC-Payload-Digest"], payload)
            if n_payload != int(fields["WARC-Payload-Length"]):
                raise ValueError("a payload is not as long as stated")
        return {
            "page_id": self._page(fields["WARC-Record-ID"]),
            "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"],
            "payload_bytes": int(fields["WARC-Payload-Length"]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "refers_to": self._page(fields["WARC-Refers-To"]) if revisit else None,
            "payload": b"".join(kept) if self.keep and not revisit else None,
        }

    @staticmethod
    def _next(pieces: Iterator[bytes]) -> bytes:
        for piece in pieces:
            if piece:
                return piece
        raise ValueError("a record is shorter than its content length")

    @staticmethod
    def _verify(stated: str, found) -> None:
        if stated != f"sha256:{found.hexdigest()}":
            raise ValueError(f"digest {stated} does not hold")

    @staticmethod
    def _page(urn: str) -> int | None:
        number = urn.removeprefix("<urn:x-page:").removesuffix(">")
        return int(number) if number else None


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives of a manifest: (page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload); payload is null unless asked for, and for revisits. A damaged archive is an error."""

    kinds = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for record in WarcReader(stream, payloads):
                        held.append(record)
                        size += len(record["payload"] or b"")
                        if len(held) == 1000 or size > 16_000_000:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    # an archive is read by one task: its size is what a writing task was dealt
    return spread(manifest.select("path"), "path").mapInArrow(run, ddl)
