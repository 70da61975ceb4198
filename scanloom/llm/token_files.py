"""Token ids of documents in files of checksummed, independently coded blocks.

A file holds the ids of consecutive documents (by ascending id) in blocks of mixing_coder, each with its number of
ids, its length and a CRC-32 of its ids, and ends with an index: document ids and numbers of tokens. Files lie in a
folder that all executors share; a task writes under a name of its attempt and moves the finished file to its name.

    file   = magic, block*, index, index length (u64), ids in the file (u64), magic
    block  = ids (u32), bytes (u32), crc32 (u32), code
    index  = zlib of: n (u64), n * id (i64), n * null flag (u8), n * tokens (u64)
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import new_path, slices, spread, written
from scanloom.llm.mixing_coder import checksum, decode_blocks, encode_blocks

MAGIC = b"SCLTOK1\n"
#: Ids of a block at most, which are held at a time.
BLOCK = 1 << 21


def _ragged(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of width[0] places, and so on."""
    ends = np.cumsum(width)
    return np.arange(ends[-1]) + np.repeat(start - ends + width, width)


class WordTokenizer:
    """A tokenizers-library vocabulary whose words do not reach over white space, applied word by word.

    The distinct words of some texts are found with Arrow and cut into letters and plain marks behind them, which the
    vocabulary treats apart. Parts met before come from a bounded table. New parts of letters alone are given to the
    library many at a time and told apart by the word-end mark of their last token; all others one by one.
    """

    #: Marks that stay together behind letters and start neither a contraction nor a special token.
    MARKS = ".,;:!?*$%&#"

    def __init__(self, path: str, table_parts: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.limit = table_parts
        self.ends = np.zeros(self.lib.get_vocab_size(), bool)
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.flat, self.start, self.n = np.empty(0, np.uint16), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, parts: list[str]) -> None:
        plain, other = [], []
        for p in parts:
            (plain if p.isalpha() and p.lower().isalpha() and unicodedata.is_normalized("NFC", p) else other).append(p)
        names, flats, counts = [], [], []
        groups = [plain[k : k + 512] for k in range(0, len(plain), 512)]
        for group, code in zip(groups, self.lib.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(code.ids, np.uint16)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                names += group
                flats.append(ids)
                counts.append(np.diff(stops, prepend=0))
            else:
                other += group
        for p, code in zip(other, self.lib.encode_batch_fast(other, add_special_tokens=False)):
            names.append(p)
            flats.append(np.array(code.ids, np.uint16))
            counts.append(np.array([len(code.ids)]))
        n = np.concatenate(counts)
        self.slot.update(zip(names, range(len(self.slot), len(self.slot) + len(names))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(n) - n))
        self.n = np.concatenate((self.n, n))
        self.flat = np.concatenate((self.flat, *flats))

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each distinct word as two parts: letters and marks, or the word and nothing."""
        body = pc.utf8_rtrim(words, self.MARKS)
        ascii_ = pc.string_is_ascii(body)
        alpha = pc.utf8_is_alpha(body).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(alpha & ~ascii_.to_numpy(zero_copy_only=False)).tolist():
            b = body[k].as_py()
            alpha[k] = b.isalpha() and b.lower().isalpha() and unicodedata.is_normalized("NFC", b)
        alpha = pa.array(alpha)
        low = pc.if_else(ascii_, pc.ascii_lower(body), body)
        marked = pc.and_(alpha, pc.not_equal(pc.binary_length(words), pc.binary_length(body)))
        width = pc.if_else(marked, pc.subtract(pc.binary_length(words), pc.binary_length(body)), 0).to_numpy()
        marks = pa.nulls(len(words), pa.string())
        for m in np.unique(width).tolist():
            some = pa.array(width == m)
            marks = pc.replace_with_mask(marks, some, pc.utf8_slice_codeunits(words.filter(some), -m) if m else pa.scalar(""))
        return pc.if_else(alpha, low, words), marks

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the number of ids of each."""
        if len(self.slot) > self.limit:
            self._clear()
        # at ASCII white space, which the vocabulary drops; the empty words at the ends of a text have no ids
        words = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return np.empty(0, np.uint16), np.zeros(len(texts), np.int64)
        head, tail = (x.dictionary_encode() for x in self._parts(coded.dictionary))
        slots = []
        for x in (head, tail):
            names = x.dictionary.to_pylist()
            known = list(map(self.slot.get, names))
            if fresh := [k for k, slot in enumerate(known) if slot is None]:
                self._learn([names[k] for k in fresh])
                for k in fresh:
                    known[k] = self.slot[names[k]]
            slots.append(np.array(known, np.int64)[x.indices.to_numpy()])
        pair = np.stack(slots, 1).ravel()  # head and tail of every distinct word
        flat = self.flat[_ragged(self.start[pair], self.n[pair])]
        n = self.n[pair].reshape(-1, 2).sum(1)
        at = coded.indices.to_numpy()
        width = n[at]
        ids = flat[_ragged((np.cumsum(n) - n)[at], width)]
        bounds = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return ids, np.diff(bounds)


@functools.lru_cache(2)
def _tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker, which its tasks use one after the other, with the parts that they have met."""
    return WordTokenizer(path)


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", folder: str | None = None
) -> DataFrame:
    """Writes the ids of every whole text, end_id behind each; returns the manifest (file_no, path, n_docs, n_ids, n_bytes).

    Files and documents in them are by ascending id; null ids come first. Null and empty texts have the end id only.
    Rows of one id stay rows of their own, next to each other, by text. Other columns are ignored; no rows write no file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = src.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at = TaskContext.get()
        words = _tokenizer(tokenizer)
        store, base = fs.FileSystem.from_uri(folder)
        name = f"part-{at.partitionId():05d}.tok"
        out = None
        ids_of, tokens_of, held, n_held, n_ids, n_bytes = [], [], [], 0, 0, 0

        def flush(everything: bool) -> None:
            nonlocal held, n_held, n_bytes
            data = np.concatenate(held) if held else np.empty(0, np.uint16)
            full = len(data) if everything else len(data) // BLOCK * BLOCK
            for k, (m, code) in enumerate(encode_blocks(data[:full], BLOCK)):
                out.write(struct.pack("<III", m, len(code), checksum(data[k * BLOCK : k * BLOCK + m])) + code)
                n_bytes += 12 + len(code)
            held, n_held = ([data[full:]], len(data) - full) if full < len(data) else ([], 0)

        for b in slices(batches, 3000):
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(draft := f"{base}/{name}.{at.taskAttemptId()}", compression=None)
                out.write(MAGIC)
            ids_of += b.column("id").to_pylist()
            ids, counts = words.encode(b.column("text"))
            held.append(np.insert(ids, np.cumsum(counts), end_id))
            tokens_of += (counts + 1).tolist()
            n_held += len(held[-1])
            n_ids += len(held[-1])
            if n_held >= BLOCK:
                flush(False)
        if out is None:
            return
        flush(True)
        nulls = np.array([x is None for x in ids_of], np.uint8)
        index = zlib.compress(
            struct.pack("<Q", len(ids_of))
            + np.array([x or 0 for x in ids_of], "<i8").tobytes()
            + nulls.tobytes()
            + np.array(tokens_of, "<u8").tobytes()
        )
        out.write(index + struct.pack("<QQ", len(index), n_ids) + MAGIC)
        out.close()
        store.move(draft, f"{base}/{name}")
        row = [[at.partitionId()], [f"{folder}/{name}"], [len(ids_of)], [n_ids], [n_bytes]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds)], ["file_no", "path", "n_docs", "n_ids", "n_bytes"]
        )

    return written(rows.mapInArrow(run, "file_no int, path string, n_docs long, n_ids long, n_bytes long"), "token-manifest")


class TokenFile:
    """Reads a file of write_tokens(): the index first, then the blocks in order, a bounded number at a time."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        stream.seek(size - 24)
        tail = stream.read(24)
        n_index, self.n_ids = struct.unpack("<QQ", tail[:16])
        if tail[16:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        self.end = size - 24 - n_index
        stream.seek(self.end)
        index = zlib.decompress(stream.read(n_index))
        n = struct.unpack("<Q", index[:8])[0]
        ids = np.frombuffer(index, "<i8", n, 8).tolist()
        nulls = np.frombuffer(index, np.uint8, n, 8 + 8 * n)
        self.doc_ids = [None if z else i for i, z in zip(ids, nulls.tolist())]
        self.tokens = np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64)

    def blocks(self) -> Iterator[np.ndarray]:
        """The ids, a block at a time; a block whose ids do not fit its checksum is an error."""
        self.stream.seek(0)
        if self.stream.read(8) != MAGIC:
            raise ValueError("not a token file")
        at = 8
        while at < self.end:
            m, n, crc = struct.unpack("<III", self.stream.read(12))
            ids = decode_blocks([(m, self.stream.read(n))])
            if checksum(ids) != crc:
                raise ValueError("a block's ids do not fit its checksum")
            at += 12 + n
            yield ids

    def documents(self, keep: bool) -> Iterator[tuple[int | None, int, int, int, list[int] | None]]:
        """(doc id, start in the file, tokens, crc32 of its ids, ids if kept)."""
        blocks, data, at, start = self.blocks(), b"", 0, 0
        for doc, n in zip(self.doc_ids, self.tokens.tolist()):
            left, crc, kept = 4 * n, 0, []
            while left:
                if at == len(data):
                    data, at = next(blocks).astype("<u4").tobytes(), 0
                part = data[at : at + left]
                crc = zlib.crc32(part, crc)
                left, at = left - len(part), at + len(part)
                if keep:
                    kept.append(part)
            yield doc, start, n, crc, np.frombuffer(b"".join(kept), "<u4").tolist() if keep else None
            start += n


def read_tokens(manifest: DataFrame, with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(doc id, start, n_tokens, ids_crc32, ids) of the documents in the files of a manifest; start counts the ids of all
    documents before, over the files in order; ids are null unless asked for."""
    # a row for each file: their number is that of the writing tasks
    before = F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file_no", "path", F.coalesce(before, F.lit(0)).alias("base"))
    files = spread(files, "file_no").select("path", "base")
    kinds = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as stream:
                    rows = []
                    for doc, start, n, crc, ids in TokenFile(stream).documents(with_ids):
                        rows.append((doc, base + start, n, crc, ids))
                        if len(rows) == (200 if with_ids else 5000):
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    return files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, ids array<int>").withColumnRenamed("id", id_col)
