"""Helpers that the text operators share: written stages, fixed-size sketches and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.sources.shared import forget, new_path, shared_dir, written

__all__ = ["ASCII_LOWER", "bloom_bits", "HEAVY", "bloom_has", "components", "counter_rows", "forget", "heavy_join", "merged_counters", "mix64", "new_path", "shared_dir", "slices", "spread", "texts_of", "written"]

#: A key that holds a larger share of all rows than one in HEAVY is not dealt out by its value: at most HEAVY keys do.
HEAVY = 1000

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def merged_counters(parts: DataFrame, size: int, combine: str) -> np.ndarray:
    """One array of `size` counters from rows (chunk int, body binary): the chunks that the tasks made are
    added ("sum") or united ("or") by chunk on the executors; the driver gets `size` counters, however large
    the input is."""
    step = {"sum": np.add, "or": np.bitwise_or}[combine]
    dtype = {"sum": np.uint32, "or": np.uint8}[combine]

    def merge(batches):
        import pandas as pd

        out: dict[int, np.ndarray] = {}
        for pdf in batches:
            for chunk, body in zip(pdf["chunk"], pdf["body"]):
                part = np.frombuffer(zlib.decompress(body), dtype)
                out[chunk] = step(out[chunk], part) if chunk in out else part
        yield pd.DataFrame({"chunk": list(out), "body": [zlib.compress(x.tobytes(), 1) for x in out.values()]})

    rows = parts.repartition("chunk").mapInPandas(merge, "chunk int, body binary").collect()
    total = np.zeros(size, dtype)
    for r in rows:
        part = np.frombuffer(zlib.decompress(r["body"]), dtype)
        total[r["chunk"] * len(part) : (r["chunk"] + 1) * len(part)] = part
    return total


def counter_rows(total: np.ndarray, n_chunks: int) -> pa.RecordBatch:
    """A task's counters as rows for merged_counters."""
    parts = np.split(total, n_chunks)
    kept = [k for k, x in enumerate(parts) if x.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array(kept, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in kept], pa.binary())],
        ["chunk", "body"],
    )


def bloom_bits(df: DataFrame, column: str, log2_bits: int = 25) -> np.ndarray:
    """A Bloom filter, of fixed size, over a bigint column. It only thins rows out ahead of an exact join:
    when it fills up, more rows pass and no result changes."""
    n_bytes = 1 << (log2_bits - 3)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bytes, np.uint8)
        for b in batches:
            for at in _bloom_slots(b.column(0).drop_null().to_numpy(zero_copy_only=False), log2_bits):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield counter_rows(bits, 16)

    return merged_counters(df.select(column).mapInArrow(collect, "chunk int, body binary"), n_bytes, "or")


def _bloom_slots(x: np.ndarray, log2_bits: int) -> list[np.ndarray]:
    h = mix64(x.astype(np.int64).view(np.uint64))
    shift, mask = np.uint64(32), np.uint64((1 << log2_bits) - 1)
    return [h & mask, (h >> shift) & mask, (h ^ (h >> np.uint64(17))) & mask]


def bloom_has(bits: np.ndarray, x: np.ndarray, log2_bits: int = 25) -> np.ndarray:
    found = np.ones(len(x), bool)
    for at in _bloom_slots(x, log2_bits):
        found &= ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return found


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixing of uint64 values (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def heavy_join(rows: DataFrame, table: DataFrame, key: str, heavy: Column) -> DataFrame:
    """rows left-joined with table, which is unique by key. `heavy` marks the at most HEAVY rows of table whose keys
    stand in more than one in HEAVY of all rows: these are broadcast, so no task gets all rows of such a key."""
    few = F.broadcast(table.where(heavy))
    rest = rows.join(F.broadcast(table.where(heavy).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(table.where(~heavy), key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b of one sortable type): label is the smallest node reachable.

    Min-label propagation with pointer jumping; each round is written to the shared folder, and they go on until no
    label changes. The rounds needed grow with the logarithm of the longest path. Self-loops keep a node; empty edges
    give an empty result. Joins by a hub or by a common label are followed by no other use of that key, so adaptive
    execution splits them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "cc")
    changed = not labels.isEmpty()
    while changed:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = written(step.join(jump, "next").select("node", F.least("next", "far").alias("label"), F.col("label").alias("old")), "cc")
        forget(labels)
        labels = new
        changed = not new.where("label <> old").isEmpty()
    forget(both)
    return labels.select("node", "label")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that a task holds few texts as Python objects at a time; what
    Arrow's pool and the C library no longer use goes back to the system after each batch, as workers are kept."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()
        _give_back()


def _give_back() -> None:
    """Asks the C library for unused memory, where it knows how to."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spread(files: DataFrame, key: str) -> DataFrame:
    """A table of files, one to a partition: the number is given, as partitions of a few bytes would be put together
    again, and one task would read all files."""
    return files.repartitionByRange(max(1, files.count()), key)
