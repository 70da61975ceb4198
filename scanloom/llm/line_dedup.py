"""Line dedup by a segment-partition edit join.

Lines within `edits` edit operations of each other are linked; the edits that count follow the length of the shorter
line in steps. A line is split into edits + 1 segments; of two linked lines, the longer one holds some segment of the
shorter unchanged, at a place that the edits left of it and right of it limit. So the segments (by number, length of the line and text) are an index, and every line probes it with its substrings at
the places that are possible, for every length the other line can have. Lines that meet at a key are verified with a
banded bit-parallel edit distance, many pairs abreast. Classes are connected components; of each class the first line
stays, by document id and line number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import HEAVY, bloom_bits, bloom_has, components, heavy_join, slices, texts_of, written

_NULL_ID = -(2**63)
#: Characters of lines that are compared abreast.
CELLS = 3_000_000


def _line_key(line: str) -> bytes:
    """128 bits: what equal lines share."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _short(keys: list[bytes]) -> np.ndarray:
    """The first halves of keys, which stand for the lines in the index; lines that share one are all compared."""
    return np.frombuffer(b"".join(keys), "<i8")[::2].astype(np.int64)


def _segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 nearly equal segments of a line."""
    n = edits + 1
    cuts = [length * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Steps:
    """How many edits link lines, by the length of the shorter one: `edits` from `least` characters on, and below that
    one less for each halving of the length. Lines of no edits are linked with equal ones only."""

    edits: int
    least: int

    def at(self, n: int) -> int:
        k, left = self.edits, self.least
        while k > 0 and n < left:
            k, left = k - 1, left // 2
        return k if n > k else 0


@lru_cache(maxsize=1 << 14)
def _plan(n: int, edits: int | Steps) -> tuple[tuple[tuple[int, int, int], ...], tuple[tuple[int, int, int], ...]]:
    """For lines of n characters the places (from, to, seed) of index keys and of probing keys."""
    at_length = (lambda _: edits) if isinstance(edits, int) else edits.at
    most = at_length(n)
    index = tuple((a, a + m, n * 64 + i) for i, (a, m) in enumerate(_segments(n, most)))
    probes = []
    for shorter in range(max(1, n - most), n + 1):
        by, e = n - shorter, at_length(shorter)
        if by > e:
            continue
        for i, (a, m) in enumerate(_segments(shorter, e)):
            # at most i edits left of segment i and e - i right of it
            lo = max(0, a - i, a + by - (e - i))
            hi = min(n - m, a + i, a + by + (e - i))
            probes += [(at, at + m, shorter * 64 + i) for at in range(lo, hi + 1)]
    return index, tuple(probes)


def segment_keys(line: str, edits: int | Steps) -> tuple[list[int], list[int]]:
    """Index keys of a line, and the keys that it probes for lines that are at most as long."""
    ask = xxhash.xxh3_64_intdigest
    if line.isascii():  # characters are bytes
        raw = line.encode()
        return tuple([ask(raw[a:b], seed=s) for a, b, s in places] for places in _plan(len(line), edits))
    return tuple([ask(line[a:b].encode("utf-8", "surrogatepass"), seed=s) for a, b, s in places] for places in _plan(len(line), edits))


def within(pairs: list[tuple[str, str]], edits: int | Steps) -> np.ndarray:
    """Which pairs of lines are within `edits` (at most 30) insertions, deletions and substitutions.

    A column of the distance matrix is a word of vertical differences along the diagonal band; all pairs step abreast.
    """
    if not pairs:
        return np.empty(0, bool)
    if isinstance(edits, Steps):
        limit = np.array([edits.at(min(len(a), len(b))) for a, b in pairs])
        out = np.zeros(len(pairs), bool)
        for t in np.unique(limit).tolist():
            some = np.flatnonzero(limit == t)
            out[some] = within([pairs[i] for i in some.tolist()], t)
        return out
    la = np.array([len(a) for a, _ in pairs])
    lb = np.array([len(b) for _, b in pairs])
    out = np.zeros(len(pairs), bool)
    order = np.argsort(lb, kind="stable")
    order = order[np.abs(la - lb)[order] <= edits]
    at = 0
    while at < len(order):  # fewer pairs of longer lines, so that their characters take a bounded space
        longest = lb[order[min(at + 2047, len(order) - 1)]]
        part = order[at : at + max(1, min(2048, CELLS // max(1, longest)))]
        out[part] = _banded([pairs[i][0] for i in part], [pairs[i][1] for i in part], la[part], lb[part], edits)
        at += len(part)
    return out


def _grid(lines: list[str], width: int, before: int, after: int, fill: int) -> np.ndarray:
    grid = np.full((before + width + after, len(lines)), fill, np.uint32)
    for k, x in enumerate(lines):
        grid[before : before + len(x), k] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return grid


def _banded(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, t: int) -> np.ndarray:
    u = np.uint64
    wa, wb = int(la.max()), int(lb.max())
    rows = _grid(a, wa, t, max(0, wb - wa) + 2 * t + 2, 0xFFFFFFFF)
    cols = _grid(b, wb, 0, 0, 0xFFFFFFFE)
    n = len(a)
    vp = np.full(n, (2**64 - 1) << (63 - t) & (2**64 - 1), u)
    vn = np.zeros(n, u)
    dist = np.full(n, t, np.int64)
    top, one = u(1 << 63), u(1)
    done = np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for j in range(wb):
            match = np.zeros(n, u)
            for k in range(2 * t + 1):  # bit 63 - k stands for row j + t - k
                match |= (rows[j + 2 * t - k] == cols[j]).astype(u) << u(63 - k)
            d0 = (((match & vp) + vp) ^ vp) | match | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            # down the band's lower edge while it is inside the matrix, then along the last row
            down = j < la - t
            bit = np.clip(62 - (j - (la - t)), 0, 63).astype(u)
            along = ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64)
            dist += np.where(down, ((d0 & top) == 0).astype(np.int64), along)
            vp = hn | ~((d0 >> one) | hp)
            vn = (d0 >> one) & hp
            done = np.where(lb == j + 1, dist, done)
    return done <= t


def _links(lines: list[str], index: list[int], probe: list[int], edits: int | Steps) -> list[tuple[int, int]]:
    """Links that span all pairs (index line, probing line) within `edits`; pairs that are joined already are passed over."""
    root = list(range(len(lines)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []

    def join(batch: list[tuple[int, int]]) -> None:
        for (x, y), good in zip(batch, within([(lines[x], lines[y]) for x, y in batch], edits)):
            if good and (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((x, y))

    for x in index:
        mine = find(x)
        join([(x, y) for y in probe if x != y and find(y) != mine])
    return out


def _takes_part(line: str, least_chars: int, short_lines: bool) -> bool:
    return len(line) >= least_chars or (short_lines and line != "" and not line.isspace())


def line_classes(
    docs: DataFrame, edits: int, least_chars: int, block: int, text_col: str, id_col: str, short_lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Occurrences (id, doc, line_no, line) of the lines that take part, and links (a, b) of near lines; doc is a digest
    of the text, which with the id tells rows apart."""
    spark = docs.sparkSession
    steps = Steps(edits, least_chars)
    # lines that have edits to be linked by; without short_lines only the long ones take part at all
    near = lambda line: steps.at(len(line)) > 0 and _takes_part(line, least_chars, short_lines)
    src = docs.select(_place_id(id_col), F.xxhash64(text_col).alias("doc"), F.col(text_col).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, nos, keys = [], [], []
            for i, t in enumerate(texts_of(b)):
                for k, line in enumerate(t.split("\n")):
                    if _takes_part(line, least_chars, short_lines):
                        row.append(i)
                        nos.append(k)
                        keys.append(_line_key(line))
            if row:
                at = pa.array(row)
                cols = [b.column("id").take(at), b.column("doc").take(at), pa.array(nos, pa.int32()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "doc", "line_no", "line"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for b in slices(batches):
            keys, lines, counts = [], [], []
            for t in texts_of(b):
                for line in t.split("\n"):
                    if not near(line) or (me := _line_key(line)) in told:
                        continue
                    if len(told) < 200_000:
                        told.add(me)
                    index, probes = segment_keys(line, steps)
                    keys += index
                    keys += probes
                    lines.append(me)
                    counts += (len(index), len(probes))
                if len(keys) > 100_000:  # a document with very many lines
                    yield batch(keys, lines, counts)
                    keys, lines, counts = [], [], []
            if keys:
                yield batch(keys, lines, counts)

    def batch(keys: list[int], lines: list[bytes], counts: list[int]) -> pa.RecordBatch:
        """counts: keys in the index and probing keys, by turns, of each line."""
        n = np.array(counts)
        line = np.repeat(_short(lines), n.reshape(-1, 2).sum(1))
        probing = np.repeat(np.arange(len(n)) % 2 == 1, n)
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(line), pa.array(probing)], ["key", "line", "probing"])

    occurrences = src.mapInArrow(split, "id long, doc long, line_no int, line binary")
    keys = src.select("text").mapInArrow(keyed, "key long, line long, probing boolean")
    by_key = Window.partitionBy("key")
    met = keys.withColumns(
        {
            "lo": F.min("line").over(by_key),
            "hi": F.max("line").over(by_key),
            "least": F.min("probing").over(by_key),
        }
    )
    met = met.where("lo <> hi and not least").select("key", "line", "probing").distinct()
    met = written(met, "lines-met")
    # a key's index lines and its probing lines are dealt out in blocks, and each block meets each: a task gets two
    parts = lambda of, size: F.greatest(F.lit(1), F.ceil(F.count_if(of) / size)).cast("int")
    sizes = met.groupBy("key").agg(parts(~F.col("probing"), block).alias("ni"), parts(F.col("probing"), 2 * block).alias("np"))
    own = lambda n: F.pmod(F.xxhash64("line"), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_index = F.transform(each("np"), lambda k: own("ni") * F.col("np") + k)
    as_probe = F.transform(each("ni"), lambda k: k * F.col("np") + own("np"))
    dealt = met.join(sizes, "key").select("key", "line", "probing", F.explode(F.when(F.col("probing"), as_probe).otherwise(as_index)).alias("blk"))
    wanted = spark.sparkContext.broadcast(bloom_bits(met.select("line"), "line"))

    def of_interest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            lines = [x for t in texts_of(b) for x in t.split("\n") if near(x)]
            keys = [_line_key(x) for x in lines]
            short = _short(keys)
            keep = {keys[i]: i for i in np.flatnonzero(bloom_has(wanted.value, short)).tolist() if keys[i] not in told}
            if len(told) < 200_000:
                told.update(keep)
            bodies = [pack.compress(lines[i].encode("utf-8", "surrogatepass")) for i in keep.values()]
            cols = [pa.array(short[list(keep.values())], pa.int64()), pa.array(list(keep), pa.binary()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["short", "line", "body"])

    texts = src.select("text").mapInArrow(of_interest, "short long, line binary, body binary").dropDuplicates(["line"])
    groups = (
        dealt.withColumnRenamed("line", "short").join(texts, "short").repartition("key", "blk").sortWithinPartitions("key", "blk", "probing", "line").select("key", "blk", "probing", "line", "body")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each block. The pairs of small blocks are verified together, some thousands at a time."""
        unpack = zstandard.ZstdDecompressor()
        now, ids, lines, index, probe, known = None, [], [], [], [], {}
        waiting: dict[tuple[bytes, bytes], tuple[str, str]] = {}

        def linked(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        def verified() -> pa.RecordBatch:
            pairs = list(waiting)
            good = within(list(waiting.values()), steps)
            waiting.clear()
            return linked([p for p, g in zip(pairs, good) if g])

        def block_done() -> Iterator[pa.RecordBatch]:
            if len(index) * len(probe) > 1024:
                yield linked([(ids[x], ids[y]) for x, y in _links(lines, index, probe, steps)])
                return
            for x in index:
                for y in probe:
                    if x != y:
                        pair = (ids[x], ids[y]) if ids[x] < ids[y] else (ids[y], ids[x])
                        waiting[pair] = (lines[x], lines[y])
            if len(waiting) >= 4096:
                yield verified()

        for b in batches:
            for key, blk, probing, line, body in zip(*(b.column(k).to_pylist() for k in ("key", "blk", "probing", "line", "body"))):
                if (key, blk) != now:
                    yield from block_done()
                    now, ids, lines, index, probe, known = (key, blk), [], [], [], [], {}
                if len(probe) >= 2 * block:  # probing lines stream past the block's index lines
                    yield from block_done()
                    n = len(index)  # they come first
                    ids, lines, probe = ids[:n], lines[:n], []
                    known = {x: k for k, x in enumerate(ids)}
                if line not in known:
                    known[line] = len(lines)
                    ids.append(line)
                    lines.append(unpack.decompress(body).decode("utf-8", "surrogatepass"))
                (probe if probing else index).append(known[line])
        yield from block_done()
        yield verified()

    links = groups.mapInArrow(compare, "a binary, b binary").distinct()
    return written(occurrences, "lines"), written(links, "line-links")


def _place_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id")


def dedup_lines(
    docs: DataFrame,
    edits: int = 2,
    least_chars: int = 24,
    block: int = 500,
    text_col: str = "text",
    id_col: str = "doc_id",
    short_lines: bool = False,
) -> DataFrame:
    """docs with repeated lines taken out of the texts, and removed_lines array<int> (numbers from 0, in order).

    Lines are what stands between line feeds; those of fewer than least_chars characters always stay, or with short_lines,
    if they are not blank, take part with fewer edits, as Steps has it: by default one from 12 characters on, and below
    that equal ones only are one class. Of each class of equal or near lines the
    one of the smallest document id, then line number, stays. Null texts stay null, texts whose lines all go are empty.
    A null id is below all others; rows of one id are one document for the order, and equal
    lines at one place of them all stay. Other columns are kept, but a column named removed_lines is replaced; no rows
    give no rows.
    """
    occurrences, links = line_classes(docs, edits, least_chars, block, text_col, id_col, short_lines)
    ends = links.select(F.col("a").alias("line")).union(links.select(F.col("b").alias("line"))).distinct()
    counted = occurrences.groupBy("line").agg(F.count("*").alias("n"))
    some = counted.join(ends.withColumn("linked", F.lit(True)), "line", "left").where("n > 1 or linked").select("line", "n")
    some = written(some, "lines-some")  # only these can go
    heavy = F.col("n") * HEAVY >= some.agg(F.sum("n")).first()[0]
    places = written(heavy_join(occurrences, some, "line", heavy).where("n is not null"), "lines-places")
    firsts = places.groupBy("line").agg(F.min(F.struct("id", "line_no")).alias("first"), F.first("n").alias("n"))
    firsts = written(firsts, "lines-first")
    # a line is known by its first place, so the smallest line of a class holds the class's first place
    nodes = firsts.select("line", F.struct("first.id", "first.line_no", "line").alias("node"))
    pairs = links.join(nodes.toDF("a", "x"), "a").join(nodes.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    classes = components(written(pairs, "line-nodes"))
    classes = classes.select(F.col("node.line").alias("line"), F.struct("label.id", "label.line_no").alias("label"))
    kept = firsts.join(classes, "line", "left").select("line", "n", F.coalesce("label", "first").alias("kept"))
    gone = heavy_join(places.select("id", "doc", "line_no", "line"), written(kept, "lines-kept"), "line", heavy)
    gone = gone.where(F.struct("id", "line_no") != F.col("kept"))
    gone = gone.groupBy("id", "doc").agg(F.collect_set(F.struct("line_no", "line")).alias("__gone"))  # of one text
    columns = [c for c in docs.columns if c != "removed_lines"]
    rows = docs.select(*columns, _place_id(id_col).alias("__id"), F.xxhash64(text_col).alias("__doc"))
    rows = rows.join(gone.toDF("__id", "__doc", "__gone"), ["__id", "__doc"], "left").drop("__id", "__doc")
    kind = T.StructType([*docs.select(*columns).schema, T.StructField("removed_lines", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, removed = [], []
            for t, gone in zip(b.column(text_col).to_pylist(), b.column("__gone").to_pylist()):
                drop = {(g["line_no"], bytes(g["line"])) for g in gone or ()}
                if not t or not drop:
                    texts.append(t)
                    removed.append([])
                    continue
                lines = t.split("\n")
                out = [k for k, x in enumerate(lines) if _takes_part(x, least_chars, short_lines) and (k, _line_key(x)) in drop]
                away = set(out)
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in away))
                removed.append(out)
            cols = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.list_(pa.int32()))], kind.names)

    return rows.mapInArrow(cut, kind)
