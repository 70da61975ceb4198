"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles. Sets fall into groups by hubs: each rare token that several sets have names the
set among them whose tokens most sets have, and a set joins the one that most of its tokens name. A group that is larger
than a block is split by the sets' keys, as groups only need to bring similar sets together, and pairs of different
groups are found through the matrix. Near copies of one text name the same hub, whatever was edited in them, so they lie
in few groups, and so do those among them that are similar to no other.

The token-group matrix holds each group's token union, as rows (token, group), over its members' rarest tokens. A set
queries for sets that are not larger than itself. Two sets of n >= m tokens and Jaccard similarity t share t / (1 + t)
(n + m) tokens at least, so a member needs only so many of its rarest tokens in the union that a set of its own size must
share `least_shared` of them, and a query asks with as many as the smallest set that it can be similar to demands. What
many documents have in common is among neither, unless little else is in them. The number of a query's tokens that
stand in a group's row, and what lies outside of both choices, bound its overlap with every member: where the bound is
below what the sizes demand no member can be similar, so only groups that reach it are opened, and only opened groups
compare sets. A token whose holders in a group are all of the query's component counts for nothing there. Nothing is approximate: token frequencies, which come from a fixed-size sketch over all documents, decide
only which tokens count as rare, and every order gives the same links.

The work goes in three steps, each of which spares the next one. Groups are compared inside, which leaves a root for
each class of similar members. Then the roots of such classes query the other groups' roots, so that the blocks of one
large group of near copies meet through a set each and not through all of theirs. Last, all sets query the groups that
do not belong whole to their own component. A task holds a block and a block of queries at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import HEAVY, bloom_bits, bloom_has, components, counter_rows, forget, heavy_join, merged_counters, slices, texts_of, written
from scanloom.llm.shingles import Shingler

SKETCH_LOG2, SKETCH_CHUNKS = 22, 64


def _digest(x: bytes) -> bytes:
    """128-bit key of a token set or a text: equal ones have equal keys."""
    return xxhash.xxh3_128_digest(x)


def _short(key: bytes) -> int:
    """The first half of a key, which stands for it where candidates are looked for; whoever shares it is compared."""
    return int.from_bytes(key[:8], "little", signed=True)


def _front(key: bytes) -> int:
    """The first seven bytes of a key, a number that SQL reads from them, too."""
    return int.from_bytes(key[:7], "big")


class _Members:
    """Sets of a group under one index of their tokens."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def similar(self, x: np.ndarray) -> np.ndarray:
        """Members whose similarity with the set x reaches the threshold."""
        lo, hi = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        n = hi - lo
        if self.num * len(x) > self.den * np.count_nonzero(n):  # the union of all members bounds the overlap with each
            return np.empty(0, np.int64)
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(self.den * both >= self.num * (len(x) + self.sizes - both))


def _roots(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the first one that similar pairs reach.

    Sets that the widest of a few pivots reaches need no further count; all others are counted against all.
    """
    index = _Members(sets, num, den)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # every member but those of one home, which the first pivots find, is counted against all members: of two
    # linked members one at least is, or both belong to the home
    home, most = 0, (0, 0)
    for i in range(len(sets)):
        if i >= 8 and find(i) == find(home):
            continue
        near = index.similar(sets[i]).tolist()
        for j in near:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        if i < 8:
            most = max(most, (len(near), i))
            home = most[1]
    return [find(i) for i in range(len(sets))]


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    words: int = 5,
    num: int = 75,
    den: int = 100,
    block: int = 1500,
    least_shared: int = 4,
) -> DataFrame:
    """(doc id, n_shingles, component_id): documents are linked when den * intersection >= num * union of their
    shingle sets; component_id is the smallest id that links reach.

    Nulls and empty texts: an empty set, linked with nothing, component_id is the own id. Repeated ids stay
    repeated rows. Null ids: a row with null id; its component_id is the smallest id of its component, null if
    there is none. Other columns of docs are ignored; no rows give no rows. Neither block nor least_shared changes a
    result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size, mask = 1 << SKETCH_LOG2, np.uint64((1 << SKETCH_LOG2) - 1)
    names = ["id", "n", "key", "short", "body_key", "chunk", "body"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Set and text keys of the documents, then this task's part of the token-frequency sketch."""
        make, total = Shingler(words), np.zeros(size, np.uint32)
        for b in slices(batches):
            part = texts_of(b)
            sets = make.sets(part)
            np.add.at(total, (np.concatenate(sets) & mask).astype(np.int64), np.uint32(1))
            keys = [_digest(x.tobytes()) if len(x) else None for x in sets]
            cols = [
                b.column("id"),
                [len(x) for x in sets],
                keys,
                [k and _short(k) for k in keys],
                [_digest(t.encode("utf-8", "surrogatepass")) for t in part],
                *([None] * len(sets),) * 2,
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names)
        rows = counter_rows(total, SKETCH_CHUNKS)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(rows.num_rows, k) for k in kinds[:5]), *rows.columns], names)

    scanned = src.mapInArrow(scan, "id long, n long, key binary, short long, body_key binary, chunk int, body binary")
    scanned = written(scanned, "jaccard-scan")
    sketch = spark.sparkContext.broadcast(  # 4 bytes for each of 2^22 counters, whatever the input
        merged_counters(scanned.where("chunk is not null").select("chunk", "body"), size, "sum")
    )
    seen = scanned.where("chunk is null").select("id", "n", "key", "short", "body_key")
    n_docs = seen.count()

    sets = seen.where("key is not null").groupBy("key")
    sets = sets.agg(*(F.min(c).alias(c) for c in ("id", "short", "n", "body_key")), F.count("*").alias("copies"))
    sets = written(sets, "jaccard-distinct")
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, short, often, held) of every set's rarest tokens, those with which it queries; `held` marks those
        of them that stand for it in its group's union. `often`: the token may be held by a share of all documents that
        no task should get alone."""
        make, freq, told = Shingler(words), sketch.value, set()
        for b in slices(batches):
            token, short, often, held = [], [], [], []
            for x in make.sets(texts_of(b)):
                if not len(x) or (k := _short(_digest(x.tobytes()))) in told:
                    continue
                if len(told) < 200_000:
                    told.add(k)
                n = len(x)
                asks, holds = -(-num * n // den), -(-2 * num * n // (num + den))  # shared at least: with any set, with one of n
                share = freq[(x & mask).astype(np.int64)]
                few = np.lexsort((x, share))[: n - asks + min(least_shared, asks)]
                token.append(x[few])
                short.append(np.full(len(few), k, np.int64))
                often.append(share[few].astype(np.int64) * HEAVY >= n_docs)
                held.append(np.arange(len(few)) < n - holds + min(least_shared, holds))
            if token:
                cols = (np.concatenate(c) for c in (token, short, often, held))
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], ["token", "short", "often", "held"])

    probes = src.select("text").mapInArrow(rarest, "token long, short long, often boolean, held boolean")
    probes = written(probes, "jaccard-probes")
    # tokens that stand for some set and are in another one, too
    met = probes.groupBy("token").agg(F.min("short").alias("lo"), F.max("short").alias("hi"), F.max("held").alias("some"), F.max("often").alias("often"))
    met = written(met.where("lo <> hi and some").select("token", "often"), "jaccard-tokens")
    seldom = probes.where("not often").join(met.where("not often"), "token", "left_semi")
    often = probes.where("often").join(met.where("often"), "token", "left_semi")  # a join that can be split where it is skewed
    matrix = seldom.select("token", "short", "held").union(often.select("token", "short", "held"))
    matrix = written(matrix.groupBy("token", "short").agg(F.max("held").alias("held")), "jaccard-matrix")
    forget(probes)

    # a token's hub is, of the sets that have it, the one whose tokens most sets have; a set's group is the hub of most of
    # its tokens, and a set alone if those are few
    ranks = matrix.join(matrix.groupBy("token").agg(F.count("*").alias("sets")), "token").groupBy("short").agg(F.sum("sets").alias("rank"))
    hubs = matrix.join(ranks, "short").groupBy("token").agg(F.max(F.struct("rank", "short")).alias("hub"))
    votes = matrix.join(hubs, "token").groupBy("short", "hub").agg(F.count("*").alias("votes"))
    homes = votes.groupBy("short").agg(F.max(F.struct("votes", "hub")).alias("best")).where(F.col("best.votes") >= least_shared)
    homes = written(homes.select("short", F.col("best.hub.short").alias("hub")), "jaccard-homes")
    large = homes.groupBy("hub").agg(F.ceil(F.count("*") / block).alias("parts")).where("parts > 1")
    large = written(large, "jaccard-large")  # small, or else joined by a shuffle: that is left to its measured size
    part = F.xxhash64("hub", F.pmod("short", "parts"))
    homes = homes.join(large, "hub", "left").select("short", F.when(F.col("parts").isNull(), F.col("hub")).otherwise(part).alias("grp"))
    sets = sets.join(homes, "short", "left").withColumn("grp", F.coalesce("grp", "short"))  # one group where halves of keys are equal
    sets = written(sets, "jaccard-sets")
    in_matrix = matrix.select("short").distinct()
    several = sets.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1").select("grp")
    within = sets.join(several, "grp", "left_semi")
    wanted = within.select("key", "body_key").union(sets.join(in_matrix, "short", "left_semi").select("key", "body_key")).distinct()
    wanted = written(wanted, "jaccard-wanted")
    front = F.conv(F.hex(F.substring("body_key", 1, 7)), 16, 10).cast("long")
    bits = spark.sparkContext.broadcast(bloom_bits(wanted.select(front.alias("front")), "front"))

    def of_interest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(body_key, compressed text) of the texts that some group holds or is queried with, once in a task."""
        told, pack = set(), zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in texts_of(b)]
            found = [_digest(t) for t in texts]
            keys, bodies = [], []
            for i in np.flatnonzero(bloom_has(bits.value, np.array([_front(k) for k in found], np.int64))).tolist():
                if found[i] not in told:
                    if len(told) < 200_000:
                        told.add(found[i])
                    keys.append(found[i])
                    bodies.append(pack.compress(texts[i]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], ["body_key", "body"])

    texts = src.select("text").mapInArrow(of_interest, "body_key binary, body binary").dropDuplicates(["body_key"])
    texts = written(wanted.join(texts, "body_key").select("key", "body"), "jaccard-texts")

    def blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, tuple[np.ndarray, ...]]]:
        """(values of columns, set) of each row."""
        make, unpack = Shingler(words), zstandard.ZstdDecompressor()
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in columns))
            for row, body in zip(rows, b.column("body").to_pylist()):
                yield row, make.sets([unpack.decompress(body).decode("utf-8", "surrogatepass")])[0]

    def compare_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, root) of the members of a group that are similar to another one."""
        now, keys, members = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(members) > 1:
                found = _roots(members, num, den)
                classes = {r for i, r in enumerate(found) if i != r}
                rows = [(keys[i], keys[r]) for i, r in enumerate(found) if r in classes]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["key", "root"])

        for (grp, key), x in blocks(batches, ["grp", "key"]):
            if grp != now:
                yield from done()
                now, keys, members = grp, [], []
            keys.append(key)
            members.append(x)
        yield from done()

    dealt = within.select("key", "grp").join(texts, "key").repartition("grp").sortWithinPartitions("grp", "key")
    classes = written(dealt.mapInArrow(compare_within, "key binary, root binary"), "jaccard-classes")

    def compare_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of queries with members of a block, which come first; one for each component of the members."""
        now, keys, labels, members, index = None, [], [], [], None
        a, b = [], []
        for (grp, blk, role, key, label), x in blocks(batches, ["grp", "blk", "role", "key", "label"]):
            if (grp, blk) != now:
                now, keys, labels, members, index = (grp, blk), [], [], [], None
            if role == 0:
                keys.append(key)
                labels.append(label)
                members.append(x)
                continue
            index = index or _Members(members, num, den)
            met = {labels[j]: keys[j] for j in index.similar(x).tolist()}
            met.pop(label, None)
            a += [key] * len(met)
            b += met.values()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (a, b)], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (a, b)], ["a", "b"])

    def across(some: DataFrame, name: str) -> DataFrame:
        """Links (a, b) between sets of different groups and labels; some is (key, short, grp, n, label)."""
        rows = matrix.select("token", "short", "held").join(some, "short")
        mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("held").alias("some"))
        rows = rows.join(mixed.where("lo <> hi and some").select("token"), "token", "left_semi")
        rows = written(rows.select("token", "key", "grp", "n", "label", "held"), f"jaccard-{name}")
        members = [f(c).alias(k) for f, c, k in ((F.min, "n", "least"), (F.max, "n", "most"), (F.min, "label", "lo"), (F.max, "label", "hi"))]
        unions = rows.where("held").groupBy("token", "grp").agg(*members)
        asking = rows.select("token", "key", "n", "label", F.col("grp").alias("home"))
        # a set queries groups where what holds the token is not all of its label, for members that are not larger than it;
        # of two sets of one size, where no other holds the token, the one in the group of the larger number asks
        pairs = asking.join(unions, "token").where("home <> grp and n >= least and not (lo = hi and lo = label)")
        pairs = pairs.where(f"{num} * n <= {den} * most and not (least = most and n = least and home < grp)")
        shared = pairs.groupBy("key", "grp").agg(F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"), *(F.first(c).alias(c) for c in ("n", "label")))
        asks = lambda c: F.ceil(c * num / den)
        holds = lambda c: F.ceil(2 * num * c / (num + den))
        n, least = F.col("n"), F.greatest("least", asks(F.col("n")))
        rest = F.greatest(asks(n) - F.least(F.lit(least_shared), asks(n)), holds(F.least("most", n)) - F.least(F.lit(least_shared), holds(F.least("most", n))))
        enough = F.col("shared") >= F.least(F.lit(least_shared), asks(n), holds(F.col("least")))
        asked = shared.where(enough & (F.col("shared") + rest >= F.ceil(num * (n + least) / (num + den)))).select("key", "grp", "label")
        asked = written(asked, f"jaccard-{name}-asked")
        # a group's queries are dealt out in blocks, each with all members
        parts = asked.groupBy("grp").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts"))
        queries = asked.join(parts, "grp").select("grp", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("blk"), F.lit(1).alias("role"), "key", "label")
        members = rows.select("key", "grp", "label").distinct().join(parts, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("blk"), F.lit(0).alias("role"), "key", "label")
        dealt = queries.unionByName(members).join(texts, "key").repartition("grp", "blk").sortWithinPartitions("grp", "blk", "role", "key")
        links = written(dealt.mapInArrow(compare_across, "a binary, b binary"), f"jaccard-{name}-links")
        forget(rows, asked)
        return links

    # roots of classes first, then all sets; a group, and so a root, holds a block at most
    rooted = sets.join(classes, "key", "left").select("key", "short", "grp", "n", "id", "copies", F.coalesce("root", "key").alias("root"))
    rooted = written(rooted, "jaccard-rooted")
    reps = rooted.join(classes.where("key = root").select("key"), "key", "left_semi")
    first = across(reps.select("key", "short", "grp", "n", F.col("key").alias("label")), "roots")
    joined = components(first).withColumnRenamed("node", "root")
    labelled = rooted.join(joined, "root", "left").select("key", "short", "grp", "n", F.coalesce("label", "root").alias("label"))
    second = across(labelled.join(in_matrix, "short", "left_semi"), "sets")
    root_of = rooted.select("key", "root")
    second = second.join(root_of.toDF("a", "ra"), "a").join(root_of.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # a root is known by the smallest id of its class, so the smallest root of a component holds the component's
    nodes = rooted.groupBy("root").agg(F.min("id").alias("id"))
    nodes = written(nodes.select("root", F.struct(F.col("id").isNull().alias("none"), "id", "root").alias("node")), "jaccard-nodes")
    links = first.union(second).where("a <> b").distinct().withColumnsRenamed({"a": "x", "b": "y"})
    links = links.join(nodes.toDF("x", "a"), "x").join(nodes.toDF("y", "b"), "y").select("a", "b")
    found = nodes.join(components(written(links, "jaccard-links")), "node", "left")
    found = found.select("root", F.coalesce("label.id", "node.id").alias("component_id"))
    by_set = written(rooted.select("key", "root", "copies").join(found, "root").select("key", "copies", "component_id"), "jaccard-components")
    out = heavy_join(seen.select("id", "n", "key"), by_set, "key", F.col("copies") * HEAVY >= n_docs)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
