"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every run of words of every item. Training texts are streamed through it: at each word it knows
the longest run that ends there and occurs in some item. Runs of 13 words (or a whole shorter item) are windows; words
inside windows are hit. Stretches in which no two neighbouring words are neighbours in an item cannot match more than
one word, so they are passed over with array operations, and the automaton starts afresh behind them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import new_path, slices, texts_of, written

#: Bytes of words as they are: 0-9, a-z (A-Z in lower case) and all bytes of characters from U+0080 on; others part words.
_WORD_BYTES = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the word ids of items [(name, words), ...]."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 13):
        self.window = window
        self.word = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        runs = [[self.word.setdefault(w, len(self.word)) for w in ws] for _, ws in items]
        for ids in runs:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.names = [name for name, _ in items]
        n = len(self.length)
        self.holders: list[set[int]] = [set() for _ in range(n)]
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, ids in enumerate(runs):
            at = 0
            for c in ids:
                at = self.step[at][c]
                up = at
                while up > 0 and k not in self.holders[up]:
                    self.holders[up].add(k)
                    up = self.link[up]
            if 0 < len(ids) < window:
                while self.length[self.link[at]] >= len(ids):
                    at = self.link[at]
                self.short[at].append((len(ids), k))
        self.any_short = [False] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.any_short[s] = bool(self.short[s]) or self.any_short[self.link[s]]
        self.least = min([min(window, len(x)) for x in runs if x], default=0)
        pairs = {a * len(self.word) + b for ids in runs for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.length)
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = len(self.length)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = twin
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words inside windows, and the items whose windows occur."""
        state = length = 0
        spans: list[list[int]] = []
        found: set[int] = set()
        for i, c in enumerate(ids):
            while state and c not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.step[state]:
                state = self.step[state][c]
                length += 1
            else:
                length = 0
            most = 0
            if length >= self.window:
                most, up = self.window, state
                while self.length[self.link[up]] >= self.window:
                    up = self.link[up]
                found |= self.holders[up]
            if length and self.any_short[state]:
                up = state
                while up > 0:
                    for n, k in self.short[up]:
                        if n <= length:
                            most = max(most, n)
                            found.add(k)
                    up = self.link[up]
            if most:
                start = i + 1 - most
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], found

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """stream() for many texts; only stretches that could hold a window reach the automaton."""
        out: list = [([], set()) for _ in texts]
        if not self.least:
            return out
        counts = np.array([len(x) + 1 for x in texts], np.int64)
        get = self.word.get
        ids = np.fromiter((get(w, -1) for ws in texts for w in (*ws, None)), np.int64, int(counts.sum()))
        if self.least >= 2:
            near = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            keys = ids[near] * len(self.word) + ids[near + 1]
            spot = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
            good = np.zeros(len(ids) + 1, bool)
            if len(self.pairs):
                good[1:-1][near[self.pairs[spot] == keys]] = True
            need = self.least - 1
        else:
            good = np.concatenate(([False], ids >= 0, [False]))
            need = 1
        edge = np.flatnonzero(good[1:] != good[:-1])
        first, last = edge[::2], edge[1::2]
        long_enough = last - first >= need
        starts = np.cumsum(counts) - counts
        for a, b in zip(first[long_enough].tolist(), last[long_enough].tolist()):
            doc = int(np.searchsorted(starts, a, "right")) - 1
            spans, found = self.stream(ids[a : b + (self.least >= 2)].tolist())
            off = a - int(starts[doc])
            out[doc][0].extend((x + off, y + off) for x, y in spans)
            out[doc][1].update(found)
        return out


def text_digest(text_col: str = "text") -> Column:
    """What rows of equal text share; null is the empty text."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _written_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> list[str]:
    """Folders of tables (name, words), one for each block of about block_words words; items are dealt out by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [words_of(t) for t in texts_of(b)]
            cols = [b.column("name"), pa.array([b" ".join(w) for w in words], pa.binary()), pa.array(list(map(len, words)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["name", "words", "n"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("text"))
    known = written(named.mapInArrow(run, "name string, words binary, n long").where("n > 0").distinct(), "benchmark-words")
    n = max(1, math.ceil((known.agg(F.sum("n")).first()[0] or 0) / block_words))
    dealt = known.select("name", "words", F.pmod(F.xxhash64("name", "words"), F.lit(n)).alias("blk"))
    folder = new_path(items.sparkSession, "benchmark-blocks")
    dealt.repartition("blk").write.partitionBy("blk").parquet(folder)
    return [f"{folder}/blk={r['blk']}" for r in dealt.select("blk").distinct().orderBy("blk").collect()]  # a name for each


def _read_block(folder: str | None) -> list[tuple[str, list[bytes]]]:
    from pyarrow import fs, parquet

    if folder is None:
        return []
    store, base = fs.FileSystem.from_uri(folder)
    rows = parquet.read_table(base, filesystem=store, columns=["name", "words"])
    return sorted(zip(rows["name"].to_pylist(), (w.split(b" ") for w in rows["words"].to_pylist())))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    block_words: int = 500_000,
) -> DataFrame:
    """(doc id, digest, n_words, spans array<struct<start,end>> in words, items array<string> sorted).

    Null or empty texts have no words and no spans; items without a word match nothing; a null item id is the name ''.
    Items of one id count once. Repeated or null doc ids stay rows of their own. Other columns are ignored; an empty
    benchmark gives no spans; no documents give no rows. Items are cut into words by tasks and written in blocks of
    about block_words words, which tasks read themselves: the documents are read once for each block, and the blocks'
    spans are joined by text_digest(), the column digest.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_digest(text_col).alias("digest"))
    kind = "id long, digest string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scanner(folder: str | None, all_rows: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(_read_block(folder), window)
            for b in slices(batches, 300):
                part = texts_of(b)
                words = [words_of(t) for t in part]
                found = automaton.scan(words)
                keep = [i for i in range(len(part)) if all_rows or found[i][0]]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").take(pa.array(keep, pa.int64())),
                        b.column("digest").take(pa.array(keep, pa.int64())),
                        pa.array([len(words[i]) for i in keep], pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in found[i][0]] for i in keep], spans_type),
                        pa.array([sorted({automaton.names[k] for k in found[i][1]}) for i in keep], pa.list_(pa.string())),
                    ],
                    ["id", "digest", "n_words", "spans", "items"],
                )

        return src.mapInArrow(run, kind)

    blocks = _written_blocks(benchmark, item_id_col, item_text_col, block_words)
    out = scanner(blocks[0] if blocks else None, True)
    for block in blocks[1:]:
        more = scanner(block, False).dropDuplicates(["digest"]).select("digest", F.col("spans").alias("s2"), F.col("items").alias("i2"))
        joined = out.join(more, "digest", "left").select(
            "id",
            "digest",
            "n_words",
            F.concat("spans", F.coalesce("s2", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
            F.array_sort(F.array_union("items", F.coalesce("i2", F.array().cast("array<string>")))).alias("items"),
        )
        out = written(joined, "contamination")
    return out.select(F.col("id").alias(id_col), "digest", "n_words", _united("spans").alias("spans"), "items")


def _united(spans: str):
    """Overlapping and touching spans united, in order."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, x):
        tail = F.try_element_at(done, F.lit(-1))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        joined = F.struct(tail["start"].alias("start"), F.greatest(tail["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (tail["end"] >= x["start"]), F.concat(head, F.array(joined))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.when(F.size(spans) < 2, F.col(spans)).otherwise(F.aggregate(F.array_sort(spans), empty, add))


def judged(found: DataFrame, id_col: str = "doc_id", per_hit: int = 20) -> DataFrame:
    """contamination() with n_hit, n_items, items_sha256 and contaminated: hit words are a twentieth of all at least."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return found.select(
        id_col,
        "digest",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (per_hit * n_hit >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def cut_spans(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the words of the found spans cut out of their texts, with what stands between those words.

    Texts and spans are matched by text_digest(), so repeated and null ids do no harm; null texts stay null, texts
    without spans as they are, and no rows give no rows.
    """
    kind = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, spans in zip(b.column(text_col).to_pylist(), b.column("__spans").to_pylist()):
                texts.append(_cut(t, [(s["start"], s["end"]) for s in spans]) if t and spans else t)
            cols = [pa.array(texts, pa.string()) if f == text_col else b.column(f) for f in kind.names]
            yield pa.RecordBatch.from_arrays(cols, kind.names)

    spans = found.where(F.size("spans") > 0).select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans")).dropDuplicates(["__digest"])
    return docs.withColumn("__digest", text_digest(text_col)).join(spans, "__digest", "left").select(*kind.names, "__spans").mapInArrow(run, kind)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    folded, at, places = raw.translate(_WORD_BYTES), 0, []
    for w in folded.split():
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
