"""Ranked lexical search with inverted treaps.

Documents are dealt out in blocks. In a block every term of the queries has a treap over its postings: a search tree by
document, a heap by impact, which is what an occurrence adds to a score but for the term's weight. A query walks the
treaps of all its terms at once over intervals of documents. In an interval the topmost node of each treap has that
term's largest impact, so the sum of these bounds every score inside: an interval whose bound cannot enter the best k is
left out with all that is below, another one is split at the document of its heaviest node, which is scored.

Intervals of many queries are walked abreast with array operations. Blocks are bounded, so a term that all documents hold
is as many treaps as there are blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import bloom_bits, bloom_has, new_path, slices, texts_of, written
from scanloom.llm.decontaminate import _WORD_BYTES

#: Weights and lengths of the score (fixed values of the contract).
LENGTH_SHARE, PER_TF, PER_LENGTH, IMPACT_UNIT = 75, 1000, 8, 1_000_000_000

_POSTINGS = "block long, term binary, docs array<int>, tfs array<int>, ids array<long>, lengths array<long>"


def _word_parts(text: str, at_once: int = 4_000_000) -> Iterator[list[bytes]]:
    """The terms of a text, A-Z in lower case, in lists of about at_once bytes of text."""
    raw = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= at_once else raw.find(b" ", at + at_once)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


class _Block:
    """Documents of one block: their terms as (term code, document, occurrences)."""

    def __init__(self, wanted: np.ndarray | None):
        self.wanted = wanted
        self.code: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.words: list[bytes] = []
        self.owner: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        n = 0
        for words in _word_parts(text):
            n += len(words)
            self.words += words
            self.owner.append((len(self.ids), len(words)))
            if len(self.words) > 300_000:
                self.sum_up()
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.bytes += len(text)

    def sum_up(self) -> None:
        if not self.words:
            return
        doc = np.repeat(*np.array(self.owner, np.int64).T)
        coded = pa.array(self.words, pa.binary()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        own = np.full(len(names), -1, np.int64)
        asked = np.arange(len(names)) if self.wanted is None else np.flatnonzero(bloom_has(self.wanted, _hashes(names)))
        own[asked] = [self.code.setdefault(names[i], len(self.code)) for i in asked.tolist()]
        at = own[coded.indices.to_numpy()]
        keys, tf = np.unique((at << 32 | doc)[at >= 0], return_counts=True)
        self.parts.append((keys >> 32, keys & 0xFFFFFFFF, tf))
        self.words, self.owner = [], []

    def batch(self, block: int) -> pa.RecordBatch:
        """Postings by term, documents in the order of their ids (null ids last); and a row without a term, which holds
        the ids and lengths of all documents."""
        self.sum_up()
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        none = np.empty(0, np.int64)
        code, doc, tf = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (none, none, none)
        keys, spot = np.unique(code << 32 | place[doc], return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, spot, tf)
        terms, starts = np.unique(keys >> 32, return_index=True)
        names = np.array(list(self.code), object)[terms]
        ends = pa.array(np.concatenate((starts, [len(keys), len(keys)])), pa.int32())
        lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x, pa.int32()))
        n = len(terms)
        last = lambda x: pa.array([None] * n + [x], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, block)),
                pa.array([*names, None], pa.binary()),
                lists(keys & 0xFFFFFFFF),
                lists(total),
                last([self.ids[k] for k in order]),
                last([self.lengths[k] for k in order]),
            ],
            ["block", "term", "docs", "tfs", "ids", "lengths"],
        )


def index_postings(docs: DataFrame, wanted: np.ndarray | None = None, block_docs: int = 8192, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Postings by block and term, written to the shared folder. `wanted` is a Bloom filter of terms: others are left out.

    Every row of docs is a document of its own; null texts have no terms. A block has at most block_docs documents, and
    ends with a document that fills 16 million characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, n = _Block(wanted), TaskContext.get().partitionId() << 32
        for b in slices(batches, 300):
            for doc_id, text in zip(b.column("id").to_pylist(), texts_of(b)):
                block.add(doc_id, text)
                if len(block.ids) >= block_docs or block.bytes >= 16_000_000:
                    yield block.batch(n)
                    block, n = _Block(wanted), n + 1
        if block.ids:
            yield block.batch(n)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(src.mapInArrow(run, _POSTINGS), "postings")


class Treaps:
    """The treaps of a block, one for each term: postings in the order of documents, with impacts and children."""

    def __init__(self, terms: list[bytes], sizes: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        """The postings of all terms, one term after the other, and how many each has."""
        self.start, self.doc, self.impact = np.cumsum(sizes) - sizes, doc, impact
        self.left, self.right = np.full(len(self.doc), -1, np.int64), np.full(len(self.doc), -1, np.int64)
        # equal impacts are told apart by a scattered number of the document, or copies would make a treap a list
        self.order = self.impact << 16 | (self.doc * 40503 & 0xFFFF)
        self.root = np.array([self._build(a, n) for a, n in zip(self.start.tolist(), sizes.tolist())], np.int64)
        self.term = {t: k for k, t in enumerate(terms)}

    def _build(self, start: int, n: int) -> int:
        """Links the postings from start on; gives the root."""
        order = self.order[start : start + n].tolist()
        left, right, path = [-1] * n, [-1] * n, []
        for k, x in enumerate(order):
            below = -1
            while path and order[path[-1]] < x:
                below = path.pop()
            left[k] = below if below < 0 else below + start
            if path:
                right[path[-1]] = k + start
            path.append(k)
        self.left[start : start + n], self.right[start : start + n] = left, right
        return path[0] + start

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From each node, the topmost node of its subtree among the documents low to high, or -1."""
        node = node.copy()
        todo = np.arange(len(node))
        while len(todo):
            at = node[todo]
            doc = self.doc[at]
            over, under = doc > high[todo], doc < low[todo]
            out = over | under
            todo, at, over = todo[out], at[out], over[out]
            node[todo] = np.where(over, self.left[at], self.right[at])
            todo = todo[node[todo] >= 0]
        return node


def _segments(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


class Walk:
    """The best k documents of queries in one block. query: for each, the numbers of its terms' treaps and their weights."""

    def __init__(self, treaps: Treaps, n_docs: int, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray):
        self.t, self.k, self.floor = treaps, k, floor
        n = len(queries)
        self.best = np.empty((0, 3), np.int64)  # query, score, document
        self.least, self.last = floor.copy(), np.full(n, n_docs, np.int64)  # score and document of each query's k-th
        self.visited = 0
        size = np.array([len(x) for x, _ in queries], np.int64)
        some = np.flatnonzero(size > 0)
        if len(some):
            entry = np.repeat(np.arange(len(some)), size[some])
            node = np.concatenate([treaps.root[queries[q][0]] for q in some])
            weight = np.concatenate([queries[q][1] for q in some])
            self.run((some, np.zeros(len(some), np.int64), np.full(len(some), n_docs - 1)), (entry, node, weight))

    def run(self, spans, entries, at_once: int = 400_000) -> None:
        stack = [(spans, entries)]
        while stack:
            (query, low, high), (entry, node, weight) = stack.pop()
            first = np.searchsorted(entry, np.arange(len(query)))
            worth = weight * self.t.impact[node]
            bound = np.add.reduceat(worth, first)
            go = (bound > self.least[query]) | (bound == self.least[query]) & (low <= self.last[query])
            if not go.all():
                take = go[entry]
                query, low, high, bound = query[go], low[go], high[go], bound[go]
                entry, node, weight, worth = (np.cumsum(go) - 1)[entry[take]], node[take], weight[take], worth[take]
                if not len(query):
                    continue
                first = np.searchsorted(entry, np.arange(len(query)))
            if len(entry) > at_once and len(query) > 1:  # the half of the higher bounds comes first
                high_half = bound >= np.partition(bound, len(bound) // 2)[len(bound) // 2]
                if high_half.all():
                    high_half[len(high_half) // 2 :] = False
                for half in (~high_half, high_half):
                    take = half[entry]
                    stack.append(((query[half], low[half], high[half]), ((np.cumsum(half) - 1)[entry[take]], node[take], weight[take])))
                continue
            self.visited += len(query)
            top = np.maximum.reduceat(worth, first)
            is_top = np.flatnonzero(worth == np.repeat(top, _segments(first, len(entry))))
            pivot = is_top[np.searchsorted(entry[is_top], np.arange(len(query)))]
            doc = self.t.doc[node[pivot]]
            at = self.t.within(node, doc[entry], doc[entry])
            self._offer(query, np.add.reduceat(np.where(at >= 0, weight * self.t.impact[at], 0), first), doc)
            n = len(query)
            new_low, new_high = np.concatenate((low, doc + 1)), np.concatenate((doc - 1, high))
            entry = np.concatenate((entry, entry + n))
            node = self.t.within(np.concatenate((node, node)), new_low[entry], new_high[entry])
            left = node >= 0
            entry, node, weight = entry[left], node[left], np.concatenate((weight, weight))[left]
            if len(entry):
                some, entry = np.unique(entry, return_inverse=True)
                stack.append(((np.concatenate((query, query))[some], new_low[some], new_high[some]), (entry, node, weight)))

    def _offer(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least[query])
        if not good.any():
            return
        x = np.concatenate((self.best, np.stack((query[good], score[good], doc[good]), 1)))
        x = x[np.lexsort((x[:, 2], -x[:, 1], x[:, 0]))]
        first = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0])))
        rank = np.arange(len(x)) - np.repeat(first, _segments(first, len(x)))
        self.best = x[rank < self.k]
        full = x[rank == self.k - 1]
        self.least[full[:, 0]] = np.maximum(self.floor[full[:, 0]], full[:, 1])
        self.last[full[:, 0]] = np.where(full[:, 1] >= self.floor[full[:, 0]], full[:, 2], self.last[full[:, 0]])


def _query_terms(queries: DataFrame) -> DataFrame:
    """(key, term, times, hash): each distinct term of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for key, text in zip(b.column("key").to_pylist(), texts_of(b)):
                for words in _word_parts(text):
                    names, times = np.unique(np.array(words, object), return_counts=True) if words else ([], [])
                    names = list(names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(names), pa.int64()), pa.array(names, pa.binary()), pa.array(times, pa.int64()), pa.array(_hashes(names))],
                        ["key", "term", "times", "hash"],
                    )

    parts = queries.mapInArrow(run, "key long, term binary, times long, hash long")
    return written(parts.groupBy("key", "term", "hash").agg(F.sum("times").alias("times")), "query-terms")


def _written_chunks(weighted: DataFrame, chunk_terms: int) -> list[str]:
    """Folders of queries (key, terms, weights), about chunk_terms terms each, which tasks read one at a time."""
    n = max(1, math.ceil(weighted.count() / chunk_terms))
    rows = weighted.groupBy("key").agg(F.collect_list(F.struct("term", "weight")).alias("x"))
    rows = rows.select("key", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"), F.pmod(F.xxhash64("key"), F.lit(n)).alias("chunk"))
    folder = new_path(weighted.sparkSession, "queries")
    rows.repartition("chunk").write.partitionBy("chunk").parquet(folder)
    return [f"{folder}/chunk={r['chunk']}" for r in rows.select("chunk").distinct().orderBy("chunk").collect()]  # a name for each


_LAST: dict[str, list] = {}


def _read_chunk(folder: str) -> list[tuple[int, list[bytes], list[int]]]:
    """The queries of a folder; a worker keeps those that it read last."""
    from pyarrow import fs, parquet

    if folder not in _LAST:
        store, base = fs.FileSystem.from_uri(folder)
        x = parquet.read_table(base, filesystem=store, columns=["key", "terms", "weights"])
        _LAST.clear()
        _LAST[folder] = list(zip(x["key"].to_pylist(), x["terms"].to_pylist(), x["weights"].to_pylist()))
    return _LAST[folder]


def block_treaps(rows: pa.Table, n_docs: int, n_terms: int) -> tuple[Treaps, list[int | None]]:
    """The treaps of one block's rows of index_postings(), and its documents' ids. n_docs and n_terms are of all blocks."""
    whole = rows.filter(rows["term"].is_null()).slice(0, 1)
    ids = whole["ids"].to_pylist()[0]
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * np.array(whole["lengths"].to_pylist()[0], np.int64) * n_docs) // max(1, n_terms)
    rows = rows.filter(rows["term"].is_valid()).combine_chunks()
    doc, tf = (pc.list_flatten(rows[c]).to_numpy().astype(np.int64) for c in ("docs", "tfs"))
    impact = (IMPACT_UNIT * tf) // (PER_TF * tf + PER_LENGTH * m[doc])
    return Treaps(rows["term"].to_pylist(), pc.list_value_length(rows["docs"]).to_numpy().astype(np.int64), doc, impact), ids


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, block_docs: int = 8192, chunk_terms: int = 1_000_000,
    text_col: str = "text", id_col: str = "doc_id", query_text_col: str = "text", query_id_col: str = "item_id",
) -> DataFrame:
    """(query id, rank, doc id, score): each query's k documents of the highest scores above 0, equal scores by id.

    A document's score sums, over the query's terms with repeats, floor(1000 ln((2N+2)/(2df+1))) times the impact
    (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L; integers but for the logarithm. Every row of docs is a
    document; null ids are last among equal scores; null or empty texts have no terms and are not counted in N. Each row
    of queries is a query, equal rows are one; a query without a known term has no rows. Other columns are ignored; no
    documents or no queries give no rows.

    Postings are made of all documents, for the terms of the queries; blocks of them are searched apart, and only their
    k best meet. Queries are read by tasks from the shared folder, in chunks of about chunk_terms terms.
    """
    asked = queries.select(F.col(query_id_col).alias("item"), F.col(query_text_col).cast("string").alias("text")).distinct()
    asked = written(asked.withColumn("key", F.monotonically_increasing_id()), "queries")
    terms = _query_terms(asked)
    postings = index_postings(docs, bloom_bits(terms, "hash"), block_docs, text_col, id_col)
    whole = postings.where("term is null")
    n_docs, n_terms = whole.select(
        F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("l")
    ).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    known = postings.where("term is not null").join(terms.select("term").distinct(), "term", "left_semi")
    held = known.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    chunks = _written_chunks(terms.join(held, "term").select("key", "term", (weight * F.col("times")).alias("weight")), chunk_terms)

    def run(rows: pa.Table) -> pa.Table:
        treaps, ids = block_treaps(rows, n_docs, n_terms)
        out = []
        for folder in chunks:
            asked = _read_chunk(folder)
            found = []
            for _, names, weights in asked:
                own = [(treaps.term[t], w) for t, w in zip(names, weights) if t in treaps.term]
                found.append(tuple(np.array(own, np.int64).reshape(-1, 2).T))
            walk = Walk(treaps, len(ids), found, k, np.zeros(len(found), np.int64))
            keys = [x[0] for x in asked]
            out += [(keys[q], ids[d], s) for q, s, d in walk.best.tolist()]
        cols = zip(*out) if out else ([], [], [])
        return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["key", "doc", "score"])

    local = known.select(whole.columns).unionByName(whole).groupBy("block").applyInArrow(run, "key long, doc long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item"), "key").select(
        F.col("item").alias(query_id_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"
    )


#: DuckDB's SQL for search() of `benchmark` in `documents`.
ORACLE = r"""
    with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
    s as (select count(*) filter (len(terms) > 0) as docs, cast(sum(len(terms)) as bigint) as words from d),
    p as (select doc_id, any_value(n) as n, term, count(*) as tf
          from (select doc_id, len(terms) as n, unnest(terms) as term from d) group by doc_id, term),
    w as (select term, cast(floor(1000 * ln(cast(2 * (select docs from s) + 2 as double) / (2 * count(*) + 1))) as bigint) as w
          from p group by term),
    q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
    t as (select item_id, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * s.docs) // s.words)))) as score
          from q join w using (term) join p using (term), s group by item_id, doc_id),
    r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from t where score > 0)
    select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from r where rank <= 10"""
