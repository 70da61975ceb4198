"""Token counts of texts by a two-tier lookup of pre-tokens, without ids and without a shuffle of pre-tokens.

A SentencePiece text parts into pre-tokens over which no piece reaches, so its length is the sum of theirs. A first scan
finds frequent pre-tokens: each task keeps a summary of bounded size, and summaries are merged in a tree. Their lengths
go to all tasks as a broadcast table. In the second scan a pre-token is looked up there, then in its worker's cache, and
only what neither holds is encoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import slices, texts_of, written
from scanloom.llm.pieces import SPACE, _WORDS

#: Pre-tokens of more characters are not candidates for the table, so that its bytes are bounded as its rows are.
LONGEST = 48
_SUMMARY = "words array<string>, counts array<bigint>"


class PieceLengths:
    """Numbers of ids of pre-tokens as the library encodes them, with a cache of those met before.

    whole_texts tells that some piece reaches over a blank or a line end, so that only whole texts can be encoded."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        self.whole_texts = any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in names)
        self.line_end = len(self.sp.encode("\n"))
        self.cache: dict[str, int] = {}

    def of(self, words: Iterable[str], at_once: int = 20_000) -> dict[str, int]:
        """Behind a line end a pre-token stands without the blank that the library puts before a text."""
        out, left = {}, iter(words)
        while part := list(islice(left, at_once)):
            if self.whole_texts:
                ids = self.sp.encode([w.removeprefix(" ") for w in part], num_threads=1)
                out.update(zip(part, map(len, ids)))
            else:
                ids = self.sp.encode(["\n" + w for w in part], num_threads=1)
                out.update((w, len(x) - self.line_end) for w, x in zip(part, ids))
        return out


_OF_WORKER: dict[str, PieceLengths] = {}


def _of_worker(model: str) -> PieceLengths:
    """The library and the cache that all tasks of one worker share."""
    if model not in _OF_WORKER:
        _OF_WORKER[model] = PieceLengths(model)
    return _OF_WORKER[model]


def pre_tokens(text: str, whole: bool = False, at_once: int = 100_000) -> Iterator[list[str]]:
    """The pre-tokens of a text in lists of at most at_once, the dummy prefix included; an empty text has none."""
    if text and whole:
        yield [" " + text.replace(SPACE, " ")]
    elif text:
        found = (m.group() for m in _WORDS.finditer(" " + text.replace(SPACE, " ")))
        if len(text) < at_once:
            yield _WORDS.findall(" " + text.replace(SPACE, " "))
        else:
            while part := list(islice(found, at_once)):
                yield part


def _kept(counts: Counter, slots: int) -> Counter:
    """At most `slots` counters: the smallest go and the largest of those is taken from the others, so that two summaries
    can be added, and no pre-token that makes up more than one in `slots` of all is lost (Misra and Gries)."""
    if len(counts) <= slots:
        return counts
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    cut = ranked[slots][1]
    return Counter({w: n - cut for w, n in ranked[:slots] if n > cut})


def _as_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], ["words", "counts"]
    )


def frequent_lengths(docs: DataFrame, model: str, slots: int = 1 << 16, fan_in: int = 32) -> dict[str, int]:
    """The numbers of ids of up to `slots` pre-tokens of all texts, the frequent ones among them.

    Each task sums up its texts in `slots` counters; groups of fan_in summaries are merged until one is left. The driver
    gets one summary, and the shuffles carry summaries, whatever the input's size."""

    def short(counts: Counter) -> Counter:
        return _kept(Counter({w: n for w, n in counts.items() if len(w) <= LONGEST}), slots)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        whole = _of_worker(model).whole_texts
        for b in slices(batches, 300):
            for t in texts_of(b):
                for words in pre_tokens(t, whole):
                    counts.update(words)
                    if len(counts) > 8 * slots:
                        counts = short(counts)
        yield _as_batch(short(counts))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for words, n in zip(b.column("words").to_pylist(), b.column("counts").to_pylist()):
                counts.update(dict(zip(words, n)))
                counts = _kept(counts, slots)
        yield _as_batch(counts)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merge(batches):
            yield _as_batch(Counter(_of_worker(model).of(b.column("words").to_pylist()[0])))

    parts = written(docs.select("text").mapInArrow(scan, _SUMMARY), "pre-tokens")
    while (n := parts.count()) > fan_in:
        parts = written(parts.repartition(-(-n // fan_in)).mapInArrow(merge, _SUMMARY), "pre-tokens")
    last = parts.coalesce(1).mapInArrow(lengths, _SUMMARY).collect()  # one row
    return {w: n for r in last for w, n in zip(r["words"], r["counts"])}


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, slots: int = 1 << 16, cache_words: int = 200_000, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(doc id, n_bytes, n_tokens, over_limit): UTF-8 bytes and SentencePiece ids of each whole text, and whether they are
    more than `limit`.

    Null texts are empty, with no bytes and tokens. Repeated and null ids stay rows of their own; other columns are
    ignored; no rows give no rows. The table holds at most `slots` pre-tokens, a worker's cache about cache_words; both
    change the cost only. Long texts go through in parts. `model` is a path that every executor can open.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = src.sparkSession.sparkContext.broadcast(frequent_lengths(src, model, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, known = _of_worker(model), table.value
        cache = library.cache

        def total(words: list[str]) -> np.ndarray:
            n = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            if (missed := np.flatnonzero(n < 0)).size:
                rest = [words[i] for i in missed.tolist()]
                if len(cache) > cache_words:
                    cache.clear()
                cache.update(library.of({w for w in rest if w not in cache}))
                n[missed] = np.fromiter(map(cache.__getitem__, rest), np.int64, len(rest))
            return n

        for b in slices(batches, 300):
            texts = texts_of(b)
            sums = np.zeros(len(texts), np.int64)
            words, owner = [], []
            for k, t in enumerate(texts):
                for part in pre_tokens(t, library.whole_texts):
                    words += part
                    owner.append((k, len(part)))
                    if len(words) > 200_000:
                        _add(sums, owner, total(words))
                        words, owner = [], []
            _add(sums, owner, total(words))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(sums)], ["id", "n_bytes", "n_tokens"])

    counted = src.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _add(sums: np.ndarray, owner: list[tuple[int, int]], n: np.ndarray) -> None:
    """Adds the lengths n, of runs of pre-tokens (text, how many), to their texts' sums."""
    if owner:
        text, many = np.array(owner, np.int64).T
        np.add.at(sums, text, np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(many)))]))
