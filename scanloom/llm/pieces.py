"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch of texts are laid out as one flat array of symbols. In every round the lowest pair rank of
each word is found with a segmented minimum, its leftmost occurrences are merged in all words at once, and words
without a pair in the vocabulary leave the arrays. The sentencepiece library only reads the vocabulary file.

A text is cut into words at spaces and line ends, over which no vocabulary piece reaches (this is verified when the
vocabulary is read; if some piece does, whole texts are the words).
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import slices, texts_of

SPACE = "▁"
_WORDS = re.compile(r"\n| *[^ \n]+| +")
_NONE = np.int32(2**31 - 1)
codecs.register_error("scanloom_each", lambda e: ("�" * (e.end - e.start), e.end))


def _run(codes) -> int:
    """A key of two or three characters in a row."""
    key = 0
    for c in codes:
        key = key << 21 | c
    return key


class PieceVocabulary:
    """Pieces, pair table and byte pieces of a SentencePiece BPE model without normalisation rules."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        own = {p: i for i, p in enumerate(names) if not special[i]}
        by_rank = sorted(own.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, _NONE, np.int32)
        self.rank[by_rank] = np.arange(len(by_rank), dtype=np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        pairs = {}
        for p, i in own.items():
            if len(p) == 1:
                self.char[ord(p)] = i
            for k in range(1, len(p)):
                if (a := own.get(p[:k])) is not None and (b := own.get(p[k:])) is not None:
                    pairs[a * n + b] = i
        self._table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        runs = {_run(map(ord, p[k : k + 3])) for p in own for k in range(len(p) - 2)}
        self.runs = np.array(sorted(runs | {_run(map(ord, p)) for p in own if len(p) == 2}), np.int64)
        self.whole_texts = any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in own)
        self.byte_ids = np.zeros(256, np.int32)
        raw = []
        for i, p in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            else:
                raw.append(b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
        self.raw = pa.array(raw, pa.binary())
        self.byte_set = frozenset(self.byte_ids.tolist())

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: pair -> merged piece."""
        self.mask = (1 << int(4 * len(keys)).bit_length()) - 1
        self.keys, self.values, self.reach = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32), 0
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[at] == -1]
            spots, first = np.unique(at[self.keys[at] == -1], return_index=True)
            self.keys[spots], self.values[spots] = keys[free[first]], values[free[first]]
            left_mask = self.keys[at] != keys[left]
            left, at = left[left_mask], (at[left_mask] + 1) & self.mask
            self.reach += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        out = np.full(len(a), -1, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[todo].astype(np.int64) * self.size + b[todo]
        at = self._slot(keys)
        for _ in range(self.reach):
            there = self.keys[at]
            hit = there == keys
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (there != -1)
            if not go.any():
                break
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & self.mask
        return out

    def ranks(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces >= 0, self.rank[pieces], _NONE)

    def words(self, text: str) -> list[str]:
        """The words of a text, the dummy prefix included; an empty text has none."""
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        return [text] if self.whole_texts else _WORDS.findall(text)

    def _joins(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether each symbol can ever be merged with the next: some piece is those two characters, or has them and a
        character beside them in a row. All merges make pieces, so where none can reach over, a word can be cut."""

        def known(*at: np.ndarray) -> np.ndarray:
            keys = _run(at)
            return self.runs[np.minimum(np.searchsorted(self.runs, keys), len(self.runs) - 1)] == keys

        joins = np.zeros(len(code), bool)
        if len(code) > 1 and len(self.runs):
            joins[:-1] = known(code[:-1], code[1:])
            three = known(code[:-2], code[1:-1], code[2:]) & (word[:-2] == word[2:])
            joins[:-2] |= three
            joins[1:-1] |= three
            joins[:-1] &= word[1:] == word[:-1]
        return joins

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of the words, and the number of ids of each. Words are merged in the parts that _joins() leaves
        whole, so that a long one takes no more rounds than its longest part."""
        code = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.char[code]
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int32)  # a character without a piece: -1 - code point
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        apart = ~self._joins(code, owner)
        word = np.cumsum(apart) - apart  # from here on a part of a word, as it is merged by itself
        place = np.arange(len(sym))  # where a symbol began: puts finished words back into order
        done_sym, done_word, done_place = [], [], []
        while len(sym):
            made = np.append(self.merged(sym[:-1], sym[1:]), np.int32(-1))
            made[:-1][word[1:] != word[:-1]] = -1
            rank = self.ranks(made)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, starts)
            best = np.repeat(best, np.diff(np.append(starts, len(sym))))
            if (over := best == _NONE).any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                done_place.append(place[over])
                sym, word, place, made, rank, best = (x[~over] for x in (sym, word, place, made, rank, best))
                if not len(sym):
                    break
            take = self._leftmost(sym, word, made, rank, best)
            at = np.flatnonzero(take)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, place = sym[keep], word[keep], place[keep]
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        sym, word, place = map(np.concatenate, (done_sym, done_word, done_place))
        order = np.argsort(place)
        return self._with_bytes(sym[order], owner[place[order]], len(words))

    def _leftmost(self, sym, word, made, rank, best) -> np.ndarray:
        """Where this round merges: the leftmost of overlapping occurrences of each word's best pair. Merging one
        may make a better pair than the next occurrence is; such words merge only their first occurrence."""
        hit = rank == best
        n = len(sym)
        index = np.arange(n)
        broken = np.concatenate(([True], ~hit[:-1]))
        run = np.maximum.accumulate(np.where(broken, index, 0))
        take = hit & ((index - run) % 2 == 0)
        at = np.flatnonzero(take)
        many = np.bincount(word[at] - word[0], minlength=word[-1] - word[0] + 1)[word[at] - word[0]] > 1
        if many.any():
            at = at[many]
            new = made[at]
            after = sym.copy()
            after[np.flatnonzero(take)] = made[take]
            worse = np.zeros(len(at), bool)

            def pair(left, right, ok):
                ok = ok & (left >= 0) & (right >= 0)
                better = self.ranks(self.merged(np.where(ok, left, -1), np.where(ok, right, -1))) < best[at]
                worse[:] |= better

            left, right, left2 = np.maximum(at - 1, 0), np.minimum(at + 2, n - 1), np.maximum(at - 2, 0)
            in_left = (at >= 1) & (word[left] == word[at])
            in_left2 = (at >= 2) & (word[left2] == word[at])
            in_right = (at + 2 < n) & (word[right] == word[at])
            pair(sym[left], new, in_left)
            pair(np.where(take[left2], after[left2], sym[left]), new, in_left2)
            pair(new, sym[right], in_right)
            pair(new, after[right], in_right)
            if worse.any():
                slow = np.unique(word[at[worse]])
                sure = np.flatnonzero(take)
                first = sure[np.concatenate(([True], word[sure][1:] != word[sure][:-1]))]
                take &= ~np.isin(word, slow)
                take[first[np.isin(word[first], slow)]] = True
        return take

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        if (lost := np.flatnonzero(sym < 0)).size:
            parts = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in sym[lost].tolist()]
            width = np.ones(len(sym), np.int64)
            width[lost] = [len(p) for p in parts]
            first = np.cumsum(width) - width
            flat = np.frombuffer(b"".join(parts), np.uint8)
            sym, word = np.repeat(sym, width), np.repeat(word, width)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(width[lost]) - width[lost], width[lost])
            sym[np.repeat(first[lost], width[lost]) + inside] = self.byte_ids[flat]
        return sym, np.bincount(word, minlength=n_words)

    def decode(self, ids: pa.ListArray) -> list[str]:
        """Texts of lists of ids: pieces joined, byte pieces read as UTF-8 (a bad byte is U+FFFD), dummy prefix dropped."""
        flat = pc.take(self.raw, ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py()))
        offsets = pc.subtract(ids.offsets, ids.offsets[0])
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, flat), b"").to_pylist()
        heads = pc.list_slice(ids, 0, 1).to_pylist()
        dummy = [bool(x) and x[0] not in self.byte_set for x in heads]  # a byte piece of a blank stays
        return [(b[1:] if d and b[:1] == b" " else b).decode("utf-8", "scanloom_each") for b, d in zip(joined, dummy)]


class PieceEncoder:
    """Encodes texts word by word; words met before come from a bounded table."""

    def __init__(self, vocabulary: PieceVocabulary, table_words: int = 200_000):
        self.v, self.limit = vocabulary, table_words
        self._clear()

    def _clear(self) -> None:
        self.slot, self.flat, self.start, self.n = {}, [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        self.filled = 0

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.slot) > self.limit:
            self._clear()
        words, counts = [], []
        for t in texts:
            own = self.v.words(t)
            counts.append(len(own))
            words += own
        slot = self.slot
        fresh = [w for w in dict.fromkeys(words) if w not in slot]
        if fresh:
            ids, n = self.v.encode_words(fresh)
            slot.update(zip(fresh, range(len(slot), len(slot) + len(fresh))))
            self.flat.append(ids)
            self.start.append(np.cumsum(n) - n + self.filled)
            self.n.append(n)
            self.filled += len(ids)
        flat, start, n = (x[0] if len(x) == 1 else np.concatenate(x) for x in (self.flat, self.start, self.n))
        self.flat, self.start, self.n = [flat], [start], [n]
        at = np.fromiter(map(slot.__getitem__, words), np.int64, len(words))
        width = n[at]
        ends = np.cumsum(width)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - ends + width, width)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[take], pa.int32()))


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: PieceVocabulary) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """(doc ids, lists of ids) of batches of (id, text), some hundred texts and about a million characters at a time."""
    encoder = PieceEncoder(vocabulary)
    for b in slices(batches, 300):
        texts, at = texts_of(b), 0
        while at < len(texts):
            n, size = 0, 0
            while at + n < len(texts) and (n == 0 or size < 1_000_000):
                size += len(texts[at + n])
                n += 1
            yield b.column("id").slice(at, n), encoder.encode(texts[at : at + n])
            at += n


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc id, ids array<int>): the SentencePiece ids of each whole text, without begin or end ids.

    Null and empty texts have no ids. Repeated and null doc ids stay rows of their own; other columns are
    ignored; no rows give no rows. `model` is a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batches, PieceVocabulary(model)):
            yield pa.RecordBatch.from_arrays([doc, ids], ["id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc id, ids, decoded string): the text of each id list, as the library's decode(ids). Null lists are empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = PieceVocabulary(model)
        for b in slices(batches, 400):
            ids = b.column("ids")
            texts = v.decode(ids if ids.null_count == 0 else pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    src = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_and_decode(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """decode_pieces(encode_pieces(docs)), in one Python worker for each task instead of two that run at once: the ids of
    a few hundred texts are decoded before the next texts are encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = PieceVocabulary(model)
        for doc, ids in _encoded(batches, v):
            yield pa.RecordBatch.from_arrays([doc, ids, pa.array(v.decode(ids), pa.string())], ["id", "ids", "decoded"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)
