"""Compression classifier: zstandard dictionaries built from good and bad labelled text.

A text is cut into blocks of bytes that are compressed twice, with the dictionary of good and with that of bad
text. The difference of the two compressed sizes, normalised by the size of the text, says which sort of text the
blocks resemble; a logistic curve, fitted on labelled rows that the dictionaries have not seen, turns it into a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import slices, texts_of


@dataclass(frozen=True)
class Compressors:
    """Two dictionaries and the curve, which holds a weight for each of _inputs(). Short texts are drawn to a fixed value:
    they count as if `shrink` more bytes, of which the good dictionary saves `doubt` more, stood before them."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    block: int = 512
    level: int = 3
    shrink: int = 128
    doubt: int = 4

    def measures(self) -> "Measure":
        return Measure(self)


#: The values of shrink and doubt that the training rows choose from.
SHRINKS, DOUBTS = (32, 64, 128, 256, 512), (0, 2, 4, 8, 16)


class Measure:
    """Compressed sizes of texts; holds the compressors, one for each dictionary."""

    def __init__(self, model: Compressors):
        import zstandard

        self.model = model
        self.by = [
            zstandard.ZstdCompressor(
                level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            for d in (_dictionary(model.good), _dictionary(model.bad))
        ]

    def sizes(self, text: str) -> tuple[int, int]:
        """What the good dictionary saves over the bad one, and the bytes of the text."""
        raw, n = text.encode("utf-8", "surrogatepass"), self.model.block
        # blocks of nearly equal size, so that no short rest is left
        parts = max(1, round(len(raw) / n))
        cuts = [len(raw) * k // parts for k in range(parts + 1)]
        good, bad = (sum(len(c.compress(raw[a:b])) for a, b in zip(cuts, cuts[1:])) if raw else 0 for c in self.by)
        return bad - good, len(raw)

    def score(self, text: str) -> float:
        saved, n = self.sizes(text)
        x = sum(c * v for c, v in zip(self.model.curve, _inputs((saved + self.model.doubt) / (n + self.model.shrink))))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _inputs(difference: float) -> tuple[float, ...]:
    """What the logistic curve takes: the difference, steeper or flatter above 0."""
    return 1.0, 10 * difference, 10 * max(0.0, difference)


def _dictionary(body: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_AUTO)


def _built(texts: list[str], block: int, size: int) -> bytes:
    """A trained zstandard dictionary; where there is too little text to train one, the text itself."""
    import zstandard

    parts = []
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        parts += [raw[k : k + block] for k in range(0, len(raw), block)]
    total = sum(map(len, parts))
    if total > 20 * size // 10 and len(parts) > 50:
        try:
            return zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[:size]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps; `ridge` holds the slopes of separable data down."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    text_col: str = "text",
    id_col: str = "doc_id",
    max_rows_per_class: int = 2000,
    max_chars: int = 20_000,
    dictionary_bytes: int = 112_640,
    block: int = 1024,
) -> Compressors:
    """Dictionaries and curve from a bounded sample of labelled documents.

    At most max_rows_per_class labelled ids of each class (those of the smallest hash) are taken, and of these the
    documents of at most max_chars characters; that bounds what the driver receives. Rows of other labels, of
    null labels or ids, and empty or null texts teach nothing. Of repeated rows of an id the one of the smallest text
    counts. Without any row of
    a class every score is the share of good labels (one half without labels).
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    )
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    picked = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(max_rows_per_class) for c in (0, 1)
    ]
    sample = F.broadcast(picked[0].union(picked[1]))  # 2 * max_rows_per_class rows of two numbers
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    taught = src.where(F.length("text").between(1, max_chars)).join(sample, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = sorted(taught.select("id", "text", "label").collect(), key=lambda r: r["id"])
    return _model(rows, dictionary_bytes, block)


def _model(rows, dictionary_bytes: int, block: int) -> Compressors:
    split = [(zlib.crc32(f"fit {r['id']}".encode()) % 2, r["label"], r["text"]) for r in rows]
    by = {(s, c): [t for a, b, t in split if (a, b) == (s, c)] for s in (0, 1) for c in (0, 1)}
    good, bad = len(by[0, 1]) + len(by[1, 1]), len(by[0, 0]) + len(by[1, 0])
    if not all(by.values()):
        p = (good + 1) / (good + bad + 2)
        return Compressors(b"", b"", (math.log(p / (1 - p)), 0.0, 0.0), block)
    # each half of the rows is measured with dictionaries of the other half; what short texts are drawn to and the curve are
    # fitted to those measures; the dictionaries of all rows serve
    saved, size, y = [], [], []
    for s in (0, 1):
        m = Measure(Compressors(_built(by[s, 1], block, dictionary_bytes), _built(by[s, 0], block, dictionary_bytes), (), block))
        for c in (0, 1):
            found = [m.sizes(t) for t in by[1 - s, c]]
            saved += [f[0] for f in found]
            size += [f[1] for f in found]
            y += [c] * len(found)
    curve, shrink, doubt = _chosen(np.array(saved, float), np.array(size, float), np.array(y, float))
    all_good, all_bad = (_built(by[0, c] + by[1, c], block, dictionary_bytes) for c in (1, 0))
    return Compressors(all_good, all_bad, curve, block, shrink=shrink, doubt=doubt)


def _chosen(saved: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], int, int]:
    """(curve, shrink, doubt) of the least logarithmic loss on these rows, of equal ones the first."""
    best = None
    for shrink in SHRINKS:
        for doubt in DOUBTS:
            x = np.array([_inputs(d) for d in (saved + doubt) / (size + shrink)])
            curve = _fit(x, y)
            z = np.clip(x @ np.array(curve), -40, 40)
            loss = float(np.mean(np.logaddexp(0.0, z) - y * z))
            if best is None or loss < best[0] - 1e-12:
                best = loss, curve, shrink, doubt
    return best[1:]


def score_quality(
    docs: DataFrame, model: Compressors, text_col: str = "text", id_col: str = "doc_id", keep_columns: bool = False
) -> DataFrame:
    """(doc id, score): likelihood of the good label for each whole text; with keep_columns all columns of docs and score.

    Null texts score as empty ones do; repeated and null ids stay rows of their own; other columns are ignored or, with
    keep_columns, kept, but for one named score; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    if keep_columns:
        src, text = docs.select(*[c for c in docs.columns if c != "score"]), text_col
        kept = src.columns
    else:
        src, text = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text")), "__text"
        kept = [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = shared.value.measures()
        for b in slices(batches):
            scores = [measure.score(t) for t in texts_of(b, text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, "score"])

    return src.mapInArrow(run, T.StructType([*(src.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))


def in_training_fold(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text (a null id: no text) is not 0 modulo 5: the only ones whose labels may be
    learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0
