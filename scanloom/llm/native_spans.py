"""Places of pattern matches in texts, with native columns only.

A text is split by a pattern and the pattern's matches are extracted: both come from the same leftmost
non-overlapping matches, so the lengths of pieces and matches in turn are the places. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind:int,end:int,value:string>"
NO_SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NO_SPANS)


def spans_of(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, kind, end, value) of the matches of a Java pattern; `keep` says of a match whether it stays."""
    pair = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    first = F.struct(F.lit(0).alias("at"), no_spans().alias("spans"))

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["0"])
        end = start + F.length(F.coalesce(x["1"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["1"].alias("value"))
        good = x["1"].isNotNull() if keep is None else x["1"].isNotNull() & keep(x["1"])
        return F.struct(
            end.alias("at"),
            F.when(good, F.concat(done["spans"], F.array(span).cast(NO_SPANS))).otherwise(done["spans"]).alias("spans"),
        )

    zipped = F.transform(pair, lambda x: F.struct(x["gap"].alias("0"), x["hit"].alias("1")))
    return F.aggregate(zipped, first, add, lambda done: done["spans"])


def in_order(*spans: Column) -> Column:
    """All spans by start, then kind, then end."""
    return F.array_sort(F.concat(*spans))


def told(spans: Column, names: Sequence[str]) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat(F.get(kinds, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")),
        ),
        ",",
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, marks: Sequence[str]) -> Column:
    """The text with every span replaced by its kind's mark. Of overlapping spans the first one's mark stands for all."""
    mark = F.array(*map(F.lit, marks))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(done: Column, x: Column) -> Column:
        gap = F.concat(done["out"], F.substring(text, done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0))))
        return F.struct(
            F.greatest(done["at"], x["end"]).alias("at"),
            F.when(x["start"] < done["at"], done["out"]).otherwise(F.concat(gap, F.get(mark, x["kind"]))).alias("out"),
        )

    rest = F.length(text)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, first, add, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, rest)))
    )
