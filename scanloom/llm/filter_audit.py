"""How filters interact: what each of them removes at each step of every order in which they can be applied.

Documents become cells: a part, the set of filters that a document fails as the bits of a mask, and counts. Cells are
unpivoted against the steps of all orders, a window's running bit-or tells which cells an earlier step took, and sums
under conditions give the counts. All that is large happens before the cells, which are at most 2^filters to a part.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filter that compares texts with those of other documents; the others see one text.
REPEAT = "E"
FILTERS = "ABCDE"


def text_failures() -> dict[str, Column]:
    """Of filters A to D: whether a document fails, over the columns text, n_words and n_distinct."""
    capitals = F.length("text") - F.length(F.translate("text", _UPPER, ""))
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def document_cells(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, bit k for the k-th of FILTERS.

    A row of docs is a document: repeated rows count each, and with one id none is before the other. A null id has no
    smaller id and is smaller than none, so it never fails E, and has no labels; null texts are empty, null parts the
    part ''. An id that labels has twice is good or toxic if one of its rows says so. No documents give no cells.

    Only keys are shuffled: a digest, an id, a part and a mask for each document. Copies meet as counts by digest and
    part, so that neither a hot text nor a hot part brings its rows to one task.
    """
    src = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    inner = F.btrim("text", F.lit(_SPACES))
    words = F.when(F.length(inner) > 0, F.split(inner, f"[{_SPACE}]+")).otherwise(F.array().cast("array<string>"))
    counted = src.withColumn("words", words).select(
        "id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")
    )
    mask = sum((F.when(fails, 1 << FILTERS.index(k)).otherwise(0) for k, fails in text_failures().items()), F.lit(0))
    keys = counted.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    known = keys.where("id is not null").join(told, "id", "left")
    one = known.groupBy("id", "part", "digest", "mask").agg(
        F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
    counts = [F.col(c) for c in ("n", "good", "toxic")]
    copies = one.groupBy("digest", "part", "mask").agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "toxic")), F.min(F.struct("id", *counts)).alias("first")
    )
    firsts = copies.groupBy(F.col("digest").alias("__digest")).agg(F.min("first.id").alias("least"))
    met = copies.join(firsts, F.col("digest") == F.col("__digest"))
    leads = F.col("first.id") == F.col("least")

    def split(c: str) -> Column:
        return F.when(leads, F.col(f"first.{c}")).otherwise(0)

    fails = 1 << FILTERS.index(REPEAT)
    rows = F.array(
        F.struct(F.col("mask"), *(split(c).cast("long").alias(c) for c in ("n", "good", "toxic"))),
        F.struct((F.col("mask") + fails).alias("mask"), *((F.col(c) - split(c)).cast("long").alias(c) for c in ("n", "good", "toxic"))),
    )
    zero = F.lit(0).cast("long")
    nameless = keys.where("id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    named = met.select("part", F.explode(rows).alias("x")).select("part", "x.*").where("n > 0")
    return named.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, zeros included: kept (after the step), removed (at it),
    redundant (failing its filter, but removed before), unique_fails (failing its filter only), good_lost, toxic_lost
    (removed with that label) and shapley (removed by the step's filter, over all orders).

    cells is document_cells() or any table (part, mask, n, good, toxic); no cells give no rows.
    """
    orders = ["".join(p) for p in permutations(filters)]
    steps = F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(1 << k).alias("bit")) for k in range(len(filters))))
    bit = sum((F.when(F.col("letter") == c, 1 << k).otherwise(0) for k, c in enumerate(filters)), F.lit(0))
    long = (
        cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.transform(steps, lambda s: s["step"])))
        .withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("bit", bit)
    )
    so_far = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("mask").bitwiseAND(F.col("bit"))
    long = long.withColumn("seen", F.bit_or(own).over(so_far))  # failures up to this step
    fails, before = own != 0, F.col("seen").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0

    def total(of: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")

    found = long.groupBy("part", "filter_order", "step", "letter").agg(
        total("n", F.col("seen") == 0).alias("kept"),
        total("n", fails & ~before).alias("removed"),
        total("n", fails & before).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~before).alias("good_lost"),
        total("toxic", fails & ~before).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return found.withColumn("shapley", shapley).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """interactions() of document_cells()."""
    return interactions(document_cells(docs, labels, text_col, id_col, part_col))


def oracle(filters: Sequence[str] = FILTERS) -> str:
    """DuckDB's SQL for audit() over documents and labels."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(filters))
    return rf"""
        with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
        w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from t),
        l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
              from labels group by doc_id),
        f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                     (case when len(words) < 50 then 'A' else '' end)
                     || (case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end)
                     || (case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 'C' else '' end)
                     || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end)
                     || (case when w.doc_id > first then 'E' else '' end) as failed
              from w left join l on w.doc_id = l.doc_id),
        c as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, failed),
        o as (select o.filter_order, s.step, substr(o.filter_order, s.step, 1) as letter, substr(o.filter_order, 1, s.step - 1) as earlier
              from (values {orders}) as o(filter_order), (select unnest(range(1, {len(filters) + 1})) as step) as s),
        x as (select part, filter_order, cast(step as int) as step, letter, n, good, toxic, contains(failed, letter) as fails,
                     failed = letter as alone, regexp_matches(failed, '[' || earlier || '_]') as gone from c, o),
        r as (select part, filter_order, step, letter,
                     cast(coalesce(sum(n) filter (not fails and not gone), 0) as bigint) as kept,
                     cast(coalesce(sum(n) filter (fails and not gone), 0) as bigint) as removed,
                     cast(coalesce(sum(n) filter (fails and gone), 0) as bigint) as redundant,
                     cast(coalesce(sum(n) filter (alone), 0) as bigint) as unique_fails,
                     cast(coalesce(sum(good) filter (fails and not gone), 0) as bigint) as good_lost,
                     cast(coalesce(sum(toxic) filter (fails and not gone), 0) as bigint) as toxic_lost
              from x group by all)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               cast(sum(removed) over (partition by part, letter) as bigint) as shapley from r"""
