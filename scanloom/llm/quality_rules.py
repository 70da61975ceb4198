"""Quality rules as a short-circuit cascade of native columns.

Each rule rejects documents, and says how much work it is on one. A small sample tells how often a rule rejects and what
it costs by the sizes of its documents; the rules are then put in the order of rejection per cost into one CASE
expression, which stops at the first rule that holds. The order changes the cost and the rule that is named first, never
the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's white space, word window and symbols.
_SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


#: Work by character of a pattern that is counted in a text, by line of a test of its end, and by line of a pattern.
PER_CHAR, PER_END, PER_LINE = 2.0, 8.0, 40.0


@dataclass(frozen=True)
class Rule:
    """work: what the rule costs on a document, in comparisons of two numbers; the columns of measured() are there already."""

    name: str
    rejects: Column
    work: Column = field(default_factory=lambda: F.lit(1.0))


def default_rules() -> list[Rule]:
    """Rules over the columns of measured()."""
    line = F.col("lines")
    ends = F.size(F.filter(line, lambda x: x.endswith("...") | x.endswith("…")))
    bullets = F.size(F.filter(line, lambda x: F.ltrim(x).rlike("^[-•]")))
    n_lines = F.size(line)
    counted = F.length("text") * PER_CHAR
    return [
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")), F.lit(2.0)),
        Rule("symbols", 5 * F.col("n_symbols") > F.col("n_words")),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * n_lines),
        Rule("capitals", 2 * F.regexp_count("text", F.lit("[A-Z]")) > F.col("word_chars"), counted),
        Rule("exclamations", 5 * F.regexp_count("text", F.lit("!")) > F.col("n_words"), counted),
        Rule("digits", 3 * F.regexp_count("text", F.lit("[0-9]")) > F.col("word_chars"), counted),
        Rule("ellipsis_lines", 10 * ends > 3 * n_lines, n_lines * (2 * PER_END)),
        Rule("bullet_lines", 10 * bullets > 9 * n_lines, n_lines * PER_LINE),
    ]


def measured(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The base columns, with text, words and lines (those with a word) for rules to use."""
    nothing = F.array().cast("array<string>")
    inner = F.btrim("text", F.lit(_SPACES))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.when(F.length(inner) > 0, F.split(inner, f"[{_SPACE}]+")).otherwise(nothing))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_SPACE}]")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    windows = F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    df = df.withColumn("windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    # only in documents with a repeated window: window hashes, with the place in the low bits, are sorted so that equal
    # ones are neighbours; the full hashes of neighbours decide
    df = df.withColumn("bits", F.length(F.bin("n_words")).cast("int"))
    packed = F.transform("windows", lambda h, i: F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("long")))
    df = df.withColumn("sorted", F.when(F.col("repeats"), F.sort_array(packed)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1

    def full(k: Column) -> Column:
        return F.get("windows", F.get("sorted", k).bitwiseAND(mask).cast("int"))

    twice = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda k: _same(full(k), full(k + 1)) | _same(full(k), full(k - 1)),
    )
    starts = F.sort_array(F.transform(twice, lambda k: F.get("sorted", k).bitwiseAND(mask)))
    df = df.withColumn("starts", F.when(F.col("repeats"), starts))
    first = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("covered"))
    covered = F.aggregate(
        "starts",
        first,
        lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["covered"] + p + WINDOW - F.greatest(p, a["end"])).alias("covered")
        ),
        lambda a: a["covered"],
    )
    return df.select(
        "doc_id",
        "text",
        "lines",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ordered(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejection per cost, both taken from `sample`, a few measured() documents, in one job.

    Both count where a document gets as far as the rules, which those that fail the base do not. Equal sizes of documents
    give equal orders, as no clock is read; of equal rules the name decides.
    """
    rows = sample.persist()  # measured once
    sums = [F.count("*").alias("n")]
    for k, rule in enumerate(rules):
        sums += [F.count_if(rule.rejects).alias(f"r{k}"), F.coalesce(F.avg(rule.work), F.lit(1.0)).alias(f"w{k}")]
    try:
        got = rows.where(~base_failed()).agg(*sums).first()
    finally:
        rows.unpersist()
    worth = [(-(got[f"r{k}"] + 0.5) / (got["n"] + 1) / max(1.0, got[f"w{k}"]), rule.name, k) for k, rule in enumerate(rules)]
    return [rules[k] for _, _, k in sorted(worth)]


def judge(
    docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 400, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule).

    kept is false if base_failed (n_words < 20 or 100 * n_repeat_words > 30 * n_words) or if a rule rejects;
    failed_rule names the first such rule of the order that the sample gave, "base" if base_failed. Null texts are
    empty; empty texts fail the base. Repeated and null ids stay rows of their own; other columns are ignored; no rows
    give no rows. The sample (about sample_rows rows of all) only orders the
    rules.
    """
    rules = default_rules() if rules is None else rules
    base = measured(docs, text_col, id_col)
    some = docs.sample(min(1.0, sample_rows / max(1, docs.count())), 1)
    order = ordered(measured(some, text_col, id_col), rules) if len(rules) > 1 else rules
    base = base.withColumn("base_failed", base_failed())
    why = F.when(F.col("base_failed"), "base")
    for rule in order:
        why = why.when(rule.rejects, rule.name)
    out = base.withColumn("failed_rule", why)
    return out.select(
        F.col("doc_id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        F.col("failed_rule").isNull().alias("kept"),
        "failed_rule",
    )
