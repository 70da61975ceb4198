"""Secret scans with a trigram inverted index.

From each rule's pattern a Boolean query of trigrams is derived that every match must satisfy. The index holds, for
the trigrams of all queries, the postings (trigram, text key) of the texts that contain them. A conjunction's postings
are intersected by counting them per text; the texts that some conjunction of a rule accepts are its candidates, and
only on them is the rule's pattern run. Rules without mandatory trigrams run on every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.native_spans import count_of, in_order, no_spans, replaced, spans_of, told


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: a pattern (of what Java and Python read alike) and a condition on the match."""

    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None


#: Fixed patterns of the contract. Runs of at least 18 and 16 characters are asked for in the pattern itself, which
#: finds the same matches: a shorter run holds no match of the required length.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{14,}"
_HEX = r"[0-9a-f]{16,}"

BASE_RULES = (
    SecretRule("assign", _ASSIGN, lambda hit: F.length(F.regexp_extract(hit, _ASSIGN, 1)) >= 12),
    SecretRule("access", _ACCESS),
    SecretRule("hex", _HEX),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("url_login", r"://[A-Za-z0-9._-]{1,60}:[A-Za-z0-9._+!$-]{1,60}@"),
)

_MOST = 48
Conjunctions = frozenset[frozenset[str]]
_ANY: Conjunctions = frozenset([frozenset()])


def _both(a: Conjunctions, b: Conjunctions) -> Conjunctions:
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= _MOST else min(a, b, key=lambda q: (_ANY <= q, len(q)))


def _either(parts: list[Conjunctions]) -> Conjunctions:
    out = frozenset().union(*parts)
    return _ANY if frozenset() in out or len(out) > _MOST else out


def _of_strings(strings: set[str]) -> Conjunctions:
    """Every one of the strings holds its trigrams; a shorter string holds none."""
    return _either([frozenset([frozenset(s[k : k + 3] for k in range(len(s) - 2))]) for s in strings])


def _exact(parsed) -> set[str] | None:
    """All strings that a pattern matches, in lower case, if they are few."""
    out = {""}
    for op, arg in parsed:
        if op is sre.LITERAL:
            more = {chr(arg).lower()}
        elif op is sre.IN and arg[0][0] is not sre.NEGATE and all(o is sre.LITERAL for o, _ in arg):
            more = {chr(a).lower() for _, a in arg}
        elif op is sre.BRANCH:
            parts = [_exact(p) for p in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op is sre.SUBPATTERN:
            more = _exact(arg[3])
        elif op is sre.MAX_REPEAT and arg[1] == 1:
            more = _exact(arg[2])
            more = more and more | ({""} if arg[0] == 0 else set())
        else:
            more = None
        if more is None or len(out) * len(more) > _MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> Conjunctions:
    """The query of a pattern, as conjunctions of trigrams of which one must hold; {{}} if the pattern demands none.

    Trigrams are in lower case, as are the texts of the index, so the letter case of the pattern does not matter.
    """
    return _query(sre_parser.parse(pattern))


def _query(parsed) -> Conjunctions:
    query, run = _ANY, {""}
    for op, arg in parsed:
        few = _exact([(op, arg)])
        if few is not None and len(run) * len(few) <= _MOST:
            run = {a + b for a in run for b in few}
            continue
        query, run = _both(query, _of_strings(run)), {""}
        if few is not None:
            run = few
        elif op is sre.SUBPATTERN:
            query = _both(query, _query(arg[3]))
        elif op is sre.BRANCH:
            query = _both(query, _either([_query(p) for p in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
            query = _both(query, _query(arg[2]))
    return _both(query, _of_strings(run))


def scan_secrets(
    docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(doc id, spans array<struct<start,kind,end,value>>, text): the places of the rules' matches, kind being the
    place of the rule in `rules`. Null texts are empty and hold nothing. Repeated and null ids stay rows of their own;
    other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    queries = [trigram_query(r.pattern) for r in rules]
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("key", F.xxhash64("text"))
    asked = [(k, n, t) for k, q in enumerate(queries) if q != _ANY for n, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    if asked:
        trigrams = sorted({t for _, _, t in asked})
        low = src.select("key", F.lower("text").alias("low"))
        found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
        # equal texts have equal postings; a key that two texts share only adds candidates
        postings = low.select("key", F.explode(found).alias("trigram")).distinct()
        terms = spark.createDataFrame(
            [(k, n, t, sum(1 for a, b, _ in asked if (a, b) == (k, n))) for k, n, t in asked], "rule int, part int, trigram string, size int"
        )
        hits = postings.join(F.broadcast(terms), "trigram").groupBy("key", "rule", "part").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        candidates = hits.where("n = size").groupBy("key").agg(F.collect_set("rule").alias("rules"))  # at most one of each rule
        src = src.join(candidates, "key", "left")
    else:
        src = src.withColumn("rules", F.lit(None).cast("array<int>"))
    parts = []
    for k, (rule, q) in enumerate(zip(rules, queries)):
        spans = spans_of(F.col("text"), rule.pattern, k, rule.keep)
        runs = F.col("text").rlike(rule.pattern)
        if q != _ANY:
            runs = F.coalesce(F.array_contains("rules", k), F.lit(False)) & runs
        parts.append(F.when(runs, spans).otherwise(no_spans()))
    return src.select(F.col("id").alias(id_col), in_order(*parts).alias("spans"), "text")


def secret_digest(found: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the base kinds (the first three rules), and all spans."""
    names, n = [r.kind for r in rules], len(BASE_RULES)
    base = F.filter("spans", lambda x: x["kind"] < n)
    return found.select(
        id_col,
        *(count_of(F.col("spans"), k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)),
        F.sha2(told(base, names), 256).alias("base_sha256"),
        told(F.col("spans"), names).alias("spans"),
    )


def masked(found: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id") -> DataFrame:
    """(doc id, text) with every secret replaced by its kind in brackets."""
    return found.select(id_col, replaced(F.col("text"), F.col("spans"), [f"[{r.kind}]" for r in rules]).alias("text"))
