"""Ranked search, filter audit and token counts against brute force, and on odd rows."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from scanloom.llm import filter_audit, queries, token_counts, treap_search

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_filter_audit"])
def test_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: collections.Counter(df[cols].itertuples(index=False, name=None))
    assert rows(got) == rows(want) and len(got) > 0


def searched(docs, items, k=10):
    """The contract's ranks by brute force: item -> [(doc, score)]."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in terms if w), sum(len(w) for _, w in terms)
    tf = [collections.Counter(w) for _, w in terms]
    df = collections.Counter(t for c in tf for t in c)
    out = {}
    for item, text in items:
        found = []
        for (doc, words), c in zip(terms, tf):
            score = 0
            for t in TERM.findall((text or "").translate(LOWER)):
                if c[t]:
                    m = 25 + (75 * len(words) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((doc, score))
        out[item] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return out


def ranks(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize("block, k", [(7, 10), (64, 3), (8192, 1)])
def test_search_by_brute_force(spark, docs_of, block, k):
    """Zipf words, many copies (ties), lengths from 0 to hundreds of words."""
    r = random.Random(block)
    words = [f"w{x}" if x % 3 else f"Ä{x}" for x in range(60)]
    text = lambda n: " ".join(words[min(59, int(r.paretovariate(0.7)) - 1)] for _ in range(n))
    docs = [(x, text(r.choice([0, 1, 5, 30, 300]))) for x in range(150)]
    docs += [(1000 - x, docs[3][1] or "w1 w2") for x in range(40)] + [(None, "w1 w4 W5")]
    items = [(x, text(r.choice([0, 1, 3, 12]))) for x in range(25)] + [(77, docs[5][1]), (78, "nothing known"), (79, None), (80, "W1; w1, w1")]
    got = ranks(treap_search.search(docs_of(docs, 4), spark.createDataFrame(items, "item_id long, text string"), k, block))
    want = {i: x for i, x in searched(docs, items, k).items() if x}
    assert got == want


def test_search_odd_rows(spark, docs_of, awkward):
    items = [(1, "one fox WORD3 tail7"), (2, ""), (3, None), (4, "日本語 ünïcödé"), (1, "one fox WORD3 tail7"), (None, "dog forest")]
    kind = "item_id long, text string"
    got = ranks(treap_search.search(docs_of(awkward), spark.createDataFrame(items, kind)))
    assert got == {i: x for i, x in searched(awkward, items).items() if x} and None in got
    assert treap_search.search(docs_of([]), spark.createDataFrame(items, kind)).count() == 0
    assert treap_search.search(docs_of(awkward), spark.createDataFrame([], kind)).count() == 0


def test_a_treap_is_ordered_by_document_and_impact():
    r = np.random.default_rng(1)
    sizes = np.array([1, 400, 50])
    doc = np.concatenate([np.sort(r.choice(1000, n, replace=False)) for n in sizes])
    t = treap_search.Treaps([b"a", b"b", b"c"], sizes, doc, np.where(np.arange(len(doc)) < 200, 7, r.integers(0, 9, len(doc))))

    def depth(node, low, high):
        if node < 0:
            return 0
        assert low <= t.doc[node] < high
        for child in (t.left[node], t.right[node]):
            assert child < 0 or t.order[child] < t.order[node]
        return 1 + max(depth(t.left[node], low, t.doc[node]), depth(t.right[node], t.doc[node] + 1, high))

    assert [depth(x, 0, 1000) for x in t.root][0] == 1
    assert depth(t.root[1], 0, 1000) < 60  # equal impacts do not make it a list


def test_search_leaves_most_documents_out(spark):
    """The bound prunes: of 4,000 documents few are scored for a rare term beside a common one."""
    docs = [(k, "common " * (1 + k % 5) + (f"rare{k % 97}" if k % 50 == 0 else "")) for k in range(4000)]
    block = treap_search._Block(None)
    for k, t in docs:
        block.add(k, t)
    import pyarrow as pa

    treaps, ids = treap_search.block_treaps(pa.Table.from_batches([block.batch(0)]), 4000, sum(block.lengths))
    at = [treaps.term[b"common"], treaps.term[b"rare50"]]
    walk = treap_search.Walk(treaps, len(ids), [(np.array(at), np.array([1, 5000]))], 3, np.zeros(1, np.int64))
    assert len(walk.best) == 3 and walk.visited < 400


def audited(docs, labels):
    first, good = {}, {i: (q, t) for i, q, t in labels}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {k for k, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)),
            i is not None and i > first[t])) if bad}
        failed.append((part or "", fails, *good.get(i, (0, 0))))
    out, shapley = {}, collections.Counter()
    for part in {x[0] for x in failed}:
        rows = [x for x in failed if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                gone = set(order[:step])
                now = [x for x in rows if f in x[1] and not x[1] & gone]
                out[part, "".join(order), step + 1] = [
                    sum(1 for x in rows if not x[1] & {*gone, f}), len(now), sum(1 for x in rows if f in x[1] and x[1] & gone),
                    sum(1 for x in rows if x[1] == {f}), sum(x[2] == 1 for x in now), sum(x[3] == 1 for x in now), (part, f)]
                shapley[part, f] += len(now)
    return {k: (*v[:-1], shapley[v[-1]]) for k, v in out.items()}


def audit_of(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_by_brute_force(spark, awkward):
    r = random.Random(4)
    base = [t for _, t in awkward] + ["UPPER # text", "a " * 60, " ".join(map(str, range(70)))] + [" ".join(r.choice("abcdefgXYZ&") for _ in range(55)) for _ in range(6)]
    docs = [(r.choice([None, *range(40)]), r.choice(base), r.choice(["s", "t", None, ""])) for _ in range(160)]
    labels = [(x, r.choice([0, 1, None]), r.choice([0, 1])) for x in range(0, 40, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit("x"), "mask": F.lit(9), "n": F.lit("y")}).repartition(3)
    got = audit_of(filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == audited(docs, labels)
    twice = spark.createDataFrame(labels + labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert audit_of(filter_audit.audit(df, twice)) == got
    assert filter_audit.audit(df.limit(0), twice).count() == 0


def counted(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("slots", [3, 1 << 16])
def test_token_counts_as_the_library(docs_of, awkward, slots):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    more = [(100 + k, "".join(r.choice(["the ", "  ", "\n", "q", "zx", "▁", "日本", "<s>", "</s>", "\t", "ing", " a"]) for _ in range(r.choice([1, 20, 400])))) for k in range(60)]
    docs = [*awkward, *more, (7000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)))]
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 40) for i, t in docs]
    assert counted(token_counts.count_tokens(docs_of(docs), MODEL, limit=40, slots=slots, cache_words=20)) == sorted(want, key=str)
    assert token_counts.count_tokens(docs_of([]), MODEL).count() == 0


def test_frequent_pre_tokens_survive_summaries(spark):
    """More than one in `slots` of all: kept through pruned summaries of many tasks and three rounds of merging."""
    rows = [(" ".join(["often", *(f"once{k}x{j}" for j in range(9))]),) for k in range(400)]
    df = spark.createDataFrame(rows, "text string").repartition(40)
    got = token_counts.frequent_lengths(df, MODEL, slots=16, fan_in=4)
    assert " often" in got and len(got) <= 16


def test_long_texts_go_in_parts():
    text = "word " * 50_000 + "\n" + "x" * 200_000
    parts = list(token_counts.pre_tokens(text, at_once=1000))
    assert max(map(len, parts)) <= 1000 and "".join(w for p in parts for w in p) == " " + text
    assert list(token_counts.pre_tokens("")) == []
