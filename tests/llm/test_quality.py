import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from scanloom.llm.quality_classifier import DOUBTS, SHRINKS, Compressors, _chosen, in_training_fold, learn, score_quality
from scanloom.llm.quality_rules import Rule, default_rules, judge, measured, ordered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def got(df):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_rules_on_awkward_rows(docs_of, awkward):
    more = [(20, "a b c d e f g h i " * 40), (21, "same line\nsame line\n\n other"), (22, "a b c d e f g h x a b c d e f g h y " + " ".join(map(str, range(90)))), (23, "### $$$ <b>|")]
    rows = awkward + more
    assert got(judge(docs_of(rows))) == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert judge(docs_of([])).count() == 0


def test_order_changes_no_verdict(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rules = default_rules()
    a = {r["doc_id"]: r["kept"] for r in judge(docs, rules).collect()}
    assert a == {r["doc_id"]: r["kept"] for r in judge(docs, rules[::-1], sample_rows=1).collect()}
    assert sum(a.values()) > 0.5 * len(a)


def test_cheap_rule_that_rejects_comes_first(docs_of):
    docs = measured(docs_of([(k, "word " * 50 + f"{k} " * (k % 5)) for k in range(50)]))
    at = lambda reject, work, name: Rule(name, reject, F.lit(work))
    none, some, all_ = F.col("n_words") < 0, F.col("n_words") > 52, F.col("n_words") > 0
    rules = [at(none, 1.0, "never"), at(all_, 1.0, "always"), at(some, 1.0, "some"), at(all_, 5000.0, "dear")]
    docs = docs.withColumn("n_repeat_words", F.lit(0))
    assert [r.name for r in ordered(docs, rules)] == ["always", "some", "never", "dear"]
    assert [r.name for r in ordered(docs.limit(0), rules[:2])] == ["always", "never"]


def test_the_order_of_the_rules_is_no_chance(spark, small):
    docs = measured(spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")).cache()
    orders = {tuple(r.name for r in ordered(docs.repartition(k + 1), default_rules())) for k in range(10)}
    assert len(orders) == 1
    (order,) = orders
    # what needs a scan of the text comes behind what compares two numbers, unless it rejects much more
    assert set(order[:3]) >= {"symbols", "duplicate_lines"} or order.index("capitals") > order.index("word_length")


def test_classifier_learns_and_holds_out(spark, small):
    sf = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = learn(docs, labels.where(in_training_fold()))
    scored = score_quality(docs, model).join(labels, "doc_id").where(~in_training_fold()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    assert sum((r["score"] >= 0.3) == bool(r["quality"]) for r in scored) >= 0.9 * len(scored)
    good = [r["score"] for r in scored if r["quality"]]
    bad = [r["score"] for r in scored if not r["quality"]]
    assert sum(g > b for g in good for b in bad) > 0.93 * len(good) * len(bad)


def test_constants_are_learned_from_the_rows_given(spark, small):
    """What short texts are drawn to follows the training rows, and labels of the other fold change nothing."""
    sf = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = learn(docs, labels.where(in_training_fold()))
    turned = labels.withColumn("quality", F.when(in_training_fold(), F.col("quality")).otherwise(1 - F.col("quality")))
    assert learn(docs, turned.where(in_training_fold())) == a
    assert a.shrink in SHRINKS and a.doubt in DOUBTS
    saved, size = np.array([5.0, 4, 6, -5, -4, -6]), np.full(6, 100.0)
    assert _chosen(saved, size, np.array([1.0, 1, 1, 0, 0, 0]))[1:] in [(s, d) for s in SHRINKS for d in DOUBTS]


def test_classifier_on_awkward_rows(spark, docs_of, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(9, 1), (9, 0), (None, 1), (4, None), (5, 7), (1, 0), (777, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        model = learn(docs_of(awkward), labels)
        assert isinstance(model, Compressors)
        rows = score_quality(docs_of(awkward), model).collect()
        assert len(rows) == len(awkward) and all(0 <= r["score"] <= 1 for r in rows)
    kept = score_quality(docs_of(awkward), learn(docs_of(awkward), none), keep_columns=True)
    assert set(kept.columns) == set(docs_of(awkward).columns) and kept.count() == len(awkward)
    assert score_quality(docs_of([]), learn(docs_of([]), none)).count() == 0
