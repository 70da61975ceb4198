import importlib
import os
import random
import subprocess
import sys

import public_tokenizers
import pytest
import sentencepiece
import test_decontaminate
import test_line_dedup
import test_near_dup

import corpus_pipeline
from scanloom.llm import decontaminate, quality_classifier
from scanloom.llm.queries import QUERIES


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0.6 * n <= len(rows) <= n and {r["doc_id"] for r in rows} <= set(texts)
        if name not in ("line dedup", "benchmark decontamination"):
            assert all(r["text"] == texts[r["doc_id"]] for r in rows)
        else:
            assert (len(rows) == n or name != "line dedup") and all(r["n_chars"] == len(r["text"]) for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"]: r["decoded"] for r in last} == {i: t.replace("▁", " ") for i, t in texts.items()}


def test_odd_rows(spark, small):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", None), (None, "x", None, None, 1), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).collect()
        assert stage(spark, docs.limit(0), small).count() == 0


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() > 100


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(importlib.import_module("scanloom").__file__))
    code = "import sys, scanloom.plans.registry; assert not [m for m in sys.modules if m.startswith('scanloom.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(root))


@pytest.fixture(scope="module")
def fixture(docs_of):
    """Near copies, chains, repeated lines of all lengths, benchmark passages, odd ids and texts."""
    rnd = random.Random(21)
    words = [f"wort{k}" for k in range(900)]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [sentence(6) for _ in range(5)]
    items = [(1, sentence(40)), (2, sentence(7)), (3, None)]
    rows = [(None, sentence(30)), (90, None), (91, ""), (92, "\n \n")]
    for k in range(12):
        rows.append((k, "\n".join([sentence(8), rnd.choice(shared), sentence(5), rnd.choice(shared)[:-1]])))
    base = sentence(80).split()
    for k in range(6):
        base[13 * k] = f"neu{k}"
        rows.append((30 + k, " ".join(base)))
    rows += [(50, sentence(20) + " " + items[0][1]), (51, items[1][1]), (52, sentence(600) + " " + items[0][1][:90]), (53, sentence(600) + " " + " ".join(items[0][1].split()[:15])), (3, rows[4][1]), (3, rows[4][1])]
    return docs_of(rows), rows, items


def test_lines_by_brute_force(spark, fixture):
    docs, rows, _ = fixture
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns
    want = [(i, t) for i, t, _ in test_line_dedup.brute(rows, short=True)]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_near_duplicates_by_brute_force(spark, fixture):
    docs, rows, _ = fixture
    firsts = {i for i, _, c in test_near_dup.brute(rows) if i == c}
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted({(i, t) for i, t in rows if i in firsts}, key=str)


def test_benchmark_by_brute_force(spark, fixture, tmp_path):
    docs, rows, items = fixture
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = {rows[k][1] for k in range(len(rows)) if test_decontaminate.brute([rows[k]], items)[0][-1]}
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()]
    want = []
    for i, t in rows:
        if t in bad:
            continue
        spans = decontaminate.SuffixAutomaton([(str(k), decontaminate.words_of(x)) for k, x in items if x]).scan([decontaminate.words_of(t or "")])[0][0]
        words, hit = (t or "").split(), {w for a, b in spans for w in range(a, b)}
        left = " ".join(w for k, w in enumerate(words) if k not in hit)
        want.append((i, t if not hit else left))
        assert not hit or len(hit) * 20 < len(words)
    assert any(t not in {x for _, x in rows} for _, t in want)  # some passage was cut out
    strip = lambda rows: sorted(((i, t if t is None else " ".join(t.split(" ")).replace("  ", " ").strip(" ")) for i, t in rows), key=str)
    assert bad and strip(got) == strip(want)


def test_quality_by_each_text(spark, small):
    """The first stage keeps just the rows whose own text scores 0.3 under the model of the training rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame([(None, None, "en", "s", 0), (None, "x " * 90, "en", "s", 180)], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.read.parquet(f"{small}/labels.parquet").where(quality_classifier.in_training_fold())
    measure = quality_classifier.learn(docs, labels).measures()
    want = [(r["doc_id"], r["text"]) for r in docs.collect() if measure.score(r["text"] or "") >= 0.3]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, docs, small).collect()]
    assert 0 < len(want) < docs.count() and sorted(got, key=str) == sorted(want, key=str)


def test_sentencepiece_as_the_library(spark, fixture):
    docs, rows, _ = fixture
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [(i, sp.encode(t or "")) for i, t in rows]
    want = sorted(((i, len(x), x, sp.decode(x)) for i, x in ids), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in corpus_pipeline.sentencepiece(spark, docs, "").collect()), key=str) == want
