import hashlib
import random
import re

from pyspark.sql import functions as F

from scanloom.llm.decontaminate import contamination, cut_spans, judged

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = WORD.findall((text or "").translate(LOW))
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    found |= windows[tuple(w[i : i + k])]
                    hit.update(range(i, i + k))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, spans string")


def test_awkward(spark, docs_of, awkward):
    items = [(1, awkward[11][1]), (2, None), (3, ""), (None, "deep dark forest"), (4, "old river mill at dawn"), (4, "lazy dog"), (5, "!!!"), (6, "日本語")]
    found = contamination(docs_of(awkward), items_of(spark, items))
    assert got(judged(found)) == brute(awkward, items)
    # the same with blocks of a few words, each its own automaton
    assert got(judged(contamination(docs_of(awkward), items_of(spark, items), block_words=4))) == brute(awkward, items)


def test_random_small_vocabulary(spark, docs_of):
    rnd = random.Random(7)
    word = lambda: rnd.choice(["a", "b", "B", "c", "d-e", "f"])
    for least in (1, 2, 5, 13):
        items = [(k, " ".join(word() for _ in range(rnd.randint(least, 20)))) for k in range(6)]
        docs = [(k, " ".join(word() for _ in range(rnd.randint(0, 200))) + " " + rnd.choice(items)[1]) for k in range(25)]
        assert got(judged(contamination(docs_of(docs), items_of(spark, items)))) == brute(docs, items)


def test_empty_tables(spark, docs_of, awkward):
    assert got(judged(contamination(docs_of([]), items_of(spark, [(1, "a b")])))) == []
    assert all(r[2:4] == (0, 0) and not r[5] for r in got(judged(contamination(docs_of(awkward), items_of(spark, [])))))


def test_cut_spans(spark, docs_of):
    docs = docs_of([(1, "Keep this: one two, THREE four! And that."), (2, "nothing here"), (3, None)])
    items = items_of(spark, [(1, "one two three four")])
    found = contamination(docs, items)
    out = {r["doc_id"]: r["text"] for r in cut_spans(docs, found).collect()}
    assert out == {1: "Keep this: ! And that.", 2: "nothing here", 3: None}
    assert cut_spans(docs, found.where(F.lit(False))).count() == 3
