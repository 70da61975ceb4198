import hashlib
import random

import numpy as np

from scanloom.llm.line_dedup import dedup_lines, segment_keys, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rnd, s, k):
    s = list(s)
    for _ in range(k):
        at, what = rnd.randrange(len(s) + 1), rnd.randrange(3)
        if what == 0:
            s.insert(at, rnd.choice("abé"))
        elif s:
            at = min(at, len(s) - 1)
            s[at : at + 1] = [] if what == 1 else [rnd.choice("abc")]
    return "".join(s)


def test_banded_distance_and_segment_keys():
    rnd = random.Random(3)
    pairs = []
    for _ in range(800):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(6, 90)))
        pairs.append((a, changed(rnd, a, rnd.randint(0, 6))))
    for t in (0, 1, 2, 3, 5):
        ok = [p for p in pairs if min(map(len, p)) > t]
        want = np.array([distance(*p) <= t for p in ok])
        assert (within(ok, t) == want).all()
        for (a, b), near in zip(ok, want):
            if near:
                short, long = (a, b) if len(a) <= len(b) else (b, a)
                assert set(segment_keys(short, t)[0]) & set(segment_keys(long, t)[1])


def limit(n, short):
    """Edits that link lines of which the shorter one has n characters."""
    return 2 if n >= 24 else (1 if n >= 12 else 0) if short else 0


def brute(rows, least=24, short=False):
    first = {}
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if len(x) >= least or short and x and not x.isspace()})
    label = {x: x for x in lines}
    for _ in range(len(lines)):
        for a in lines:
            for b in lines:
                if label[a] > label[b] and abs(len(a) - len(b)) <= (e := limit(min(len(a), len(b)), short)) and distance(a, b) <= e:
                    label[a] = label[b]
    place = lambda i, k: (-(2**63) if i is None else i, k)
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x in label:
                first[label[x]] = min(first.get(label[x], (2**63, 0)), place(i, k))
    out = []
    for i, t in rows:
        gone = [k for k, x in enumerate((t or "").split("\n")) if x in label and place(i, k) != first[label[x]]]
        text = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out.append((i, text, gone))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in df.collect()), key=str)


def test_lines(docs_of):
    rnd = random.Random(4)
    bases = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(20, 60))) for _ in range(12)]
    rows = [(None, bases[0] + "\n" + bases[1]), (0, None), (1, ""), (2, "\n\n"), (3, bases[0]), (3, bases[0]), (3, bases[2])]
    for k in range(30):
        rows.append((k + 4, "\n".join(changed(rnd, rnd.choice(bases), rnd.choice((0, 0, 1, 2, 4))) for _ in range(rnd.randint(1, 5)))))
    want = brute(rows)
    assert got(dedup_lines(docs_of(rows))) == want
    assert got(dedup_lines(docs_of(rows), block=2)) == want
    assert sum(len(g) for _, _, g in want) > 20


def test_short_lines(docs_of):
    """Lines of all lengths around the steps: near repeats of short ones, across a step, and equal ones."""
    rnd = random.Random(7)
    bases = ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (1, 2, 5, 10, 11, 12, 13, 14, 20, 22, 23, 24, 25, 26) for _ in range(2)]
    rows = [(1, "short line number one\nshort line number 1ne"), (2, "chapter 12"), (3, "chapter 13\nchapter 12\n  \n  ")]
    for k in range(25):
        rows.append((k + 4, "\n".join(changed(rnd, rnd.choice(bases), rnd.choice((0, 1, 1, 2))) for _ in range(4))))
    want = brute(rows, short=True)
    assert got(dedup_lines(docs_of(rows), short_lines=True)) == want
    assert want[0] == (1, "short line number one", [1])
    assert {g for i, _, g in map(lambda x: (x[0], x[1], tuple(x[2])), want) if i == 3} == {(1,)}


def test_awkward_and_empty(docs_of, awkward):
    out = dedup_lines(docs_of(awkward))
    assert out.columns == docs_of(awkward).columns  # removed_lines is replaced
    assert got(out) == brute([r for r in awkward if r[0] not in (6, 8)] + [r for r in awkward if r[0] in (6, 8)])
    assert got(dedup_lines(docs_of([]))) == []


def test_query_digest(spark, small):
    from scanloom.llm.queries import op1_line_dedup

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op1_line_dedup(spark, small).collect():
        lines = texts[r["doc_id"]].split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if k not in set(r["removed_lines"]))
        assert r["n_lines"] == len(lines) and r["n_removed"] == len(r["removed_lines"])
        assert r["text_sha256"] == hashlib.sha256(left.encode()).hexdigest()
