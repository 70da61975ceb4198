import random

from scanloom.llm import pii

COMMON = ["the", "and", "house", "garden", "river", "street", "morning", "evening"]


def filler(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(COMMON) for _ in range(n))


def marked(docs_of, rows, disclosure=0.6):
    found = pii.find_pii(docs_of(rows), disclosure=disclosure)
    spans = {r["doc_id"]: [(s["start"], s["value"]) for s in r["spans"] if s["kind"] == 4] for r in found.collect()}
    return spans, {r["doc_id"]: r["text"] for r in pii.sanitised(docs_of(rows), found).collect()}


def test_terms_count_and_are_marked_beyond_a_window(docs_of):
    rows = [(k, filler(k, 30)) for k in range(60)]
    rows += [(100 + k, f"jane@mail.example {filler(k, 80)} Zorblat") for k in range(5)]
    rows += [(200, f"{filler(200, 40)}\nzorblat, and ZORBLAT"), (201, f"+49 30 5555 0001 {filler(201, 40)} Zorblat")]
    spans, clean = marked(docs_of, rows)
    for i, t in rows:
        low, term = t.lower(), "zorblat"
        assert spans[i] == [(at, term) for at in range(len(low)) if low.startswith(term, at)]
        assert clean[i].count("[TERM]") == low.count(term) and term not in clean[i].lower()
    assert sum(map(len, spans.values())) == 8


def test_copies_count_once_for_terms_too(docs_of):
    rows = [(k, filler(k, 30)) for k in range(60)]
    rows += [(100 + k, f"jane@mail.example {filler(k, 20)} Zorblat") for k in range(5)]
    rows += [(200 + k, rows[-1][1]) for k in range(90)]
    spans, clean = marked(docs_of, rows)
    for i, _ in rows:
        assert [v for _, v in spans[i]] == ["zorblat"] * (i >= 100)
        assert ("[TERM]" in clean[i]) == (i >= 100)
