"""Hot groups: one key that many different lines or documents share."""

import random

from scanloom.llm.line_dedup import dedup_lines
from scanloom.llm.near_dup import near_duplicates


def test_hot_segment(spark, docs_of):
    """Many lines share their first two thirds and differ by more than two edits; some are near each other."""
    rnd = random.Random(8)
    head = "every line of this table begins with the very same words and then goes on "
    tails = ["".join(rnd.choice("abcdefghij") for _ in range(30)) for _ in range(300)]
    rows = [(k, head + t) for k, t in enumerate(tails)] + [(1000 + k, head + t[:-1] + "Z") for k, t in enumerate(tails[:40])]
    out = {r["doc_id"]: r["removed_lines"] for r in dedup_lines(docs_of(rows), block=50).collect()}
    assert all(out[k] == [] for k in range(300)) and all(out[1000 + k] == [0] for k in range(40))


def test_hot_copies_and_hub(spark, docs_of):
    """Copies by the hundred, and near copies that are near to one hub only."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(100)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(80):
        words = list(base)
        start = rnd.randrange(0, 92)
        words[start : start + 7] = [f"x{k}_{j}" for j in range(7)]
        rows.append((1000 + k, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(rows), block=16).collect()}
    assert set(got.values()) == {0}
