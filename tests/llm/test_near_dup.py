import random

from scanloom.llm import near_dup
from scanloom.llm.near_dup import _roots, near_duplicates
from scanloom.llm.shingles import Shingler

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x.decode("utf-8", "surrogatepass") for x in (text or "").translate(LOW).encode("utf-8", "surrogatepass").split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and label[i] > label[j] and 100 * len(a & b) >= 75 * len(a | b):
                    label[i], changed = label[j], True
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if label[k] == label[i] and sets[i] and d is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else doc))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_awkward(docs_of, awkward):
    assert got(near_duplicates(docs_of(awkward))) == brute(awkward)


def test_empty(docs_of):
    assert got(near_duplicates(docs_of([]))) == []


def test_families_and_common_passage(docs_of):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(4000)]
    passage = [rnd.choice(words) for _ in range(40)]
    rows = []
    for family in range(6):
        base = [rnd.choice(words) for _ in range(120)]
        for _ in range(14):
            text = list(base)
            for _ in range(rnd.randint(0, 9)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            if rnd.random() < 0.5:
                text[60:60] = passage[: rnd.randint(5, 40)]
            rows.append((len(rows), " ".join(text)))
    for _ in range(40):
        rows.append((len(rows), " ".join([rnd.choice(words) for _ in range(30)] + passage)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:10])]
    want = brute(rows)
    assert got(near_duplicates(docs_of(rows))) == want
    assert got(near_duplicates(docs_of(rows), block=4)) == want  # groups over many blocks


def test_roots_are_those_of_all_pairs():
    rnd = random.Random(2)
    for _ in range(30):
        texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(8, 16))) for _ in range(40)]
        sets = Shingler(2).sets(texts)
        real = [
            (i, j)
            for i in range(40)
            for j in range(i)
            if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))
        ]
        assert _roots(sets, 75, 100) == _labels(40, real)


def test_two_large_groups_and_bridges(docs_of):
    """Two groups of many near copies, a common passage in both, and chains from one copy to the next."""
    rnd = random.Random(4)
    words = [f"v{k}" for k in range(5000)]
    passage = [rnd.choice(words) for _ in range(30)]
    rows = []
    for base in ([rnd.choice(words) for _ in range(90)] for _ in range(2)):
        for k in range(60):
            text = list(base)
            for _ in range(rnd.randint(0, 6)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows) + 500, " ".join(text + passage)))
    chain = [rnd.choice(words) for _ in range(80)]
    for k in range(25):
        chain[3 * k % 80] = rnd.choice(words)
        rows.append((1000 - k, " ".join(chain)))
    rows += [(None, rows[3][1]), (2, rows[70][1]), (2, rows[70][1])]
    want = brute(rows)
    for block, least_shared in ((1500, 4), (7, 1), (1, 9)):
        assert got(near_duplicates(docs_of(rows), block=block, least_shared=least_shared)) == want


def _labels(n, pairs):
    out = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            out[i] = out[j] = min(out[i], out[j])
    return out


def test_a_common_passage_opens_nothing(docs_of, monkeypatch):
    """Documents of one passage and a few words of their own, which are not similar: no group is opened, and what is
    joined does not grow with the square of their number."""
    from scanloom.llm import near_dup

    tables, write = {}, near_dup.written

    def kept(df, name):
        out = write(df, name)
        tables[name] = out.count()  # the table itself may be deleted later
        return out

    monkeypatch.setattr(near_dup, "written", kept)
    rnd = random.Random(6)
    passage = [f"p{k}" for k in range(30)]
    sizes = []
    for n in (100, 300):
        rows = [(k, " ".join(passage + [f"own{k}x{j}" for j in range(8)])) for k in range(n)]
        rnd.shuffle(rows)
        tables.clear()
        out = got(near_duplicates(docs_of(rows)))
        assert all(i == c for i, _, c in out) and len(out) == n
        assert tables["jaccard-sets-asked"] == 0
        sizes.append(tables["jaccard-matrix"])
    assert sizes[1] <= 3 * sizes[0]


def test_sizes_at_the_threshold(docs_of):
    """Sets of many sizes that share just enough or one too few, whoever is the longer one."""
    rnd = random.Random(9)
    rows = []
    for n in (4, 5, 6, 7, 8, 9, 12, 20, 31, 44):
        base = [f"b{n}x{k}" for k in range(n)]
        for m in range(max(1, n // 2), 2 * n):
            rows.append((len(rows), " ".join(base[:m] + [f"c{n}y{m}z{k}" for k in range(max(0, m - n))])))
    rnd.shuffle(rows)
    for block, least_shared in ((1500, 4), (1, 1), (2, 7)):
        assert got(near_duplicates(docs_of(rows), block=block, least_shared=least_shared)) == brute(rows)


def test_near_copies_of_many_smallest_shingles_meet_in_few_groups(docs_of, monkeypatch):
    """Copies of one text with an edit each, whose smallest shingles differ, linked through the text or not at all: they
    ask for groups, and groups are asked, in proportion to their number."""
    from scanloom.llm import near_dup

    tables, write = {}, near_dup.written

    def kept(df, name):
        out = write(df, name)
        tables[name] = tables.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dup, "written", kept)
    for linked in (True, False):
        rnd = random.Random(11)
        base = [f"b{k}" for k in range(40)]
        asked = []
        for n in (80, 240):
            rows = [(0, " ".join(base))] if linked else []
            for k in range(n):
                text = list(base)
                text[rnd.randrange(4, 36)] = f"own{k}"
                rows.append((k + 1, " ".join(text)))
            rnd.shuffle(rows)
            tables.clear()
            assert got(near_duplicates(docs_of(rows))) == brute(rows)
            asked.append(tables["jaccard-sets-asked"] + tables["jaccard-roots-asked"])
        assert asked[1] <= 3 * max(asked[0], 80), asked


def test_texts_are_found_in_one_python_step(spark, docs_of, monkeypatch):
    """The texts of groups are known and packed by one Python worker to a task, and their front is what SQL reads."""
    key = near_dup._digest(b"some text")
    front = near_dup._front(key)
    assert spark.createDataFrame([(key,)], "k binary").selectExpr("cast(conv(hex(substring(k, 1, 7)), 16, 10) as long)").first()[0] == front
    steps, write = {}, near_dup.written

    def written(df, name):
        steps[name] = df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        return write(df, name)

    monkeypatch.setattr(near_dup, "written", written)
    text = " ".join(f"w{k}" for k in range(60))
    out = near_dup.near_duplicates(docs_of([(1, text), (2, text + " end"), (3, "else")]))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 1, 3: 3}
    assert steps["jaccard-texts"] == 1
