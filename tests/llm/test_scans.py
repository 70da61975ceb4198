import hashlib
import random
import re

from scanloom.llm import pii, secret_scan
from scanloom.llm.secret_scan import BASE_RULES, MORE_RULES, SecretRule, masked, scan_secrets, secret_digest, trigram_query

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def told(spans, names):
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()


def secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return (*(sum(s[1] == k for s in out) for k in range(3)), told(out, ("assign", "access", "hex")))


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(t):
    t, digits = t or "", lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return (*(sum(s[1] == k for s in out) for k in range(4)), told(out, pii.KINDS))


def texts(seed, parts, n=150):
    rnd = random.Random(seed)
    return [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for k in range(n)]


SECRET_PARTS = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMN", "0123456789", "\n", "é", "\U0001f600", "x", "-", "+/", "passwd"]
PII_PARTS = ["a.b", "@", "ex-ample", ".com", "_x", "%", "1", "255", "256.", ".", "10.0.0.1", "4111 1111 1111 1111", "-", " ", "+49", "(30)", "5555", "é", "\U0001f600", "\n", "00", "7992739871"]


def test_secrets(docs_of, awkward):
    rows = awkward + texts(1, SECRET_PARTS) + [(500, "token=secret: abcdefghijklmnop"), (501, "0" * 20_000), (502, "token" + " " * 5000 + "=" + "a" * 5000)]
    out = secret_digest(scan_secrets(docs_of(rows))).collect()
    got = sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in out), key=str)
    assert got == sorted(((i, *secrets(t)) for i, t in rows), key=str)
    assert scan_secrets(docs_of([])).count() == 0


def test_more_kinds_and_masking(docs_of):
    key = "ghp_" + "a1B2" * 10
    rows = [(1, f"see {key} and xoxb-1234567890ab."), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, "postgres://me:pw123@host/db"), (4, "nothing"), (5, None)]
    out = {r["doc_id"]: r["spans"] for r in secret_digest(scan_secrets(docs_of(rows))).collect()}
    assert out == {1: "code_host:4:48,chat:53:70", 2: "private_key:0:31", 3: "url_login:8:20", 4: "", 5: ""}
    text = {r["doc_id"]: r["text"] for r in masked(scan_secrets(docs_of(rows))).collect()}
    assert text == {1: "see [code_host] and [chat].", 2: "[private_key]", 3: "postgres[url_login]host/db", 4: "nothing", 5: ""}


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{16,}") == frozenset([frozenset()])
    assert trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert trigram_query("(abc|xyz)[0-9]+def") == frozenset([frozenset(["abc", "def"]), frozenset(["xyz", "def"])])
    assert trigram_query("ab?c") == frozenset([frozenset()])
    rnd = random.Random(3)
    samples = {BASE_RULES[0].pattern: 'api_key="abcdefghijkl', MORE_RULES[0].pattern: "-----BEGIN PRIVATE KEY-----", MORE_RULES[4].pattern: "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12}
    for pattern, hit in samples.items():
        assert re.search(pattern, hit)
        assert any(all(t in hit.lower() for t in c) for c in trigram_query(pattern)), rnd


def test_rule_without_trigrams_only(docs_of):
    out = scan_secrets(docs_of([(1, "a1b2"), (2, None)]), (SecretRule("digit", "[0-9]"),)).collect()
    assert {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in out} == {1: [(1, 2), (3, 4)], 2: []}
    assert secret_scan.told is not None


def test_pii(docs_of, awkward):
    rows = awkward + texts(2, PII_PARTS) + [(500, "a@b.c_d@e.f"), (501, "1.2.3.4.5.6.7.8"), (502, "9" * 20_000), (503, "1 " * 10_000), (504, "x" * 20_000 + "@a.b")]
    found = pii.find_pii(docs_of(rows))
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.pii_digest(found).collect()), key=str)
    assert got == sorted(((i, *personal(t)) for i, t in rows), key=str)
    assert pii.find_pii(docs_of([])).count() == 0


def test_disclosing_terms(docs_of):
    common = ["the", "and", "house", "garden", "river", "street", "morning", "evening"]
    rows = []
    for k in range(60):
        rnd = random.Random(k)
        rows.append((k, " ".join(rnd.choice(common) for _ in range(30))))
    for k, extra in enumerate(("near the garden", "by the river", "in the morning", "at the house")):
        rows.append((100 + k, f"{extra} Zorblat writes from jane@mail.example every day"))
    rows += [(200 + k, "only Quxify once with joe@mail.example") for k in range(5)]  # copies prove nothing
    found = pii.find_pii(docs_of(rows), disclosure=0.6)
    spans = {r["doc_id"]: [(s["value"], s["kind"]) for s in r["spans"]] for r in found.collect()}
    for k in range(4):
        assert ("zorblat", 4) in spans[100 + k] and ("jane@mail.example", 0) in spans[100 + k]
        assert not any(v in common for v, _ in spans[100 + k])
    assert all(spans[200 + k] == [("joe@mail.example", 0)] for k in range(5)) and all(spans[k] == [] for k in range(60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs_of(rows), found).collect()}
    assert "[TERM]" in clean[100] and "[EMAIL]" in clean[100] and "Zorblat" not in clean[100]
    assert clean[5] == dict(rows)[5]
