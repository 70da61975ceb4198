"""Information-theoretic sanitisation of personal data, with native columns only.

Patterns find the protected entities: addresses, numbers, cards and phones. A term reveals an entity as far as their
pointwise mutual information reaches the entity's own information content: PMI(t; e) = IC(e) + log2 p(e | t). Both are
counted in the same contexts, the distinct lines of all texts; a term whose PMI is at least `disclosure` times IC(e) is
a span too, wherever it stands in any text, and is generalised like the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import written
from scanloom.llm.native_spans import NO_SPANS, count_of, in_order, no_spans, replaced, spans_of, told

KINDS = ("email", "ip", "card", "phone", "term")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")

#: Fixed patterns of the contract, written so that a run of characters is tried once from its beginning: possessive
#: quantifiers, and for addresses a lookbehind, which \G lifts behind a match that ended inside a run.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}(?![\p{L}\p{N}@_%+-]|\.\p{L})"


#: Slots of the filter of disclosing terms.
_SLOTS = 1 << 16


def _slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(_SLOTS)).cast("int")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _parts_fit(hit: Column) -> Column:
    """Every part is at most 255, however many zeros lead it."""
    return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _luhn(hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return F.when((n >= 14) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds of entities, in order."""
    n_phone = lambda hit: F.length(_digits(hit)).between(10, 15)
    found = [
        F.when(text.contains("@"), spans_of(text, _EMAIL, 0)),
        F.when(text.rlike(_IP), spans_of(text, _IP, 1, _parts_fit)),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), spans_of(text, _CARD, 2, _luhn)),
        F.when(text.contains("+"), spans_of(text, _PHONE, 3, n_phone)),
    ]
    return in_order(*(F.coalesce(x, no_spans()) for x in found))


def find_pii(
    docs: DataFrame,
    disclosure: float = 0.9,
    contexts: int = 3,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc id, spans array<struct<start,kind,end,value>>, k1, k2): entities (kinds 0 to 3) and disclosing terms (kind 4).

    A context is a line with an entity; equal contexts count once, so copies of a document prove nothing. Terms need
    `contexts` distinct contexts with the entity, and are marked at all their places in all texts. Null texts are empty
    and hold nothing. Repeated and null ids stay rows of their own; other columns are ignored; no rows give no rows.
    (k1, k2) is a 128-bit key of the text.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})
    lines = src.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    words = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(_TERM), F.lit(0)), F.lower))
    # no entity reaches over a line feed, so those of a line are those of the text there
    near = lines.select("line", base_spans(F.col("line")).alias("base")).where(F.size("base") > 0)
    near = near.select(F.xxhash64("line").alias("c1"), F.xxhash64(F.lit("second"), "line").alias("c2"), "base", words.alias("words"))
    near = written(near.dropDuplicates(["c1", "c2"]), "pii-contexts")
    seen = near.select("c1", "c2", F.explode("base").alias("s")).select("c1", "c2", F.col("s.kind").alias("kind"), F.lower("s.value").alias("value")).distinct()
    entities = seen.groupBy("kind", "value").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= contexts)
    often = seen.join(entities, ["kind", "value"])
    pairs = often.join(near.select("c1", "c2", "words"), ["c1", "c2"]).select("kind", "value", "n_e", F.explode("words").alias("term"))
    pairs = pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e")).where(F.col("n_te") >= contexts)
    every = F.concat(F.array(F.lit("")), words)  # the empty term stands in every line
    corpus = written(lines.distinct().select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "pii-corpus")
    total = (corpus.where("term = ''").first() or (None, 1))[1]
    p_e = F.least(F.lit(1.0), F.col("n_e") / F.lit(float(total)))
    p_e_t = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    content = -F.log2(p_e)
    strong = pairs.join(corpus, "term").where(content + F.log2(p_e_t) >= disclosure * content)
    strong = written(strong.select("term").distinct(), "pii-strong")
    # a byte for each of a fixed number of hashes thins the places out ahead of the exact join
    held = bytearray(_SLOTS)
    for r in strong.select(_slot(F.col("term")).alias("slot")).distinct().collect():  # at most _SLOTS
        held[r["slot"]] = 1
    may = lambda hit: F.substring(F.lit(held), _slot(F.lower(hit)) + 1, F.lit(1)) == F.lit(b"\x01")
    places = src.select("k1", "k2", F.explode(spans_of(F.col("text"), _TERM, 4, may)).alias("s"))
    places = places.select("k1", "k2", "s.start", "s.end", F.lower("s.value").alias("term")).distinct()
    spans = places.join(strong, "term", "left_semi")
    spans = (
        spans.select("k1", "k2", F.struct("start", F.lit(4).alias("kind"), "end", F.col("term").alias("value")).alias("s"))
        .groupBy("k1", "k2")
        .agg(F.collect_list("s").cast(NO_SPANS).alias("more"))  # of one text
    )
    src = src.withColumn("base", base_spans(F.col("text")))
    overlaps = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    out = src.select("id", "k1", "k2", "base").join(spans, ["k1", "k2"], "left")
    more = F.coalesce(F.filter("more", lambda x: ~overlaps(x)), no_spans())
    return out.select(F.col("id").alias(id_col), in_order("base", more).alias("spans"), "k1", "k2")


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base kinds, and all spans."""
    base = F.filter("spans", lambda x: x["kind"] < 4)
    return found.select(
        id_col,
        *(count_of(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(told(base, KINDS), 256).alias("base_sha256"),
        told(F.col("spans"), KINDS).alias("spans"),
    )


def sanitised(docs: DataFrame, found: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc id, text) with entities and disclosing terms generalised to their kind; matched by the key of the text."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})
    spans = found.select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    out = src.join(spans, ["k1", "k2"], "left").withColumn("spans", F.coalesce("spans", no_spans()))
    return out.select(F.col("id").alias(id_col), replaced(F.col("text"), F.col("spans"), MARKS).alias("text"))
