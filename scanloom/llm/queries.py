"""The registered queries of the text operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, filter_audit, line_dedup, pieces, pii, quality_classifier, quality_rules, secret_scan, token_counts, token_files, treap_search, warc
from scanloom.llm.near_dup import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: numbers of lines and of removed lines, the removed lines, and the digest of the text that is left."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    out = line_dedup.dedup_lines(docs, short_lines=True)
    return out.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.size("removed_lines").cast("long").alias("n_removed"),
        "removed_lines",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(quality_classifier.in_training_fold())
    scored = quality_classifier.score_quality(docs, quality_classifier.learn(docs, labels))
    return scored.select(
        "doc_id",
        (~quality_classifier.in_training_fold()).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).drop("spans", "digest")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = pieces.encode_and_decode(_table(spark, sf_dir, "documents"), model)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op4_token_output": op4_token_output,
    "op6_secret_scans": op6_secret_scans,
    "op10_pii": op10_pii,
    "op3_warc": op3_warc,
    "op5_quality_rules": op5_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_counts": op13_token_counts,
}

#: DuckDB's SQL for those queries that SQL can express at the size of whole tables.
ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": treap_search.ORACLE,
    "op12_filter_audit": filter_audit.oracle(),
    "op3_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        d as (select page_id, octet_length(body) as n, sha256(body) as digest from p),
        f as (select digest, min(page_id) as first from d where n >= 100 group by digest)
        select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
               case when f.first is null or f.first = d.page_id then 'response' else 'revisit' end as record_type,
               case when f.first <> d.page_id then f.first end as refers_to
        from d left join f on d.n >= 100 and d.digest = f.digest""",
    "op5_quality_rules": r"""
        with t as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
        g as (select doc_id, i, list_slice(words, i, i + 7) as gram
              from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
        r as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) >= 2),
        c as (select doc_id, count(distinct i + k) as n from r, range(8) as s(k) group by doc_id),
        b as (select w.doc_id, text, lines, cast(len(words) as bigint) as n_words,
                     cast(length(array_to_string(words, '')) as bigint) as word_chars,
                     cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
                     cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
                     cast(coalesce(c.n, 0) as bigint) as n_repeat_words
              from w left join c on w.doc_id = c.doc_id),
        f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 5 * n_symbols > n_words
                    or 10 * n_dup_lines > 3 * len(lines)
                    or 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars
                    or 5 * len(regexp_extract_all(text, '!')) > n_words
                    or 3 * len(regexp_extract_all(text, '[0-9]')) > word_chars
                    or 10 * len(list_filter(lines, lambda x: ends_with(x, '...') or ends_with(x, '…'))) > 3 * len(lines)
                    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-•]'))) > 9 * len(lines)) as kept
        from f""",
}
