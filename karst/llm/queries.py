"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.sources.shared import read_table


def op1_quality_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.quality_svm import score_quality

    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from karst.llm.token_files import token_files

    out = token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_lbl_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.lbl_lm import score

    return score(read_table(spark, sf_dir, "documents"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.superminhash import near_groups

    return near_groups(read_table(spark, sf_dir, "documents"), percent=85).drop("th")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.suffix_dedup import dedup_substrings

    return dedup_substrings(read_table(spark, sf_dir, "documents"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.recompression import dedup_windows

    return dedup_windows(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.quality_rules import quality_rules

    out = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.decontam import find_hits, find_spans, words
    from karst.sources.shared import spread, text_hash

    docs, bench = spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark")
    spans = find_spans(find_hits(docs, bench)).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "n_hit", "items")
    every = docs.select("doc_id", text_hash().alias("th"), F.size(words()).cast("long").alias("n_words"))
    out = every.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<long>"))
    named = F.concat_ws(",", F.sort_array(F.transform(items, lambda i: i.cast("string"))))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.pfair import mix

    return mix(read_table(spark, sf_dir, "documents")).drop("th")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.warc import archive_pages

    return archive_pages(read_table(spark, sf_dir, "pages"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> {k}) % 32 + 1, 1)" for k in (15, 10, 5, 0))

ORACLES: dict[str, str] = {
    "op8_decontaminate": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bk AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM bk),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM bp),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dp AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM dp),
h AS (SELECT r, p, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + k - 1)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * 20 >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
x AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(sha1(h), 5 * i + 1, 5))::INTEGER) AS parts FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(parts, lambda v: {_CHARS}), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM x""",
}

QUERIES = [op1_quality_svm, op2_token_files, op3_lbl_lm, op4_superminhash, op5_suffix_dedup, op6_recompression, op7_quality_rules, op8_decontaminate, op9_mix, op10_warc]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
