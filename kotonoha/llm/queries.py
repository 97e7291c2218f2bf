"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm import bpe, counts, exact, langid, lines, mix, neardup, negatives, quality, repeats, shard, urls, variants
from kotonoha.llm.common import documents, unfolded

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard.shard_rows(rows, n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return bpe.digests(bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded=True, keep=["doc_id"]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, limit=512)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", mix.word_count(F.col("text")).alias("size"))
    return mix.mixed_sizes(sized).select("doc_id", "size", "source_size", "target", "taken")


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_classes(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "class_id", "class_size", "kept", "near_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = exact.normalised(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", F.encode(text, "UTF-8").alias("body"), F.sha2(text, 256).alias("text_sha256"))
    out = unfolded(exact.exact_groups(rows), "rows", "n")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_chunks")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge_urls(pages, urls.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir).select("doc_id", "text"), damage=variants.DAMAGE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_shard_shuffle, op2_line_spread, op3_byte_bpe, op4_language_id, op5_token_counts, op6_mix_sources, op7_bag_minhash, op8_exact_dedup, op9_compression_bands, op10_url_rules, op11_suffix_dedup, op12_hard_negatives, op13_spelling_variants)}

ORACLES = {
    "op2_line_spread": r"""
        WITH lines AS (
            SELECT doc_id, source, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core
            FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)),
        gone AS (SELECT core FROM lines WHERE core <> '' GROUP BY core HAVING count(DISTINCT source) >= 10)
        SELECT doc_id, count(*) FILTER (core <> '') AS n_lines, count(*) FILTER (core IN (SELECT core FROM gone)) AS n_removed,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (core NOT IN (SELECT core FROM gone)), '')) AS text_sha256
        FROM lines GROUP BY doc_id""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)""",
    "op10_url_rules": r"""
        WITH p AS (
            SELECT page_id,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT host, path, max_by(struct_pack(rule := h || q, verdict := v), length(h || q)) AS won
            FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path)
        SELECT page_id, p.host, p.path, won.rule AS rule, coalesce(won.verdict, 'allow') AS verdict
        FROM p LEFT JOIN fits ON p.host = fits.host AND p.path = fits.path""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.vec, b.vec)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5""",
}
