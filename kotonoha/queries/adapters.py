"""The given tables in the shapes of dictionary and reading data, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions import text as T

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: For each letter a kana; with it words of the corpus inflect.
KANA = "かばきだてふがはいじくらまんおぱけるしたうぶわさよず"
HIRA, KATA = T.chars(0x3041, 0x3096), T.chars(0x30A1, 0x30F6)
RULES = ["v1", "v5", "adj-i", "vs", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kana(w: Column) -> Column:
    return F.translate(w, LETTERS, KANA)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, w: the words of ``documents``."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "w"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w and s (its kana), distinct words of ``documents``."""
    return tokens(spark, sf_dir).select("w").distinct().withColumn("s", kana(F.col("w")))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary rows made of the words of ``benchmark``."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words_of(F.col("text"))).alias("w")).distinct()
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.length("w") % 5 + 1).cast("int"))
    return words.select(
        kana(F.col("w")).alias("term"),
        T.hiragana_to_katakana(kana(F.col("w"))).alias("reading"),
        F.concat(F.lit("dict"), (F.col("item_id") % 4).cast("string")).alias("dictionary"),
        F.array(F.col("w"), F.concat(F.lit("see "), F.col("w"))).alias("definitions"),
        F.when(F.length("w") % 3 == 0, F.array(F.lit("n"), F.lit("common"))).otherwise(F.array(F.lit("n"))).alias("term_tags"),
        F.array(F.concat(F.lit("d"), (F.length("w") % 4).cast("string"))).alias("definition_tags"),
        F.filter(F.array(rule), lambda r: r != "").alias("inflection_rules"),
        F.length("w").cast("double").alias("popularity"),
        F.col("item_id").cast("long").alias("sequence_number"),
    )


def terms_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata row for each word in ``documents``: frequency (a number, a display text, or both), pitch (with morae and tags, or not) or ipa by its length and count."""
    n, c = F.length("w") % 3, F.col("n")
    counted = tokens(spark, sf_dir).groupBy("w").agg(F.count("*").alias("n"))
    numbers = lambda when, *x: F.when(n == 1, F.when(when, F.array(*x)).otherwise(F.array().cast("array<int>")))
    return counted.select(
        kana(F.col("w")).alias("term"),
        F.concat(F.lit("freq"), (F.length("w") % 2).cast("string")).alias("dictionary"),
        F.when(n == 0, "frequency").when(n == 1, "pitch").otherwise("ipa").alias("meta_type"),
        F.when((n == 0) & (c % 3 != 1), c.cast("double")).alias("frequency"),
        F.when((n == 0) & (c % 3 != 0), F.concat(c.cast("string"), F.lit("x"))).alias("display_frequency"),
        F.when(n == 1, (c % 5).cast("int")).alias("downstep_position"),
        numbers(c % 2 == 0, F.lit(1), (c % 4).cast("int")).alias("devoice_positions"),
        numbers(c % 3 == 0, F.lit(2)).alias("nasal_positions"),
        F.when(n == 2, F.concat(F.lit("/"), F.col("w"), F.lit("/"))).alias("transcription"),
        F.when((n > 0) & (c % 5 == 0), F.array(F.lit("t"), F.lit("u"))).when(n > 0, F.array().cast("array<string>")).alias("tags"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("n", "partOfSpeech", 1.0, "noun", 0.0), ("common", "frequent", 2.0, "common word", 10.0), ("d0", "misc", 3.0, "zero", 1.0), ("d1", "misc", 4.0, "one", 1.0), ("d3", "misc", 5.0, "three", 1.0)]
    dictionaries = terms(spark, sf_dir).select("dictionary").distinct()
    return dictionaries.withColumn("t", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("tag", "category", "sorting_order", "notes", "popularity"), r)]) for r in rows]))).select("dictionary", "t.*")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, pos, item_id, href, html: ten pages make a book."""
    return table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).cast("long").alias("book"), (F.col("page_id") % 10).cast("int").alias("pos"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("item_id"), F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1).alias("href"), "html")


TOKENS_SQL = "tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)"
SURFACES_SQL = f"{TOKENS_SQL}, surfaces AS (SELECT w, translate(w, '{LETTERS}', '{KANA}') AS s FROM (SELECT DISTINCT w FROM tokens))"
TERMS_SQL = f"""terms AS (
    SELECT translate(w, '{LETTERS}', '{KANA}') AS term, translate(translate(w, '{LETTERS}', '{KANA}'), '{HIRA}', '{KATA}') AS reading,
        'dict' || (item_id % 4) AS dictionary, [w, 'see ' || w] AS definitions,
        CASE WHEN length(w) % 3 = 0 THEN ['n', 'common'] ELSE ['n'] END AS term_tags, ['d' || (length(w) % 4)] AS definition_tags,
        list_filter([(['v1', 'v5', 'adj-i', 'vs', ''])[length(w) % 5 + 1]], lambda r: r <> '') AS inflection_rules,
        length(w)::DOUBLE AS popularity, item_id::BIGINT AS sequence_number
    FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark))"""
META_SQL = f"""meta AS (
    SELECT translate(w, '{LETTERS}', '{KANA}') AS term, 'freq' || (length(w) % 2) AS dictionary,
        CASE length(w) % 3 WHEN 0 THEN 'frequency' WHEN 1 THEN 'pitch' ELSE 'ipa' END AS meta_type,
        CASE WHEN length(w) % 3 = 0 AND n % 3 <> 1 THEN n::DOUBLE END AS frequency, CASE WHEN length(w) % 3 = 0 AND n % 3 <> 0 THEN n || 'x' END AS display_frequency,
        CASE WHEN length(w) % 3 = 1 THEN (n % 5)::INT END AS downstep_position,
        CASE WHEN length(w) % 3 = 1 THEN CASE WHEN n % 2 = 0 THEN [1, n % 4] ELSE [] END END AS devoice_positions, CASE WHEN length(w) % 3 = 1 THEN CASE WHEN n % 3 = 0 THEN [2] ELSE [] END END AS nasal_positions,
        CASE WHEN length(w) % 3 = 2 THEN '/' || w || '/' END AS transcription, CASE WHEN length(w) % 3 > 0 THEN CASE WHEN n % 5 = 0 THEN ['t', 'u'] ELSE [] END END AS tags
    FROM (SELECT w, count(*) AS n FROM tokens GROUP BY w))"""
PAGES_SQL = r"""spine AS (
    SELECT page_id // 10 AS book, (page_id % 10)::INT AS pos, 'p' || page_id AS item_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS href, html
    FROM pages)"""
