"""A stored index of terms, by which lookups of any mode join without moving the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.operators.search import MODES, SPREAD, matches

#: Characters of a key, at most, and buckets of the tables.
LEAST, BUCKETS = 3, 64

#: What a key begins with, for each mode; an empty query has keys of its own.
MARKS = {"exact": "=", "suffix": "<", "prefix": ">", "contains": "~"}


def term_keys(term: Column, least: int = LEAST) -> Column:
    """The keys under which a term is entered: itself, its first and its last characters, and its runs of up to ``least`` characters, each once."""
    def run(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - n + 1, F.lit(1))), lambda i: F.substr(term, i, F.lit(n)))

    runs = [run(n) for n in range(1, least + 1)]
    marked = lambda mark, values: F.transform(F.array_distinct(values), lambda v: F.concat(F.lit(MARKS[mark]), v))
    ends = lambda cut: F.array(*[cut(term, F.lit(n)) for n in range(1, least + 1)])
    part = F.array(F.concat(F.lit("#"), F.pmod(F.xxhash64(term), F.lit(SPREAD)).cast("string")))
    return F.concat(marked("exact", F.array(term)), marked("suffix", ends(F.left)), marked("prefix", ends(F.right)), marked("contains", F.flatten(F.array(*runs))), part)


def query_keys(query: Column, mode: str, least: int = LEAST) -> Column:
    """The keys that a query is sought under: one, or all parts for an empty query, which every term matches unless it must be equal."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "exact":
        return F.array(F.concat(F.lit("="), query))
    end = F.right(query, F.lit(least)) if mode == "prefix" else F.left(query, F.lit(least))
    parts = F.array(*[F.lit(f"#{i}") for i in range(SPREAD)])
    return F.when(query == "", parts).otherwise(F.array(F.concat(F.lit(MARKS[mode]), end)))


def write_index(terms: DataFrame, path: str, table: str, least: int = LEAST, buckets: int = BUCKETS) -> None:
    """Write ``terms`` (term, more columns) to ``path`` as two tables of the catalogue: ``<table>_rows``, the rows with a ``term_id``, and ``<table>_keys`` (key, term_id, term). Both are in buckets, sorted in each, by term_id and by key. Null terms have no keys."""
    spark = terms.sparkSession

    def put(rows: DataFrame, by: str, name: str) -> None:
        rows.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", f"{path}/{name}").saveAsTable(f"{table}_{name}")

    put(terms.withColumn("term_id", F.monotonically_increasing_id()), "term_id", "rows")
    stored = spark.table(f"{table}_rows").where("term is not null")
    put(stored.select(F.explode(term_keys(F.col("term"), least)).alias("key"), "term_id", "term"), "key", "keys")


def drop_index(spark: SparkSession, table: str) -> None:
    """Take the tables out of the catalogue; their files stay."""
    for name in ("rows", "keys"):
        spark.sql(f"DROP TABLE IF EXISTS {table}_{name}")


def lookup_index(queries: DataFrame, table: str, mode: str = "exact", key: str = "candidate", least: int = LEAST) -> DataFrame:
    """What ``search.batch_lookup`` gives, from a stored index: queries go to the buckets of their keys, and what they find to those of the rows; the tables stay where they are. Null finds nothing."""
    spark = queries.sparkSession
    asked = queries.where(F.col(key).isNotNull()).withColumn("_key", F.explode(query_keys(F.col(key), mode, least)))
    keys = spark.table(f"{table}_keys").select(F.col("key").alias("_at"), F.col("term_id").alias("_id"), F.col("term").alias("_term"))
    met = asked.join(keys, F.col("_key") == F.col("_at"))
    if mode != "exact":  # there the keys say all, and one more equality would ask for other buckets
        met = met.where(matches(F.col("_term"), F.col(key), mode))
    met = met.drop("_key", "_at", "_term")
    return met.join(spark.table(f"{table}_rows"), F.col("_id") == F.col("term_id")).drop("_id", "term_id")
