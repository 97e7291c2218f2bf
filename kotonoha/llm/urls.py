"""URL rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm.common import without

#: Rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Rule lists up to so many rows are broadcast (under 20 MB); longer ones are joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or a text without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: list[int]) -> Column:
    """Of the host and the suffixes of it that start behind a dot, those of as many labels as ``labels`` says."""
    have = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.array_compact(F.array(*[F.when(have >= n, F.substring_index(host, ".", -n)) for n in labels])) if labels else F.array().cast("array<string>")


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The path's beginnings of the given lengths."""
    return F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")


def keyed(df: DataFrame, host: str, path: str) -> DataFrame:
    """Adds the digest of an expression, in which the host's length tells where the path begins, and its first 32 bits."""
    digest = F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), F.col(host), F.col(path)), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, 8))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages`` (a column ``url``).

    A rule fits its host and all subdomains if the path starts with the rule's; of those that
    fit, the one with the longest host and path wins, then the longest host, then ``block``.
    Each distinct host and path is expanded into its host suffixes of as many labels as rules
    have, times the path prefixes of those lengths that rules have (so a host of thousands of
    labels costs no more than another); expressions meet rules in an equi-join on the first 32 bits
    of their SHA-256 and count only if all of it agrees. Without a rule: ``rule`` null and the
    verdict ``default``. Null urls and urls without ``://`` have an empty host and path and fit
    no rule; rules without a host fit nothing. Repeated rows are judged alike, an empty table
    gives no rows; input columns of the added names are replaced.
    """
    hosted = rules.where("host <> ''").select("host", "path", "verdict")
    lengths = sorted(n for (n,) in hosted.select(F.length("path")).distinct().collect())  # at most the longest path's length
    labels = sorted(n for (n,) in hosted.select(F.size(F.split("host", r"\.", -1))).distinct().collect())  # at most the longest host's labels
    known = keyed(hosted, "host", "path").select("prefix", F.col("digest").alias("rule_digest"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), "verdict")
    known = F.broadcast(known) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else known
    rows = without(pages, "host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = rows.where("host <> ''").select("host", "path").distinct()
    parts = urls.withColumn("suffix", F.explode(host_suffixes(F.col("host"), labels))).withColumn("start", F.explode(path_prefixes(F.col("path"), lengths)))
    met = keyed(parts, "suffix", "start").join(known, "prefix").where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block", "rule")
    judged = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("won"))
    out = rows.join(judged, ["host", "path"], "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
