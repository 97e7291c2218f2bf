"""Removal of boilerplate lines by the number of distinct sites that have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import cut, split_likely, without

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10

#: Sketches have 2 ** LOG_K registers; an estimate within MARGIN of the threshold is counted exactly. The
#: standard error is about 0.8 / 2 ** (LOG_K / 2), here 0.013, so the margin is over fifteen of them.
LOG_K, MARGIN = 12, 0.2

#: Lists of lines up to so many (16 bytes each) are broadcast; longer ones are joined by a shuffle.
BROADCAST_LINES = 200_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """A row for each line of ``docs`` that has a word: doc_id, mark (hash of the text), pos, site (its hash, null for none), and the line's two hashes a and b."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.when(F.col(f"`{site}`").isNotNull(), F.xxhash64(f"`{site}`")).alias("site"), lines).withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    return rows.select("doc_id", "mark", "pos", "site", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The lines (a, b) on ``min_sites`` distinct sites or more; a null site is none.

    One aggregation over all lines merges a HyperLogLog sketch of each line's sites, made by
    each task from what it reads, with the least and the greatest site; a line on one site
    alone, as most are, ends there. An estimate well over the threshold is taken, one well
    under it dropped, and only lines near it have their distinct sites counted. Both
    aggregations are partial before rows meet by line, so a line that a third of all rows have
    sends a sketch, or a row for each site, from each task.
    """
    about = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("about")
    sketched = lines.where("site is not null").groupBy("a", "b").agg(about, F.min("site").alias("lo"), F.max("site").alias("hi"))
    spread = cut(sketched.where((F.col("lo") < F.col("hi")) if min_sites > 1 else F.lit(True)).select("a", "b", "about"), "spread")
    sure = spread.where(F.col("about") > min_sites * (1 + MARGIN)).select("a", "b")
    near = small(spread.where(F.col("about").between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("a", "b"))
    counted = lines.where("site is not null").join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    return sure.unionByName(counted.where(F.col("n") >= min_sites).select("a", "b"))


def small(lines: DataFrame) -> DataFrame:
    """``lines`` to be broadcast if there are up to BROADCAST_LINES of them; else as they are, for a join by shuffle."""
    return F.broadcast(lines) if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else lines


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, and a column ``site``) with boilerplate lines cut from ``text``, and ``n_lines`` and ``n_removed`` (long).

    A line is a piece between newlines, compared without white space at its ends; lines without
    a word are never removed or counted. Every copy of a boilerplate line goes, also within one
    site. A null text stays null and counts as without lines. Lines are known by 128 bits of
    hash; only texts that lose lines move, and the positions of these. The work on a text
    grows with its length alone, however many of its lines go. Rows that agree in doc_id and
    text are cut alike; an empty table gives no rows. Input columns of the added names are
    replaced.
    """
    rows = without(docs, "n_lines", "n_removed")
    lines = cut(line_table(rows, site), "lines")
    found = small(cut(boilerplate_lines(lines, min_sites), "boilerplate"))
    gone = lines.join(found, ["a", "b"], "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"), "gone")
    gone = cut(gone, "gone")
    marked = rows.select(F.struct("*").alias("row"), F.xxhash64("text").alias("g_m"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    likely, others = split_likely(marked, gone.select(F.xxhash64("g_id", "g_mark").alias("key")), "key", gone.count())
    met = likely.join(gone, F.col("row.doc_id").eqNullSafe(F.col("g_id")) & (F.col("g_m") == F.col("g_mark")), "left").select("row", "gone").unionByName(others.select("row", F.lit(None).cast("array<int>").alias("gone")))
    listed = F.coalesce("gone", F.array().cast("array<int>"))
    split = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    # array_except looks positions up in a hash set, and the lines are split once for all of them
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), listed)
    cut_out = F.transform(F.array(F.struct(split.alias("lines"), left.alias("left"))), lambda v: F.array_join(F.transform(v["left"], lambda i: F.get(v["lines"], i)), "\n"))[0]
    full = F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    text = F.when(F.size(listed) > 0, cut_out).otherwise(F.col("row.text"))
    return met.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in rows.columns], full.alias("n_lines"), F.size(listed).cast("long").alias("n_removed"))
