"""Mixing of sources to target weights by blocks, multinomial draws and index permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.llm.common import WORD, cut, row_hash, unfolded, without
from kotonoha.llm.draws import binomial, let, permuted, uniform

#: Words of a block, output shards, greatest number of times that a source is repeated.
BLOCK, SHARDS, MOST_REPEATS = 128, 16, 3
WEIGHTS = (1, 2, 3)
#: Rows whose sizes are summed in one sort; slots that one row unfolds into, and that one task makes.
PART_ROWS, SLOT_ROWS, TASK_SLOTS = 2_048, 4_096, 1 << 20
#: Rows equal in all columns whose pieces are listed together.
LISTED = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, size) -> a row for each source: source, rank (from 0 by code point, null last), source_size, source_rows, target double.

    Sources share the sum of all sizes by weight; a target stops at ``most`` times its source's
    size and the rest is shared again. The level at which this ends comes from one pass in the
    order of cap over weight: a source is full while its cap is under its share of what the
    earlier ones leave. The windows over all sources sort a table of a row for each source, not
    for each document, in one task, which spills: some ten million sources (such as sites) fit.
    """
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("level", "rank")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")).withColumn("rank", F.row_number().over(by_name) - 1)
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double")).withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("cap").over(by_level) - F.col("cap"))
    heavier = F.sum("weight").over(everything) - (F.sum("weight").over(by_level) - F.col("weight"))
    opened = weighed.withColumn("share", left / heavier).withColumn("full", F.col("level") < F.col("share"))
    level = F.min(F.when(~F.col("full"), F.struct("level", "rank", "share"))).over(everything)["share"]
    target = F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return opened.select("source", "rank", "source_size", "source_rows", target.alias("target"))


def dealt_counts(quotas: Column, sizes: Column, seed: Column) -> Column:
    """For each shard the number of slots that each source fills: array<array<long>>.

    Shard s takes ``sizes[s]`` slots (the sizes' sum is that of the quotas), drawn from a
    multinomial law whose probabilities are what the sources' ``quotas`` still hold; a draw never
    exceeds what is left, so over all shards each source fills its quota exactly.
    """

    def shard(acc: Column, s: Column) -> Column:
        def source(inner: Column, i: Column) -> Column:
            rest = inner["pool"] - acc["left"][i]
            p = F.when(inner["pool"] > 0, acc["left"][i] / inner["pool"]).otherwise(F.lit(0.0))
            drawn = F.greatest(inner["n"] - rest, F.least(binomial(inner["n"], p, uniform(seed, s, i)), acc["left"][i], inner["n"]))
            return let(drawn, lambda x: F.struct((inner["n"] - x).alias("n"), rest.alias("pool"), F.concat(inner["row"], F.array(x)).alias("row")))

        pool = F.aggregate(acc["left"], F.lit(0).cast("long"), lambda a, b: a + b)
        row = F.aggregate(F.sequence(F.lit(0), F.size(acc["left"]) - 1), F.struct(F.get(sizes, s).alias("n"), pool.alias("pool"), F.array().cast("array<long>").alias("row")), source)["row"]
        return let(row, lambda x: F.struct(F.zip_with(acc["left"], x, lambda a, b: a - b).alias("left"), F.concat(acc["rows"], F.array(x)).alias("rows")))

    zero = F.struct(quotas.alias("left"), F.array().cast("array<array<long>>").alias("rows"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), zero, shard)["rows"]


def shard_counts(planned: DataFrame, n_sources: int, n_shards: int, seed: int) -> DataFrame:
    """``planned`` (rank, blocks, quota) -> (rank, blocks, shard, n): the slots of each shard that each source fills, when the shards have equal numbers of slots.

    Drawn in two levels, groups of sources and then the sources of each group, so that no row
    holds more than about the square root of their number.
    """
    width = math.isqrt(max(1, n_sources - 1)) + 1
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    groups = planned.groupBy(F.floor(F.col("rank") / width).cast("long").alias("g")).agg(F.sum("quota").alias("quota"), listed("rank", "blocks", "quota").alias("s"))
    total = F.aggregate("gs.quota", F.lit(0).cast("long"), lambda a, b: a + b)
    ends = let(total, lambda t: F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.floor(t * (i + 1) / n_shards).cast("long") - F.floor(t * i / n_shards).cast("long")))
    top = groups.groupBy().agg(listed("g", "quota").alias("gs")).where(F.size("gs") > 0).withColumn("sizes", ends)
    drawn = top.select("gs", dealt_counts(F.col("gs.quota"), F.col("sizes"), F.lit(seed)).alias("rows"))
    shares = drawn.select("rows", F.posexplode("gs").alias("j", "x")).select("x.g", F.transform("rows", lambda row: F.get(row, F.col("j"))).alias("sizes"))
    each = groups.join(shares, "g").select("s", F.posexplode(dealt_counts(F.col("s.quota"), F.col("sizes"), F.xxhash64(F.lit(seed + 1), "g"))).alias("shard", "counts"))
    return each.select("shard", F.explode(F.zip_with("s", "counts", lambda s, n: F.struct(s["rank"].alias("rank"), s["blocks"].alias("blocks"), n.alias("n")))).alias("d")).select("d.rank", "d.blocks", "shard", "d.n")


def place(sized: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """``n_rows`` different rows with ``rank`` and ``size`` -> the same with ``start``, the words before them in their source's stream, whose order is a hash of the rows.

    Sums run within parts of about PART_ROWS rows; a part starts where the sums of the parts before it end.
    """
    parts = max(1, -(-n_rows // PART_ROWS))
    dealt = sized.withColumns({"part": F.pmod(row_hash(sized, seed), F.lit(parts)), "order": row_hash(sized, seed + 1)})
    sums = dealt.groupBy("rank", "part").agg(F.sum("size").alias("n")).select("rank", "part", (F.sum("n").over(W.partitionBy("rank").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(W.partitionBy("rank", "part").orderBy("order").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return dealt.withColumn("inside", inside).join(sums.hint("merge"), ["rank", "part"]).select(*sized.columns, (F.col("before") + F.col("inside")).alias("start"))


def slot_table(planned: DataFrame, n_sources: int, n_slots: int, n_shards: int, seed: int) -> DataFrame:
    """``planned`` (rank, source_size, blocks, quota, last) -> a row for each block that the mix takes: rank, shard, slot (the source's count so far), block, most (words of it that are taken; null: all)."""
    each = shard_counts(planned, n_sources, n_shards, seed).join(planned.select("rank", "quota", "last"), "rank")
    begun = each.withColumn("first", F.sum("n").over(W.partitionBy("rank").orderBy("shard")) - F.col("n")).where("n > 0")
    dealt = begun.select("rank", "blocks", "quota", "last", "shard", (F.col("first") + F.col("n")).alias("end"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(SLOT_ROWS).cast("long"))).alias("begin"))
    tasks = max(int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_slots // TASK_SLOTS))
    spread = dealt.repartition(tasks, "rank", "begin")
    slots = spread.select("rank", "blocks", "quota", "last", "shard", F.explode(F.sequence("begin", F.least(F.col("begin") + SLOT_ROWS, F.col("end")) - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    most = F.when(F.col("slot") == F.col("quota") - 1, F.col("last")).alias("most")
    return slots.select("rank", "shard", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), turn).alias("block"), most)


def block_pieces(placed: DataFrame) -> DataFrame:
    """Rows with rank, start, size and their source's ``source_size`` and ``blocks`` -> a row for each block that they reach into: rank, start, block, skip (words of the row before it), words, before (words of the block before the row).

    A source's blocks are equal but for one word, the first ones longer.
    """
    short = F.expr("source_size div blocks")
    longer = F.col("source_size") - short * F.col("blocks")
    words = placed.where("size > 0").withColumns({"short": short, "longer": longer})
    inside = lambda w: F.expr(f"case when {w} < longer * (short + 1) then ({w}) div (short + 1) else longer + ({w} - longer * (short + 1)) div short end")
    cutting = words.select("rank", "start", "size", "short", "longer", F.explode(F.sequence(inside("start"), inside("(start + size - 1)"))).alias("block"))
    begin = lambda b: b * F.col("short") + F.least(b, F.col("longer"))
    opened = cutting.withColumns({"b": begin(F.col("block")), "e": begin(F.col("block") + 1)})
    skip, end = F.greatest(F.col("b") - F.col("start"), F.lit(0)), F.least(F.col("e") - F.col("start"), F.col("size"))
    return opened.select("rank", "start", "block", skip.alias("skip"), (end - skip).alias("words"), F.greatest(F.col("start") - F.col("b"), F.lit(0)).alias("before"))


def plan_mix(sized: DataFrame, block: int = BLOCK, n_shards: int = SHARDS, seed: int = 29) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sized`` (source, size, columns that name the row) -> targets, placed rows (with ``copy``, the number among rows equal in all columns), and the pieces taken (rank, start, shard, slot, skip, words).

    A source of S words has the least number of blocks that hold at most ``block`` words each.
    It fills slots until its target is met, the last one in part. Reruns agree: all that looks random is a
    hash of contents. Rows that agree in all columns are counted and numbered first, so that they
    spread over parts however many they are.
    """
    counted = sized.groupBy(*[F.col(f"`{c}`") for c in sized.columns]).agg(F.count("*").alias("copies"))
    kept = cut(unfolded(counted, "copies", "copy"), "sized")
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    filled = F.try_divide(F.col("target"), F.col("source_size")) * F.col("blocks")
    quota = F.coalesce(F.least(F.col("blocks") * MOST_REPEATS, F.ceil(filled - 1e-9).cast("long")), F.lit(0).cast("long"))
    last = F.round(F.try_divide((filled - F.col("quota") + 1) * F.col("source_size"), F.col("blocks"))).cast("long")
    targets = cut(source_targets(kept).withColumn("blocks", blocks).withColumn("quota", quota).withColumn("last", last), "targets")
    size = targets.agg(F.coalesce(F.sum("source_rows"), F.lit(0)).alias("rows"), F.count_if(F.col("source_size") > 0).alias("sources"), F.coalesce(F.sum("quota"), F.lit(0)).alias("slots")).first()
    named = targets.select(F.col("source").alias("t_source"), "rank", "source_size", "blocks")
    ranked = kept.join(named, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    placed = cut(place(ranked, size.rows, seed), "placed")
    slots = slot_table(targets.where("source_size > 0"), size.sources, size.slots, n_shards, seed + 2).hint("merge")  # few rows unfold into many: never broadcast them
    taken = slots.join(block_pieces(placed), ["rank", "block"]).withColumn("words", F.least("words", F.greatest(F.coalesce("most", F.lit(1 << 62)) - F.col("before"), F.lit(0).cast("long")))).where("words > 0")
    return targets, placed, taken.select("rank", "start", "shard", "slot", "skip", "words")


def mixed_sizes(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sized`` (doc_id, source, size) -> doc_id, source, size, source_size, target, taken: words of each row that the mix takes, repeats counted. A row for each row.

    A null source is a source. A row may be longer than many blocks, and its pieces are taken each
    by itself, up to MOST_REPEATS times. Rows without words take part with 0 words; repeated rows
    are rows of their own, which may be taken differently; an empty table gives no rows. Extra
    columns are left out.
    """
    targets, placed, taken = plan_mix(sized.select("doc_id", "source", "size"), block)
    sums = taken.groupBy("rank", "start").agg(F.sum("words").alias("taken"))
    full = placed.where("size > 0").join(sums, ["rank", "start"], "left").unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return full.join(targets.select("rank", "target"), "rank").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix_texts(docs: DataFrame, block: int = BLOCK, n_shards: int = SHARDS, n_chars: str | None = "n_chars") -> DataFrame:
    """The mix as rows like ``docs`` (doc_id, text, source, ...): each taken piece of a text, with the columns of its document, ``shard`` and ``slot``.

    Streams of words are packed into blocks of ``block`` words; a block holds pieces of
    neighbouring documents, each with the white space behind its words. A column ``n_chars``
    becomes the piece's length. Null and empty texts have no words and give no rows, nor does an
    empty table; a null source is a source; input columns ``shard`` and ``slot`` are replaced.
    Rows equal in doc_id, source and text share their pieces, with the other columns of one of
    them; however many there are, no list of pieces has those of more than LISTED of them. A very
    long text has many pieces, and is split into words once for each list.
    """
    rows = without(docs, "shard", "slot")
    marked = rows.select(F.struct("*").alias("row"), F.struct(F.xxhash64("doc_id", "source", "text"), F.xxhash64(F.lit(1), "doc_id", "source", "text")).alias("mark"))
    _, placed, taken = plan_mix(marked.select("row.source", "mark", word_count(F.col("row.text")).alias("size")), block, n_shards)
    pieces = taken.join(placed.where("size > 0").select("rank", "start", "mark", F.floor((F.col("copy") - 1) / LISTED).alias("part")), ["rank", "start"]).select("mark", "part", "shard", "slot", "skip", "words")
    listed = pieces.groupBy("mark", "part").agg(F.collect_list(F.struct("shard", "slot", "skip", "words")).alias("pieces"))
    met = marked.dropDuplicates(["mark"]).join(listed, "mark")
    words = F.regexp_extract_all("row.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut_out = lambda w, p: F.array_join(F.slice(w, (p["skip"] + 1).cast("int"), p["words"].cast("int")), "")
    opened = met.withColumn("piece", F.explode(let(words, lambda w: F.transform("pieces", lambda p: F.struct(cut_out(w, p).alias("text"), p["shard"].alias("shard"), p["slot"].alias("slot"))))))
    made = {"text": F.col("piece.text")} | ({n_chars: F.length("piece.text").cast("long")} if n_chars in rows.columns else {})
    return opened.select(*[made[c].alias(c) if c in made else F.col(f"row.`{c}`") for c in rows.columns], "piece.shard", "piece.slot")
