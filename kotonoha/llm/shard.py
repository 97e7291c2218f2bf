"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.llm.common import cut, row_hash, unfolded, without
from kotonoha.llm.draws import hypergeometric, let, uniform


def _spread(sizes: Column, capacity: Column, seed: Column) -> Column:
    """For parts of the given ``sizes`` (one array), how many rows each sends to each shard, when the shards take ``capacity`` rows from all of them."""

    def part(acc: Column, i: Column) -> Column:
        def shard(inner: Column, s: Column) -> Column:
            x = hypergeometric(acc["free"][s], inner["pool"], inner["left"], uniform(seed, i, s))
            return let(x, lambda n: F.struct((inner["left"] - n).alias("left"), (inner["pool"] - acc["free"][s]).alias("pool"), F.concat(inner["row"], F.array(n)).alias("row")))

        zero = F.struct(F.element_at(sizes, i + 1).alias("left"), F.aggregate(acc["free"], F.lit(0).cast("long"), lambda a, b: a + b).alias("pool"), F.array().cast("array<long>").alias("row"))
        drawn = F.aggregate(F.sequence(F.lit(0), F.size(capacity) - 1), zero, shard)["row"]
        return let(drawn, lambda row: F.struct(F.zip_with(acc["free"], row, lambda a, b: a - b).alias("free"), F.concat(acc["rows"], F.array(row)).alias("rows")))

    zero = F.struct(capacity.alias("free"), F.array().cast("array<array<long>>").alias("rows"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), zero, part)["rows"]


def communication_matrix(sizes: DataFrame, n_shards: int, n_rows: int, parts: int, seed: int) -> DataFrame:
    """``sizes`` (part, n) -> (part, counts array<long>), a draw from the law of a uniform shuffle of ``n_rows`` rows.

    The matrix is drawn in two levels, groups of parts and then the parts of each group, so
    that no row holds more than about the square root of the number of parts.
    """
    width = max(1, math.isqrt(max(1, parts - 1)) + 1)
    capacity = F.array(*[F.lit(n_rows // n_shards + (s < n_rows % n_shards)).cast("long") for s in range(n_shards)])
    listed = lambda key: F.array_sort(F.collect_list(F.struct(key, "n")))
    groups = sizes.groupBy(F.floor(F.col("part") / width).cast("long").alias("g")).agg(F.sum("n").alias("n"), listed("part").alias("parts"))
    top = groups.groupBy().agg(listed("g").alias("gs")).where(F.size("gs") > 0)
    drawn = top.select(F.explode(F.arrays_zip(F.col("gs.g").alias("g"), _spread(F.col("gs.n"), capacity, F.lit(seed)).alias("c"))).alias("d")).select("d.g", "d.c")
    each = groups.join(drawn, "g").select(F.explode(F.arrays_zip(F.col("parts.part").alias("part"), _spread(F.col("parts.n"), F.col("c"), F.xxhash64(F.lit(seed + 1), "g")).alias("counts"))).alias("d"))
    return each.select("d.part", "d.counts")


def shard_rows(docs: DataFrame, n_shards: int = 8, seed: int = 17, part_rows: int = 16_384) -> DataFrame:
    """Deal the rows of ``docs`` to ``n_shards`` shards: a uniform shuffle whose shard sizes are at most one apart.

    Adds ``shard`` int and ``slot`` long (gapless from 0 in each shard); input columns of these
    names are replaced. Rows fall into parts of about ``part_rows`` by a hash of their content;
    the matrix says how many rows of each part go to each shard, a local permutation says
    which, and after the exchange a second permutation gives the slots. No step sorts more than
    about ``part_rows`` rows together. Rows equal in all columns are counted first and then
    numbered, so that they spread over parts however many they are. Nulls count as values; an
    empty table gives no rows. Select the columns that are needed beforehand: all of them move
    three times.
    """
    rows = without(docs, "shard", "slot")
    n_rows = rows.count()
    parts, blocks = max(1, -(-n_rows // part_rows)), max(1, -(-n_rows // (n_shards * part_rows)))
    key, order = row_hash(rows, seed), row_hash(rows, seed + 1)
    counted = rows.select(F.struct("*").alias("row"), key.alias("key"), order.alias("r")).groupBy("row", "key", "r").agg(F.count("*").alias("copies"))
    numbered = unfolded(counted, "copies", "no")
    keyed = cut(numbered.select("row", F.pmod(F.xxhash64("key", "no"), F.lit(parts)).alias("part"), F.xxhash64("r", "no").alias("r")), "numbered")
    sizes = cut(keyed.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    matrix = communication_matrix(sizes, n_shards, n_rows, parts, seed)
    placed = keyed.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("r")).cast("long")).join(matrix.hint("merge"), "part")  # both sides are dealt by part already
    shard = F.aggregate("counts", F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("end")), lambda acc, n: F.struct((acc["s"] + (acc["end"] + n < F.col("k")).cast("int")).alias("s"), (acc["end"] + n).alias("end")))["s"]
    dealt = cut(placed.select("row", shard.alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 2), "r"), F.lit(blocks)).alias("block"), F.xxhash64(F.lit(seed + 3), "r").alias("r")), "shard")
    starts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    within = F.row_number().over(W.partitionBy("shard", "block").orderBy("r")) - 1
    return dealt.withColumn("within", within).join(starts.hint("merge"), ["shard", "block"]).select("row.*", "shard", (F.col("start") + F.col("within")).alias("slot"))
