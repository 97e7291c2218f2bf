"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and a run of white space, in the sense of all operators here.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A temporary one where none is set, in local mode alone: on a cluster the executors would not see it, so that there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kotonoha-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on the executors that made it.

    The table is removed when the driver ends (``deleteOnExit`` of its file system), as results
    are read from it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a bitmap of wanted keys: 16 for each, within these bounds (64 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


def _flagged(rows: DataFrame, wanted: DataFrame, key: str, n: int, how: str) -> DataFrame:
    """``rows`` with ``_likely``: whether the bit of their ``key`` is set in the bitmap of the ``n`` keys in ``wanted``."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    maps = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    placed = rows.withColumn("_place", place).join(F.broadcast(maps), F.bitmap_bucket_number("_place") == F.col("_bucket"), how)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.bitmap_bit_position("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("cast(bitmap_bit_position(_place) % 8 as int)")
    return placed.withColumn("_likely", F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1)


def likely_wanted(rows: DataFrame, wanted: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of ``rows`` whose ``key`` is one of the ``n`` in ``wanted``, and few others: a bitmap of hashes is broadcast, so that what a later join would drop isn't moved first.

    The bitmap's size is bounded; with more keys than it holds it lets more rows through, never fewer. Null is a key.
    """
    return _flagged(rows, wanted, key, n, "inner").where("_likely").select(*[F.col(f"`{c}`") for c in rows.columns])


def split_likely(rows: DataFrame, wanted: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows that ``likely_wanted`` gives, and all others, which surely have no ``key`` in ``wanted``."""
    flagged = _flagged(rows, wanted, key, n, "left").withColumn("_likely", F.coalesce("_likely", F.lit(False)))
    back = [F.col(f"`{c}`") for c in rows.columns]
    return flagged.where("_likely").select(*back), flagged.where("not _likely").select(*back)


def drop_special(docs: DataFrame, mark: Column, special: DataFrame) -> DataFrame:
    """The rows of ``docs`` less those that ``special`` (s_id, s_mark, keep, key) names by doc_id and ``mark``; where ``keep`` is true one of them stays, that with the least hash of its text. Rows that it doesn't name aren't moved."""
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_id"), mark.alias("r_mark")).withColumn("key", F.xxhash64("r_id", "r_mark"))
    n = special.agg(F.count("*").alias("all"), F.count_if("keep").alias("keep")).first()
    named = lambda rows: rows.select(F.col("key").alias("s_key"), "s_id", "s_mark")
    same = (F.col("key") == F.col("s_key")) & F.col("r_id").eqNullSafe(F.col("s_id")) & (F.col("r_mark") == F.col("s_mark"))
    likely, others = split_likely(marked, special, "key", n["all"])
    out = others.select("row.*").unionByName(likely.join(named(special), same, "left_anti").select("row.*"))
    if n["keep"]:
        repeated = special.where("keep")
        found = likely_wanted(marked, repeated, "key", n["keep"]).join(named(repeated), same)
        out = out.unionByName(found.groupBy("key", "r_id", "r_mark").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*"))
    return out


def row_hash(df: DataFrame, seed: int, columns: list[str] | None = None) -> Column:
    """A 64-bit pseudorandom value that depends on a row's content alone, so that a lost task gives the same value again."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (columns or df.columns)])


def unfolded(df: DataFrame, copies: str, number: str, most: int = 4_096) -> DataFrame:
    """Each row as often as its column ``copies`` (1 or more) says, with ``number`` from 1 in its place; in steps of ``most``, so that no array grows with the number."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != copies]
    begun = df.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies), F.lit(most).cast("long"))).alias("_begin"))
    return begun.select(*kept, F.explode(F.sequence("_begin", F.least(F.col("_begin") + most - 1, F.col(copies)))).alias(number))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add (in any case of letters)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most`` bytes (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)
