"""Reading progress and imports as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from kotonoha.functions.scratch import clear, exists, listed, remove, scratch
from kotonoha.sources import banks


def percent(position: Column, extent: Column) -> Column:
    """Position over extent in percent, to one decimal (halves up)."""
    return F.when(extent > 0, F.floor(position / extent * 1000 + 0.5) / 10)


def latest_progress(events: DataFrame, extent: float = 100.0) -> DataFrame:
    """Events (ts, event_id, user_id, value) -> the last position of each book (one per user) in percent. The same plan runs on a batch and on a stream; its state is a row for each book."""
    latest = events.groupBy(F.col("user_id").alias("book")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("position"), F.count("*").alias("n"))
    return latest.select("book", percent(F.col("position"), F.lit(extent)).alias("progress"), "n")


def heartbeats(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum of values for each book and window; on a stream, state older than ``late`` is dropped and events later than that are ignored."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("user_id").alias("book"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "book", "n", "total")


def reading_sessions(events: DataFrame, idle: str = "12 hours", late: str = "2 hours", extent: float = 100.0) -> DataFrame:
    """Events -> book, start, last, progress, n: a row for each stretch of a book's events without a pause of ``idle``, with the progress at its last event.

    On a stream a stretch is given, and its state dropped, once no event in time can lengthen
    it, so that state is kept for books being read alone; events out of order join what they
    fall into, later ones than ``late`` are ignored.
    """
    read = events.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), F.col("user_id").alias("book"))
    kept = read.agg(F.max_by("value", F.struct("ts", "event_id")).alias("position"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return kept.select("book", F.col("w.start").alias("start"), "last", percent(F.col("position"), F.lit(extent)).alias("progress"), "n")


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to the table ``path`` what is final of a streamed aggregate (``heartbeats``, ``reading_sessions``): each window once, when the watermark has passed its end."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late_stream(events: DataFrame, path: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Write events to ``path``, each marked whether it is ``late``: earlier than the last event of the batches before by more than ``late``. ``split_events`` reads them.

    Watermarks drop such events without a trace. Events without a time are late. A batch that
    comes again overwrites its own files; it needs no more than the mark of the batch before.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark, where = batch.sparkSession, f"{path}/events/batch={number}"
        before = spark.read.schema("mark timestamp").parquet(f"{path}/marks/batch={number - 1}").first().mark if number else None
        overdue = F.lit(False) if before is None else F.col("ts") < F.lit(before) - F.expr(f"interval {late}")
        batch.withColumn("late", F.coalesce(overdue | F.col("ts").isNull(), F.lit(True))).write.mode("overwrite").partitionBy("late").parquet(where)
        own = spark.read.schema(batch.schema).parquet(where).agg(F.greatest(F.max("ts"), F.lit(before).cast("timestamp")).alias("mark"))
        own.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_events(spark: SparkSession, path: str, schema: StructType, late: bool) -> DataFrame:
    """The events that ``split_late_stream`` found late, or those in time."""
    every = StructType([*schema.fields, StructField("batch", IntegerType()), StructField("late", BooleanType())])
    return spark.read.schema(every).parquet(f"{path}/events").where(F.col("late") == late).drop("batch", "late")


def progress_stream(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``latest_progress`` on what has arrived; each batch of changed books goes to ``sink``."""
    return latest_progress(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_stream(entries: DataFrame, path: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """A stream of archive entries (archive, path, content): each batch's new dictionaries are published under ``path``, then ``after`` gets their titles. An archive's entries must arrive together.

    The import's id is that of the stream and the batch: a batch that comes again after it was
    published is left out, one that broke off before is written anew.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def one(batch: DataFrame, number: int) -> None:
        import_batch(batch, path, f"{stream}-{number}", after)

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held_import_stream(entries: DataFrame, path: str, checkpoint: str, quiet: int = 1, patience: int = 100, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """As ``import_stream`` for archives whose entries may arrive in several batches.

    Entries wait under ``path`` until their archive has an index, a bank and banks numbered without
    a gap, and nothing of it came in the last ``quiet`` batches; then it is imported, once. An
    archive that is still incomplete after ``patience`` batches without an entry is given up. Both are settled
    (``settled``: archive, imported), and what comes later of them is left out. Waiting entries
    of settled archives are removed. ``finish_held`` settles what waits when a stream has ended.
    """

    def one(batch: DataFrame, number: int) -> None:
        banks.route_entries(batch.select("archive", "path", "content")).write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        _settle(batch.sparkSession, path, checkpoint, number, number - quiet, number - patience, after)

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish_held(spark: SparkSession, path: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> None:
    """Import complete archives that still wait after their stream has ended, and give up the others."""
    if exists(spark, f"{path}/waiting"):
        number = 1 + max(spark.read.schema("batch int").parquet(f"{path}/{name}").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] for name in ("waiting", "settled"))
        _settle(spark, path, checkpoint, number, number, number, after)


def settled(spark: SparkSession, path: str) -> DataFrame:
    """(archive, imported, batch) of the archives that ``held_import_stream`` is done with."""
    if not exists(spark, f"{path}/settled"):
        return spark.createDataFrame([], _SETTLED)
    return spark.read.schema(_SETTLED).parquet(f"{path}/settled")


_SETTLED = "archive string, imported boolean, batch int"


def _settle(spark: SparkSession, path: str, checkpoint: str, number: int, quiet_since: int, given_up_since: int, after: Callable[[DataFrame], None] | None) -> None:
    """Settle what is ready with a batch. What is settled is written first, and a batch that comes again keeps to it; the import has an id, so it isn't done twice."""
    stream, where = hashlib.md5(checkpoint.encode()).hexdigest()[:8], f"{path}/settled/batch={number}"
    done = settled(spark, path).where(F.col("batch") != number).select("archive")
    waiting = spark.read.schema(f"{banks.ENTRY}, kind string, bank_no int, batch int").parquet(f"{path}/waiting").join(done, "archive", "left_anti")
    if not exists(spark, f"{where}/_SUCCESS"):
        gaps = banks.bank_contiguity(waiting.dropDuplicates(["archive", "path"])).groupBy("archive").agg(F.bool_and("contiguous").alias("whole"))
        seen = waiting.groupBy("archive").agg(F.max("batch").alias("last"), F.bool_or(F.col("kind") == "index").alias("indexed")).join(gaps, "archive", "left")
        complete = F.col("indexed") & F.coalesce("whole", F.lit(False))
        over = (complete & (F.col("last") <= quiet_since)) | (~complete & (F.col("last") <= given_up_since))
        seen.where(over).select("archive", complete.alias("imported")).write.mode("overwrite").parquet(where)
    now = settled(spark, path).where((F.col("batch") == number) & F.col("imported")).select("archive")
    if not now.isEmpty():
        ready = waiting.join(now, "archive", "left_semi").dropDuplicates(["archive", "path"])
        import_batch(ready.select("archive", "path", "content"), path, f"{stream}-held-{number}", after)
    left = waiting.join(settled(spark, path).select("archive"), "archive", "left_anti").select("batch").distinct()
    kept = {row.batch for row in left.collect()}  # a row for each batch that waits
    for name in listed(spark, f"{path}/waiting"):
        if name.startswith("batch=") and int(name.removeprefix("batch=")) not in kept:
            remove(spark, f"{path}/waiting/{name}")


def import_batch(batch: DataFrame, path: str, import_id: str, after: Callable[[DataFrame], None] | None = None) -> bool:
    """Import archive entries once under ``import_id``; false if that was published before."""
    spark, known = batch.sparkSession, None
    if f"id-{import_id}" in banks.commits(spark, path):
        return False
    if exists(spark, f"{path}/dictionaries"):
        known = banks.read_table(spark, path, "dictionaries").select("title")
    work = scratch(spark)
    try:
        banks.write_dictionaries(banks.import_dictionaries(banks.route_entries(batch), known, work), path, import_id)
    finally:
        clear(spark, work)
    if after:
        after(spark.read.parquet(f"{path}/dictionaries").where(F.col(banks.IMPORT) == f"id-{import_id}").select("title"))
    return True
