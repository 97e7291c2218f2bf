"""How rows are dealt to tasks, and texts to batches of bounded size, where Python works on them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Tasks for each core, so that none waits long for the last one.
WAVES = 4


def tasks(spark: SparkSession) -> int:
    """Partitions for work whose rows are small and whose time isn't: a number that is given is kept, where AQE would put small partitions together."""
    return max(WAVES * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], sizes: str = "size", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column ``sizes`` adds up to about ``most`` (one row at least)."""
    for batch in batches:
        start = total = 0
        for i, n in enumerate(batch.column(sizes).to_pylist()):
            if i > start and total + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)
