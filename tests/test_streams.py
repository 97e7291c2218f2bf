"""Streams whose events come out of order."""

from __future__ import annotations

from datetime import datetime, timedelta

from kotonoha.streaming import progress as P

SCHEMA = "event_id long, user_id long, value double, ts timestamp"


def test_late_events_are_told_apart(spark, tmp_path):
    """The mark is the last time of the batches before, later batches don't lower it; events without a time are late, in the first batch too."""
    noon = datetime(2024, 1, 2, 12)
    batches = [[(1, 0), (2, 10), (3, None)], [(4, 8.5), (5, 7.5), (6, 8)], [(7, None)], [(8, 7), (9, 9)]]
    for rows in batches:
        made = [(i, 1, 1.0, None if h is None else noon + timedelta(hours=h)) for i, h in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        P.split_late_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    told = {late: sorted(r.event_id for r in P.split_events(spark, f"{tmp_path}/out", spark.createDataFrame([], SCHEMA).schema, late).collect()) for late in (True, False)}
    assert told == {True: [3, 5, 7, 8], False: [1, 2, 4, 6, 9]}
