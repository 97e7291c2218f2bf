"""Batches of bounded size, tasks for small rows, and what ingestion writes and moves."""

from __future__ import annotations

import pyarrow as pa

from kotonoha.functions.batches import slices, tasks
from kotonoha.functions.scratch import scratch
from kotonoha.operators import books as K
from kotonoha.plans.deinflect import register_deinflect, surfaces
from kotonoha.queries import lookup_queries
from kotonoha.queries.flow_queries import shelf
from kotonoha.sources import epub

SMALL = "/root/testdata/sf0.001"


def test_slices():
    """A batch ends before its sizes add up to more than the most; a row that is larger is alone."""
    batch = pa.RecordBatch.from_pydict({"n": list(range(6)), "size": [4, 4, 4, 50, None, 9]})
    assert [b.column("n").to_pylist() for b in slices(iter([batch, batch.slice(0, 0)]), most=10)] == [[0, 1], [2], [3], [4, 5]]


def test_walk_takes_rows_by_their_size(spark):
    """Rows of any length give the same parts; one that is called _size in the input's other columns stays apart from sizes."""
    rows = [("b", f"i{n}", f"<html><body><p>{'x' * n}</p></body></html>", n) for n in (1, 1 << 20, 3, 2_000_000)] + [("b", "none", None, 0)]
    parts = epub.item_parts(spark.createDataFrame(rows, "book string, item_id string, html string, size int").coalesce(1), keep=["size"])
    assert {(x.item_id, x.characters) for x in parts.select("item_id", "characters", "size").where("characters = size").collect()} == {(i, n) for _, i, _, n in rows}


def test_ingestion_reads_packages_once_and_keeps_no_bodies(spark):
    """Packages are a table that is read again, parts have pieces and no second copy of the text, and the table of contents doesn't move the entries."""
    work = scratch(spark)
    out = K.ingest_books(shelf(spark, SMALL, bodies=True), work=work)
    assert spark.read.parquet(f"{work}/packages").count() == out["packages"].count() > 0
    assert "body" not in (columns := spark.read.parquet(f"{work}/parts").columns) and "pieces" in columns
    plan = out["sections"]._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and out["parts"].where("body is null").isEmpty()


def test_surfaces_keep_their_tasks(spark):
    """Few and short texts are still dealt to many tasks, and the table function can leave chains out."""
    df = spark.createDataFrame([("食べた",), ("食べた",), (None,), ("読んだ",)], "t string")
    assert surfaces(df, "t").rdd.getNumPartitions() == tasks(spark) >= 4 * spark.sparkContext.defaultParallelism and surfaces(df, "t").count() == 2
    register_deinflect(spark, "bare", chains=False)
    got = spark.sql("SELECT t.text, d.* FROM {texts} t, LATERAL bare(t.text) d", texts=surfaces(df, "t"))
    assert got.columns == ["text", "cand_pos", "candidate", "conditions"] and got.where("candidate = '食べる'").count() > 0


def test_entry_lookup_either_way(spark, monkeypatch):
    """Known words that are broadcast, and ones that are too many for that, give the same rows."""
    few = sorted(map(tuple, lookup_queries.entry_lookup(spark, SMALL).collect()))
    monkeypatch.setattr(lookup_queries, "KNOWN", 0)
    assert sorted(map(tuple, lookup_queries.entry_lookup(spark, SMALL).collect())) == few and few
