"""Each query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kotonoha.queries.adapters import surfaces, terms

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if value is None or value != value:
        return ""
    return str(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    wanted = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in got.columns]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture
def small(spark, tmp_path):
    """Words of one letter to sixteen, some of them in terms."""
    texts = ["a ab abc abcd abcde abcdefg internationalise internationalisation", "b international nation"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "abcdefgh internationalise"), (1, "ab nation b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_variants_of_long_words(spark, small):
    got = Counter(r.text for r in QUERIES["text_variants"](spark, small).collect())
    assert got == dict.fromkeys([r.w + "った" for r in surfaces(spark, small).collect()], 4)


def test_all_surfaces_by_brute_force(spark, small):
    words = {r.w: r.s for r in surfaces(spark, small).collect()}
    found = [(r.term, r.dictionary, r.sequence_number) for r in terms(spark, small).collect()]
    longest = max(len(t) for t, *_ in found)
    got = Counter(map(tuple, QUERIES["batch_lookup"](spark, small).collect()))
    assert got == Counter((s, *t) for s in words.values() for t in found if s in t[0])
    parts = {r.w: r.parts.split("|") for r in QUERIES["substrings"](spark, small).collect()}
    assert parts == {w: [s[i : i + n] for i in range(len(s)) for n in range(min(longest, len(s) - i), 0, -1)] for w, s in words.items()}
    joined = {(r.text, r.cand_pos, r.candidate, r.conditions) for r in QUERIES["deinflect_joins"](spark, small).collect()}
    assert joined == {(r.text, r.cand_pos, r.candidate, r.conditions) for r in QUERIES["deinflect"](spark, small).collect()}
    assert {t for t, *_ in joined} == set(words.values())
