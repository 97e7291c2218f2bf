"""Running text scanned for entries, against all substrings by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kotonoha.functions import text as T
from kotonoha.operators import scan
from kotonoha.operators.scan import scan_entries, scan_texts
from kotonoha.plans.deinflect import candidates, fitting_rules, rule_index
from kotonoha.plans.rules import japanese_rules

INDEX, FITS = rule_index(japanese_rules()), fitting_rules()
TERMS = [("食べる", "a", ["v1"]), ("食べる", "b", []), ("読む", "a", ["v5"]), ("来る", "a", ["vk"]), ("くる", "a", ["vk"]), ("い", "a", ["adj-i"]), ("高い", "a", ["adj-i"]), ("本", "a", []), ("本屋", "b", []), ("た", "a", []), ("る", "a", ["v1"]), ("", "a", []), (None, "a", [])]
TEXTS = ["昨日本屋で本を読んでいるのを食べさせられたくなかった", "きたくない来なかった高くなければ", "かったくないたる", "", None, "xyz", "本" * 30]


def brute(text: str | None, terms: list[tuple], longest: int) -> list[tuple]:
    out = []
    for start in range(len(text or "")):
        for n in range(min(longest, len(text) - start), 0, -1):
            source = text[start : start + n]
            forms = candidates(source, INDEX, 6)
            if any(t == form and (not conditions or any(r in FITS[c] for c in conditions for r in rules)) for form, conditions, _ in forms for t, _, rules in terms):
                out.append((start, n, source))
                break
    return out


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term string, dictionary string, inflection_rules array<string>")


@pytest.mark.parametrize("longest,part_terms", [(24, 1000), (5, 4)])
def test_scan(spark, terms, longest, part_terms):
    r = random.Random(6)
    made = ["".join(r.choices("くるいたかっなきてべ食読んで来高本", k=40)) for _ in range(12)]
    texts = TEXTS + made
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("start", F.lit("x"))
    got = sorted((x.id, x.start, x.length, x.source) for x in scan_texts(df, terms, longest=longest, part_terms=part_terms).collect())
    assert got == sorted((i, *p) for i, t in enumerate(texts) for p in brute(t, TERMS, longest))


def test_scan_with_forms(spark, terms):
    """Katakana is read as hiragana too; a form that changes the number of characters is no help."""
    df = spark.createDataFrame([(1, "キタくナイ"), (2, "本ヤ")], "id int, text string")
    forms = [lambda c: T.katakana_to_hiragana(c), lambda c: F.concat(c, F.lit("い"))]
    got = {(x.id, x.start): (x.source, x.variant) for x in scan_texts(df, terms, forms=forms).collect()}
    assert got[1, 0] == ("キタくナイ", "きたくない") and got[2, 0] == ("本", "本") and got[1, 4] == ("イ", "い")


def test_entries_of_places(spark, terms):
    df = spark.createDataFrame([(1, "本を食べた"), (2, "食べた食べた")], "id int, text string")
    got = {(x.id, x.start, x.term, x.dictionary): x.chains for x in scan_entries(scan_texts(df, terms), terms, ["term", "dictionary"]).collect()}
    assert got[1, 2, "食べる", "a"] == [["-た"]] and got[2, 0, "食べる", "a"] == [["-た"]] and (2, 3, "食べる", "a") in got
    assert (1, 2, "食べる", "b") not in got and got[1, 0, "本", "a"] == [[]]


def test_no_terms_no_texts(spark, terms):
    df = spark.createDataFrame([(1, "本")], "id int, text string")
    assert scan_texts(df, terms.limit(0)).collect() == [] and scan_texts(df.limit(0), terms).collect() == []


def test_scan_over_blocks_and_forgetting(spark, terms, monkeypatch):
    """Places that take letters in small blocks, and endings forgotten in between, change nothing; lists hold the same places, of which only what is told comes back."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("places", F.lit("x"))
    whole = sorted((x.id, x.places, x.start, x.length, x.variant) for x in scan_texts(df, terms).collect())
    rules = {t: frozenset(r) for t, _, r in TERMS if t}
    rules["食べる"] = frozenset(["v1"])
    monkeypatch.setattr(scan, "TOGETHER", 7)
    monkeypatch.setattr(scan, "REMEMBERED", 3)
    endings = scan.Endings(japanese_rules(), rules, {c: frozenset(r) for c, r in FITS.items()}, 24)
    texts = [(i, t) for i, t in enumerate(TEXTS) if t]
    found = endings.longest_sources([t for _, t in texts]).tolist()
    places = [(i, start) for i, t in texts for start in range(len(t))]
    assert [(i, start, n) for (i, start), n in zip(places, found, strict=True) if n] == [(i, start, n) for i, _, start, n, _ in whole]
    lists = {x.id: x.places for x in scan.scan_lists(df, terms, told=["length", "start"]).collect()}
    assert sorted((i, p.start, p.length) for i, listed in lists.items() for p in listed) == [(i, start, n) for i, _, start, n, _ in whole] and set(lists) == {i for i, _ in texts}


def test_scan_runs_once_for_entries(spark, terms):
    """Entries of places read what was scanned from a table: no scan is left in their plan."""
    met = scan_entries(scan_texts(spark.createDataFrame([(1, "本を食べた")], "id int, text string"), terms), terms, ["term"])
    assert "mapInArrow" not in (plan := met._jdf.queryExecution().analyzed().toString()) and "MapInArrow" not in plan
