from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kotonoha.operators.scan import Endings
from kotonoha.plans import deinflect as D
from kotonoha.plans.rules import Rule, japanese_rules, widened

COUNTS = {"-ば": 11, "-ちゃ": 17, "-しまう": 2, "-なさい": 16, "-そう": 17, "-たい": 16, "-たら": 37, "-たり": 36, "-て": 37, "-ず": 16, "causative": 19, "short causative": 17, "imperative": 20, "continuative": 35, "negative": 18, "passive": 16, "-た": 39, "-ます": 17, "potential": 14, "potential or passive": 8, "volitional": 18, "volitional slang": 17, "-まい": 9, "-おく": 6, "-いる": 8, "-え": 42, "n-slang": 5, "kansai-ben negative": 6, "kansai-ben -て": 15, "kansai-ben -く": 11}


def test_table():
    rules = japanese_rules()
    counts = Counter(r.transform for r in rules)
    assert len(rules) == 810 and len(counts) == 53 and len({r.suffix for r in rules}) == 676
    assert max(len(r.suffix) for r in rules) == 6 and sum(len(r.plain) > len(r.suffix) for r in rules) == 28 and sum(not r.before for r in rules) == 365
    assert all(counts[k] == n for k, n in COUNTS.items())


def test_conditions():
    assert widened(["v5ss"]) == {"v5ss", "v5s", "v5", "v"} and widened([]) == frozenset() and widened(["-て"]) == {"-て"}


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("食べた", {"食べた": "", "食べる": "v1", "食ぶ": "v5d"}),
        ("行った", {"行った": "", "行っる": "v1", "行う": "v5", "行つ": "v5", "行る": "v5", "行く": "v5"}),
        ("読んでいる", {"読んでいる": "", "読んで": "-て", "読ぬ": "v5", "読ぶ": "v5", "読む": "v5"}),
        ("猫", {"猫": ""}),
    ],
)
def test_vectors(text, wanted):
    got = D.candidates(text, D.rule_index(japanese_rules()), 6)
    assert {form: " ".join(c) for form, c, _ in got} == wanted and got[0] == (text, (), ())


def test_long_chain_and_cap():
    index = D.rule_index(japanese_rules())
    got = D.candidates("食べさせられた", index, 6)
    assert len(got) == 11
    chains = [[s[0] for s in chain] for form, c, chain in got if form == "食べる" and c == ("v1",)]
    assert ["-た", "potential or passive", "causative"] in chains
    with pytest.raises(ValueError):
        D.candidates("食べさせられた", index, 6, most=5)


def test_helper_and_joins_agree(spark):
    words = ["食べた", "行った", "読んでいる", "猫", "食べさせられた", "しちゃった", "高くない", "来られない", "", "まい", "すごく", "飲まなければ", "書いとく"]
    df = spark.createDataFrame([(w,) for w in [*words, *words, None]], "w string")
    a = {(r.text, r.cand_pos, r.candidate, " ".join(r.conditions)) for r in D.deinflect(df, "w").collect()}
    b = {(r.text, r.cand_pos, r.candidate, r.conditions) for r in D.deinflect_by_joins(df, "w", steps=7).collect()}
    assert a == b and {t for t, *_ in a} == set(words)


def test_joins_end_where_no_row_is_new(spark):
    long = "食べ" + "てい" * 10 + "た"
    df = spark.createDataFrame([(long,), ("食べた",)], "w string")
    a = {(r.text, r.cand_pos, r.candidate, " ".join(r.conditions)) for r in D.deinflect(df, "w").collect()}
    assert max(len(r.chain) for r in D.deinflect(df, "w").collect()) > 8
    assert {(r.text, r.cand_pos, r.candidate, r.conditions) for r in D.deinflect_by_joins(df, "w").collect()} == a
    with pytest.raises(ValueError):
        D.deinflect_by_joins(df, "w", steps=8)


def test_recursive_query(spark):
    """The same rows as by joins, nothing run before they are asked for."""
    df = spark.createDataFrame([("食べさせられた",), ("食べさせられた",), ("た",), ("",), (None,), ("高くなかった",)], "w string")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    got = D.deinflect_recursive(df, "w")
    assert jobs() == before
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.deinflect_by_joins(df, "w").select(*got.columns).collect()))
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        D.deinflect_recursive(df, "w", steps=2).collect()


def test_rules_for_prefixes(spark):
    """A rule at the front takes its prefix alone, in the order of the table, under the same conditions; the scan has no such rules."""
    table = [Rule("past", 0, 0, "た", "る", (), ("v1",)), Rule("honorific", 1, 0, "お", "", ("v1",), ("adj-i",), front=True), Rule("reading", 2, 0, "御", "お", (), (), front=True)]
    rows = D.deinflect(spark.createDataFrame([("お見せた",), ("見せお",), ("お",)], "w string"), "w", table).collect()
    assert sorted((r.text, r.cand_pos, r.candidate) for r in rows) == [("お", 0, "お"), ("お", 1, ""), ("お見せた", 0, "お見せた"), ("お見せた", 1, "お見せる"), ("お見せた", 2, "見せた"), ("お見せた", 3, "見せる"), ("見せお", 0, "見せお")]
    assert [c[0] for c in D.candidates("御た", D.rule_index(table), 1, fronts=D.rule_index(table, front=True))] == ["御た", "御る", "おた", "おる", "た", "る"]
    df = spark.createDataFrame([("おた",), ("たお",), ("お\n",), ("た\n",)], "w string")
    assert [r.h for r in df.select(D.is_inflected(F.col("w"), "honorific", table).alias("h")).collect()] == [True, False, True, False]
    assert [r.h for r in df.select(D.is_inflected(F.col("w"), "past", table).alias("h")).collect()] == [True, False, False, False]
    with pytest.raises(ValueError, match="prefixes"):
        Endings(table, {}, {}, 5)
