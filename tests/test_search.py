from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kotonoha.operators import search as S
from kotonoha.plans.deinflect import filter_by_conditions

TERMS = "term string, reading string, dictionary string, definitions array<string>, term_tags array<string>, definition_tags array<string>, inflection_rules array<string>, popularity double, sequence_number long"


@pytest.fixture(scope="module")
def terms(spark):
    rows = [("食べる", "たべる", "A", ['"eat"', '{"type":"text","text":"consume"}', "{"], ["v"], ["d"], ["v1"], 2.0, 1), ("食ぶ", "たぶ", "A", ['"old eat"'], [], [], ["v5"], 1.0, 2), ("食べる", "たべる", "B", ['"essen"'], [], [], ["v1"], 3.0, 1), ("100%_x", "x", "A", ['"p"'], [], [], [], None, 3), ("猫", "ねこ", "B", ['["食べる",["v1"]]'], [], [], [], 1.0, 4)]
    return spark.createDataFrame(rows, TERMS)


def found(df):
    return sorted(r.term + r.dictionary for r in df.collect())


def test_modes(terms):
    assert found(S.search(terms, "term", "食", "suffix")) == ["食ぶA", "食べるA", "食べるB"]
    assert found(S.search(terms, "term", "る", "prefix", ["B"])) == ["食べるB"]
    assert found(S.search(terms, "term", "べ", "contains")) == ["食べるA", "食べるB"]
    assert found(S.search(terms, "term", "%", "contains")) == ["100%_xA"] and found(S.search(terms, "term", "0%X", "contains", like_compat=True)) == ["100%_xA"]
    assert found(S.search(terms, "term", "食_る", "suffix", like_compat=True)) == ["食べるA", "食べるB"]
    with pytest.raises(ValueError):
        S.search(terms, "term", "x", "other")


def test_lookup_by_inflected_form(spark, terms):
    texts = spark.createDataFrame([("食べた",), ("食べた",), ("猫",), (None,)], "text string")
    got = S.search_terms(texts, terms)
    assert sorted((r.text, r.cand_pos, r.term, r.dictionary) for r in got.collect()) == [("猫", 0, "猫", "B"), ("食べた", 1, "食べる", "A"), ("食べた", 1, "食べる", "B"), ("食べた", 2, "食ぶ", "A")]
    assert filter_by_conditions(got).count() == 4
    assert S.search_terms(texts, terms, deinflected=False).count() == 1
    assert S.search_terms(texts, terms, dictionaries=["B"]).count() == 2


@pytest.mark.parametrize("mode", ["prefix", "suffix", "contains"])
def test_batch_lookup_equals_single_searches(spark, terms, mode):
    words = ["食", "べる", "食べ", "る", "100", "%_", "x", "zz", "食べる", ""]
    queries = spark.createDataFrame([*[(w,) for w in words], (None,)], "q string")
    got = sorted((r.q, r.term, r.dictionary) for r in S.batch_lookup(queries, terms, mode, key="q").collect())
    assert got == sorted((w, r.term, r.dictionary) for w in words for r in S.search(terms, "term", w, mode).collect())


def test_pointing_definitions(terms):
    got = S.dictionary_deinflections(terms.withColumn("text", F.col("term")), terms).collect()
    assert {(r.via, r.term, r.dictionary, tuple(r.rules), r.kind) for r in got} == {("猫", "食べる", "A", ("v1",), "dictionary"), ("猫", "食べる", "B", ("v1",), "dictionary")}
    led = S.dictionary_deinflections(terms.withColumn("text", F.col("term")).withColumn("rules", F.array(F.lit("-た"))), terms).first()
    assert led.rules == ["-た", "v1"] and led.kind == "both"


def test_matches_of_one_entry_are_merged(spark):
    rows = [("e", "食べた", ["-た"], "algorithm"), ("e", "食べた", ["-た"], "dictionary"), ("e", "食べだ", ["x"], "algorithm"), ("e", "食べ", [], "dictionary"), ("f", "飲む", [], "dictionary"), ("f", "読む", [], "dictionary")]
    got = S.dedupe_lookup(spark.createDataFrame(rows, "entry string, text string, rules array<string>, kind string"), ["entry"]).collect()
    assert {r.entry: (r.source, r.matches, [(c.rules, c.kind) for c in r.chains]) for r in got} == {"e": ("食べた", 3, [(["-た"], "both"), (["x"], "algorithm")]), "f": ("読む", 2, [([], "dictionary")])}


META = "term string, dictionary string, meta_type string, frequency double, display_frequency string, downstep_position int, devoice_positions array<int>, nasal_positions array<int>, transcription string, tags array<string>"


def test_rendering(spark, terms):
    rows = [
        ("食べる", "F", "frequency", 5.0, "5位", None, None, None, None, None), ("食べる", "G", "frequency", None, "12x", None, None, None, None, None), ("食べる", "H", "frequency", 2.5, None, None, None, None, None, None),
        ("食べる", "P", "pitch", None, None, 2, [1, 3], [2], None, ["t", "u"]), ("食べる", "Q", "pitch", None, None, 0, [], [], None, []), ("x", "P", "ipa", None, None, None, None, None, "[x]", ["t"]), ("x", "P", "odd", None, None, None, None, None, None, None),
    ]
    meta = spark.createDataFrame(rows, META)
    texts = ["F<br>Frequency: 5位 Actual Value: 5", "G<br>Frequency: 12x", "H<br>Actual Value: 2.5", "P<br>Downstep on mora 2 <br>Devoice on these morae: 1 3 <br>Nasal on these morae: 2 <br> Tags: t u", "Q<br>Downstep on mora 0"]
    got = S.render_lookup(S.attach_term_meta(terms.where("dictionary = 'A' and popularity = 2"), meta)).orderBy("def_no").collect()
    assert [r.html for r in got] == ["<br>".join([*texts, "Term Tags: v", "Definition Tags: d", d]) for d in ("eat", "consume")] + [None]
    bare = S.render_lookup(S.attach_term_meta(terms.where("dictionary = 'B' and popularity = 3"), meta.where("term = 'x'"))).first()
    assert bare.html == "essen"
    few = spark.createDataFrame([("x", "P", "ipa", "[x]")], "term string, dictionary string, meta_type string, transcription string")
    assert few.select(S.meta_text(few)).first()[0] == "P<br>Transcription: [x]"


def test_ranks(spark, terms):
    top = S.rank_terms(terms, ["sequence_number"], top=1).collect()
    assert {(r.sequence_number, r.dictionary) for r in top} == {(1, "B"), (2, "A"), (3, "A"), (4, "B")}
    meta = spark.createDataFrame([("食べる", "F", "frequency", 5.0), ("猫", "F", "frequency", 9.0)], "term string, dictionary string, meta_type string, frequency double")
    order = lambda mode: [r.term for r in S.rank_by_frequency(terms, meta, [], "F", mode).orderBy("rank").collect()]
    assert order("occurrence")[0] == "猫" and order("rank")[:2] == ["食べる", "食べる"]


def test_stored_index(spark, tmp_path):
    """The rows of ``batch_lookup`` in every mode, by a plan that moves neither table of the index."""
    from kotonoha.sources.index import drop_index, lookup_index, write_index

    terms = spark.createDataFrame([("a", 1), ("ab", 2), ("ab", 2), ("aab", 3), ("bab", 4), ("abcd", 5), ("", 6), (None, 7), ("ああい", 8)], "term string, n int")
    queries = spark.createDataFrame([("a",), ("ab",), ("abc",), ("abcd",), ("",), (None,), ("あい",), ("x",)], "candidate string")
    write_index(terms, str(tmp_path / "index"), "stored_index", buckets=4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in S.MODES:
            found = lookup_index(queries, "stored_index", mode)
            order = lambda rows: sorted(map(tuple, rows))
            assert order(found.select("candidate", "term", "n").collect()) == order(S.batch_lookup(queries, terms, mode).select("candidate", "term", "n").collect())
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Bucketed: true") == 2 and plan.count("Exchange hashpartitioning") == 2  # of the queries, and of what they find
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        drop_index(spark, "stored_index")


def test_ranks_by_ranges(spark):
    """A key with nearly all rows, ties, nulls and a key of null: ranks as one sort gives them."""
    rows = [("k" if i % 50 else None, i * 7 % 40 if i % 9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, x int, i int")
    got = S.ranked(df, ["key"], [F.col("x").desc_nulls_last(), F.col("i").asc()])
    want = {}
    for k in ("k", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])), 1):
            want[r[2]] = n
    assert {r.i: r.rank for r in got.collect()} == want and got.columns == ["key", "x", "i", "rank"]
    assert S.ranked(df.limit(0), ["key"], [F.col("x")]).collect() == []


def test_deinflect_as_table_function(spark):
    from kotonoha.plans.deinflect import deinflect, register_deinflect

    df = spark.createDataFrame([("食べさせられた",), ("猫",), (None,), ("",)], "text string")
    register_deinflect(spark, "deinflect_test")
    got = spark.sql("SELECT t.text, d.* FROM {df} t, LATERAL deinflect_test(t.text) d", df=df).collect()
    assert sorted(map(str, got)) == sorted(map(str, deinflect(df, "text").collect()))
