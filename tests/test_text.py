from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kotonoha.functions import readings, structured
from kotonoha.functions import text as T
from kotonoha.plans.language import JAPANESE, text_variants


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f,given,wanted",
    [
        (T.halfwidth_kana_to_full, "ﾖﾐﾁｬﾝ", "ヨミチャン"),
        (T.halfwidth_kana_to_full, "ｶﾞﾊﾟｱﾞ", "ガパアﾞ"),
        (T.normalize_combining, "ド", "ド"),
(T.normalize_combining, "は\u3070\u3071\u309aあ\u3099", "は\u3070\u3073あ\u3099"),
        (T.normalize_combining, "\u3070\u3099", "\u3071"),
        (lambda c: T.normalize_combining(T.normalize_compatibility(c)), "㌀", "アパート"),
        (T.normalize_radicals, "⼀x", "一x"),
        (T.to_halfwidth_alnum, "ｙｏｍｉｔａｎ", "yomitan"),
        (T.to_fullwidth_alnum, "yomitan!", "ｙｏｍｉｔａｎ!"),
        (T.collapse_emphatic, "すっっごーーい", "すっごーい"),
        (lambda c: T.collapse_emphatic(c, True), "すっっごーーい", "すごい"),
        (T.collapse_emphatic, "ッッああーー", "ッッああーー"),
        (T.collapse_emphatic, "ーーッ", "ーーッ"),
        (T.katakana_to_hiragana, "ラーメン", "らあめん"),
        (T.katakana_to_hiragana, "ノート", "のーと"),
        (T.katakana_to_hiragana, "コーヒー", "こうひい"),
        (T.katakana_to_hiragana, "ヵヶ", "ヵヶ"),
        (lambda c: T.katakana_to_hiragana(c, True), "ラーメン", "らーめん"),
        (T.hiragana_to_katakana, "らーめん", "ラーメン"),
        (T.mora_count, "きょう", 2),
        (T.mora_count, "がっこう", 4),
        (T.count_characters, "Ab1é、漢字カナー 𠮷", 10),
        (T.diacritic_type, "ぱ", "handakuten"),
        (T.diacritic_type, "ガ", "dakuten"),
        (T.diacritic_type, "あ", None),
        (lambda c: T.clamp(c, 5), "abcdefgh", "abc ... fgh"),
        (lambda c: T.substrings(c, 2), "あいう", ["あい", "あ", "いう", "い", "う"]),
        (lambda c: T.substrings(c, 2), "", []),
        (T.is_entirely_kana, "", False),
        (T.is_entirely_kana, "かなカナー", True),
        (T.is_partially_japanese, "abc漢", True),
        (T.is_partially_japanese, "abc", False),
        (readings.alphabetic_to_kana, "yomichan", "よみちゃん"),
        (readings.alphabetic_to_kana, "ｋａnji gakkou", "かんじ がっこう"),
    ],
)
def test_pairs(spark, f, given, wanted):
    assert one(spark, given, f) == wanted
    assert one(spark, None, f) in (None, [])


def test_pitch(spark):
    rows = [("さくら", 0, False, "heiban"), ("さくら", 1, False, "atamadaka"), ("さくら", 3, False, "odaka"), ("さくら", 2, False, "nakadaka"), ("たべる", 2, True, "kifuku"), ("たべる", -1, False, None)]
    got = spark.createDataFrame(rows, "t string, d int, v boolean, w string").select(T.pitch_category(F.col("t"), F.col("d"), F.col("v")).alias("c"), "w").collect()
    assert all(r.c == r.w for r in got)


def test_stem_length(spark):
    rows = [("abc", "abd", 2), ("abc", "abc", 3), ("abc", "abcd", 3), ("x", "y", 0), ("", "a", 0), ("a" * 30_000, "a" * 29_999 + "b", 29_999)]
    got = spark.createDataFrame(rows, "a string, b string, w int").select(T.stem_length(F.col("a"), F.col("b")).alias("n"), "w").collect()
    assert all(r.n == r.w for r in got)


def test_styles_keep_their_order(spark):
    one = spark.range(1).select(structured.style_string(F.create_map(F.lit("marginLeft"), F.lit("1"), F.lit("margin"), F.lit("0"))).alias("s")).first()
    assert one.s == " margin-left:1; margin:0;"


def test_inverse_functions(spark):
    hira = T.chars(0x3041, 0x3094)
    assert one(spark, hira, lambda c: T.katakana_to_hiragana(T.hiragana_to_katakana(c), True)) == hira
    assert one(spark, "aZ09", lambda c: T.to_halfwidth_alnum(T.to_fullwidth_alnum(c))) == "aZ09"
    assert one(spark, "きょうはがっこうー", lambda c: F.array_join(T.morae(c), "")) == "きょうはがっこうー"


@pytest.mark.parametrize(
    "term,reading,wanted",
    [
        ("食べる", "たべる", [("食", "た"), ("べる", "")]),
        ("お母さん", "おかあさん", [("お", ""), ("母", "かあ"), ("さん", "")]),
        ("かな", "かな", [("かな", "")]),
        ("仮名", "カナ", [("仮名", "カナ")]),
        ("カナ漢", "かなカン", [("カナ", "かな"), ("漢", "カン")]),
        ("木の木の", "ものののの", [("木の木の", "ものののの")]),
        ("飲む", "たべ", [("飲む", "たべ")]),
    ],
)
def test_furigana(term, reading, wanted):
    got = readings.align(term, reading)
    assert got == wanted and "".join(t for t, _ in got) == term


def test_inflected_furigana():
    assert readings.align_inflected("食べる", "たべる", "食べた") == [("食", "た"), ("べた", "")]
    assert readings.align_inflected("食べる", "たべる", "たべた") == [("たべた", "")]
    assert readings.align_inflected("食べる", "たべる", "飲んだ") == [("飲んだ", "")]


def test_variants(spark):
    got = text_variants(spark.createDataFrame([("ｽｯｯｺﾞｲ",), ("abc",), (None,)], "t string"), "t", JAPANESE.preprocessors).collect()
    of = lambda t: [r.variant for r in sorted(got, key=lambda r: r.variant_no) if r.text == t]
    assert of("ｽｯｯｺﾞｲ")[0] == "ｽｯｯｺﾞｲ" and {"スッッゴイ", "すっっごい", "すっごい", "すごい"} <= set(of("ｽｯｯｺﾞｲ"))
    assert len(set(of("abc"))) == len(of("abc")) and {"ａｂｃ", "あbc"} <= set(of("abc"))


def test_structured_content():
    html = structured.definition_html
    node = '{"type":"structured-content","content":[{"tag":"div","data":{"a":"b"},"lang":"ja","style":{"fontSize":"1em"},"content":["x",{"tag":"br"}]},"<raw>"]}'
    assert html(node, "D") == '<div a="b" lang="ja" style=" font-size:1em;">x<br></div><raw>'
    image = '{"type":"structured-content","content":{"tag":"img","path":"a.png","collapsible":true,"collapsed":false,"border":"1px","title":"t"}}'
    assert html('{"type":"image","path":"a","appearance":"monochrome","collapsible":false}', "D").count("appearance") == 0 and 'appearance="auto"' in html('{"type":"image","path":"a","collapsible":false}', "D")
    assert html(image, "D", "/b") == '<details open=""><summary> </summary><img title="t" src="/b/dictionaryMedia/D/a.png"></details>'
    assert html('"plain"', "D") == "plain" and html('["食う",["v5"]]', "D") == "食う" and html(None, "D") is None
    with pytest.raises(ValueError):
        html('{"type":"structured-content","content":{"tag":"img"}}', "D")
    deep = '{"type":"structured-content","content":' + '{"tag":"span","content":' * 300 + '"x"' + "}" * 300 + "}"
    assert html(deep, "D").count("<span>") == 300


def test_malformed_definitions_have_no_html(spark):
    given = ['"plain"', "7", "[]", "{}", "null", "no JSON", '{"type":"text"}', '{"type":"structured-content","content":7}', '{"type":"text","text":"x"}', None]
    got = spark.createDataFrame(list(enumerate(given)), "i int, d string").select("i", structured.structured_html("d", F.lit("D")).alias("h")).collect()
    assert {r.i: r.h for r in got if r.h is not None} == {0: "plain", 8: "x"} and len(got) == len(given)


def test_counted_characters_of_mixed_texts(spark):
    """ASCII counted first and the rest by its class give what the whole class gives, letter by letter; the class doesn't see ASCII any more."""
    texts = ["", "a b-c", "漢字かな, x9!", "𠮷𠮷 a😀", "ſK ok", "ＡＢ１ ｱ…", "a\n\tb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = F.regexp_replace("t", f"[^{T.COUNTED_CLASS}]", "")
    whole = F.length(one) + F.length(F.regexp_replace(one, r"[^\x{10000}-\x{10FFFF}]", ""))
    got = df.select("t", T.count_characters(F.col("t")).alias("n"), whole.alias("m")).collect()
    assert [x.n for x in got] == [x.m for x in got] and {x.t: x.n for x in got}["a b-c"] == 3
    assert "[0-9A-Za-z]+" in df.select(T.count_characters(F.col("t")))._jdf.queryExecution().analyzed().toString()
