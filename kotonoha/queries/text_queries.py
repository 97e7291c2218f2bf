"""Text functions over the words of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions import text as T
from kotonoha.plans.language import JAPANESE, text_variants
from kotonoha.queries.adapters import HIRA, KATA, LETTERS, PAGES_SQL, SURFACES_SQL, TERMS_SQL, TOKENS_SQL, kana, pages, surfaces, table, terms, tokens
from kotonoha.queries.registry import query

_HALF_LETTERS = "ｱｶﾊﾋｻﾀﾁﾂﾄﾎﾌﾍﾅﾝﾞﾟｦｳｯｰﾏﾐﾔﾗﾜｸ"
_MARKED_LETTERS = "かば゚ひふへほカタハヒいろトつたナにっんヲさしすせ"
_ODD_LETTERS = "㌀㌘㍿㎏⼀⼆⺟⻳かきくけこさしすせそたちつてとなにぬね"
_RUN_LETTERS = "かっッーいうえおきくけこすせそはひふへほまっーるみむめ"




def _vowel_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains('{row}', {x}) THEN '{v}'" for v, row in T.VOWELS.items()) + " END"


@query(f"""WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n_words, count(*) FILTER (regexp_matches(CASE WHEN length(w) % 3 = 0 THEN w ELSE translate(w, '{LETTERS}', 'かばきだてふがはいじくらまんおぱけるしたうぶわさよず') END, '[{T.JAPANESE_BMP}]')) AS n_worthy FROM tokens GROUP BY doc_id""")
def lookup_worthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.length("w") % 3 == 0, F.col("w")).otherwise(kana(F.col("w")))
    return tokens(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if(T.is_partially_japanese(w)).alias("n_worthy"))


@query(f"""WITH {PAGES_SQL}, p AS (SELECT book, pos, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS bodies FROM spine)
    SELECT book, pos, len(bodies) AS paragraphs, length(regexp_replace(array_to_string(bodies, ''), '[^{T.COUNTED_CLASS}]', '', 'g'))::BIGINT AS characters FROM p""")
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each page and their characters; pages without any have 0."""
    bodies = pages(spark, sf_dir).select("book", "pos", F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)).alias("bodies"))
    return bodies.select("book", "pos", F.size("bodies").cast("long").alias("paragraphs"), T.count_characters(F.array_join("bodies", "")).cast("long").alias("characters"))


@query(f"WITH t AS (SELECT doc_id, text FROM documents) SELECT doc_id, length(regexp_replace(text, '[^{T.COUNTED_CLASS}]', '', 'g'))::INT AS characters, CASE WHEN length(text) > 61 THEN left(text, 31) || ' ... ' || right(text, 31) ELSE text END AS clamped FROM t")
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.count_characters(F.col("text")).cast("int").alias("characters"), T.clamp(F.col("text"), 61).alias("clamped"))


@query(f"""WITH {SURFACES_SQL}, k AS (SELECT w, replace(translate(s, '{HIRA}', '{KATA}'), 'ガ', 'ー') AS k FROM surfaces),
    p AS (SELECT w, k, translate(k, '{T._SHIFTED}', '{T._HIRA}') AS plain FROM k)
    SELECT w, plain AS kept, list_reduce(list_concat([''], string_split(plain, '')), lambda a, x: a || CASE WHEN x = 'ー' THEN coalesce(CASE WHEN a = '' THEN NULL ELSE {_vowel_sql("right(a, 1)")} END, x) ELSE x END) AS hiragana FROM p""")
def kata_to_hira(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.replace(T.hiragana_to_katakana(F.col("s")), F.lit("ガ"), F.lit("ー"))
    return surfaces(spark, sf_dir).select("w", T.katakana_to_hiragana(k, keep_long=True).alias("kept"), T.katakana_to_hiragana(k).alias("hiragana"))


@query(f"WITH {SURFACES_SQL} SELECT w, translate(s, '{HIRA}', '{KATA}') AS katakana FROM surfaces")
def hira_to_kata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("w", T.hiragana_to_katakana(F.col("s")).alias("katakana"))


@query(f"WITH {TOKENS_SQL}, t AS (SELECT DISTINCT w FROM tokens) SELECT w, translate(w, '{T._ALNUM}', '{T._WIDE}') AS wide, w AS narrow FROM t")
def width_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = T.to_fullwidth_alnum(F.col("w"))
    return surfaces(spark, sf_dir).select("w", wide.alias("wide"), T.to_halfwidth_alnum(wide).alias("narrow"))


def _half_sql(x: str) -> str:
    for half, full, mark in ((T.VOICED_HALF, T.VOICED_FULL, "ﾞ"), (T.PLOSIVE_HALF, T.PLOSIVE_FULL, "ﾟ")):
        for a, b in zip(half, full):
            x = f"replace({x}, '{a}{mark}', '{b}')"
    return f"translate({x}, '{T.HALF}', '{T.FULL}')"


@query(f"WITH {SURFACES_SQL}, h AS (SELECT w, translate(w, '{LETTERS}', '{_HALF_LETTERS}') AS h FROM surfaces) SELECT w, {_half_sql('h')} AS katakana FROM h")
def halfwidth_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("w", T.halfwidth_kana_to_full(F.translate("w", LETTERS, _HALF_LETTERS)).alias("katakana"))


@query(f"""WITH {SURFACES_SQL}, m AS (SELECT w, unnest(regexp_extract_all(translate(w, '{LETTERS}', '{_MARKED_LETTERS}'), '(?s)[か-とは-ほカ-トハ-ホ]゙|[は-ほハ-ホ]゚|.')) AS x, generate_subscripts(regexp_extract_all(translate(w, '{LETTERS}', '{_MARKED_LETTERS}'), '(?s)[か-とは-ほカ-トハ-ホ]゙|[は-ほハ-ホ]゚|.'), 1) AS i FROM surfaces)
    SELECT w, string_agg(CASE WHEN length(x) = 2 AND right(x, 1) = '゙' THEN chr(unicode(x) + 1) WHEN length(x) = 2 THEN chr(unicode(x) + 2) ELSE x END, '' ORDER BY i) AS joined FROM m GROUP BY w""")
def combining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("w", T.normalize_combining(F.translate("w", LETTERS, _MARKED_LETTERS)).alias("joined"))


def _odd_sql() -> str:
    import unicodedata

    x = f"translate(w, '{LETTERS}', '{_ODD_LETTERS}')"
    for ch in _ODD_LETTERS[:8]:
        x = f"replace({x}, '{ch}', '{unicodedata.normalize('NFKD', ch)}')"
    return x


@query(f"WITH {SURFACES_SQL} SELECT w, {_odd_sql()} AS plain FROM surfaces")
def compat_radicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("w", T.normalize_radicals(T.normalize_compatibility(F.translate("w", LETTERS, _ODD_LETTERS))).alias("plain"))


@query(rf"""WITH {SURFACES_SQL}, e AS (SELECT w, translate(w, '{LETTERS}', '{_RUN_LETTERS}') || CASE WHEN length(w) % 3 = 0 THEN chr(10) ELSE '' END AS x FROM surfaces),
    c AS (SELECT w, x, regexp_extract(x, '^[っッー]*') AS head, regexp_extract(x, '[っッー]*\z') AS tail FROM e),
    m AS (SELECT *, x[length(head) + 1 : length(x) - length(tail)] AS mid FROM c)
    SELECT w, CASE WHEN head = x THEN x ELSE head || regexp_replace(regexp_replace(regexp_replace(mid, 'っ+', 'っ', 'g'), 'ッ+', 'ッ', 'g'), 'ー+', 'ー', 'g') || tail END AS partly,
        CASE WHEN head = x THEN x ELSE head || regexp_replace(mid, '[っッー]', '', 'g') || tail END AS fully FROM m""")
def emphatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.translate("w", LETTERS, _RUN_LETTERS), F.when(F.length("w") % 3 == 0, "\n").otherwise(""))
    return surfaces(spark, sf_dir).select("w", T.collapse_emphatic(x).alias("partly"), T.collapse_emphatic(x, full=True).alias("fully"))


@query(f"WITH {SURFACES_SQL} SELECT w, CASE WHEN contains('{T.DAKUTEN}', left(s, 1)) THEN 'dakuten' WHEN contains('{T.HANDAKUTEN}', left(s, 1)) THEN 'handakuten' END AS mark FROM surfaces")
def diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("w", T.diacritic_type(F.left("s", F.lit(1))).alias("mark"))


@query(f"""WITH {SURFACES_SQL}, x AS (SELECT w, CASE length(w) % 4 WHEN 0 THEN s WHEN 2 THEN s || chr(10) ELSE w || s END AS x FROM surfaces)
    SELECT w, regexp_full_match(x, '[{T.KANA_CLASS}]+') AS kana_only, regexp_matches(x, '[{T.JAPANESE_BMP}]') AS japanese, unicode(right(x, 1)) BETWEEN 12352 AND 12543 AS last_kana,
        {' OR '.join(f'unicode(right(x, 1)) BETWEEN {a} AND {b}' for a, b in T.KANJI)} AS last_kanji FROM x""")
def kana_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.length("w") % 4 == 0, F.col("s")).when(F.length("w") % 4 == 2, F.concat("s", F.lit("\n"))).otherwise(F.concat("w", "s"))
    last = F.conv(F.hex(F.encode(F.right(x, F.lit(1)), "UTF-16BE")), 16, 10).cast("int")
    return surfaces(spark, sf_dir).select("w", T.is_entirely_kana(x).alias("kana_only"), T.is_partially_japanese(x).alias("japanese"), T.is_kana_point(last).alias("last_kana"), T.is_kanji_point(last).alias("last_kanji"))


_SMALL_LETTERS = "かゃきゅてふがはいょくらまんおぱけるしたうぶっさーず"


@query(f"""WITH {SURFACES_SQL}, x AS (SELECT w, translate(w, '{LETTERS}', '{_SMALL_LETTERS}') AS x FROM surfaces)
    SELECT w, array_to_string(regexp_extract_all(x, '(?s).[{T.SMALL_KANA}]*'), '|') AS morae, len(regexp_extract_all(x, '(?s).[{T.SMALL_KANA}]*'))::INT AS n FROM x""")
def morae(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.translate("w", LETTERS, _SMALL_LETTERS)
    return surfaces(spark, sf_dir).select("w", F.array_join(T.morae(x), "|").alias("morae"), T.mora_count(x).alias("n"))


@query(f"""WITH {SURFACES_SQL}, x AS (SELECT w, length(w) % 5 AS d, length(w) % 3 = 0 AS v, len(regexp_extract_all(translate(w, '{LETTERS}', '{_SMALL_LETTERS}'), '(?s).[{T.SMALL_KANA}]*')) AS n FROM surfaces)
    SELECT w, CASE WHEN d = 0 THEN 'heiban' WHEN v AND d > 0 THEN 'kifuku' WHEN d = 1 THEN 'atamadaka' WHEN d > 1 THEN CASE WHEN d >= n THEN 'odaka' ELSE 'nakadaka' END END AS category,
        CASE WHEN d = 0 THEN 1 > 0 WHEN d = 1 THEN 1 < 1 ELSE 1 > 0 AND 1 < d END AS second_high FROM x""")
def pitch_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.length("w") % 5
    x = F.translate("w", LETTERS, _SMALL_LETTERS)
    return surfaces(spark, sf_dir).select("w", T.pitch_category(x, d, F.length("w") % 3 == 0).alias("category"), T.mora_pitch_high(F.lit(1), d).alias("second_high"))


@query(f"""WITH {SURFACES_SQL} SELECT w, (SELECT count(*) FROM range(1, length(w) + 1) t(i) WHERE left(w, i) = left(reverse(w), i))::INT AS n FROM surfaces""")
def stem_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("w", T.stem_length(F.col("w"), F.reverse("w")).alias("n"))


@query(f"""WITH {SURFACES_SQL}, {TERMS_SQL}, m AS (SELECT coalesce(max(length(term)), 0) AS most FROM terms), p AS (SELECT w, s, i, unnest(range(1, least(most, length(s) - i + 1) + 1)) AS n FROM surfaces, m, range(1, length(s) + 1) a(i))
    SELECT w, count(*) AS n, string_agg(s[i : i + n - 1], '|' ORDER BY i, n DESC) AS parts FROM p GROUP BY w""")
def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substrings of all surfaces, up to the length of the longest term."""
    longest = terms(spark, sf_dir).agg(F.max(F.length("term"))).first()[0]
    parts = T.substrings(F.col("s"), longest or 0)
    return surfaces(spark, sf_dir).select("w", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("parts"))


_VARIED_LETTERS = "カきっッーいうえおきくけこすせソそはヒふへホまっーるみむめ"
_MID = "v[length(regexp_extract(v, '^[っッー]*')) + 1 : length(v) - length(regexp_extract(v, '[っッー]*$'))]"
_COLLAPSED = "CASE WHEN regexp_extract(v, '^[っッー]*') = v THEN v ELSE regexp_extract(v, '^[っッー]*') || {} || regexp_extract(v, '[っッー]*$') END"
_PARTLY = _COLLAPSED.format(rf"regexp_replace(regexp_replace(regexp_replace({_MID}, 'っ+', 'っ', 'g'), 'ッ+', 'ッ', 'g'), 'ー+', 'ー', 'g')")
_FULLY = _COLLAPSED.format(f"regexp_replace({_MID}, '[っッー]', '', 'g')")
_KANA_FORM = f"list_reduce(list_concat([''], string_split(translate(text, '{T._SHIFTED}', '{T._HIRA}'), '')), lambda a, x: a || CASE WHEN x = 'ー' THEN coalesce(CASE WHEN a = '' THEN NULL ELSE {_vowel_sql('right(a, 1)')} END, x) ELSE x END)"


def _merged_sql(rows: str) -> str:
    """Of equal variants of a text the one made first."""
    return f"SELECT text, v, min(o) AS o FROM ({rows}) GROUP BY text, v"


@query(f"""WITH {TERMS_SQL}, t AS (SELECT DISTINCT translate(definitions[1], '{LETTERS}', '{_VARIED_LETTERS}') AS text FROM terms),
    k AS ({_merged_sql(f"SELECT text, unnest([text, translate(text, '{HIRA}', '{KATA}'), {_KANA_FORM}]) AS v, unnest([[0], [1], [2]]) AS o FROM t")}),
    e AS ({_merged_sql(f"SELECT text, unnest([v, {_PARTLY}, {_FULLY}]) AS v, unnest([list_append(o, 0), list_append(o, 1), list_append(o, 2)]) AS o FROM k")})
    SELECT text, (row_number() OVER (PARTITION BY text ORDER BY o) - 1)::INT AS variant_no, v AS variant FROM e""")
def japanese_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the eight shipped preprocessors make of the dictionary's words in kana with emphatic marks. Six of them leave these alone."""
    words = terms(spark, sf_dir).select(F.translate(F.col("definitions")[0], LETTERS, _VARIED_LETTERS).alias("text"))
    return text_variants(words, "text", JAPANESE.preprocessors)
