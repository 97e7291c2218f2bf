"""Japanese text functions; all take and give Columns and stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges (inclusive) and tables of the script.
HIRAGANA, KATAKANA = (0x3040, 0x309F), (0x30A0, 0x30FF)
KANJI = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F), (0x31350, 0x323AF), (0x2EBF0, 0x2EE5F), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
WIDTH_FORMS = [(0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF01, 0xFF0F), (0xFF1A, 0xFF1F), (0xFF3B, 0xFF3F), (0xFF5B, 0xFF60), (0xFFE0, 0xFFEE)]
PUNCTUATION = [(0xFF61, 0xFF65), (0x3000, 0x303F)]
HALFWIDTH_KATAKANA = (0xFF66, 0xFF9F)
COMPATIBILITY = (0x3300, 0x33FF)
RADICALS = [(0x2F00, 0x2FDF), (0x2E80, 0x2EFF), (0x31C0, 0x31EF)]
#: Counted characters: digits, Latin letters of both widths and what case folding adds, marks, kana, radicals, ideographs.
COUNTED = [(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x17F, 0x17F), (0x212A, 0x212A), (0x25CB, 0x25CB), (0x25EF, 0x25EF), (0x3005, 0x3007), (0x303B, 0x303B), (0x3041, 0x3096), (0x309D, 0x309E), (0x30A1, 0x30FA), (0x30FC, 0x30FC), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9D), (0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFA0E, 0xFA0F), (0xFA11, 0xFA11), (0xFA13, 0xFA14), (0xFA1F, 0xFA1F), (0xFA21, 0xFA21), (0xFA23, 0xFA24), (0xFA27, 0xFA29), (0x20000, 0x2A6DF), (0x2A700, 0x2B739), (0x2B740, 0x2B81D), (0x2B820, 0x2CEA1), (0x2CEB0, 0x2EBE0), (0x2EBF0, 0x2EE5D), (0x30000, 0x3134A), (0x31350, 0x323AF)]
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮ"
EMPHATIC = "っッー"
HALF, FULL = "･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ", "・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
VOICED_HALF, VOICED_FULL = "ｦｳｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾊﾋﾌﾍﾎ", "ヺヴガギグゲゴザジズゼゾダヂヅデドバビブベボ"
PLOSIVE_HALF, PLOSIVE_FULL = "ﾊﾋﾌﾍﾎ", "パピプペポ"
#: Kana by vowel; の and ノ are in no row.
VOWELS = {
    "あ": "ぁあかがさざただなはばぱまゃやらゎわヵァアカガサザタダナハバパマャヤラヮワヵヷ",
    "い": "ぃいきぎしじちぢにひびぴみりゐィイキギシジチヂニヒビピミリヰヸ",
    "う": "ぅうくぐすずっつづぬふぶぷむゅゆるゥウクグスズッツヅヌフブプムュユルヴ" + "ぉおこごそぞとどほぼぽもょよろをォオコゴソゾトドホボポモョヨロヲヺ",
    "え": "ぇえけげせぜてでねへべぺめれゑヶェエケゲセゼテデネヘベペメレヱヶヹ",
}
#: Kana and their forms with dakuten.
PLAIN, DAKUTEN = "うかきくけこさしすせそたちつてとはひふへほワヰヱヲウカキクケコサシスセソタチツテトハヒフヘホ", "ゔがぎぐげござじずぜぞだぢづでどばびぶべぼヷヸヹヺヴガギグゲゴザジズゼゾダヂヅデドバビブベボ"
HANDAKUTEN = "ぱぴぷぺぽパピプペポ"


def span(*ranges: tuple[int, int]) -> str:
    """The inside of a regular expression's class."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


KANA_CLASS = span(HIRAGANA, KATAKANA)
JAPANESE_BMP = span(HIRAGANA, KATAKANA, *[r for r in KANJI if r[1] < 0x10000], HALFWIDTH_KATAKANA, *PUNCTUATION, *WIDTH_FORMS)
COUNTED_CLASS = span(*COUNTED)


def chars(a: int, b: int) -> str:
    return "".join(map(chr, range(a, b + 1)))


def utf16_length(c: Column) -> Column:
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))


def count_characters(c: Column) -> Column:
    """UTF-16 units of the counted characters. ASCII's letters and digits are counted first, as a class of many ranges takes long for each character."""
    others = F.regexp_replace(c, "[0-9A-Za-z]+", "")
    return F.length(c) - F.length(others) + utf16_length(F.regexp_replace(others, f"[^{COUNTED_CLASS}]+", ""))


_SHIFTED = "".join(chr(x) for x in range(0x30A1, 0x30F7) if chr(x) not in "ヵヶ")
_HIRA = "".join(chr(ord(x) - 0x60) for x in _SHIFTED)
_ALNUM = chars(0x30, 0x39) + chars(0x41, 0x5A) + chars(0x61, 0x7A)
_WIDE = "".join(chr(ord(x) + 0xFEE0) for x in _ALNUM)


def hiragana_to_katakana(c: Column) -> Column:
    return F.translate(c, chars(0x3041, 0x3096), chars(0x30A1, 0x30F6))


def lengthened(last: Column) -> Column:
    """The hiragana that a prolonged sound mark stands for behind ``last``; null if ``last`` has no vowel."""
    return F.coalesce(*[F.when(last.rlike(f"[{row}]"), F.lit(v)) for v, row in VOWELS.items()])


def katakana_to_hiragana(c: Column, keep_long: bool = False) -> Column:
    """A prolonged sound mark becomes the vowel of the character that came out before it, unless ``keep_long``; ヵ and ヶ stay."""
    plain = F.translate(c, _SHIFTED, _HIRA)
    if keep_long:
        return plain
    step = lambda out, x: F.concat(out, F.when(x == "ー", F.coalesce(lengthened(F.substring(out, -1, 1)), x)).otherwise(x))
    return F.when(F.contains(plain, F.lit("ー")), F.aggregate(F.split(plain, ""), F.lit(""), step)).otherwise(plain)


def to_fullwidth_alnum(c: Column) -> Column:
    return F.translate(c, _ALNUM, _WIDE)


def to_halfwidth_alnum(c: Column) -> Column:
    return F.translate(c, _WIDE, _ALNUM)


def halfwidth_kana_to_full(c: Column) -> Column:
    """Pairs with a voicing mark first, where the pair has a form of its own; a mark behind other kana stays."""
    for half, full, mark in ((VOICED_HALF, VOICED_FULL, "ﾞ"), (PLOSIVE_HALF, PLOSIVE_FULL, "ﾟ")):
        for a, b in zip(half, full, strict=True):
            c = F.replace(c, F.lit(a + mark), F.lit(b))
    return F.translate(c, HALF, FULL)


def _raised(x: Column, by: int, allowed: str) -> Column:
    return F.when(x.rlike(rf"^[{allowed}]\z"), F.translate(x, "".join(_allowed(allowed)), "".join(chr(ord(k) + by) for k in _allowed(allowed))))


def _allowed(ranges: str) -> list[str]:
    return [chr(x) for a, b in zip(ranges[0::3], ranges[2::3], strict=True) for x in range(ord(a), ord(b) + 1)]


def normalize_combining(c: Column) -> Column:
    """A combining (han)dakuten moves the kana before it one (two) code points on; pairs are taken from the right and don't combine again."""
    pair = r"(?s)[か-とは-ほカ-トハ-ホ]\x{3099}|[は-ほハ-ホ]\x{309A}|."
    joined = lambda x: F.coalesce(F.when(F.substring(x, 2, 1) == "゙", _raised(F.substring(x, 1, 1), 1, "か-とは-ほカ-トハ-ホ")), F.when(F.substring(x, 2, 1) == "゚", _raised(F.substring(x, 1, 1), 2, "は-ほハ-ホ")), x)
    return F.when(c.rlike(r"[\x{3099}\x{309A}]"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(pair), F.lit(0)), joined), "")).otherwise(c)


def _decomposed(c: Column, ranges: list[tuple[int, int]]) -> Column:
    table = {chr(x): unicodedata.normalize("NFKD", chr(x)) for a, b in ranges for x in range(a, b + 1)}
    one = {k: v for k, v in table.items() if len(v) == 1 and v != k}
    many = {k: v for k, v in table.items() if len(v) > 1}
    out = F.translate(c, "".join(one), "".join(one.values())) if one else c
    if not many:
        return out
    lookup = F.create_map(*[F.lit(x) for item in many.items() for x in item])
    return F.when(out.rlike(f"[{span(*ranges)}]"), F.array_join(F.transform(F.split(out, ""), lambda x: F.coalesce(F.element_at(lookup, x), x)), "")).otherwise(out)


def normalize_compatibility(c: Column) -> Column:
    return _decomposed(c, [COMPATIBILITY])


def normalize_radicals(c: Column) -> Column:
    return _decomposed(c, RADICALS)


def collapse_emphatic(c: Column, full: bool = False) -> Column:
    """Inside the text, a run of one emphatic character becomes one (or, with ``full``, none); runs at either end stay, as does a text of nothing else."""
    head, tail = F.regexp_extract(c, f"^[{EMPHATIC}]*", 0), F.regexp_extract(c, rf"[{EMPHATIC}]*\z", 0)
    middle = F.substring(c, F.length(head) + 1, F.length(c) - F.length(head) - F.length(tail))
    inner = F.regexp_replace(middle, f"[{EMPHATIC}]", "") if full else F.regexp_replace(middle, f"([{EMPHATIC}])\\1+", "$1")
    return F.when(F.length(head) == F.length(c), c).otherwise(F.concat(head, inner, tail))


def diacritic_type(c: Column) -> Column:
    return F.when(c.rlike(rf"^[{DAKUTEN}]\z"), "dakuten").when(c.rlike(rf"^[{HANDAKUTEN}]\z"), "handakuten")


def is_kana_point(code: Column) -> Column:
    return _inside(code, [HIRAGANA, KATAKANA])


def is_kanji_point(code: Column) -> Column:
    return _inside(code, KANJI)


def is_japanese_point(code: Column) -> Column:
    return _inside(code, [HIRAGANA, KATAKANA, *KANJI, HALFWIDTH_KATAKANA, *PUNCTUATION, *WIDTH_FORMS])


def _inside(code: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | code.between(a, b)
    return out


def is_entirely_kana(c: Column) -> Column:
    return c.rlike(rf"^[{KANA_CLASS}]+\z")


def is_partially_japanese(c: Column) -> Column:
    return c.rlike(f"[{JAPANESE_BMP}]")


def morae(c: Column) -> Column:
    """Small kana belong to the mora before them; the first character always starts one."""
    return F.regexp_extract_all(c, F.lit(f"(?s).[{SMALL_KANA}]*"), F.lit(0))


def mora_count(c: Column) -> Column:
    return F.size(morae(c))


def mora_pitch_high(i: Column, downstep: Column) -> Column:
    return F.when(downstep == 0, i > 0).when(downstep == 1, i < 1).otherwise((i > 0) & (i < downstep))


def pitch_category(c: Column, downstep: Column, verb_or_adjective: Column) -> Column:
    return F.when(downstep == 0, "heiban").when(verb_or_adjective & (downstep > 0), "kifuku").when(downstep == 1, "atamadaka").when(downstep > 1, F.when(downstep >= mora_count(c), "odaka").otherwise("nakadaka"))


def stem_length(a: Column, b: Column) -> Column:
    """Length of the common prefix, in time that grows with the shorter text."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: x == y)
    return F.when(n > 0, F.coalesce(F.nullif(F.array_position(pairs, False), F.lit(0)) - 1, n)).when(n == 0, 0).cast("int")


def clamp(c: Column, n: int) -> Column:
    """Texts over ``n`` characters keep half of it at either end."""
    half = (n + 1) // 2
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(half)), F.lit(" ... "), F.right(c, F.lit(half)))).otherwise(c)


def substrings(c: Column, longest: int) -> Column:
    """All substrings up to ``longest`` characters, by start, longer ones first."""
    starts = F.sequence(F.lit(1), F.length(c))
    cut = lambda s: F.transform(F.sequence(F.least(F.lit(longest), F.length(c) - s + 1), F.lit(1), F.lit(-1)), lambda n: c.substr(s, n))
    return F.when(F.length(c) > 0, F.flatten(F.transform(starts, cut))).otherwise(F.array().cast("array<string>"))
