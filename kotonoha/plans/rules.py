"""Suffix rules of Japanese inflection, built from paradigms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

# Conditions and the conditions below them; godan endings and their stem rows.
CONDITIONS = {"v": ["v1", "v5", "vk", "vs", "vz"], "v1": ["v1d", "v1p"], "v5": ["v5d", "v5s"], "v5s": ["v5ss", "v5sp"]}
SINGLE_CONDITIONS = ["v1d", "v1p", "v5d", "v5ss", "v5sp", "vk", "vs", "vz", "adj-i", "-ます", "-ません", "-て", "-ば", "-く", "-た", "-ん", "-なさい", "-ゃ"]
DICTIONARY_FORMS = ["v1", "v5", "vk", "vs", "vz", "adj-i"]
ENDINGS = "うくぐすつぬぶむる"
ROWS = {"a": "わかがさたなばまら", "i": "いきぎしちにびみり", "e": "えけげせてねべめれ", "o": "おこごそとのぼもろ"}
#: Endings by the form they take before て and た, and whether that voices it.
ONBIN = [("い", "く", False), ("い", "ぐ", True), ("し", "す", False), ("っ", "うつる", False), ("ん", "ぬぶむ", True)]
IKU = ["いく", "行く", "逝く", "往く"]
KOU = ["こう", "とう", "請う", "乞う", "恋う", "問う", "訪う", "宣う", "曰う", "給う", "賜う", "揺蕩う"]
TAMAU = {"のたまう": "のたもう", "たまう": "たもう", "たゆたう": "たゆとう"}
# Contracted, continuative, slang and dialect endings with their plain forms. れえ for らい is there twice, which gives a candidate twice.
CONTRACTED_BA = [
    ("けりゃ", "ければ"), ("きゃ", "ければ"), ("や", "えば"), ("きゃ", "けば"), ("ぎゃ", "げば"), ("しゃ", "せば"), ("ちゃ", "てば"), ("にゃ", "ねば"), ("びゃ", "べば"), ("みゃ", "めば"),
    ("りゃ", "れば"),
]
CONTINUATIVE = [
    ("い", "いる"), ("え", "える"), ("き", "きる"), ("ぎ", "ぎる"), ("け", "ける"), ("げ", "げる"), ("じ", "じる"), ("せ", "せる"), ("ぜ", "ぜる"), ("ち", "ちる"),
    ("て", "てる"), ("で", "でる"), ("に", "にる"), ("ね", "ねる"), ("ひ", "ひる"), ("び", "びる"), ("へ", "へる"), ("べ", "べる"), ("み", "みる"), ("め", "める"),
    ("り", "りる"), ("れ", "れる"),
]
SLANG_E = [
    ("ねえ", "ない"), ("めえ", "むい"), ("みい", "むい"), ("ちぇえ", "つい"), ("ちい", "つい"), ("せえ", "すい"), ("ええ", "いい"), ("ええ", "わい"), ("ええ", "よい"), ("いぇえ", "よい"),
    ("うぇえ", "わい"), ("けえ", "かい"), ("げえ", "がい"), ("げえ", "ごい"), ("せえ", "さい"), ("めえ", "まい"), ("ぜえ", "ずい"), ("っぜえ", "ずい"), ("れえ", "らい"), ("れえ", "らい"),
    ("ちぇえ", "ちゃい"), ("でえ", "どい"), ("れえ", "れい"), ("べえ", "ばい"), ("てえ", "たい"),
]
SLANG_SMALL_E = [
    ("ねぇ", "ない"), ("めぇ", "むい"), ("みぃ", "むい"), ("ちぃ", "つい"), ("せぇ", "すい"), ("けぇ", "かい"), ("げぇ", "がい"), ("げぇ", "ごい"), ("せぇ", "さい"), ("めぇ", "まい"),
    ("ぜぇ", "ずい"), ("っぜぇ", "ずい"), ("れぇ", "らい"), ("でぇ", "どい"), ("れぇ", "れい"), ("べぇ", "ばい"), ("てぇ", "たい"),
]
KANSAI_TE = [
    ("う", "っ"), ("おう", "あっ"), ("こう", "かっ"), ("ごう", "がっ"), ("そう", "さっ"), ("ぞう", "ざっ"), ("とう", "たっ"), ("どう", "だっ"), ("のう", "なっ"), ("ほう", "はっ"),
    ("ぼう", "ばっ"), ("もう", "まっ"), ("ろう", "らっ"), ("よう", "やっ"), ("ゆう", "いっ"),
]
KANSAI_KU = [
    ("う", "く"), ("こう", "かく"), ("ごう", "がく"), ("そう", "さく"), ("とう", "たく"), ("のう", "なく"), ("ぼう", "ばく"), ("もう", "まく"), ("ろう", "らく"), ("よう", "よく"),
    ("しゅう", "しく"),
]


@dataclass(frozen=True)
class Rule:
    """``suffix`` at the end of a form gives way to ``plain``; with ``front`` both stand at its beginning instead."""

    transform: str
    transform_no: int
    rule_no: int
    suffix: str
    plain: str
    before: tuple[str, ...]
    after: tuple[str, ...]
    front: bool = False


Part = tuple[str, str, tuple[str, ...]]


def _pairs(pairs: list[tuple[str, str]], *after: str, add: str = "") -> list[Part]:
    return [(a + add, b + add, after) for a, b in pairs]


def _godan(row: str, suffix: str, order: str = ENDINGS, after: tuple[str, ...] = ("v5",)) -> list[Part]:
    return [(ROWS[row][ENDINGS.index(e)] + suffix, e, after) for e in order]


def _tail(zuru: str, suru: str, kuru: str, suffix: str) -> list[Part]:
    """Irregular verbs: the stems of ずる, する and くる in kana; those in kanji take the suffix alone."""
    return [(zuru + suffix, "ずる", ("vz",)), (suru + suffix, "する", ("vs",)), (f"為{suffix}", "為る", ("vs",)), (kuru + suffix, "くる", ("vk",)), (f"来{suffix}", "来る", ("vk",)), (f"來{suffix}", "來る", ("vk",))]


def _onbin(plain: str, voiced: str, order: str = "くぐすうつるぬぶむ") -> list[Part]:
    form = {e: stem + (voiced if v else plain) for stem, endings, v in ONBIN for e in endings}
    return [(form[e], e, ("v5",)) for e in order]


def _irregular(suffix: str) -> list[Part]:
    iku = [(f"{v[0]}っ{suffix}", v, ("v5",)) for v in IKU]
    return iku + [(v + suffix, v, ("v5",)) for v in KOU] + [(te + suffix, v, ("v5",)) for v, te in TAMAU.items()]


def _i_form(suffix: str, adjective: bool) -> list[Part]:
    return [(suffix, "い", ("adj-i",))] * adjective + [(suffix, "る", ("v1",)), *_godan("i", suffix), *_tail("じ", "し", "き", suffix)]


def _a_form(suffix: str) -> list[Part]:
    return [(suffix, "る", ("v1",)), *_godan("a", suffix, "くぐすつぬぶむるう"), *_tail("ぜ", "せ", "こ", suffix)]


def _te_form(plain: str, voiced: str) -> list[Part]:
    return [(plain, "る", ("v1",)), *_onbin(plain, voiced), *_tail("じ", "し", "き", plain)]


def _contracted(plain: str, voiced: str) -> list[Part]:
    """As _te_form, with い-forms voiced one first and っ also for く."""
    form = [("い" + voiced, "ぐ", ("v5",)), ("い" + plain, "く", ("v5",)), ("し" + plain, "す", ("v5",)), *[("っ" + plain, e, ("v5",)) for e in "うくつる"], *[("ん" + voiced, e, ("v5",)) for e in "ぬぶむ"]]
    return [(plain, "る", ("v1",)), *form, *_tail("じ", "し", "き", plain)]


def _polite() -> list[Part]:
    godan = [(s, e, ("v5d", "v5s") if e == "す" else ("v5d",)) for s, e, _ in _godan("i", "ます")]
    return [("ます", "る", ("v1",)), *godan, *_tail("じ", "し", "き", "ます"), ("くあります", "い", ("adj-i",))]


def _causative(suffix: str, after_v1: str) -> list[Part]:
    verbs = [(after_v1, "る", ("v1",)), *_godan("a", suffix, "くぐすつぬぶむるう"), ("じ" + after_v1, "ずる", ("vz",)), ("ぜ" + after_v1, "ずる", ("vz",))]
    return verbs


def _short_causative() -> list[tuple[tuple[str, ...], Part]]:
    parts = [*_causative("す", "さす"), ("さす", "する", ("vs",)), ("為す", "為る", ("vs",)), ("こさす", "くる", ("vk",)), ("来さす", "来る", ("vk",)), ("來さす", "來る", ("vk",))]
    return [(("v5sp",) if p[0] in ("かす", "がす", "たす", "なす", "ばす", "ます", "らす", "わす") else ("v5ss",), p) for p in parts]


def _imperative() -> list[Part]:
    return [("ろ", "る", ("v1",)), ("よ", "る", ("v1",)), *_godan("e", ""), ("じろ", "ずる", ("vz",)), ("ぜよ", "ずる", ("vz",)), ("しろ", "する", ("vs",)), ("せよ", "する", ("vs",)), ("為ろ", "為る", ("vs",)), ("為よ", "為る", ("vs",)), ("こい", "くる", ("vk",)), ("来い", "来る", ("vk",)), ("來い", "來る", ("vk",))]


def _continuative() -> list[Part]:
    return [*_pairs(CONTINUATIVE, "v1d"), *_godan("i", ""), ("き", "くる", ("vk",)), ("し", "する", ("vs",)), ("来", "来る", ("vk",)), ("來", "來る", ("vk",))]


def _passive() -> list[Part]:
    godan = [(s, e, ("v5d", "v5sp") if e == "す" else ("v5",)) for s, e, _ in _godan("a", "れる", "くぐすつぬぶむうる")]
    return [*godan, ("じされる", "ずる", ("vz",)), ("ぜされる", "ずる", ("vz",)), ("される", "する", ("vs",)), ("為れる", "為る", ("vs",)), ("こられる", "くる", ("vk",)), ("来られる", "来る", ("vk",)), ("來られる", "來る", ("vk",))]


def _potential() -> list[Part]:
    return [("れる", "る", ("v1", "v5d")), *_godan("e", "る", "うくぐすつぬぶむ", ("v5d",)), ("できる", "する", ("vs",)), ("出来る", "する", ("vs",)), ("これる", "くる", ("vk",)), ("来れる", "来る", ("vk",)), ("來れる", "來る", ("vk",))]


def _volitional(suffix: str) -> list[Part]:
    return [("よ" + suffix, "る", ("v1",)), *_godan("o", suffix), ("じよ" + suffix, "ずる", ("vz",)), ("しよ" + suffix, "する", ("vs",)), (f"為よ{suffix}", "為る", ("vs",)), ("こよ" + suffix, "くる", ("vk",)), (f"来よ{suffix}", "来る", ("vk",)), (f"來よ{suffix}", "來る", ("vk",)), ("ましょ" + suffix, "ます", ("-ます",))]


def _tables() -> dict[str, list[tuple[tuple[str, ...], Part]]]:
    """Transform -> (conditions before, (suffix, plain, conditions after)), in order."""
    under = lambda before, parts: [((before,) if before else (), p) for p in parts]
    adj = lambda s: (s, "い", ("adj-i",))
    masu = lambda s, plain="ます": (s, plain, ("-ます",))
    te, nai = ("-て",), ("adj-i",)
    return {
        "-ば": under("-ば", [adj("ければ"), *_godan("e", "ば")[:-1], ("れば", "る", ("v1", "v5", "vk", "vs", "vz")), masu("れば", "")]),
        "-ゃ": under("-ゃ", _pairs(CONTRACTED_BA, "-ば")),
        "-ちゃ": under("v5", _contracted("ちゃ", "じゃ")),
        "-ちゃう": under("v5", _contracted("ちゃう", "じゃう")),
        "-ちまう": under("v5", _contracted("ちまう", "じまう")),
        "-しまう": under("v5", [("てしまう", "て", te), ("でしまう", "で", te)]),
        "-なさい": under("-なさい", _i_form("なさい", False)),
        "-そう": under("", _i_form("そう", True)),
        "-すぎる": under("v1", _i_form("すぎる", True)),
        "-過ぎる": under("v1", _i_form("過ぎる", True)),
        "-たい": under("adj-i", _i_form("たい", False)),
        "-たら": under("", [adj("かったら"), *_te_form("たら", "だら"), *_irregular("たら"), masu("ましたら")]),
        "-たり": under("", [adj("かったり"), *_te_form("たり", "だり"), *_irregular("たり")]),
        "-て": under("-て", [adj("くて"), *_te_form("て", "で"), *_irregular("て")]) + under("", [masu("まして")]),
        "-ず": under("", _a_form("ず")),
        "-ぬ": under("", _a_form("ぬ")),
        "-ん": under("-ん", _a_form("ん")),
        "-んばかり": under("", _a_form("んばかり")),
        "-んとする": under("vs", _a_form("んとする")),
        "-む": under("", _a_form("む")),
        "-ざる": under("", _a_form("ざる")),
        "-ねば": under("-ば", _a_form("ねば")),
        "-く": under("-く", [adj("く")]),
        "causative": under("v1", [*_causative("せる", "させる"), ("させる", "する", ("vs",)), ("為せる", "為る", ("vs",)), ("せさせる", "する", ("vs",)), ("為させる", "為る", ("vs",)), ("こさせる", "くる", ("vk",)), ("来させる", "来る", ("vk",)), ("來させる", "來る", ("vk",))]),
        "short causative": _short_causative(),
        "imperative": under("", _imperative()),
        "continuative": under("", _continuative()),
        "negative": under("adj-i", [adj("くない"), ("ない", "る", ("v1",)), *_godan("a", "ない", "くぐすつぬぶむるう"), *_tail("じ", "し", "こ", "ない")]) + under("-ません", [masu("ません")]),
        "-さ": under("", [adj("さ")]),
        "passive": under("v1", _passive()),
        "-た": under("-た", [adj("かった"), *_te_form("た", "だ"), *_irregular("た"), masu("ました"), ("でした", "", ("-ません",)), ("かった", "", ("-ません", "-ん"))]),
        "-ます": under("-ます", _polite()),
        "potential": under("v1", _potential()),
        "potential or passive": under("v1", [("られる", "る", ("v1",)), ("ざれる", "ずる", ("vz",)), ("ぜられる", "ずる", ("vz",)), ("せられる", "する", ("vs",)), ("為られる", "為る", ("vs",)), ("こられる", "くる", ("vk",)), ("来られる", "来る", ("vk",)), ("來られる", "來る", ("vk",))]),
        "volitional": under("", [*_volitional("う"), adj("かろう")]),
        "volitional slang": under("", _volitional("っか")),
        "-まい": under("", [("まい", "", ("v",)), ("まい", "る", ("v1",)), *_tail("じ", "し", "こ", "まい"), masu("まい", "")]),
        "-おく": under("v5", [("ておく", "て", te), ("でおく", "で", te), ("とく", "て", te), ("どく", "で", te), ("ないでおく", "ない", nai), ("ないどく", "ない", nai)]),
        "-いる": [((b,), p) for b, p in (("v1", ("ている", "て", te)), ("v5", ("ておる", "て", te)), ("v1p", ("てる", "て", te)), ("v1", ("でいる", "で", te)), ("v5", ("でおる", "で", te)), ("v1p", ("でる", "で", te)), ("v5", ("とる", "て", te)), ("v1", ("ないでいる", "ない", nai)))],
        "-き": under("", [adj("き")]),
        "-げ": under("", [adj("げ"), adj("気")]),
        "-がる": under("v5", [adj("がる")]),
        "-え": under("", _pairs(SLANG_E, "adj-i") + _pairs(SLANG_SMALL_E, "adj-i")),
        "n-slang": under("", [("んなさい", "りなさい", ("-なさい",))]) + under("adj-i", [("らんない", "られない", nai), ("んない", "らない", nai)]) + under("", [("んなきゃ", "らなきゃ", ("-ゃ",)), ("んなきゃ", "れなきゃ", ("-ゃ",))]),
        "imperative negative slang": under("", [("んな", "る", ("v",))]),
        "kansai-ben negative": under("", [("へん", "ない", nai), ("ひん", "ない", nai), ("せえへん", "しない", nai)]) + under("-た", [("へんかった", "なかった", ("-た",)), ("ひんかった", "なかった", ("-た",))]) + under("", [("うてへん", "ってない", nai)]),
        "kansai-ben -て": under("-て", _pairs(KANSAI_TE, "-て", add="て")),
        "kansai-ben -た": under("-た", _pairs(KANSAI_TE, "-た", add="た")),
        "kansai-ben -たら": under("", _pairs(KANSAI_TE, add="たら")),
        "kansai-ben -たり": under("", _pairs(KANSAI_TE, add="たり")),
        "kansai-ben -く": under("", _pairs(KANSAI_KU, "-く")),
        "kansai-ben adjective -て": under("-て", _pairs(KANSAI_KU, "-て", add="て")),
        "kansai-ben adjective negative": under("adj-i", _pairs(KANSAI_KU, "adj-i", add="ない")),
    }


def japanese_rules() -> list[Rule]:
    return [Rule(name, t, r, suffix, plain, before, after) for t, (name, parts) in enumerate(_tables().items()) for r, (before, (suffix, plain, after)) in enumerate(parts)]


@cache
def ancestors() -> dict[str, frozenset[str]]:
    """Each condition with all conditions above it."""
    up = {child: parent for parent, children in CONDITIONS.items() for child in children}

    def line(c: str) -> set[str]:
        return {c} | (line(up[c]) if c in up else set())

    return {c: frozenset(line(c)) for c in [*CONDITIONS, *SINGLE_CONDITIONS]}


def widened(conditions: tuple[str, ...] | list[str]) -> frozenset[str]:
    """What two sets of conditions are compared by: the set with everything above its members."""
    above = ancestors()
    return frozenset().union(*[above[c] for c in conditions]) if conditions else frozenset()
