"""Furigana and romaji: small helpers for what has no built-in, as pandas UDFs."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types

from kotonoha.functions import text as T

Segment = tuple[str, str]
SEGMENTS = types.ArrayType(types.StructType([types.StructField("text", types.StringType()), types.StructField("reading", types.StringType())]))

_TO_HIRAGANA = str.maketrans(T._SHIFTED, T._HIRA)
_VOWEL = {k: v for v, row in T.VOWELS.items() for k in row}


def hiragana(text: str) -> str:
    """As functions.text.katakana_to_hiragana, for one text."""
    out: list[str] = []
    for c in text.translate(_TO_HIRAGANA):
        out.append(_VOWEL.get(out[-1], c) if c == "ー" and out else c)
    return "".join(out)


def is_kana(c: str) -> bool:
    return 0x3040 <= ord(c) <= 0x30FF


def kana_runs(text: str, reading: str) -> list[Segment]:
    """Where two kana texts of one length agree, the text has no reading of its own; elsewhere it has the other's."""
    out: list[Segment] = []
    for t, r in zip(text, reading):
        same = t == r
        if out and (out[-1][1] == "") == same:
            out[-1] = (out[-1][0] + t, out[-1][1] + ("" if same else r))
        else:
            out.append((t, "" if same else r))
    return out


def align(term: str, reading: str) -> list[Segment]:
    """The reading dealt to the term's runs of kana and other characters.

    From the last run back, a table holds for each place in the reading where the next run
    must start if there is exactly one way to go on. A kana run has to agree in hiragana; any
    other takes at least its own length, and the last of them the whole rest. Without a way, or
    with several, the term has the reading as a whole.
    """
    if term == reading:
        return [(term, "")]
    runs: list[str] = []
    for c in term:
        if runs and is_kana(runs[-1][0]) == is_kana(c):
            runs[-1] += c
        else:
            runs.append(c)
    plain, n = hiragana(reading), len(reading)
    if len(plain) != n:
        return [(term, reading)]
    nxt: list[list[int | None]] = [[None] * (n + 1) for _ in runs]
    open_after = [False] * n + [True]
    for g in reversed(range(len(runs))):
        run, here = runs[g], [False] * (n + 1)
        wanted = hiragana(run)
        for p in range(n + 1):
            if is_kana(run[0]):
                ends = [p + len(run)] if plain.startswith(wanted, p) and p + len(run) <= n and open_after[p + len(run)] else []
            elif g == len(runs) - 1:
                ends = [n] if n - p >= len(run) else []
            else:
                ends = [e for e in range(p + len(run), n + 1) if open_after[e]]
            if len(ends) == 1:
                nxt[g][p], here[p] = ends[0], True
        open_after = here
    if not runs or not open_after[0]:
        return [(term, reading)]
    out, p = [], 0
    for g, run in enumerate(runs):
        e = nxt[g][p]
        part = reading[p:e]
        out += [(run, part)] if not is_kana(run[0]) else [(run, "")] if part == run else kana_runs(run, part)
        p = e
    return out


def common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def first_characters(segments: list[Segment], n: int) -> list[Segment]:
    """The segments of the first ``n`` characters; one that goes on behind them has no reading."""
    ends = list(accumulate(len(text) for text, _ in segments))
    cut = [(text[: max(0, n - end + len(text))], read if end <= n else "") for (text, read), end in zip(segments, ends)]
    return [s for s in cut if s[0]]


def align_inflected(term: str, reading: str, source: str) -> list[Segment]:
    """The reading of an inflected ``source`` of the term.

    A source that agrees with the reading as far as with the term, or further, is in kana and
    needs none. Otherwise the stem that it shares with the term keeps what the whole term's
    alignment gives it, and the ending has no reading.
    """
    plain = hiragana(source)
    stem, in_kana = common(hiragana(term), plain), common(hiragana(reading), plain)
    if not stem or in_kana >= stem:
        return [(source, "")] if source else []
    kept = first_characters(align(source[:stem] + term[stem:], reading), stem)
    ending = source[stem:]
    if ending and not kept[-1][1]:
        return [*kept[:-1], (kept[-1][0] + ending, "")]
    return kept + [(ending, "")] * bool(ending)


def _frame(segments: list[list[Segment]]) -> pd.Series:
    return pd.Series([[{"text": t, "reading": r} for t, r in s] for s in segments], dtype=object)


@F.pandas_udf(SEGMENTS)
def distribute_furigana(term: pd.Series, reading: pd.Series) -> pd.Series:
    return _frame([align(t or "", r or "") for t, r in zip(term, reading, strict=True)])


@F.pandas_udf(SEGMENTS)
def distribute_furigana_inflected(term: pd.Series, reading: pd.Series, source: pd.Series) -> pd.Series:
    return _frame([align_inflected(t or "", r or "", s or "") for t, r, s in zip(term, reading, source, strict=True)])


# Hepburn and Kunrei syllables by consonant, in the order a i u e o ("-": none).
SYLLABLES = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ",
    "p": "ぱぴぷぺぽ", "m": "まみむめも", "y": "や-ゆ-よ", "r": "らりるれろ", "l": "らりるれろ", "w": "わゐ-ゑを",
}
GLIDES = {"ky": "き", "gy": "ぎ", "sh": "し", "sy": "し", "ch": "ち", "ty": "ち", "cy": "ち", "j": "じ", "zy": "じ", "jy": "じ", "dy": "ぢ", "ny": "に", "hy": "ひ", "by": "び", "py": "ぴ", "my": "み", "ry": "り", "ly": "り"}
SPECIAL = {"shi": "し", "chi": "ち", "tsu": "つ", "ji": "じ", "fu": "ふ", "fa": "ふぁ", "fi": "ふぃ", "fe": "ふぇ", "fo": "ふぉ", "va": "ゔぁ", "vi": "ゔぃ", "vu": "ゔ", "ve": "ゔぇ", "vo": "ゔぉ", "n": "ん", "nn": "ん", "n'": "ん", "-": "ー", "wi": "うぃ", "we": "うぇ", "she": "しぇ", "che": "ちぇ", "je": "じぇ"}


def romaji_table() -> dict[str, str]:
    table = {c + v: k for c, row in SYLLABLES.items() for v, k in zip("aiueo", row) if k != "-"}
    table |= {c + v: k + s for c, k in GLIDES.items() for v, s in zip("auo", "ゃゅょ")}
    table |= {"x" + v: k for v, k in zip("aiueo", "ぁぃぅぇぉ")} | {"x" + v: k for v, k in zip(("ya", "yu", "yo", "tu", "tsu", "wa"), "ゃゅょっっゎ")}
    return table | SPECIAL


_ROMAJI = romaji_table()
_NARROW = {ord(w): a for a, w in zip(T._ALNUM, T._WIDE)} | {0xFF0D: "-"}


def kana_of(run: str) -> str:
    """A run of Latin letters by the longest syllables that fit; a doubled consonant is a small tsu; what is no syllable stays."""
    out, i = [], 0
    while i < len(run):
        if i + 1 < len(run) and run[i] == run[i + 1] and run[i] in "kgsztdhbpmyrlwfjcv":
            out.append("っ")
            i += 1
            continue
        for n in (3, 2, 1):
            piece = run[i : i + n]
            if len(piece) == n and piece in _ROMAJI and not (piece == "nn" and i + 2 < len(run) and run[i + 2] in "aiueoy"):
                out.append(_ROMAJI[piece])
                i += n
                break
        else:
            out.append(run[i])
            i += 1
    return "".join(out)


def alphabetic(text: str) -> str:
    return re.sub(r"[A-Za-zＡ-Ｚａ-ｚ\-－]+", lambda m: kana_of(m[0].translate(_NARROW).lower()), text)


@F.pandas_udf(types.StringType())
def alphabetic_to_kana(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else alphabetic(t) for t in text], dtype=object)
