"""Properties of the helpers that run inside tasks."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kotonoha.functions.readings import align, align_inflected, alphabetic, hiragana
from kotonoha.functions.structured import to_html
from kotonoha.plans.deinflect import candidates, rule_index
from kotonoha.plans.rules import japanese_rules, widened

RULES = japanese_rules()
INDEX = rule_index(RULES)
KANA, KANJI = "あかさたなはまいきしカラるーんっ", "食山本人木"


@given(st.text(KANA + KANJI, max_size=8), st.text(KANA, max_size=10))
@settings(max_examples=500, deadline=None)
def test_segments_rebuild_the_term(term, reading):
    got = align(term, reading)
    assert "".join(t for t, _ in got) == term
    if term and reading and len(hiragana(reading)) == len(reading):
        assert hiragana("".join(r or t for t, r in got)) == hiragana(reading)


@given(st.text("あかのアノー山本", max_size=6), st.text("あかのアノー", max_size=8))
@settings(max_examples=400, deadline=None)
def test_alignment_by_counting_the_ways(term, reading):
    """The runs of the term with every way to deal the reading to them; a run with two ways to go on has none."""
    runs = re.findall(r"[\u3040-\u30ff]+|[^\u3040-\u30ff]+", term)
    plain, n = hiragana(reading), len(reading)

    def ways(g, p):
        if g == len(runs):
            return [[]] if p == n else []
        kana = "\u3040" <= runs[g][0] <= "\u30ff"
        stops = [p + len(runs[g])] if kana else [n] if g == len(runs) - 1 else range(p + len(runs[g]), n + 1)
        on = [[(p, e), *rest] for e in stops if e - p >= len(runs[g]) and e <= n and (not kana or plain[p:e] == hiragana(runs[g])) for rest in ways(g + 1, e)]
        return on if len(on) == 1 else []

    found = ways(0, 0) if len(plain) == n and term != reading else []
    got, at, p = align(term, reading), 0, 0
    if not found or not runs:
        assert got == [(term, reading if term != reading else "")]
        return
    for run, (p, e) in zip(runs, found[0]):
        part = ""
        while len(part) < len(run):
            part, read, at = part + got[at][0], got[at][1], at + 1
            assert read in ("", *(reading[p:e][i:j] for i in range(e - p) for j in range(i + 1, e - p + 1)))
        assert part == run


@given(st.text(KANA + KANJI, min_size=1, max_size=6), st.text(KANA, min_size=1, max_size=8), st.text(KANA + KANJI, min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_inflected_segments_rebuild_the_source(term, reading, source):
    assert "".join(t for t, _ in align_inflected(term, reading, source)) == source


@given(st.text("食べ行きましたていかったらくなるせれのどうんうすぎ", max_size=10))
@settings(max_examples=400, deadline=None)
def test_chains_lead_to_their_candidates(text):
    by_key = {(r.transform, r.rule_no): r for r in RULES}
    for form, conditions, chain in candidates(text, INDEX, 6):
        now, held = text, ()
        for transform, number, source in chain:
            rule = by_key[transform, number]
            assert source == now and now.endswith(rule.suffix) and (not held or widened(held) == widened(rule.before))
            now, held = now[: len(now) - len(rule.suffix)] + rule.plain, rule.after
        assert (now, held) == (form, conditions)


@given(st.text("かなkanshiy 漢-Ａ", max_size=12))
def test_romaji_leaves_other_characters(text):
    kept = [c for c in text if c in "かな 漢"]
    assert [c for c in alphabetic(text) if c in " 漢"] == [c for c in kept if c in " 漢"]


NODE = st.recursive(st.text("ab<&", max_size=3), lambda inner: st.one_of(st.lists(inner, max_size=3), st.fixed_dictionaries({"tag": st.sampled_from(["div", "span", "td"]), "content": inner})), max_leaves=12)


@given(NODE)
def test_html_by_recursion(node):
    def slow(x):
        if isinstance(x, str):
            return x
        if isinstance(x, list):
            return "".join(map(slow, x))
        return f"<{x['tag']}>{slow(x['content'])}</{x['tag']}>"

    assert to_html(node, "") == slow(node)
