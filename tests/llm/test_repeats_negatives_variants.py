"""Suffix-array dedup, hard negatives and spelling variants, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kotonoha.llm import negatives, queries, repeats, suffix, variants
from tests.llm.conftest import GERMAN, PROSE

LAST = 2**63 - 1


# -- suffix arrays ---------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for letters in ((97, 98), (97, 122), (0, 2)):
        rows = rng.integers(letters[0], letters[1] + 1, (60, 76)).astype(np.uint8)
        rows[20:30], rows[30:40, 5:] = rows[:10], rows[:10, :-5]
        first = rng.integers(0, 10, 60)
        last = rng.integers(first, 27)
        ends = last + 50
        ordered, place = suffix.suffix_array(rows, first, last, ends)
        text = [bytes(r) for r in rows]
        tail = lambda p: text[p // 76][p % 76 : ends[p // 76]]  # noqa: B023, E731
        assert len(ordered) == (last + 1 - first).sum() and all(place[p] == k for k, p in enumerate(ordered))
        assert all(tail(a) <= tail(b) for a, b in zip(ordered, ordered[1:]))
        shared = suffix.common_prefixes(rows, first, last, ends, ordered, place, 50)
        for k, (a, b) in enumerate(zip(ordered, ordered[1:]), 1):
            x, y = tail(a)[:50], tail(b)[:50]
            assert shared[k] == next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))


def test_merged_lists():
    rng = random.Random(1)
    lists = []
    for _ in range(5):
        words = sorted(rng.sample(range(300), 80))
        lists.append((np.array([b"%03d!" % w for w in words]), np.array([rng.randrange(1000) for _ in words])))
    words, least = suffix.merged(list(lists))
    want = defaultdict(lambda: LAST)
    for x, n in lists:
        for w, k in zip(x, n):
            want[bytes(w)] = min(want[bytes(w)], k)
    assert [bytes(w) for w in words] == sorted(want) and [int(k) for k in least] == [want[w] for w in sorted(want)]


def removed(rows: list[tuple], length: int) -> dict:
    """(doc_id, text) -> (intervals, bytes left)."""
    least: dict[bytes, int] = {}
    named = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, body in named:
        for p in range(len(body) - length + 1):
            key = body[p : p + length]
            least[key] = min(least.get(key, LAST), i)
    out = {}
    for (i, body), row in zip(named, rows):
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if least[body[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[row] = spans, bytes(b for b, g in zip(body, gone) if not g)
    return out


def compare(spark, rows: list[tuple], **options) -> None:
    got = repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **options).collect()
    want = removed(rows, options.get("length", repeats.LENGTH))
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for r in got:
        spans, kept = want[(r.doc_id, r.text)]
        assert [(s.begin, s.end) for s in r.spans] == spans and bytes(r.kept) == kept
        assert r.n_bytes == len((r.text or "").encode()) and r.n_removed == r.n_bytes - len(kept)


PASSAGE = "all of this passage stands in many of the documents, word for word and letter for letter as it was written once"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = [chr(97 + i) * (i % 4 + 1) for i in range(20)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, line(30) + (PASSAGE if i % 3 == 0 else PASSAGE[:70] if i % 3 == 1 else "") + line(20)) for i in range(30, 0, -1)]
    rows += [(40, rows[0][1]), (41, rows[0][1]), (40, rows[0][1]), (7, rows[3][1]), (None, PASSAGE), (None, PASSAGE + "!"), (50, None), (51, ""), (52, "short"), (None, None)]
    return rows + [(60, "é" * 40), (61, "x" + "é" * 40), (62, "日本" * 30), (63, "本日" * 30), (64, "a" * 300), (65, "b" + "a" * 120), (66, "nul\0" * 30), (67, "nul\0" * 20 + "!")]


def test_repeats(spark):
    compare(spark, corpus())
    compare(spark, corpus(), length=30, gram=11)


def test_repeats_in_pieces_and_common_grams(spark):
    """Texts of many pieces; grams of over COMMON places go to shards string by string."""
    text = PROSE + PASSAGE + GERMAN
    compare(spark, [(1, PROSE * 3000 + "x"), (2, "y" + PROSE * 6), (3, text), (4, None)])
    rows = [(i, f"{i:05d}" * 3 + PASSAGE[:60] + f"{i * 7:07d}" * 3) for i in range(repeats.COMMON + 300)]
    got = repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).agg(F.sum("n_removed").alias("n"), F.count_if(F.col("n_removed") == 0).alias("whole")).first()
    want = removed(rows, 50)
    assert (got.n, got.whole) == (sum(len(t) - len(want[(i, t)][1]) for i, t in rows), sum(not want[r][0] for r in rows))


def test_repeats_odd_columns(spark, odd, none):
    out = repeats.drop_repeats(odd.withColumnsRenamed({"lang": "kept", "source": "Spans", "SIZE": "mark"}))
    assert out.count() == odd.count() and out.columns == ["doc_id", "text", "n_chars", "shard", "ids", "mark", "n_bytes", "n_removed", "spans", "kept"]
    assert repeats.drop_repeats(none).collect() == []


def test_op11(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = removed(docs, 50)
    for r in queries.QUERIES["op11_suffix_dedup"](spark, sf).collect():
        spans, kept = want[next(d for d in docs if d[0] == r.doc_id)]
        assert (r.n_spans, r.n_removed) == (len(spans), r.n_bytes - len(kept))


# -- hard negatives --------------------------------------------------------------------------------


def mined(rows: list[tuple], anchors: int = 100, most: int = 5) -> list[tuple]:
    good = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in dict.fromkeys((i, lab, None if v is None else tuple(v)) for i, lab, v in rows) if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, v in good:
        if i % anchors:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, lab) for j, lab, w in good))
        for s, p in [(-s, j) for s, j, lab in scored if lab == label and j != i][:most]:
            found = [(-t, j) for t, j, lab in scored if lab != label and 80 * s <= -100 * t <= 100 * s][:most]
            out += [(i, p, k, j, s, t) for k, (t, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_hard_negatives(spark, spread):
    """Clustered vectors, of which few cells are visited, and ones without order; ties, equal vectors, odd rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, i % 3, [float(x) for x in (centres[i % 6] + spread * rng.normal(size=8)).astype(np.float32)]) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(60)] + [rows[5], rows[5]]
    rows += [(2000, 0, None), (2100, None, rows[0][2]), (2200, 1, [1.0, None] * 4), (2300, 1, [float("nan")] * 8), (2301, 1, [float("-inf")] + [0.0] * 7), (None, 1, rows[1][2]), (2400, 1, []), (2500, 2, rows[3][2][:5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<float>").withColumn("mark", F.lit("x"))
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, shard_rows=64).collect())
    assert got == mined(rows) and got


def test_certified_early():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 100
    vectors = (centres[np.arange(4000) % 16] + rng.normal(size=(4000, 8))).astype(np.int64)
    books = negatives.codebook(vectors[:, :4].astype(float), 16), negatives.codebook(vectors[:, 4:].astype(float), 16)
    index = negatives.MultiIndex(vectors, np.arange(4000), np.zeros(4000, np.int64), books)
    query = vectors[7]
    bounds = [b for b, _ in index.cells(query)]
    assert bounds == sorted(bounds, reverse=True)
    [(ids, scores)], visited = index.best(query, lambda rows: np.ones(len(rows), bool), [(-(10**9), 10**9)], 5)
    want = sorted((-(vectors @ query)).tolist())[:5]
    assert [-s for s in scores] == want and visited < len(bounds) / 2


def test_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, label int, vector array<float>")
    assert negatives.hard_negatives(none).collect() == []
    huge = spark.createDataFrame([(0, 1, [1e300, 1.0]), (1, 1, [1e30, 0.0]), (2, 2, [1.0, 1.0])], "vec_id long, label int, vector array<double>")
    assert negatives.hard_negatives(huge).count() == 0


# -- spelling variants -----------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def varied(docs: list[tuple], damage: int = 31, times: int = 10) -> list[tuple]:
    counts: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if damage and h % damage == 0 else word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {w: [v for v in words if v != w and near(v, w)] for w in words}
    form = {w: v for w, vs in found.items() if vs and words[v := min(vs, key=lambda x: (-words[x], x))] >= times * words[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return sorted((w, n, len(found[w]), form.get(w) or "", words.get(form.get(w), 0), root(w)) for w, n in words.items())


def shown(df) -> list[tuple]:
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize("tile", [8, 1024])
def test_variants(spark, tile):
    rng = random.Random(9)
    base = ["internationalise", "spelling", "ÉtrangerS", "abcdefg", "naïveté", "aaaaaaaaaa", "aaaaaaaaa", "straßenbahn"]
    words = []
    for w in base:
        words += [w] * 240
        for _ in range(25):
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("xyzé") + w[k:], w[:k] + rng.choice("xyz") + w[k + 1 :]])] * rng.choice([1, 2, 3, 22])
    rng.shuffle(words)
    docs = [(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50)] + [(None, "spelling, spellings; spellings"), (3, None), (4, ""), (5, "x" * 3000 + " " + "x" * 2999), (6, "x" * 3000 + "\n" + "x" * 2999)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "N": F.lit(2)})
    got = shown(variants.spelling_variants(df, tile=tile))
    assert got == varied(docs) and any(r[3] for r in got)


def test_variants_empty(spark, odd, none):
    assert variants.spelling_variants(none).collect() == []
    assert shown(variants.spelling_variants(odd)) == varied([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_op13(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert shown(queries.QUERIES["op13_spelling_variants"](spark, sf)) == varied(docs)
