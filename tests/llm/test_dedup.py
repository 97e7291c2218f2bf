from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kotonoha.llm import components, exact, lines, neardup
from pyspark.sql import functions as F


def body(df):
    return df.select("doc_id", F.encode(exact.normalised(F.col("text")), "UTF-8").alias("body"))


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    return groups


@pytest.mark.parametrize("primes,chunk", [(exact.PRIMES, exact.CHUNK), ((7, 5), 16)])
def test_exact_groups_match_brute_force(odd, primes, chunk):
    """Tiny primes and chunks make most fingerprints collide, so that the comparison has to part them."""
    got = exact.exact_groups(body(odd), primes, chunk).collect()
    groups = brute_groups(odd.collect())
    assert sum(r.rows for r in got) == odd.count()
    wanted = Counter((min((i for i in ids if i is not None), default=None), len(ids)) for ids in groups.values() for _ in set(ids))
    assert Counter((r.keep_id, r.group_size) for r in got) == wanted


def test_fingerprints_are_composable():
    data = np.frombuffer(b"some bytes that are cut in two places", np.uint8)
    p = exact.PRIMES[0]
    powers = exact.power(exact.BASE, np.arange(100), p)
    whole = exact.chunk_hashes(data, np.array([0, len(data)]), p, powers)[0]
    parts = exact.chunk_hashes(data, np.array([0, 7, 20, len(data)]), p, powers)
    shift = exact.power(exact.BASE, np.array([len(data) - 7, len(data) - 20, 0]), p)
    assert whole == (parts * shift % np.uint64(p)).sum() % np.uint64(p)
    assert [int(x) for x in exact.power(3, np.array([0, 1, 5, 40]), p)] == [pow(3, n, p) for n in (0, 1, 5, 40)]


def test_exact_dedup_of_no_rows_and_of_rows(spark, odd, none):
    assert exact.exact_groups(body(none)).count() == 0 and exact.drop_copies(none).count() == 0
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    groups = brute_groups(odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in (min((x for x in ids if x is not None), default=None) for ids in groups.values()))


def weighted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute_classes(texts: dict[int, str]) -> dict[int, int]:
    sets, root = {i: weighted(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = sum((sets[a] & sets[b]).values())
            if both and both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def copies(seed: int) -> dict[int, str]:
    """Texts, and copies of copies with more and more words changed; some repeat a sentence, so that weights matter."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    out: list[str] = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(40, 200))]
        if r.random() < 0.4:
            base = base[:30] * r.randint(2, 5)
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
            if r.random() < 0.4:
                base = copy
    r.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_match_brute_force(spark, seed):
    texts = copies(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()}
    assert got == brute_classes(texts)


def test_a_chain_and_a_star_of_near_copies(spark):
    """Copies far from each other but near to one that is neither first nor last."""
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(base[: 5 * i] + [f"x{i}"] + base[5 * i + 1 :]) for i in range(30)} | {40: " ".join(base[:150]), 41: " ".join(base[10:])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_classes(df).collect()} == brute_classes(texts)


def test_near_classes_of_odd_rows(odd, none):
    assert neardup.near_classes(none).count() == 0
    got = neardup.near_classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: (r.class_id, r.class_size) for r in got if r.doc_id is not None}
    assert by[0] == by[1] == by[5] == (0, 5) and by[2] == (2, 1) and by[3] == (3, 1) and by[6][0] == 6
    kept = neardup.drop_near_copies(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 0, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13}


def test_signatures_are_unbiased():
    r = np.random.default_rng(3)
    a = Counter(dict(zip(range(300), r.integers(1, 9, 300).tolist())))
    b = Counter(dict(zip(range(100, 400), r.integers(1, 9, 300).tolist())))
    true = sum((a & b).values()) / sum((a | b).values())
    hashed = lambda c: (neardup.mixed(np.array(list(c), np.uint64) + np.uint64(7)), np.array(list(c.values())))
    element, weight = (np.concatenate(x) for x in zip(hashed(a), hashed(b)))
    owner = np.repeat([0, 1], [len(a), len(b)])
    registers = neardup.bag_minhash(element, weight, owner, 2, 4096)
    assert abs((registers[0] == registers[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)
    alone = neardup.bag_minhash(*(x[: len(a)] for x in (element, weight, owner)), 1, 4096)
    assert (alone[0] == registers[0]).all()


def test_components_match_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x.id: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, least):
    sites = defaultdict(set)
    trim = lambda x: x.strip("\t\n\x0b\x0c\r ")
    for r in rows:
        for x in (r.text or "").split("\n"):
            if trim(x) and r.source is not None:
                sites[trim(x)].add(r.source)
    bad = {x for x, s in sites.items() if len(s) >= least}
    return [(r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if trim(x) not in bad), sum(trim(x) in bad for x in (r.text or "").split("\n"))) for r in rows]


@pytest.mark.parametrize("least", [1, 2, 5])
def test_boilerplate_lines_match_brute_force(spark, odd, none, least):
    r = random.Random(7)
    rows = [(i, "\n".join(r.choice(["a", " b ", "c\t", "", "d", "e e", f"own {i}"]) for _ in range(r.randint(0, 6))), f"s{r.randrange(9)}" if i % 11 else None) for i in range(60)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, source string"), odd, none):
        got = lines.drop_boilerplate(df, min_sites=least).collect()
        key = lambda t: tuple((x is None, x or "") for x in map(lambda v: v if v is None else str(v), t))
        assert sorted(((x.doc_id, x.text, x.n_removed) for x in got), key=key) == sorted(brute_lines(df.collect(), least), key=key)


def test_one_id_of_two_texts(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(3, words("a")), (5, words("b")), (5, words("a") + " end"), (7, words("b") + " end"), (9, words("a") + " new"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.class_id, r.class_size) for r in neardup.near_classes(df).join(df.withColumn("mark", F.xxhash64("text")), ["doc_id", "mark"]).collect()}
    assert got == dict(zip(rows, [(3, 3), (5, 2), (3, 3), (5, 2), (3, 3), (5, 1)], strict=True))
    assert sorted(map(tuple, neardup.drop_near_copies(df).collect())) == [(3, words("a")), (5, ""), (5, words("b"))]


def test_kept_rows_of_classes(spark):
    """Rows without an id stay apart; of near copies under one id, and of equal rows, one stays."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(None, a), (None, b), (None, c), (None, None), (5, a), (5, a + " one"), (7, b), (7, b), (7, b), (8, b + " more"), (9, None), (9, ""), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_classes(df)
    assert got.count() == len(rows)
    seen = [(r.doc_id, r.class_id, r.class_size, r.kept, r.near_id) for r in got.collect()]
    assert Counter(x for x in seen if x[0] is None) == {(None, None, 1, True, None): 4}
    assert Counter(x for x in seen if x[0] == 9) == {(9, 9, 1, True, None): 3}
    assert sorted((x[1:4]) for x in seen if x[0] == 5) == [(5, 2, False), (5, 2, True)] and all(x[4] == 5 for x in seen if x[0] == 5)
    assert Counter(x[:4] for x in seen if x[0] in (7, 8)) == {(7, 7, 4, True): 1, (7, 7, 4, False): 2, (8, 7, 4, False): 1}
    kept = Counter(map(tuple, neardup.drop_near_copies(df.withColumn("key", F.lit(1))).select("doc_id", "text").collect()))
    five = next(r.text for r in df.where("doc_id = 5").orderBy(F.xxhash64("text")).limit(1).collect())
    assert kept == Counter([(None, a), (None, b), (None, c), (None, None), (5, five), (7, b), (9, None), (9, ""), (9, "")])


def test_copies_under_one_id(spark):
    """Spellings of white space under one id and repeated rows: one stays, the same in each run; columns with names of the operator's own."""
    rows = [(1, "a  b", 1), (1, "a b", 2), (1, "a b", 2), (None, "a b", 3), (None, "c", 4), (None, "c", 5), (2, "d", 6), (3, None, 7), (4, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumns({"key": F.lit("k"), "turn": F.lit(0)})
    for n in (1, 5):
        got = exact.drop_copies(df.repartition(n)).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, next(x.text for x in df.where("doc_id = 1").orderBy(F.xxhash64("text")).limit(1).collect())), (None, "c"), (2, "d"), (3, None)])
    named = df.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"), F.lit(1).alias("rows"), F.lit(2).alias("mark"), F.lit(3).alias("turn"), F.lit(4).alias("own"))
    assert {(r.doc_id, r.rows, r.own) for r in exact.exact_groups(named).collect() if r.doc_id == 1} == {(1, 1, 4), (1, 2, 4)}


def test_texts_of_one_template_do_not_meet(spark):
    """Many texts that share most of their words, but less than a link needs: no pairs, and no links."""
    shared = [f"w{i}" for i in range(100)]
    for changed in (13, 8):
        texts = {i: " ".join(shared[:40] + [f"x{i}y{k}" for k in range(changed)] + shared[40 + changed :]) for i in range(400)}
        df = spark.createDataFrame(list(texts.items()), "id long, text string")
        known = df.select("id", F.lit(96).cast("long").alias("n"), F.col("id").alias("root"))
        assert neardup.possible_links(df, known, 0.8, 5).count() == 0
    assert all(r.class_size == 1 for r in neardup.near_classes(df.withColumnRenamed("id", "doc_id")).collect())


def test_possible_links_lose_none(spark):
    r = random.Random(12)
    texts = {}
    for i in range(150):
        words = [f"w{k}" for k in range(r.randint(60, 110))]
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"x{r.randrange(40)}"
        texts[i] = " ".join(words)
    sets = {i: weighted(t) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    known = spark.createDataFrame([(i, sum(s.values()), i) for i, s in sets.items()], "id long, n long, root long")
    got = {tuple(sorted((p.a, p.b))) for p in neardup.possible_links(df, known, 0.8, 5).collect()}
    linked = set()
    for a in texts:
        for b in range(a + 1, len(texts)):
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                linked.add((a, b))
    assert linked and linked <= got


def test_a_document_of_boilerplate_lines(spark):
    """Copies of a text of 50,000 lines on twelve sites, all of which go but one, and a word of a megabyte."""
    text = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(i, f"{text}\nown {i}", f"s{i}") for i in range(12)] + [(20, "x" * 1_000_000, "s1")]
    got = {r.doc_id: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].text == f"own {i}" and got[i].n_removed == 50_000 for i in range(12)) and got[20].n_removed == 0 and len(got[20].text) == 1_000_000


def test_sites_near_and_far_from_the_threshold(spark):
    """Sketches decide far from the threshold, exact counts near it; repeats on one site count once."""
    rows = [(1000 * n + 10 * i + k, f"on {n} sites", f"s{i}") for n in (1, 2, 7, 9, 10, 11, 40) for i in range(n) for k in range(2)]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=10).collect()
    assert {r.doc_id // 1000 for r in got if r.n_removed} == {10, 11, 40} and {r.doc_id // 1000 for r in got if not r.n_removed} == {1, 2, 7, 9}


def test_long_texts_in_near_dedup(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(120_000)]
    near = list(words)
    near[60_000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "y" * 1_000_000), (4, " ".join(reversed(words)))]
    got = {x.doc_id: x.class_id for x in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
