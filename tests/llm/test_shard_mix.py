from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from kotonoha.llm import mix, shard
from kotonoha.llm.draws import binomial, hypergeometric, permuted, uniform


def test_draws_have_their_law(spark):
    u = uniform(F.lit(5), F.col("id"))
    df = spark.range(4000).select(hypergeometric(F.lit(300).cast("long"), F.lit(1000).cast("long"), F.lit(50).cast("long"), u).alias("h"), binomial(F.lit(40).cast("long"), F.lit(0.3), u).alias("b"))
    got = df.toPandas()
    assert abs(got.h.mean() - 15) < 0.15 and abs(got.h.var() - 50 * 0.3 * 0.7 * 950 / 999) < 0.7
    assert abs(got.b.mean() - 12) < 0.15 and abs(got.b.var() - 8.4) < 0.7
    assert got.h.between(0, 50).all() and got.b.between(0, 40).all()


def test_draws_at_the_edges(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    long = lambda n: F.lit(n).cast("long")
    assert one(hypergeometric(long(0), long(5), long(3), F.lit(0.9))) == 0
    assert one(hypergeometric(long(5), long(5), long(3), F.lit(0.1))) == 3
    assert one(hypergeometric(long(4), long(5), long(5), F.lit(0.1))) == 4
    assert abs(one(hypergeometric(long(10**9), long(3 * 10**9), long(10**6), F.lit(0.3))) - 333_333) < 6 * 472
    assert one(binomial(long(7), F.lit(0.0), F.lit(0.5))) == 0 and one(binomial(long(7), F.lit(1.0), F.lit(0.5))) == 7


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 100, 1601, 5000):
        got = [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 7 or got != list(range(n))


def test_matrix_margins(spark):
    sizes = spark.createDataFrame([(p, 5 + p) for p in range(9)], "part long, n long")
    n = sum(5 + p for p in range(9))
    got = {r.part: r.counts for r in shard.communication_matrix(sizes, 4, n, 9, 3).collect()}
    assert all(sum(got[p]) == 5 + p for p in range(9))
    assert [sum(got[p][s] for p in range(9)) for s in range(4)] == [n // 4 + (s < n % 4) for s in range(4)]


def test_matrix_has_the_law_of_a_uniform_shuffle(spark):
    """The first two entries of 3,000 matrices against their exact joint law, by chi-square."""
    sizes, capacity = F.array(*[F.lit(x).cast("long") for x in (3, 2, 4)]), F.array(*[F.lit(x).cast("long") for x in (4, 3, 2)])
    rows = spark.range(3000).select(shard._spread(sizes, capacity, F.xxhash64("id")).alias("m"))
    seen = Counter((r.m[0][0], r.m[1][0]) for r in rows.collect())
    places = [0] * 3 + [1] * 2 + [2] * 4  # the part of each of nine rows; any four of them may form the first shard
    law = Counter((sum(places[i] == 0 for i in c), sum(places[i] == 1 for i in c)) for c in combinations(range(9), 4))
    total = sum(law.values())
    assert set(seen) <= set(law)
    chi = sum((seen[k] - 3000 * w / total) ** 2 / (3000 * w / total) for k, w in law.items())
    assert chi < len(law) - 1 + 5 * np.sqrt(2 * (len(law) - 1))


def test_repeated_rows_spread(spark):
    df = spark.range(1, 4001).select(F.when(F.col("id") > 3000, F.col("id")).otherwise(0).alias("doc_id"), F.lit("x").alias("v"))
    got = shard.shard_rows(df, 4, part_rows=200)
    assert got.count() == 4000 and Counter(r.doc_id for r in got.collect())[0] == 3000
    of = Counter(r.shard for r in got.where("doc_id = 0").collect())
    assert all(abs(of[s] - 750) < 100 for s in range(4))


def test_shards_are_exact(spark, odd, none):
    for df, parts in ((odd, 3), (odd, 65_536), (none, 10)):
        got = shard.shard_rows(df, 4, part_rows=parts).collect()
        sizes = Counter(r.shard for r in got)
        assert len(got) == df.count() and (not got or max(sizes.values()) - min(sizes.get(s, 0) for s in range(4)) <= 1)
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        assert Counter(r.text for r in got) == Counter(r.text for r in df.collect())


def test_shards_are_uniform_and_rerun_alike(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    a, b = (sorted(map(tuple, shard.shard_rows(df, 8, part_rows=100).collect())) for _ in range(2))
    assert a == b
    by = np.array([r[1] for r in a])
    assert abs(np.corrcoef(np.arange(2000), by)[0, 1]) < 0.1
    pairs = Counter((by[i], by[i + 1]) for i in range(1999))
    assert len(pairs) == 64 and max(pairs.values()) < 70


def test_targets_reshare_the_excess(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 10), (None, 890), ("c", 0)], "source string, size long")
    got = {r.source: r for r in mix.source_targets(sized).collect()}
    # weights a 1, b 2, c 3, null 1: b stops at 30, c at 0; the other 970 are shared 1 : 1 but a stops at 300
    assert got["b"].target == 30 and got["c"].target == 0 and got["a"].target == 300 and abs(got[None].target - 670) < 1e-9
    assert [got[s]["rank"] for s in ("a", "b", "c", None)] == [0, 1, 2, 3]


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Share the rest by weight again and again, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while open_ and rest > 1e-9:
        share = rest / sum(weight[s] for s in open_)
        rest = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def test_targets_equal_iterative_resharing(spark):
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 40):
        sizes = {None if i == n // 2 else f"s{i}": int(x) for i, x in enumerate(r.pareto(0.7, n) * 50)}
        got = {x.source: x.target for x in mix.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        wanted = brute_targets(sizes)
        assert all(abs(got[s] - wanted[s]) < 1e-6 * (1 + wanted[s]) for s in sizes)


def test_draws_in_two_levels_meet_all_quotas(spark):
    quotas = [(i, 10 + i, 3 * i % 17 * 5) for i in range(30)]
    got = mix.shard_counts(spark.createDataFrame(quotas, "rank int, blocks long, quota long"), 30, 7, 5).collect()
    by, per = Counter(), Counter()
    for r in got:
        by[r.rank] += r.n
        per[r.shard] += r.n
    assert all(by[i] == q for i, _, q in quotas) and max(per.values()) - min(per.values()) <= 1 and min(r.n for r in got) >= 0


def test_mix_nears_its_targets(spark):
    rows = [(i, f"s{i % 7}" if i % 7 else None, (i * 37) % 400) for i in range(1500)]
    got = mix.mixed_sizes(spark.createDataFrame(rows, "doc_id long, source string, size long"), block=16).toPandas()
    assert len(got) == 1500 and (got.taken <= 3 * got["size"]).all()
    sums = got.fillna({"source": "~"}).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), whole=("source_size", "first"))
    assert (sums["size"] == sums.whole).all() and abs(sums.target.sum() - got["size"].sum()) < 1e-6
    assert (abs(sums.taken / sums.target - 1) < 0.01).all()


def test_small_sources_near_their_targets(spark):
    """Sources of one to five blocks, and of fewer words than a block."""
    r = np.random.default_rng(8)
    rows = [(i, f"s{i % 40:02d}", int(n)) for i, n in enumerate(r.integers(1, 40, 600))] + [(1000, "tiny", 3), (1001, "none", 0)]
    got = mix.mixed_sizes(spark.createDataFrame(rows, "doc_id long, source string, size long"), block=128).toPandas()
    sums = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), whole=("source_size", "first"))
    assert (got.taken <= 3 * got["size"]).all() and sums.whole.max() < 5 * 128
    assert (abs(sums.taken - sums.target) <= 1 + 0.05 * sums.target).all()


def test_equal_rows_spread_over_parts(spark):
    """Rows equal in all columns are numbered, so that they fall into parts of bounded size and are taken as planned."""
    df = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"))
    sized = df.unionByName(spark.createDataFrame([(1, "t", 50)], df.schema))
    targets, placed, _ = mix.plan_mix(sized, block=16)
    assert placed.count() == 200_001 and placed.select("rank", "start").distinct().count() == 200_001
    parts = placed.groupBy(F.pmod(mix.row_hash(placed.select("doc_id", "source", "size", "copy", "rank", "source_size", "blocks"), 29), F.lit(-(-200_001 // mix.PART_ROWS)))).count()
    assert parts.agg(F.max("count")).first()[0] < 2 * mix.PART_ROWS
    got = mix.mixed_sizes(sized, block=16).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.max("taken").alias("most")).collect()
    assert all(abs(r.n - r.t) < 0.01 * r.t + 1 for r in got)


def test_pieces_of_equal_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e", "s")] * 700 + [(2, "f g", "t")], "doc_id long, text string, source string")
    got = mix.mix_texts(df, block=4).select(F.size(F.split("text", " +")).alias("n"), "text").collect()
    planned = mix.mixed_sizes(df.select("doc_id", "source", mix.word_count(F.col("text")).alias("size")), block=4).agg(F.sum("taken")).first()[0]
    assert sum(len(r.text.split()) for r in got) == planned


def test_mix_of_odd_and_no_rows(spark, odd, none):
    assert mix.mixed_sizes(none.select("doc_id", "source", mix.word_count(F.col("text")).alias("size"))).count() == 0
    sized = odd.select("doc_id", "source", mix.word_count(F.col("text")).alias("size"))
    got = mix.mixed_sizes(sized, block=4)
    assert got.count() == odd.count() and got.where("size is null or taken is null or taken > 3 * size").count() == 0


def test_mixed_texts_are_pieces(spark, odd, none):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = mix.mix_texts(docs, block=4).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got and all(r.text in texts[r.doc_id] and r.n_chars == len(r.text) for r in got)
    sizes = mix.mixed_sizes(docs.select("doc_id", "source", mix.word_count(F.col("text")).alias("size")), block=4)
    total = sum(len(r.text.split(" ")) > 0 for r in got)
    assert total == len(got) and sizes.agg(F.sum("taken")).first()[0] > 0
    assert mix.mix_texts(none).count() == 0


def test_mixed_pieces_carry_each_word_as_often_as_planned(spark):
    docs = spark.createDataFrame([(1, "a b\nc  d", "s"), (2, "e", "s"), (3, " f g h", "t")], "doc_id long, text string, source string")
    got = mix.mix_texts(docs, block=2).collect()
    words = Counter(w for r in got for w in r.text.split())
    planned = mix.mixed_sizes(docs.select("doc_id", "source", mix.word_count(F.col("text")).alias("size")), block=2).collect()
    assert set(words) <= set("abcdefgh") and max(words.values()) <= 3
    assert sum(words.values()) == sum(r.taken for r in planned)


def test_native_plans_have_no_python(spark, odd):
    plan = shard.shard_rows(odd, 4)._jdf.queryExecution().toString() + mix.mixed_sizes(odd.select("doc_id", "source", mix.word_count(F.col("text")).alias("size")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
