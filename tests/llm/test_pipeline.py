from __future__ import annotations

import re
from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from kotonoha.llm import pretokens
from kotonoha.llm.common import cut
from tests.llm.test_dedup import brute_classes, brute_groups
from tests.llm.test_shard_mix import brute_targets


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = cut(stage(spark, docs, sf), "test")
        after = docs.collect()
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "language ID":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}
        elif name == "exact dedup":
            assert sorted(r.doc_id for r in after) == sorted(min(ids) for ids in brute_groups(before).values())
        elif name == "MinHash near-dedup":
            classes = brute_classes({r.doc_id: r.text for r in before})
            assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))
        elif name == "mixing sources":
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(r.text.split())
            for r in after:
                taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert sum(taken.values()) and all(n <= 3 * sizes[s] for s, n in taken.items())
            targets = brute_targets(sizes)
            assert set(taken) <= set(sizes) and all(abs(taken[s] - t) <= 1 + 0.02 * t for s, t in targets.items())
        else:
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pretokens.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
            assert all(r.round_trip for r in after)
            assert Counter((r.doc_id, tuple(r.ids)) for r in after) == Counter((r.doc_id, tuple(own.encode_ordinary(r.text))) for r in before)


def test_odd_rows_pass_all_stages(spark, odd, none, sf):
    for df in (odd, none):
        docs = df
        for _, stage in C.STAGES:
            docs = cut(stage(spark, docs, sf), "test")
        assert docs.count() > 0 or df is none
        assert docs.where(~F.col("round_trip")).count() == 0
