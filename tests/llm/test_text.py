from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kotonoha.llm import bpe, counts, langid, pretokens, quality, urls
from tests.llm.conftest import PROSE

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pretokens.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def odd_texts() -> list[str]:
    """Every assigned code point of the first planes between letters, digits and spaces, and awkward runs."""
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x10000, 0x1F700, 97)]
    return ["".join(f"a{c}1 {c} {c}{c}\n" for c in points[i : i + 200]) for i in range(0, len(points), 200)] + ["", " ", "  \n\n  x", "\x1c\x1d a\x85b\u2028c\u00a0d", "ab" * 3000, "'s 't're I'LL don't", "日本語" * 500, "🙂👨‍👩‍👧" * 50, " " * 3000 + "x"]


def test_encoding_is_that_of_the_library(theirs):
    encode = bpe.encoder(bpe.serialise(pretokens.read_ranks(RANKS)), P.PATTERN)
    for text in odd_texts():
        assert list(encode(text)) == theirs.encode_ordinary(text)


def test_every_token_comes_back(theirs):
    ranks = pretokens.read_ranks(RANKS)
    encode = bpe.encoder(bpe.serialise(ranks), r"(?s).+")
    whole = tiktoken.Encoding("all", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for token in list(ranks)[::7]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert list(encode(text)) == whole.encode_ordinary(text)


def test_encoding_and_decoding_of_rows(odd, none, theirs):
    got = bpe.decode_ids(bpe.encode_texts(odd, RANKS, P.PATTERN), RANKS).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.ids == theirs.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    digest = bpe.digests(bpe.encode_texts(odd.where("doc_id = 7"), RANKS, P.PATTERN, decoded=True, keep=["doc_id"])).first()
    ids = theirs.encode_ordinary("日本語 テキスト 𠮷野家")
    assert digest.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digest.n_tokens == len(ids)
    assert bpe.decode_ids(bpe.encode_texts(none, RANKS, P.PATTERN), RANKS).count() == 0


def test_counts_are_those_of_the_library(odd, none, library):
    merges, added = pretokens.read_merges(JSON)
    count = counts.token_counter({pair: i for i, pair in enumerate(merges)}, added, P.PATTERN)
    texts = [*odd_texts(), "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", " <|endoftext|>\n\n<|endo", "x \n<|endoftext|>"]
    assert [count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = counts.count_tokens(odd, JSON, P.PATTERN, limit=20).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 20) for r in odd.collect())
    assert counts.count_tokens(none, JSON, P.PATTERN).count() == 0


def test_merging_by_brute_force():
    ranks = {("a", "b"): 3, ("b", "a"): 1, ("ba", "ba"): 2, ("a", "a"): 0}

    def brute(s):
        s = list(s)
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if best is None:
                return len(s)
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    for n in range(1, 9):
        for k in range(2**n):
            s = ["ab"[k >> i & 1] for i in range(n)]
            assert counts.count_merged(s, ranks) == brute(s)


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs.select("doc_id", "text", "lang")).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_scores_equal_plain_naive_bayes(spark):
    """A count of n-grams in dictionaries, and Bayes' rule, against the matrix."""
    r = random.Random(6)
    word = {"x": "abcdef", "y": "cdefgh", "z": "ghiéß"}
    rows = [(i, " ".join("".join(r.choices(word[k], k=r.randint(1, 6))) + r.choice(["", "!", "7"]) for _ in range(r.randint(1, 8))), k) for i, k in enumerate(r.choices("xyz", k=120))]
    docs = spark.createDataFrame([(i, t, k if i % 5 else None) for i, t, k in rows], "doc_id long, text string, lang string")

    def bucket(gram):
        h = len(gram)
        for k, c in enumerate(gram):
            h = (h ^ ord(c)) * int(langid._MIX[k]) % 2**32
            h ^= h >> 15
        return h * int(langid._MIX[0]) % 2**32 * langid.BUCKETS >> 32

    def plain(text):
        letters = re.sub(r"[^a-zéß]+", " ", f" {text.lower()} ")
        return Counter(bucket(letters[k : k + n]) for n in (1, 2, 3) for k in range(len(letters) - n + 1) if letters[k : k + n].strip())

    table = {k: Counter() for k in "xyz"}
    count = Counter()
    for r_ in docs.where("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").collect():
        table[r_.lang].update(plain(r_.text))
        count[r_.lang] += 1
    total = {k: sum(t.values()) for k, t in table.items()}
    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    for i, t, _ in rows:
        logs = {k: math.log((count[k] + 1) / (sum(count.values()) + 3)) + sum(n * math.log((table[k][g] + langid.SMOOTHING) / (total[k] + langid.SMOOTHING * langid.BUCKETS)) for g, n in plain(t).items()) for k in "xyz"}
        best = max(logs, key=logs.get)
        score = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert got[i].lang_pred == best and abs(got[i].score - score) < 1e-9


def test_texts_of_no_learned_language_do_not_fit(spark, sf):
    r = random.Random(8)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd_ones = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=400)), base64.b64encode(r.randbytes(300)).decode(), "съешь ещё этих мягких французских булок " * 5, "日本語の文章" * 30]
    model = langid.train(docs)
    fits = [x.fit for x in langid.predict(spark.createDataFrame([(t,) for t in odd_ones], "text string"), model).collect()]
    assert max(fits) < corpus_pipeline.LEAST_FIT
    clean = langid.predict(docs, model).where("fit is not null")
    assert clean.where(F.col("fit") < corpus_pipeline.LEAST_FIT).count() == 0 and abs(clean.agg(F.avg("fit")).first()[0]) < 0.2


def test_too_many_languages_are_an_error(spark):
    many = spark.range(langid.MOST_LANGUAGES + 1).select(F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.train(many)


def test_columns_of_predictions_are_replaced(spark):
    docs = spark.createDataFrame([("ab", "q", 1, "keep")], "text string, LANG_PRED string, fit int, more string")
    assert langid.predict(docs, langid.train(spark.createDataFrame([("ab", "en")], "text string, lang string"))).columns == ["text", "more", "lang_pred", "score", "fit"]


def test_long_texts(spark, theirs, library):
    """Texts of megabytes: many words, one word, and one line after another."""
    r = random.Random(9)
    words = ["".join(r.choices("etaoinshr", k=r.randint(2, 9))) for _ in range(4_000)]
    texts = [" ".join(r.choices(words, k=250_000)), "x" * 1_000_000, "\n".join(r.choices(words, k=200_000)), PROSE]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    encoded = {x.doc_id: x.ids for x in bpe.encode_texts(docs.where("doc_id <> 1"), RANKS, P.PATTERN).collect()}
    assert all(encoded[i] == theirs.encode_ordinary(texts[i]) for i in (0, 2, 3))
    counted = {x.doc_id: x.n_tokens for x in counts.count_tokens(docs, JSON, P.PATTERN).collect()}
    assert all(counted[i] == len(encoded[i]) for i in encoded) and counted[1] == len(library.encode(texts[1], add_special_tokens=False).ids)
    assert {x.lang_pred for x in langid.identify(docs).collect()} == {"en"}
    judged = {x.doc_id: x for x in quality.judge_quality(docs).collect()}
    assert judged[0].n_words == 250_000 and judged[1].n_words == 1 and judged[1].base_failed and judged[2].word_chars == sum(map(len, texts[2].split()))


def test_unknown_ids_and_missing_bytes_are_errors(spark):
    decode = bpe.decoder(pretokens.read_ranks(RANKS))
    for bad in ([-1], [50_256]):
        with pytest.raises(LookupError):
            decode(bad)
    with pytest.raises(ValueError):
        bpe.serialise({bytes([b]): b for b in range(255)})


def test_unsupported_added_tokens_are_errors(tmp_path):
    for more in ({"added_tokens": [{"content": "<x>", "lstrip": True}]}, {"normalizer": {"type": "NFC"}}):
        (tmp_path / "t.json").write_text(json.dumps({"model": {"merges": []}, **more}))
        with pytest.raises(ValueError):
            pretokens.read_merges(str(tmp_path / "t.json"))


def test_languages_of_odd_rows(spark, odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2, 3, 4, 10)) and not by[None].held_out
    assert {r.lang_pred for r in got} <= {"und", "en", "de", "ja", "fr"}
    assert langid.identify(none).count() == 0
    blind = langid.predict(odd.select("doc_id", "text"), langid.train(none))
    assert {r.lang_pred for r in blind.collect()} == {"und"}


def test_grams_of_each_text_are_its_own():
    texts = ["Ab, c", None, "", "12", "x", "Ab, c"]
    together, sizes = langid.grams(texts)
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        alone, m = langid.grams([text])
        assert list(together[at : at + n]) == list(alone) and m[0] == n
        at += n
    assert sizes[0] == sizes[5] > 0 and not sizes[1:4].any()


def test_base_quality_by_brute_force(odd, none):
    got = quality.judge_quality(odd).collect()
    assert len(got) == odd.count()
    wanted = []
    for r in odd.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) for k in range(3) if windows.count(w) > 1}
        seen, dup = set(), 0
        for line in (r.text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        ratio = len(zstandard.ZstdCompressor(level=quality.LEVEL).compress((r.text or "").encode())) / max(1, len((r.text or "").encode()))
        wanted.append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text or "")), dup, len(covered), failed, round(ratio, 9)))
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.ratio, 9)) for r in got) == sorted(wanted)
    assert all(not r.kept for r in got if r.base_failed) and quality.judge_quality(none).count() == 0


def test_verdicts_by_brute_force(spark, sf):
    """Ratio, chunks and verdict of every document by a plain reading of the limits."""
    c = zstandard.ZstdCompressor(level=quality.LEVEL)

    def outside(data):
        if len(data) < quality.LEAST:
            return False
        x, ratio = math.log(len(data)), len(c.compress(data)) / len(data)
        marks = [(math.log(n), low, high) for n, low, high in quality.LIMITS]
        below, above = max([m for m in marks if m[0] <= x], default=marks[0]), min([m for m in marks if m[0] >= x], default=marks[-1])
        t = (x - below[0]) / (above[0] - below[0]) if above[0] > below[0] else 0.0
        return not below[1] + t * (above[1] - below[1]) - 1e-12 <= ratio <= below[2] + t * (above[2] - below[2]) + 1e-12

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge_quality(docs).collect():
        data = (texts[r.doc_id] or "").encode()
        parts = [data[i : i + quality.CHUNK] for i in range(0, max(1, len(data)), quality.CHUNK)]
        if len(parts) > 1 and len(parts[-1]) < quality.LEAST:
            parts[-2:] = [parts[-2] + parts[-1]]
        odd_share = sum(map(outside, parts)) / len(parts)
        passes = not outside(data) and (len(parts) == 1 or odd_share <= quality.CHUNK_SHARE)
        assert abs(r.odd_chunks - odd_share) < 1e-9 and r.kept == (passes and not r.base_failed)


def test_bands_reject_repetition_and_noise():
    import random

    r = random.Random(1)
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    prose = " ".join("".join(r.choices("etaoinshr", k=r.randint(2, 9))) for _ in range(900))
    assert quality.within_bands(prose.encode(), c)[2]
    assert not quality.within_bands(b"again and " * 300, c)[2]
    assert not quality.within_bands(r.randbytes(3000), c)[2]
    half = prose.encode() + b"again and " * 1500
    assert not quality.within_bands(half, c)[2]


def test_limits_reject_text_that_does_not_compress_as_prose():
    import base64
    import random
    import string

    r = random.Random(2)
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    for n in (500, 2_000, 20_000):
        assert not quality.within_bands(base64.b64encode(r.randbytes(n))[:n], c)[2]
        assert not quality.within_bands("".join(r.choices(string.ascii_letters, k=n)).encode(), c)[2]
        words = "".join(r.choices(string.ascii_letters + string.digits + "      ", k=n))
        assert not quality.within_bands(words.encode(), c)[2]


def test_limits_separate_labelled_rows(sf):
    import pyarrow.parquet as pq

    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    label = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    kept = {0: [], 1: []}
    for x in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        words = re.findall(r"[^\x20\x09-\x0D]+", x["text"] or "")
        if x["doc_id"] in label and len(words) >= quality.MIN_WORDS and 100 * quality.repeated_words(words) <= quality.MAX_REPEAT_PERCENT * len(words):
            kept[label[x["doc_id"]]].append(quality.within_bands(x["text"].encode(), c)[2])
    assert sum(kept[1]) > 0.99 * len(kept[1]) and sum(kept[0]) < 0.6 * len(kept[0])


def test_every_chunk_counts():
    import random

    r = random.Random(3)
    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    words = ["".join(r.choices("etaoinshr", k=r.randint(2, 9))) for _ in range(20_000)]
    prose = " ".join(words).encode()
    for n in (0, 1, 99, 100, 4_095, 4_096, 4_097, 4_195, 4_196, 8_192, 20_001):
        parts = quality.chunks(prose[:n])
        assert b"".join(parts) == prose[:n] and all(len(x) < quality.CHUNK + quality.LEAST for x in parts)
        assert all(len(x) >= quality.LEAST for x in parts[1:])
    assert quality.within_bands(prose[:32_000], c)[2]
    assert quality.within_bands(b"a" * 3_000, c)[1:] == (1.0, False)
    for start, filler in ((4_096, 4_096), (32_000, 35_000), (8_192, 4_000)):
        _, share, passes = quality.within_bands(prose[:start] + b"a" * filler, c)
        assert share > quality.CHUNK_SHARE and not passes


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_by_brute_force(spark):
    rules = [*urls.RULES, ("example.com", "", "allow"), ("example.com", "/d", "block"), ("a.b.c", "/x/y/", "block"), ("c", "/x/", "allow"), ("c", "/x/", "block")]
    hosts = ["net", "example.net", "www.Example.NET", "xexample.net", "example.com", "m.example.com", "a.b.c", "b.c", "org", "x.org", "example.net:80", "", ".net", "..net", "u@net", "ÄÖ.net"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/1", "/d", "/fr/a?b", "/x/y/z#q", "/x/", "?q=/en/", "#/en/", "/a://b/"]
    given = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths] + [None, "", "no scheme", "a\n://net/\n", "http://net/", "http://net/"]
    df = spark.createDataFrame([(i % 50, u, "x") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = urls.judge_urls(df, urls.rules_frame(spark, rules)).collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(((i % 50, u, *brute_url(u, rules)) for i, u in enumerate(given)), key=key)


def test_hosts_of_many_labels_and_rules_that_join_up(spark):
    rules = urls.rules_frame(spark, [("exa", "mple.com", "block"), ("com", "", "allow"), ("b.example.com", "/x", "block")])
    long = "a." * 20_000 + "b.example.com"
    given = ["http://example.com", "http://example.com/x", f"http://{long}/x", f"http://{long}/y"]
    got = urls.judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id int, url string"), rules)
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {0: ("com", "allow"), 1: ("com", "allow"), 2: ("b.example.com/x", "block"), 3: ("com", "allow")}


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    none = urls.rules_frame(spark).limit(0)
    assert urls.judge_urls(df, none).first().verdict == "allow"
    assert urls.judge_urls(df.limit(0), urls.rules_frame(spark)).count() == 0
