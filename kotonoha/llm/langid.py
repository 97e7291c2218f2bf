"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kotonoha.llm.common import slices, without

ORDERS, BUCKETS, SMOOTHING = (1, 2, 3), 1 << 15, 0.5

#: Languages of one model: its counts come to the driver and its table (8 bytes for each bucket and
#: language, 64 MB at most) goes to all executors. More are an error.
MOST_LANGUAGES = 256

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, one text behind the other, and the number of each text's n-grams.

    Lower case; runs of other characters than letters count as one space, and each text starts
    and ends with one; n-grams of spaces alone don't occur. A text without letters has none.
    """
    joined = "\0".join(" " + (t or "").lower().replace("\0", " ") + " " for t in texts) if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter, cut = letters()[codes], codes == 0
    keep = letter | cut
    keep[1:] |= letter[:-1] | cut[:-1]  # of a run of others the first stays
    keep[:1] = True
    codes, letter, cut = np.where(letter | cut, codes, np.uint32(32))[keep], letter[keep], cut[keep]
    owner = np.cumsum(cut)
    found, whose = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h, inside, any_letter = np.full(size, n, np.uint32), np.ones(size, bool), np.zeros(size, bool)
        for k in range(n):
            h = (h ^ codes[k : k + size]) * _MIX[k]
            h ^= h >> np.uint32(15)
            inside &= ~cut[k : k + size]
            any_letter |= letter[k : k + size]
        good = np.flatnonzero(inside & any_letter)
        found.append(((h[good] * _MIX[0]) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64))
        whose.append(owner[good])
    buckets, docs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, whose))
    order = np.argsort(docs, kind="stable")
    return buckets[order], np.bincount(docs, minlength=len(texts))[: len(texts)]


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in slices(batches, "text", 1 << 18):
        buckets, sizes = grams(batch.column("text").to_pylist())
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.repeat([names.index(x) for x in langs], sizes)
        for i, name in enumerate(names):
            counts[name] = counts.get(name, 0) + np.bincount(buckets[code == i], minlength=BUCKETS)
            docs[name] = docs.get(name, 0) + langs.count(name)
    for name, row in counts.items():
        full = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * (len(full) + 1)), pa.array([*full, -1], pa.int32()), pa.array([*row[full], docs[name]], pa.int64())], names=["lang", "bucket", "n"])


class Model(NamedTuple):
    """Languages in order, log P(bucket | language) as (BUCKETS, languages), log P(language), and the mean of the first over each language's training n-grams."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray
    usual: np.ndarray


def train(docs: DataFrame) -> Model:
    """A model of ``docs`` (text, lang); rows without a language teach nothing.

    Counts are made by each task, then added up by Spark; what comes to the driver has at most
    BUCKETS + 1 rows for each of at most MOST_LANGUAGES languages.
    """
    labelled = docs.where("lang is not null").select("text", "lang")
    if labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    counted = labelled.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in counted})
    counts, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for r in counted:
        if r.bucket < 0:
            prior[langs.index(r.lang)] = r.n
        else:
            counts[r.bucket, langs.index(r.lang)] = r.n
    table = np.log((counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0))
    return Model(langs, table, np.log((prior + 1) / (prior + 1).sum()), (counts * table).sum(axis=0) / np.maximum(1, counts.sum(axis=0)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``lang_pred``, ``score`` and ``fit``; only the text counts.

    ``score`` is the posterior probability of the language among those learned. ``fit`` is the
    mean log-probability of the text's n-grams less that of the language's training n-grams: about 0
    for a text of the language, well below for one in none of those learned, of which ``score``
    can't tell. A null text, one without a letter, and any text where nothing was learned give
    ``und`` with score 0 and no ``fit``. A very long text is scored whole, a batch by itself.
    Repeated rows are scored each, an empty table gives no rows; input columns of the added
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = without(docs, "lang_pred", "score", "fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, prior, usual = shared.value
        for batch in slices(batches, "text", 1 << 18):
            buckets, sizes = grams(batch.column("text").to_pylist())
            full = np.flatnonzero(sizes)
            names, scores, fits = np.full(len(sizes), "und", object), np.zeros(len(sizes)), np.full(len(sizes), np.nan)
            if len(full) and langs:
                starts = (np.cumsum(sizes) - sizes)[full]
                likely = np.stack([np.add.reduceat(table[buckets, k], starts) for k in range(len(langs))], axis=1)
                logs = likely + prior
                best, each = logs.argmax(axis=1), np.arange(len(full))
                names[full] = np.array(langs, object)[best]
                scores[full] = 1 / np.exp(logs - logs[each, best][:, None]).sum(axis=1)
                fits[full] = likely[each, best] / sizes[full] - usual[best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(fits, from_pandas=True)], names=[*batch.schema.names, "lang_pred", "score", "fit"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) -> doc_id, held_out, lang_pred, score, a row for each row.

    The model learns from rows with a language whose doc_id isn't held out (crc32 of the id's
    digits mod 3 is not 1; a null id isn't held out). Nulls, very long texts and repeated rows as
    for ``predict``. Extra columns are left out.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
