"""A pipeline over ``documents``: language ID, exact dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), with ``docs`` what the stage before kept, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm import bpe, exact, langid, mix, neardup
from kotonoha.llm.common import cut

#: A document whose language has a lower posterior probability, or whose n-grams are on average so
#: much less likely (in nats) than that language's own, is rejected. All documents of sf0.1 with a
#: letter have a fit over -2.8; random letters, base64 and other scripts have one under -3.6.
LEAST_SCORE, LEAST_FIT = 0.5, -3.5

#: Words of a block of the mix.
BLOCK = 512


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled rows that aren't held out.

    Null texts, texts without letters, and texts that no language has with LEAST_SCORE and
    LEAST_FIT go: other scripts, random letters, encoded data. Repeated rows stay each, a very
    long text is judged whole, an empty table gives no rows; all columns stay.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    named = langid.predict(docs.select("text", others), model)
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("fit") >= LEAST_FIT))
    return kept.select(*["text" if c == "text" else F.col(f"others.`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for runs of white space the one with the smallest doc_id (null is the largest), once if rows repeat. Null and empty texts are equal; a very long text is compared in chunks; an empty table gives no rows."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id. Null and empty texts and rows without a doc_id all stay, and so do different texts of one doc_id unless they are near copies; an empty table gives no rows."""
    return neardup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix takes, repeats included, each with its document's columns. Texts without words have no pieces, a null source is a source, a very long text has many pieces; an empty table gives no rows."""
    return mix.mix_texts(docs, block=BLOCK).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's token ids, with their number and whether they decode to the text. A null text has no ids and decodes to an empty one; a very long text is one row as well; an empty table gives no rows."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    marked = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    encoded = bpe.encode_texts(marked, path, public_tokenizers.PATTERN, decoded=True, keep=["doc_id", "lang", "source", "digest"])
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("byte-level BPE", encode)]

#: SQL can express neither the classifier nor the draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
