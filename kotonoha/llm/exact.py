"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import SPACE, cut, drop_special, likely_wanted, slices, without

#: Two primes under 2^31 and a base: products fit in 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
BASE = 1_000_003

#: Bytes of a chunk: byte times power, summed over a chunk, stays under 2^63.
CHUNK = 65_536

#: Columns that the operators here add; input columns of these names are left out.
RESERVED = ("mark", "n_bytes", "rows", "no", "piece", "behind", "bytes", "t1", "t2", "s1", "s2", "f1", "f2", "turn", "keep_id", "keep_mark", "group_size", "texts", "best", "id", "m", "kept", "salts", "salt", "kept_piece")

#: Members of one group that meet one copy of the kept text's chunks.
SALT_ROWS = 500


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """``base ** exponents mod prime`` by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(prime), out)
        square, left = square * square % np.uint64(prime), left >> np.uint64(1)
    return out


def chunk_hashes(data: np.ndarray, offsets: np.ndarray, prime: int, powers: np.ndarray) -> np.ndarray:
    """The polynomial hash of each chunk ``data[offsets[i]:offsets[i + 1]]``: sum of (byte + 1) * BASE ** (bytes behind it)."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        behind = np.repeat(offsets[1:][full], lengths[full]) - 1 - np.arange(offsets[0], offsets[-1])
        out[full] = np.add.reduceat((data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)) * powers[behind], offsets[:-1][full] - offsets[0])
    return out % np.uint64(prime)


def _hash_chunks(primes: tuple[int, ...], chunk: int):
    """Chunks (.., piece binary, behind long) -> for each its hash times BASE ** behind, mod each prime."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [power(BASE, np.arange(chunk), p) for p in primes]
        for batch in slices(batches, "piece", 1 << 20):
            piece, at = batch.column("piece"), batch.schema.get_field_index("piece")
            offsets = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64) if len(piece) else np.zeros(1, np.int64)
            data = np.frombuffer(piece.buffers()[2], np.uint8) if piece.buffers()[2] else np.zeros(0, np.uint8)
            behind = batch.column("behind").to_numpy(zero_copy_only=False)
            terms = [chunk_hashes(data, offsets, p, w) * power(BASE, behind, p) % np.uint64(p) for p, w in zip(primes, powers, strict=True)]
            kept = [i for i in range(batch.num_columns) if i != at and batch.schema.names[i] != "behind"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(t.astype(np.int64)) for t in terms]], names=[*[batch.schema.names[i] for i in kept], "t1", "t2"])

    return run


def chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows with ``body`` (binary) -> a row for each chunk: no (from 0), piece, behind (bytes behind it). An empty body has one empty chunk."""
    n = F.octet_length("body").cast("long")
    numbers = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / chunk).cast("long") - 1, F.lit(0).cast("long")))
    kept = [c for c in rows.columns if c != "body"]
    cutting = rows.select(*kept, "body", n.alias("bytes"), F.explode(numbers).alias("no"))
    piece = F.col("body").substr((F.col("no") * chunk + 1).cast("int"), F.lit(chunk))
    return cutting.select(*kept, "no", piece.alias("piece"), F.greatest(F.col("bytes") - (F.col("no") + 1) * chunk, F.lit(0).cast("long")).alias("behind"))


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (doc_id, body, and columns that follow from them) -> one row for each different doc_id and body: rows long, n_bytes long, f1 and f2 long.

    Chunks of all texts are hashed independently and combined by addition once each is shifted
    by the number of bytes behind it, so that a task holds chunks, not texts, and the hash of a
    text can be made in parts. Columns named as in RESERVED are left out.
    ``mark`` (a hash of the body) tells apart rows with one doc_id; rows that agree in all of
    it add the same terms, so the sum is divided by their number.
    """
    docs = without(docs, *RESERVED)
    carried = [c for c in docs.columns if c not in ("doc_id", "body")]
    marked = docs.withColumns({"mark": F.xxhash64("body"), "n_bytes": F.octet_length("body").cast("long")})
    pieces = chunks(marked, chunk)
    kept = [c for c in pieces.columns if c not in ("piece", "behind")]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    hashed = pieces.mapInArrow(_hash_chunks(primes, chunk), ", ".join([*[f"`{c}` {types[c]}" for c in kept], "t1 long, t2 long"]))
    rows = F.count_if(F.col("no") == 0)
    combined = hashed.groupBy("doc_id", "mark", "n_bytes", *carried).agg(rows.alias("rows"), F.sum("t1").alias("s1"), F.sum("t2").alias("s2"))
    fp = lambda s, p: F.expr(f"{s} div rows % {p}")
    return combined.select("doc_id", "mark", "n_bytes", "rows", fp("s1", primes[0]).alias("f1"), fp("s2", primes[1]).alias("f2"), *carried)


def exact_groups(docs: DataFrame, primes: tuple[int, int] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """``docs`` (doc_id, body binary, and columns that follow from these two) -> the same rows less ``body``, with ``mark``, ``n_bytes``, ``rows``, ``keep_id`` and ``group_size``.

    Rows belong together if their bodies are equal; ``keep_id`` is the smallest doc_id (null
    counts as the largest). Fingerprints, with the length, propose groups. Each member's text is
    then compared with the kept row's, chunk by chunk; members that differ (a collision) form
    groups of their own and are compared again, until none differs. Texts without a partner are
    left out before anything is moved, by a bitmap of the ids that have one. Copies of one doc_id and body
    come back as one row with ``rows`` over 1. A null doc_id is an id like others; a very long text
    is compared as chunks that many tasks hold. An empty table gives no rows.
    """
    docs, key = without(docs, *RESERVED), ["f1", "f2", "n_bytes", "turn"]
    members = cut(fingerprints(docs, primes, chunk).withColumn("turn", F.lit(0)), "fingerprints")
    extra = [c for c in members.columns if c not in (*key, "doc_id", "mark", "rows")]
    body = docs.select("doc_id", F.xxhash64("body").alias("mark"), F.octet_length("body").cast("long").alias("n_bytes"), "body")
    done, turn = [], 0
    while True:
        best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))).alias("best")
        groups = cut(members.groupBy(*key).agg(best, F.sum("rows").alias("group_size"), F.count("*").alias("texts")).select(*key, F.col("best.doc_id").alias("keep_id"), F.col("best.mark").alias("keep_mark"), "group_size", "texts"), "groups")
        placed = members.join(groups, key)  # a hot group's rows are split by AQE: both sides are plain exchanges
        salts = F.ceil(F.col("texts") / SALT_ROWS).cast("long")
        kept_row = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
        wanted = placed.where("texts > 1").select(*key, F.col("doc_id").alias("id"), F.col("mark").alias("m"), kept_row.alias("kept"), salts.alias("salts"))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")) & (F.col("bytes") == F.col("n_bytes"))
        paired = groups.where("texts > 1").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n")).first().n
        held = likely_wanted(body, wanted.select(F.col("id").alias("doc_id")), "doc_id", paired).withColumnRenamed("n_bytes", "bytes").join(wanted, same).select(*key, "id", "m", "kept", "salts", "body")
        pieces = cut(chunks(held, chunk).drop("behind"), "pieces")
        theirs = pieces.where("not kept").withColumn("salt", F.pmod(F.xxhash64("id", "m"), F.col("salts")))
        once = pieces.where("kept").dropDuplicates([*key, "no"]).select(*key, "no", F.col("piece").alias("kept_piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        differ = theirs.join(once, [*key, "no", "salt"]).where(F.col("piece") != F.col("kept_piece"))
        wrong = cut(differ.select(*key, "id", "m").distinct(), "unequal")
        if wrong.isEmpty():
            done.append(placed)
            return reduce(DataFrame.unionByName, done).select("doc_id", "mark", "n_bytes", "rows", *extra, "keep_id", "group_size")
        turn += 1
        members = _again(members, wrong, key, turn)


def _again(members: DataFrame, wrong: DataFrame, key: list[str], turn: int) -> DataFrame:
    """The same members; those in ``wrong`` go to the group of the next turn."""
    marked = wrong.select(*[F.col(k).alias(f"w_{k}") for k in key], "id", "m")
    on = reduce(Column.__and__, [F.col(k) == F.col(f"w_{k}") for k in key]) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))
    moved = F.when(F.col("m").isNotNull(), F.lit(turn)).otherwise(F.col("turn"))
    return cut(members.join(marked, on, "left").select(*[c for c in members.columns if c != "turn"], moved.alias("turn")), "fingerprints")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more columns) that stay: of texts equal but for runs of white space the one with the smallest doc_id (null is the largest), in one copy.

    Of several spellings of white space under that doc_id the one with the least hash stays. Null
    and empty texts are equal; a very long text is compared in chunks; an empty table gives no
    rows; all columns stay. Only rows that go or are repeated are moved.
    """
    body = F.encode(normalised(F.col("text")), "UTF-8")
    groups = exact_groups(docs.select("doc_id", body.alias("body")))
    keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    special = groups.where((~keep) | (F.col("rows") > 1)).select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), keep.alias("keep"), F.xxhash64("doc_id", "mark").alias("key"))
    return drop_special(docs, F.xxhash64(body), cut(special, "copies"))
