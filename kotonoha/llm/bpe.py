"""Byte-level BPE encoding and decoding through a sentencepiece model written from the ranks."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kotonoha.llm.common import slices, without
from kotonoha.llm.pretokens import Memo, byte_symbols, compiled, read_ranks


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


#: Field numbers of the public sentencepiece_model.proto.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
NORMAL, UNKNOWN, BPE = 1, 2, 2


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with piece ``rank + 1`` for each token: its bytes as symbols, its score the negative rank; piece 0 is the unknown one. Identity normalisation."""
    symbol = byte_symbols()
    out = [_bytes(PIECES, _bytes(PIECE, b"<unk>") + _number(TYPE, UNKNOWN))]
    by_rank = {rank: token for token, rank in ranks.items()}
    if sorted(by_rank) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary has no token for the bytes {missing}")
    for rank in range(len(ranks)):
        piece = "".join(symbol[b] for b in by_rank[rank]).encode()
        out.append(_bytes(PIECES, _bytes(PIECE, piece) + _varint(SCORE << 3 | 5) + struct.pack("<f", -rank) + _number(TYPE, NORMAL)))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(ranks) + 1) + _number(UNK_ID, 0) + b"".join(_number(f, -1) for f in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _bytes(NAME, b"identity") + b"".join(_number(f, 0) for f in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join([*out, _bytes(TRAINER, trainer), _bytes(NORMALIZER, normalizer)])


#: Characters of a text whose pre-tokens are listed at once.
LISTED = 1 << 20


def encoder(model: bytes, pattern: str):
    """text -> its ranks as a compact array of ints. An unknown piece, which a vocabulary with all bytes never gives, is an error."""
    pieces, symbol, split = sentencepiece.SentencePieceProcessor(model_proto=model), byte_symbols(), compiled(pattern)

    def ids(some: list[str]) -> list[bytes]:
        found = pieces.encode(["".join([symbol[b] for b in piece.encode()]) for piece in some], out_type=int, num_threads=1)
        if any(0 in x for x in found):
            raise ValueError(f"not in the vocabulary: one of {some[:10]!r}")
        return [array("i", [i - 1 for i in x]).tobytes() for x in found]

    memo = Memo(lambda piece: ids([piece])[0])

    def encode(text: str) -> array:
        # the same pre-tokens either way; those of a very long text are not listed at once
        if len(text) <= LISTED and not split.groups:
            parts = split.findall(text)
            if fresh := [p for p in set(parts) if p not in memo and len(p) <= memo.longest]:
                if len(memo) + len(fresh) > memo.most:
                    memo.clear()
                memo.update(zip(fresh, ids(fresh)))
        else:
            parts = map(itemgetter(0), split.finditer(text))
        out = array("i")
        out.frombytes(b"".join(map(memo.__getitem__, parts)))
        return out

    return encode


def decoder(ranks: dict[bytes, int]):
    """list of ranks -> bytes; an id that is no rank is an error."""
    by_rank = {rank: token for token, rank in ranks.items()}
    token = [by_rank[i] for i in range(len(by_rank))].__getitem__

    def decode(ids) -> bytes:
        if len(ids) and np.asarray(ids).min() < 0:
            raise IndexError("ids are not negative")
        return b"".join(map(token, ids.tolist() if isinstance(ids, array) else ids))

    return decode


def encode_texts(docs: DataFrame, path: str, pattern: str, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) to ``docs``: the ranks of each whole text's tokens; with ``decoded`` also the bytes that they decode to.

    Each match of ``pattern`` is encoded by itself, without special tokens. The ranks (bounded
    by the vocabulary at ``path``) are broadcast. Null counts as empty: no ids. A very long text
    is encoded as a whole in one task, a batch by itself; repeated rows are encoded each, an empty
    table gives no rows. The columns in ``keep`` stay (all of them by default); input columns
    ``ids`` and ``decoded`` are replaced.
    """
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((serialise(ranks), ranks if decoded else {}))
    rows = without(docs, "ids", *["decoded"] * decoded)
    kept = [f for f in rows.schema.fields if keep is None or f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        encode, decode = encoder(model, pattern), decoder(table)
        for batch in slices(batches, "text", 1 << 18):
            found = [encode(text or "") for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))
            made = [ids, *[pa.array(map(decode, found), pa.binary()) for _ in range(decoded)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *made], names=[*[f.name for f in kept], "ids", *["decoded"] * decoded])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.BinaryType())] * decoded]))


def decode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (binary) to ``docs`` (a column ``ids``): the tokens' bytes behind one another. Null and empty ids give no bytes; an unknown id fails; an input column ``decoded`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    rows = without(docs, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                decoded = pa.array([decode(ids.values.to_pylist()) if ids.is_valid else b"" for ids in part.column("ids")], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """``ids`` and ``decoded`` -> n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
