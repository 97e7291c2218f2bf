"""Token counts by byte-pair merging on a heap and a linked list."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import slices
from kotonoha.llm.pretokens import Memo, byte_symbols, compiled, read_merges


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the adjacent pair of the lowest rank (leftmost of equals) is merged again and again: their number less the merges."""
    after, before, alive = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1)), list(symbols)
    end, merges = len(symbols), 0
    heap = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
    heapify(heap)
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if alive[i] is None or j >= end or (alive[i], alive[j]) != pair:
            continue  # one of the two has been merged since
        alive[i], alive[j] = alive[i] + alive[j], None
        after[i] = nxt = after[j]
        merges += 1
        if nxt < end:
            before[nxt] = i
            if (rank := ranks.get(fresh := (alive[i], alive[nxt]))) is not None:
                heappush(heap, (rank, i, fresh))
        if (prev := before[i]) >= 0 and (rank := ranks.get(fresh := (alive[prev], alive[i]))) is not None:
            heappush(heap, (rank, prev, fresh))
    return len(symbols) - merges


def token_counter(ranks: dict[tuple[str, str], int], added: list[str], pattern: str):
    """text -> number of tokens; added tokens inside the text count as one each, longest first."""
    symbol, split = byte_symbols(), compiled(pattern).findall
    memo = Memo(lambda piece: count_merged([symbol[b] for b in piece.encode()], ranks))
    cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def count(text: str) -> int:
        if cut is None or not cut.search(text):
            return sum(map(memo.__getitem__, split(text)))
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(memo.__getitem__, split(part))) for part in parts)

    return count


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, a row for each row.

    Counts by the merges of the byte-level ``tokenizer.json`` at ``path``: each match of
    ``pattern`` is merged by itself, added tokens inside a text count as one, no tokens are
    put around a text, and no identifiers are made. The merges (bounded by the vocabulary)
    are broadcast. Null counts as empty: no bytes, no tokens. A pre-token of n bytes, however
    long, costs n log n; a very long text is counted in one task, a batch by itself. Repeated rows
    are counted each, an empty table gives no rows. Extra columns are left out.
    """
    merges, added = read_merges(path)
    shared = docs.sparkSession.sparkContext.broadcast((merges, added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, special = shared.value
        count = token_counter({pair: rank for rank, pair in enumerate(pairs)}, special, pattern)
        for batch in slices(batches, "text"):
            n = [count(text) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
