"""Removal of byte strings that documents with smaller ids have as well, by suffix arrays."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import cut, split_likely, without
from kotonoha.llm.suffix import common_prefixes, merged, suffix_array

#: Bytes of a repeated string, and of the grams that stand for it.
LENGTH, GRAM = 50, 24

#: Bytes of text that are looked at together, and that a batch hands on together.
PIECE, BATCH = 1 << 18, 16 << 20

#: Bytes of text for a shard, at least so many shards.
SHARD_TEXT, LEAST_SHARDS = 2 << 20, 16

#: A gram with more places is common: its strings are dealt to shards by themselves.
COMMON = 4_000

#: Bits of the bitmap of shared grams: 16 for each, within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

LAST = np.iinfo(np.int64).max
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of each ``size`` bytes, put together from hashes of runs that double in length."""
    run, width, out, done = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B), 1, None, 0
    while True:
        if size & width:
            out = run[: len(data) - width + 1] if out is None else (out[: len(data) - done - width + 1] * np.uint32(0x27D4EB2F)) ^ run[done : len(data) - width + 1]
            done += width
        if width * 2 > size:
            return (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        run = run[:-width] * np.uint32(0xC2B2AE35) + (run[width:] ^ (run[width:] >> np.uint32(13)))
        width *= 2


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if have < width else out


class Strings:
    """The strings of ``length`` bytes in a run of texts, gathered by gram: each string goes by the gram in it with the least hash (the first of equal ones), wherever it occurs.

    ``at`` is where the gram begins, ``low`` and ``high`` where the first and the last string begin that go by it there.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int, gram: int):
        keyed = (gram_hashes(data, gram).astype(np.uint64) << np.uint64(32)) | np.arange(len(data) - gram + 1, dtype=np.uint64)
        best = (sliding_least(keyed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.ones(len(data) + 1, bool)
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            inside[max(start, end - length + 1) : end] = False
        begin = np.flatnonzero(inside[: len(best)])
        best = best[begin]
        new = np.ones(len(begin), bool)
        new[1:] = (best[1:] != best[:-1]) | (begin[1:] != begin[:-1] + 1)
        first = np.flatnonzero(new)
        self.at, self.low, self.high = best[first], begin[first], begin[np.append(first[1:], len(begin)) - 1] if len(begin) else begin
        words = data[self.at[:, None] + np.arange(gram)]
        words = np.concatenate([words, np.zeros((len(words), -gram % 8), np.uint8)], 1).view(np.uint64)
        self.hash = np.zeros(len(words), np.uint64)
        for k in range(words.shape[1]):
            self.hash = mixed(self.hash * _A + words[:, k] + _B)


def pieces_of(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, offset, bytes) of texts in pieces of PIECE bytes, each with the ``length`` - 1 bytes behind it, so that every string is in one piece; in order of doc_id."""
    ids, texts = batch.column("order").to_numpy(), batch.column("text")
    for row in np.argsort(ids, kind="stable"):
        body = (texts[int(row)].as_py() or "").encode()
        for offset in range(0, max(0, len(body) - length + 1), PIECE):
            yield int(row), offset, body[offset : offset + PIECE + length - 1]


def gathered(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Strings]]:
    """For pieces put together to about PIECE bytes: their bytes, starts, rows and offsets, and strings."""
    held: list[tuple[int, int, bytes]] = []
    for piece in [*pieces_of(batch, length), None]:
        if held and (piece is None or sum(len(p[2]) for p in held) + len(piece[2]) > PIECE + length):
            data = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
            ends = np.cumsum([len(p[2]) for p in held])
            yield data, np.r_[0, ends[:-1]], np.array([p[0] for p in held]), np.array([p[1] for p in held]), Strings(data, ends, length, gram)
            held = []
        if piece:
            held.append(piece)


def large_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        for i in range(len(sizes)):
            if total + sizes[i] - (sizes[start - 1] if start else 0) >= most:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
            total += sizes[-1] - (sizes[start - 1] if start else 0)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(*arrays: np.ndarray) -> bytes:
    parts = [a.tobytes() for a in arrays]
    return zstandard.compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts), 1)


def unpacked(blob: bytes, *kinds: np.dtype | str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def shared_grams(rows: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """(hash, common): the hashes of grams that more than one row has, and whether they have over COMMON places.

    Each batch hands on each gram once, with how often it occurs there and whether two of its
    rows have it, in a blob for each part of the hashes.
    """

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large_batches(batches, "text"):
            found = [(s.hash, rows[np.searchsorted(starts, s.at, "right") - 1]) for _, starts, rows, _, s in gathered(batch, length, gram)]
            if not found:
                continue
            h, row = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h)
            h, row = h[order], row[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n, several = np.diff(np.append(first, len(h))), np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
            h, n = h[first], np.minimum(n, COMMON + 1)
            part = (h >> np.uint64(32)).astype(np.int64) % shards
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(bounds))
            blobs = [packed(*(x[order[bounds[p] : bounds[p + 1]]] for x in (h, n.astype(np.uint16), several))) for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def count(table: pa.Table) -> pa.Table:
        h, n, several = (np.concatenate(x) for x in zip(*(unpacked(b, np.uint64, np.uint16, bool) for b in table["blob"].to_pylist()), strict=True))
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.append(first, len(h)))
        wanted = (size > 1) | np.logical_or.reduceat(several[order], first)
        total = np.add.reduceat(n[order].astype(np.int64), first)
        return pa.table({"hash": pa.array(h[first][wanted].view(np.int64)), "common": pa.array((total > COMMON)[wanted])})

    return rows.select("order", "text").mapInArrow(hand_on, "part int, blob binary").groupBy("part").applyInArrow(count, "hash long, common boolean")


def bitmap(hashes: DataFrame, n: int) -> np.ndarray:
    """A bitmap of at most MOST_BITS in which the places of ``n`` ``hashes`` are set; with more than it holds it lets more through, never fewer."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    place = F.pmod(F.col("hash"), F.lit(bits)) + 1
    made = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in made.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def marked_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def contexts(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> np.ndarray:
    """(n, width + 3) bytes: what the strings of each gram cover, with the gram always at one place and nothing around them, and behind it where the first and the last begin."""
    before, width = length - gram, 2 * length - gram
    column = np.arange(width)
    source = at[:, None] - before + column
    first, last = low - at + before, high - at + before
    held = (column >= first[:, None]) & (column < last[:, None] + length)
    out = np.zeros((len(at), width + 3), np.uint8)
    out[:, :width] = np.where(held, data[np.clip(source, 0, len(data) - 1)], 0)
    out[:, width], out[:, width + 1], out[:, width + 2] = first, last, 1
    return out


def as_strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as one string each, to be sorted and sought; the last byte of each isn't 0."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def merged_runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals sorted by their begin as those that they cover together."""
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]][: len(begin)])
    return begin[first], reach[np.append(first[1:], len(reach))[: len(first)] - 1]


def span_rows(ids: np.ndarray, null: np.ndarray, marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """(doc_id, mark, spans): a row for each document, with its intervals as pairs of 64-bit numbers."""
    order = np.lexsort((begin, marks, ids))
    ids, null, marks, begin, end = (x[order] for x in (ids, null, marks, begin, end))
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]) if len(ids) else np.zeros(0, np.int64)
    step = end.max(initial=0) + 1  # documents lie behind each other, so that no interval reaches into the next
    shift = np.repeat(np.arange(len(first)) * step, np.diff(np.append(first, len(ids))))
    begin, end = merged_runs(begin + shift, end + shift)
    number = begin // step
    pairs = np.ascontiguousarray(np.stack([begin - number * step, end - number * step], 1).astype(np.int64))
    offsets = np.append(np.searchsorted(number, np.arange(len(first))), len(number)).astype(np.int32) * 16
    spans = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pairs.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64(), mask=null[first]), pa.array(marks[first], pa.int64()), spans], names=["doc_id", "mark", "spans"])


SPANS = "doc_id long, mark long, spans binary"


def handed_on(shared, common, shards: int, length: int, gram: int):
    """Batches of texts -> for each shard what its grams' strings cover, different pieces once, with the documents that have them; and for each document what the batch already shows to be repeated. ``shared`` and ``common`` are broadcast bitmaps."""
    before, width = length - gram, 2 * length - gram

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in large_batches(batches, "text"):
            found = []
            for data, starts, row, offset, s in gathered(batch, length, gram):
                wanted = marked_in(shared.value, s.hash)
                at, low, high, h = s.at[wanted], s.low[wanted], s.high[wanted], s.hash[wanted]
                many = marked_in(common.value, h)
                each = np.where(many, high - low + 1, 1)
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                at, low, high, h, many = (np.repeat(x, each) for x in (at, low, high, h, many))
                low = low + step
                high = np.where(many, low, high)
                body = contexts(data, at, low, high, length, gram)
                piece = np.searchsorted(starts, at, "right") - 1
                if many.any():
                    by_string = h[many]
                    padded = np.concatenate([body[many], np.zeros((int(many.sum()), -body.shape[1] % 8), np.uint8)], 1).view(np.uint64)
                    for k in range(padded.shape[1]):
                        by_string = mixed(by_string * _A + padded[:, k] + _C)
                    h[many] = by_string
                found.append((as_strings(body), row[piece], offset[piece] + at - starts[piece] - before, (h >> np.uint64(32)).astype(np.int64) % shards))
            if not found:
                continue
            body, row, place, shard = (np.concatenate(x) for x in zip(*found, strict=True))
            ids, null, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("order", "null", "mark"))
            different, first, which = np.unique(body, return_index=True, return_inverse=True)  # rows come in order of doc_id, so the first has the least
            later = ids[row] > ids[row[first]][which]
            if later.any():  # repeated inside the batch
                edge = body[later].view(np.uint8).reshape(-1, width + 3)[:, width : width + 2].astype(np.int64)
                spans = span_rows(ids[row[later]], null[row[later]], marks[row[later]], place[later] + edge[:, 0], place[later] + edge[:, 1] + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.abs(spans.column("mark").to_numpy()) % shards, pa.int32()), pa.nulls(len(spans), pa.binary()), *spans.columns], names=["shard", "blob", "doc_id", "mark", "spans"])
            own = np.flatnonzero(~later)
            order = own[np.lexsort((which[own], shard[own]))]
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            full, blobs = np.flatnonzero(np.diff(bounds)), []
            for p in full:
                mine = order[bounds[p] : bounds[p + 1]]
                kinds, number = np.unique(which[mine], return_inverse=True)
                blobs.append(packed(different[kinds], number.astype(np.int32), ids[row[mine]], null[row[mine]], marks[row[mine]], place[mine]))
            none = len(full)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], names=["shard", "blob", "doc_id", "mark", "spans"])

    return hand_on


def settled(length: int, gram: int):
    """What came to a shard -> (doc_id, mark, spans) of its repeated strings."""
    before, width = length - gram, 2 * length - gram

    def settle(table: pa.Table) -> pa.Table:
        done = table.filter(pc.is_valid(table["spans"])).select(["doc_id", "mark", "spans"])
        blobs = [unpacked(b, f"S{width + 3}", np.int32, np.int64, bool, np.int64, np.int64) for b in table["blob"].to_pylist() if b is not None]
        if not blobs:
            return done
        lists = []
        for strings, number, ids, *_ in blobs:
            least = np.full(len(strings), LAST)
            np.minimum.at(least, number, ids)
            lists.append((strings, least))
        strings, least = merged(lists)
        rows = strings.view(np.uint8).reshape(-1, width + 3)
        first, last = rows[:, width].astype(np.int64), rows[:, width + 1].astype(np.int64)
        ordered, place = suffix_array(rows[:, :width], first, last, last + length)
        prefix = common_prefixes(rows[:, :width], first, last, last + length, ordered, place, length)
        begin = np.flatnonzero(prefix < length)
        group = np.minimum.reduceat(least[ordered // width], begin)
        smallest = np.full(len(rows) * width, LAST)
        smallest[ordered] = np.repeat(group, np.diff(np.append(begin, len(prefix))))
        smallest = smallest.reshape(-1, width)
        column = np.arange(before + 1)
        smallest = np.where((column >= first[:, None]) & (column <= last[:, None]), smallest[:, : before + 1], LAST)
        out = [done]
        for strings_, number, ids, null, marks, at in blobs:
            which = np.searchsorted(strings, strings_)[number]
            hit = smallest[which] < ids[:, None]
            entry, column_ = np.nonzero(hit)
            if len(entry):
                start = at[entry] + column_
                out.append(pa.Table.from_batches([span_rows(ids[entry], null[entry], marks[entry], start, start + length)]))
        return pa.concat_tables(out)

    return settle


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id long, text) -> doc_id, mark (hash of the text), spans: intervals of bytes that are covered by strings of ``length`` bytes which also begin in a document with a smaller doc_id (null is the largest). Several rows for one document may come.

    Every string goes by one of its grams (see ``Strings``), so equal strings go by equal ones,
    and only grams that several rows have matter. What their strings cover is sent to the shard
    of the gram, equal pieces of a batch once, with the least doc_id. A shard merges its
    batches' sorted lists by binary search, builds the suffix array of the different pieces with
    its common prefixes, and so learns for each string the least doc_id. Grams with very many
    places go to shards string by string. No shard's work grows with the number of copies of a
    text beyond one piece for each batch that has it.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(int(LAST))).alias("order"), F.col("doc_id").isNull().alias("null"), F.xxhash64("text").alias("mark"), "text").where(F.octet_length("text") >= length)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shards = max(LEAST_SHARDS, -(-size // SHARD_TEXT))
    grams = cut(shared_grams(rows, shards, length, gram), "grams")
    sums = grams.agg(F.count("*").alias("n"), F.count_if("common").alias("common")).first()
    sc = docs.sparkSession.sparkContext
    shared, common = sc.broadcast(bitmap(grams, sums.n)), sc.broadcast(bitmap(grams.where("common"), sums.common))

    handed = rows.mapInArrow(handed_on(shared, common, shards, length, gram), f"shard int, blob binary, {SPANS}")
    return handed.groupBy("shard").applyInArrow(settled(length, gram), SPANS)


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id long, text, more columns) with ``n_bytes``, ``n_removed`` (long), ``spans`` array<struct<begin, end>> and ``kept`` binary: the text's bytes less those covered by a string of ``length`` bytes that begins in a document with a smaller doc_id as well.

    A null text counts as empty; a null doc_id is the largest. Rows of one doc_id never remove
    from each other. Overlaps count, strings are judged on the input, and matches never cross
    texts; what is left may not be UTF-8. A very long text is looked at in pieces that overlap.
    Texts without repeats aren't moved. An empty table gives no rows; input columns of the
    added names are replaced.
    """
    kept_columns = without(docs, "n_bytes", "n_removed", "spans", "kept")
    found = cut(repeated_spans(docs, length, gram).groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("all_spans")), "spans")
    keyed = kept_columns.select(F.struct("*").alias("row"), F.col("doc_id").alias("r_id"), F.xxhash64("text").alias("r_mark")).withColumn("r_key", F.xxhash64("r_id", "r_mark"))
    wanted = found.select(F.xxhash64("doc_id", "mark").alias("r_key"))
    likely, others = split_likely(keyed, wanted, "r_key", found.count())
    met = likely.join(found.hint("merge"), F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_mark") == F.col("mark")), "left")
    bytes_of = F.coalesce(F.encode("row.text", "UTF-8"), F.lit(b""))
    kind = dict(kept_columns.dtypes)
    fields = ", ".join(f"`{c}` {kind[c]}" for c in kept_columns.columns)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, n = [], [], []
            for body, blobs in zip(batch.column("body").to_pylist(), batch.column("all_spans").to_pylist(), strict=True):
                pairs = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs or []] or [np.zeros((0, 2), np.int64)])
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                begin, end = merged_runs(pairs[:, 0], pairs[:, 1]) if len(pairs) else (pairs[:, 0], pairs[:, 1])
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                n.append(len(body))
            made = [pa.array(n, pa.int64()), pa.array([a - len(k) for a, k in zip(n, kept, strict=True)], pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "n_bytes", "n_removed", "spans", "kept"])

    cutting = met.select("row", bytes_of.alias("body"), "all_spans").mapInArrow(remove, f"row struct<{fields.replace('` ', '`: ')}>, n_bytes long, n_removed long, spans array<struct<begin: bigint, end: bigint>>, kept binary")
    whole = others.select("row", F.octet_length(bytes_of).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<begin: bigint, end: bigint>>").alias("spans"), bytes_of.alias("kept"))
    return cutting.unionByName(whole).select("row.*", "n_bytes", "n_removed", "spans", "kept")
