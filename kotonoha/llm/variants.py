"""Spelling variants: words one edit apart, found by Gram matrices of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import cut

#: Code points of a word, from A to z and from U+00C0 to U+00FF; least code points and occurrences of a word.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2

#: A form occurs so many times as often as its variant.
FORM_TIMES = 10

#: A word loses a letter where this divides the hash of its document and itself.
DAMAGE = 31

#: Words that one Gram matrix holds. Larger blocks are cut into parts of half as many, each pair of which is a tile.
TILE = 1024


def lowered(word: Column) -> Column:
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """``docs`` (doc_id, text) -> word, n: maximal runs of letters with only A-Z lowered, those of at least ``least_length`` code points that occur ``least`` times.

    Where ``damage`` divides the crc32 of ``<doc_id>:<run>`` the run loses one letter first (0:
    never). A null doc_id is written as nothing. Shorter runs are left out before rows are made
    of them; counts are partial before they meet.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run")).select("doc", lowered(F.col("run")).alias("run"))
    if damage:
        h = F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8"))
        at = (h % F.length("run")).cast("int")
        lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = words.select(F.when(h % damage == 0, lost).otherwise(F.col("run")).alias("run")).where(F.length("run") >= least_length)
    return words.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def blocks(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``words`` (word, n) -> m, block, side, word, n: a row for each place where a word may meet another.

    Of two words one edit apart, the shorter of ``m`` letters, either the first m // 2 letters are
    the same or the last m - m // 2. So each word goes to the blocks of its start and of its end,
    with words as long and with those one longer, and with those one shorter. A block of more
    than ``tile`` words is cut into parts, and each two of its parts are a block of their own, in
    which ``side`` tells the parts apart (and is the same for all in a block of one part).
    """
    length = F.length("word")
    places = []
    for longer in (0, 1):
        m = length - longer
        half = F.floor(m / 2).cast("int")
        for end, part in ((0, F.substring("word", F.lit(1), half)), (1, F.right("word", m - half))):
            places.append(F.struct(m.alias("m"), F.xxhash64(m, F.lit(end), part).alias("key")))
    placed = words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("p.m", "p.key", "word", "n")
    large = placed.groupBy("m", "key").agg(F.count("*").alias("size")).where(F.col("size") > tile).select("m", "key", F.ceil(F.col("size") * 2 / tile).cast("int").alias("parts"))
    dealt = placed.join(large, ["m", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    side = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    others = dealt.withColumn("side", side).select("m", "key", "word", "n", "side", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return others.select("m", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("block"), "side", (F.col("side") == F.col("other")).alias("own"), "word", "n")


def letter_counts(codes: np.ndarray, present: np.ndarray) -> np.ndarray:
    """How often each of the letters ``present`` occurs in each row of codes (0 is none), as floats in which all products are exact."""
    out = np.zeros((len(codes), len(present)), np.float32 if codes.shape[1] < 2_000 else np.float64)
    for j, letter in enumerate(present):
        out[:, j] = (codes == letter).sum(1)
    return out


def one_edit(a: np.ndarray, b: np.ndarray, m: int, longer: np.ndarray) -> np.ndarray:
    """For rows of codes, ``a`` of ``m`` letters and ``b`` as many or (``longer``) one more: whether one edit makes them equal."""
    same = a[:, :m] == b[:, :m]
    shifted = a[:, :m] == b[:, 1 : m + 1]
    before = np.where(same.all(1), m, np.argmin(same, 1))
    after = np.where(shifted.all(1), m, np.argmin(shifted[:, ::-1], 1))
    return np.where(longer, before + after >= m, (~same).sum(1) == 1)


def close_pairs(m: int, block: np.ndarray, side: np.ndarray, own: np.ndarray, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows, the first of ``m`` letters, whose words are one edit apart, by the Gram matrix of their letter counts.

    |x|^2 + |y|^2 - 2 xy is the squared distance of two counts: a replaced letter makes 2, an
    inserted or deleted one 1. Pairs that meet by their ends though their starts agree as well
    are told by both blocks; the caller removes repeats.
    """
    counts = letter_counts(codes, np.unique(codes[codes > 0]))
    norms = (counts * counts).sum(1)
    short = np.flatnonzero(length == m)
    distance = norms[short][:, None] + norms[None, :] - 2 * (counts[short] @ counts.T)
    wanted = np.where(length == m, 2, 1)[None, :] == distance
    wanted &= block[short][:, None] == block[None, :]
    i, j = np.nonzero(wanted)
    i = short[i]
    keep = ((side[i] != side[j]) | (own[i] & own[j])) & ((length[j] > m) | (i < j))
    i, j = i[keep], j[keep]
    good = one_edit(codes[i], codes[j], m, length[j] > m)
    return i[good], j[good]


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``words`` (word, n) -> word, other, n_other: both directions of each pair of words that one inserted, deleted or replaced code point makes equal.

    Rows of a block come together in one task, sorted; whole blocks up to ``tile`` rows share a
    Gram matrix, and no block has more than about as many rows.
    """
    placed = blocks(words, tile)
    sorted_blocks = placed.repartition("m", "block").sortWithinPartitions("m", "block")

    def pairs(m: int, table: pa.Table) -> pa.RecordBatch:
        texts, n = table["word"].to_pylist(), table["n"].to_numpy()
        raw = [t.encode("latin-1") for t in texts]
        length = np.array([len(r) for r in raw])
        codes = np.frombuffer(b"".join(r.ljust(m + 1, b"\0") for r in raw), np.uint8).reshape(len(raw), m + 1)
        i, j = close_pairs(m, table["block"].to_numpy(), table["side"].to_numpy(), table["own"].to_numpy(zero_copy_only=False), codes, length)
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        names = np.array(texts, object)
        return pa.RecordBatch.from_arrays([pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(n[b], pa.int64())], names=["word", "other", "n_other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(len(t) for t in held) < tile:
                continue
            table = pa.concat_tables(held).combine_chunks()
            last = _starts(table)[-1]  # of the block that may go on
            yield from (pairs(m, t) for m, t in _groups(table.slice(0, last), tile))
            held = [table.slice(last)]
        if held:
            yield from (pairs(m, t) for m, t in _groups(pa.concat_tables(held).combine_chunks(), tile))

    return sorted_blocks.mapInArrow(run, "word string, other string, n_other long").distinct()


def _starts(table: pa.Table) -> np.ndarray:
    """Where blocks begin in a sorted table of at least one row."""
    m, block = table["m"].to_numpy(), table["block"].to_numpy()
    return np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (block[1:] != block[:-1])])


def _groups(table: pa.Table, tile: int) -> Iterator[tuple[int, pa.Table]]:
    """Whole blocks of one length together, up to ``tile`` rows (and about 4 MB of letters), where one alone isn't larger; blocks of one row are left out."""
    if not len(table):
        return
    starts = _starts(table)
    sizes = np.diff(np.append(starts, len(table)))
    table, m = table.take(pa.array(np.flatnonzero(np.repeat(sizes > 1, sizes)))), table["m"].to_numpy()[starts[sizes > 1]]
    sizes = sizes[sizes > 1]
    at = first = 0
    for k in range(len(sizes)):
        rows = sizes[first:k].sum()
        if k > first and (m[k] != m[first] or (rows + sizes[k]) > min(tile, max(2, (4 << 20) // (m[first] + 1)))):
            yield int(m[first]), table.slice(at, rows)
            at, first = at + rows, k
    if len(sizes):
        yield int(m[first]), table.slice(at)


def roots_of(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) -> word, root: the last form that following forms leads to. Each round doubles the steps taken; counts grow tenfold with each step, so a few rounds do."""
    held = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = held.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = held.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = cut(after, "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        held = after.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, times: int = FORM_TIMES, damage: int = DAMAGE, tile: int = TILE) -> DataFrame:
    """``docs`` (doc_id, text) -> word, n, n_near, form, form_n, root: a row for each word of ``word_counts``.

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's
    form is its near word of largest count (the first in code-point order of several), if it
    occurs ``times`` times as often; its root is what following forms leads to, itself without one.
    Null and empty texts have no words; a run of any length is one word; repeated rows count
    each; an empty table gives no rows; other columns are not looked at. Pairs are found by the
    Gram matrices of letter counts in blocks of bounded size, so that no word's neighbours are
    missed and none are capped.
    """
    words = cut(word_counts(docs, least_length, least, damage), "words")
    best = F.min(F.struct((-F.col("n_other")).alias("m"), F.col("other").alias("w"))).alias("best")
    near = cut(near_words(words, tile).groupBy("word").agg(F.count("*").alias("n_near"), best), "near")
    known = words.join(near, "word", "left")
    formed = -F.col("best.m") >= F.col("n") * times
    named = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.w")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "named")
    roots = roots_of(named.where("form is not null"))
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
