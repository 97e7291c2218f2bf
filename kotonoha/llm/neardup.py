"""Near-duplicate detection: BagMinHash signatures, banding, verified multiset overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.llm.common import WORD, cut, drop_special, likely_wanted, slices, unfolded
from kotonoha.llm.components import components

#: Words of a shingle, least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8

#: Bands and registers in each: two texts of similarity 0.8 meet in no band with probability (1 - 0.8 ** 6) ** 40 < 1e-5.
BANDS, ROWS = 40, 6

_word = re.compile(WORD)
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``size`` words; a text with fewer words is one shingle, one without words has none."""
    found = _word.findall(text or "")
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed((out ^ words[k : k + len(out)]) + _GOLDEN)
    return out


def counted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a list of multisets: element, multiplicity and owner, a row for each different element of each."""
    sizes = [len(h) for h in hashes]
    h, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), sizes)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))), owner[first]


def bag_minhash(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m): two multisets agree in a register with probability sum of minima over sum of maxima of their weights.

    Each unit of an element's weight has a Poisson process of unit rate whose points fall on a
    register at random; a register keeps its earliest point. Units are not enumerated: weights
    are cut into dyadic intervals [0, 1), [1, 2), [2, 4), ..., each with one process of the
    interval's rate, whose points carry a place in the interval; where the weight ends inside
    an interval, the points beyond it are left out. Points come in order of time, and a process
    stops once it is past the latest register of its multiset.
    """
    seeds, rates, limits, docs = [], [], [], []
    low, level = 0, 0
    while (inside := np.flatnonzero(weight > low)).size:
        rate = 1 if level == 0 else low
        seeds.append(mixed(element[inside] + np.uint64((level + 1) * int(_GOLDEN) % (1 << 64))))
        rates.append(np.full(len(inside), float(rate)))
        limits.append((weight[inside] - low).astype(float))
        docs.append(owner[inside])
        low, level = low + rate, level + 1
    registers, latest = np.full(n * m, np.inf), np.full(n, np.inf)
    if not seeds:
        return registers.reshape(n, m)
    seed, rate, limit, doc = map(np.concatenate, (seeds, rates, limits, docs))
    time, done, width = np.zeros(len(seed)), 0, 1
    while len(seed):
        numbers = (np.arange(done + 1, done + width + 1).astype(np.uint64) * _GOLDEN)[None, :]
        h = mixed(seed[:, None] + numbers)
        gap = -np.log1p(-((h >> np.uint64(11)).astype(float) * 2.0**-53)) / rate[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        other = mixed(h ^ _M1)
        place = (other & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * rate[:, None]
        row, column = np.nonzero((at < latest[doc][:, None]) & (place < limit[:, None]))
        target = doc[row] * m + (((other[row, column] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(registers, target, at[row, column])
        some = np.unique(doc)
        latest[some] = registers.reshape(n, m)[some].max(axis=1)
        time, done, width = at[:, -1], done + width, min(64, width * 2 if done else 1)
        live = time < latest[doc]
        seed, rate, limit, doc, time = seed[live], rate[live], limit[live], doc[live], time[live]
    return registers.reshape(n, m)


def band_hashes(registers: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands): a hash of each band's registers and the band's number."""
    bits = registers.view(np.uint64).reshape(len(registers), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1).astype(np.uint64) * _GOLDEN, bits.shape[:2])
    for k in range(bits.shape[2]):
        out = mixed((out ^ bits[:, :, k]) + _GOLDEN)
    return out


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, mark (hash of the text), w1 and w2 (128 bits of the sequence of words), n (shingles), bands array<long>; texts without words have null bands."""
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            words = [" ".join(_word.findall(t or "")) for t in texts]
            hashes = [shingles(t, size) for t in words]
            full = [i for i, h in enumerate(hashes) if len(h)]
            found: list[list[int] | None] = [None] * len(texts)
            if full:
                element, weight, owner = counted([hashes[i] for i in full])
                signed = band_hashes(bag_minhash(element, weight, owner, len(full), bands * rows), bands).view(np.int64)
                for i, row in zip(full, signed, strict=True):
                    found[i] = row
            digests = [xxhash.xxh3_128_intdigest(w) for w in words]
            halves = [pa.array(np.array([d >> s & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64)) for s in (64, 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *halves, pa.array([len(h) for h in hashes], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "mark", "w1", "w2", "n", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, mark long, w1 long, w2 long, n long, bands array<long>")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two multisets of hashes."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / max(1, len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``pairs`` (a, b) of ids in ``texts`` (id, text) -> a, b, similarity, by the shingles of both whole texts. A text many pairs share is a skewed key of a plain join, which AQE splits."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for batch in slices(batches, "text_a", 1 << 20):
            out = []
            for b, one, two in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b")), strict=True):
                if b != last:
                    last, known = b, shingles(two, size)
                out.append(overlap(shingles(one, size), known))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def elements(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``texts`` (id, text) -> (id, element): a hash for each shingle and number of its occurrence, so that multisets become sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            ids, found = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = np.sort(shingles(text, size))
                first = np.searchsorted(h, h)
                found.append(mixed(h + (np.arange(len(h)) - first).astype(np.uint64) * _GOLDEN))
                ids.append(np.full(len(h), i, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found).view(np.int64))], names=["id", "element"])

    return texts.select("id", "text").mapInArrow(run, "id long, element long")


#: Texts under one shared shingle that meet one copy of the shorter texts under it.
SALT_TEXTS = 2_000


def possible_links(texts: DataFrame, known: DataFrame, similarity: float, size: int) -> DataFrame:
    """Pairs (a, b) of different roots among ``known`` (id, n, root) that may be linked: all that are, and few others.

    In one order of all elements, rarest first, two texts with an overlap of at least o share an
    element among the first n - o + 1 of each. What o is at least follows for the shorter of the
    two from its own length and the same length again, for the longer one from its own. So each
    text is entered under the elements that it may share with texts as long or longer, and sought
    under those (a few more) that it may share with shorter ones; an element of one text, and one
    whose texts have all one root, joins nothing. What all texts made from one template share is
    among the first elements only of texts that differ in less than they need to be linked by it,
    so texts that stay apart don't meet on it. The seekers of an element that many
    share are dealt to several tasks.
    """
    least = lambda share: F.ceil(F.col("n") * share - 1e-9)
    every = elements(texts, size)
    counts = every.groupBy("element").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = every.join(counts, "element").withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("texts", "element"))).withColumn("common", F.count("*").over(W.partitionBy("id")))
    placed = shared.join(known, "id").select("id", "element", "n", "root", (F.col("place") + F.col("n") - F.col("common")).alias("place"))
    heads = cut(placed.where(F.col("place") <= F.col("n") - least(similarity) + 1).withColumn("entered", F.col("place") <= F.col("n") - least(2 * similarity / (1 + similarity)) + 1), "heads")
    met = heads.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("entered").alias("any"), F.count("*").alias("texts"))
    salted = met.where("lo < hi and any").select("element", F.ceil(F.col("texts") / SALT_TEXTS).cast("long").alias("salts"))
    named = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "root", "place")]
    short = heads.where("entered").join(salted, "element").select("element", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *named("a"))
    long = heads.join(salted, "element").select("element", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), *named("b"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-9)
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    near = (F.col("place_a") <= F.col("n_a") - need + 1) & (F.col("place_b") <= F.col("n_b") - need + 1)
    pairs = short.join(long, ["element", "salt"]).where(ordered & (F.col("root_a") != F.col("root_b")) & near)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id long, text) -> doc_id, mark, class_id, class_size, kept, near_id, a row for each row.

    Texts are linked if the multisets of their shingles of ``size`` words overlap by
    ``similarity`` or more; classes are what links connect, and ``class_id`` is a class's
    smallest doc_id. Texts with the same words are one class from the start, and one of them
    stands for all. In each bucket of a band all texts are compared with one of them, the one
    that meets most others over all bands. Texts of one bucket that then are in different
    classes may still be linked; which ones can be follows from their rarest shingles, and
    those are compared as well. So no candidate pair is left open, and groups of near copies
    don't unfold into all pairs. ``kept`` is true for one row of each class: of its smallest
    doc_id, of several texts of that id the one with the least hash, of equal rows the first.
    ``near_id`` is the doc_id of a text that ties a row to its class: the one with the same words
    that stands for them, else the smallest one linked to it; null without any.

    Different texts of one doc_id are texts of their own: those that stand for their words go by a
    hash of the words until classes are made, and their classes may have the same class_id.
    Repeated rows are of one class. Rows without words (null, empty) or without a doc_id are
    classes of their own each, of size 1. A very long text is hashed whole; an empty table gives
    no rows; other columns are not looked at. Only texts that a pair names are moved.
    """
    signed = cut(signatures(docs, size, bands, rows), "signatures")
    known = signed.where("doc_id is not null and n > 0")
    one = F.min(F.struct("doc_id", "mark")).alias("r")
    same = cut(known.groupBy("w1", "w2").agg(one, F.count("*").alias("members"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("w1", "w2", F.col("r.doc_id").alias("id"), F.col("r.mark").alias("mark"), "members", "n", "bands"), "representatives")
    repeated = cut(same.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select("id"), "repeated")
    same = same.withColumn("doc_id", F.col("id"))
    if not repeated.isEmpty():
        own = same.join(repeated.withColumn("again", F.lit(True)), "id", "left")
        same = cut(own.withColumn("id", F.when(F.col("again"), F.xxhash64("w1", "w2")).otherwise(F.col("id"))).drop("again"), "representatives")

    buckets = same.select("id", "n", F.explode("bands").alias("bucket"))
    filled = cut(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    shared = cut(likely_wanted(buckets, filled, "bucket", filled.count()).join(filled, "bucket"), "shared")
    central = shared.groupBy("id").agg(F.sum("members").alias("met"))
    firsts = shared.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("first"))
    members = cut(shared.join(firsts, "bucket").select("bucket", "first", "id", "n"), "members")
    pairs = cut(members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    named = cut(same.join(needed, "id", "left_semi").select("id", "doc_id", "mark", F.xxhash64("doc_id", "mark").alias("key")), "named")
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").withColumn("key", F.xxhash64("doc_id", "mark"))
    wanted = cut(likely_wanted(texts, named, "key", named.count()).join(named, ["key", "doc_id", "mark"]).dropDuplicates(["id"]).select("id", "text"), "texts")
    checked = cut(verified(pairs, wanted, size).where(F.col("similarity") >= similarity).select("a", "b"), "checked")
    roots = components(checked)

    placed = members.join(roots.withColumnRenamed("root", "found"), "id", "left").withColumn("root", F.coalesce("found", "id")).drop("found")
    mixed_buckets = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    unsettled = cut(placed.join(mixed_buckets, "bucket", "left_semi").select("id", "n", "root").distinct(), "unsettled")
    others = cut(possible_links(wanted.join(unsettled.select("id"), "id", "left_semi"), unsettled, similarity, size), "others")
    more = cut(verified(others, wanted, size).where(F.col("similarity") >= similarity).select("a", "b"), "more")
    links = checked.unionByName(more)
    if not more.isEmpty():
        roots = components(links)

    both_ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied = both_ways.join(same.select(F.col("id").alias("b"), F.col("doc_id").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
    rooted = cut(same.join(roots, "id", "left").join(tied, F.col("id") == F.col("a"), "left").select("w1", "w2", F.coalesce("root", "id").alias("root"), "doc_id", "mark", "members", "other"), "rooted")
    classes = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("kept"), F.sum("members").alias("class_size"))
    classed = rooted.join(classes, "root").select("w1", "w2", F.col("doc_id").alias("one_id"), F.col("mark").alias("one_mark"), "other", "kept", "class_size")
    own = (F.col("doc_id") == F.col("one_id")) & (F.col("mark") == F.col("one_mark"))
    first = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("mark") == F.col("kept.mark")) & (F.col("copy") == 1)
    counted = unfolded(known.groupBy("doc_id", "mark", "w1", "w2").agg(F.count("*").alias("copies")), "copies", "copy")
    near = F.when(~own, F.col("one_id")).otherwise(F.col("other")).alias("near_id")
    worded = counted.join(classed, ["w1", "w2"]).select("doc_id", "mark", F.col("kept.doc_id").alias("class_id"), "class_size", first.alias("kept"), near)
    alone = signed.where("doc_id is null or n = 0").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("near_id"))
    return worded.unionByName(alone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more columns) that stay: one of each class of ``near_classes``.

    That is the row with the smallest doc_id, of several texts of that id the one with the least
    hash, of rows equal in both any one. Rows without a doc_id or without words all stay; very
    long texts are compared whole; an empty table gives no rows; all columns stay. Only rows that
    may have to go, or that are repeated, are moved.
    """
    classes = near_classes(docs.select("doc_id", "text")).where("doc_id is not null")
    states = classes.groupBy("doc_id", "mark").agg(F.max("kept").alias("keep"), F.count("*").alias("rows"), F.max("class_size").alias("class_size"))
    special = states.where("class_size > 1 and (not keep or rows > 1)").select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), "keep", F.xxhash64("doc_id", "mark").alias("key"))
    return drop_special(docs, F.xxhash64("text"), cut(special, "near"))
