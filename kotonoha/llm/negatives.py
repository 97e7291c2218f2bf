"""Hard negatives by an inverted multi-index: exact search that stops once its windows are certified."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.llm.common import cut

#: Rows whose id this divides are anchors; positives of an anchor, negatives of a positive.
ANCHORS, POSITIVES, NEGATIVES = 100, 5, 5

#: A negative's score is at least so many hundredths of the positive's, and no more than it.
LOW, HIGH = 80, 100

#: Rows that the codebooks are fitted on (those with the least hashes of their ids), words of each codebook, rounds of the fit.
SAMPLE, WORDS, ROUNDS = 4_096, 16, 12

#: Components beyond this in size count as this, so that scores of vectors of some tens of components fit in 64 bits.
LARGEST = 1 << 20

#: Rows of a shard, at least so many shards, rows that are scored together.
SHARD_ROWS, LEAST_SHARDS, CHUNK = 16_384, 12, 512


def whole(vector: Column) -> Column:
    """Components as the whole numbers floor(256 * x); null where the vector or a component is null or no finite number."""
    good = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    held = lambda x: F.greatest(F.least(x.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.when(good, F.transform(vector, lambda x: F.floor(held(x) * 256).cast("long")))


def codebook(half: np.ndarray, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``words`` groups of rows by Lloyd's rounds, from evenly spaced rows on."""
    centres = half[np.linspace(0, len(half) - 1, min(words, len(half))).astype(int)].astype(float)
    for _ in range(rounds):
        near = nearest(half, centres)
        for k in np.unique(near):
            centres[k] = half[near == k].mean(0)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(half @ centres.T - (centres * centres).sum(1) / 2, axis=1)


class MultiIndex:
    """The rows of a shard in cells: for each half of the components a codebook, a cell for each pair of words.

    A row's score with a query is at most, for each half, the query's product with the row's
    word and the query's length times the word's radius, the greatest distance of its rows.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, centres: tuple[np.ndarray, np.ndarray]):
        self.middle = vectors.shape[1] // 2
        self.centres, halves = centres, (vectors[:, : self.middle], vectors[:, self.middle :])
        codes = [nearest(half.astype(float), c) for half, c in zip(halves, centres, strict=True)]
        self.radii = []
        for half, c, code in zip(halves, centres, codes, strict=True):
            radius = np.full(len(c), -np.inf)  # a word without rows
            np.maximum.at(radius, code, np.sqrt(((half - c[code]) ** 2).sum(1)))
            self.radii.append(radius)
        cell = codes[0] * len(centres[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.vectors, self.ids, self.labels = vectors[order], ids[order], labels[order]
        self.bounds = np.searchsorted(cell[order], np.arange(len(centres[0]) * len(centres[1]) + 1))
        self.exact = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2**53
        self.fast = self.vectors.astype(float) if self.exact else None

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact and float(np.abs(query).max(initial=0)) * float(np.abs(self.vectors[rows]).max(initial=0)) * len(query) < 2**53:
            return (self.fast[rows] @ query.astype(float)).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(query, v)) for v in self.vectors[rows]], np.int64)

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of all cells with rows, the greatest bound first: a heap walks the pairs of the two lists of words, each sorted by its own bound."""
        lists, slack = [], 1e-3  # so that rounding never lowers a bound
        for part, c, radius in zip((query[: self.middle], query[self.middle :]), self.centres, self.radii, strict=True):
            part = part.astype(float)
            norm, full = np.sqrt((part * part).sum()), np.flatnonzero(radius > -np.inf)
            bound = c @ part + norm * radius
            slack += 1e-9 * norm * (np.abs(c).max(initial=0) * len(part) + radius[full].max(initial=0))
            order = full[np.argsort(-bound[full], kind="stable")]
            lists.append((bound[order].tolist(), order.tolist()))
        (one, first), (two, second) = lists
        if not one or not two:
            return
        width = len(self.centres[1])
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = first[i] * width + second[j]
            if self.bounds[cell] < self.bounds[cell + 1]:
                yield slack - bound, cell
            if j + 1 < len(two):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))

    def best(self, query: np.ndarray, wanted, windows: list[tuple[int, int]], most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (low, high) of scores the ids and scores of its first ``most`` rows among the ``wanted`` (a function of rows), greatest score first, ties by id; and the number of cells visited.

        Ends when each window has as many rows at or above every cell's bound that is left, or the bounds are below the window.
        """
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        need = [low for low, _ in windows]  # scores under this can't matter any more
        visited, waiting, size = 0, [], 0

        def score() -> None:
            rows = np.concatenate([np.arange(self.bounds[c], self.bounds[c + 1]) for c in waiting])
            rows = rows[wanted(rows)]
            got = self.scores(query, rows)
            for k, (low, high) in enumerate(windows):
                inside = (got >= max(low, need[k])) & (got <= high)
                ids, scores = np.append(held[k][0], self.ids[rows[inside]]), np.append(held[k][1], got[inside])
                order = np.lexsort((ids, -scores))[:most]
                held[k] = ids[order], scores[order]
                if len(order) == most:
                    need[k] = int(held[k][1][-1])

        for bound, cell in self.cells(query):
            if bound < min(need):
                break
            waiting.append(cell)
            size += int(self.bounds[cell + 1] - self.bounds[cell])
            visited += 1
            if size >= CHUNK:
                score()
                waiting, size = [], 0
        if waiting:
            score()
        return held, visited


def _searched(rows: DataFrame, queries: DataFrame, shards: int, width: int, centres: tuple[np.ndarray, np.ndarray], ask, schema: str) -> DataFrame:
    """Each query in each shard of rows. A shard's rows come first and are held, its queries then stream by. ``ask(index, query)`` gives tuples."""
    none = lambda kind: F.lit(None).cast(kind)
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "label", "vector", none("long").alias("mark"), none("array<long>").alias("windows"))
    asking = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "label", "vector", "mark", "windows")
    together = held.unionByName(asking).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "vec_id")
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.int64()] * len(names)

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column("vector")
        if pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
            return column.flatten().to_numpy().reshape(-1, width)
        found = np.zeros((len(batch), width), np.int64)
        for i, v in enumerate(batch.column("vector").to_pylist()):
            found[i, : len(v)] = v
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, kept = None, None, []
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                if numbers[a] != shard:
                    shard, index, kept = numbers[a], None, []
                part = batch.slice(a, b - a)
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                mine = part.filter(pa.array(~asks))
                if len(mine):
                    kept.append((vectors(mine), mine.column("vec_id").to_numpy(), mine.column("label").to_numpy()))
                asked = part.filter(pa.array(asks))
                if not len(asked) or not kept:
                    continue
                if index is None:
                    vs, ids, labels = (np.concatenate(x) for x in zip(*kept, strict=True))
                    _, once = np.unique(np.column_stack([vs, ids, labels]), axis=0, return_index=True)  # repeated rows count once
                    index = MultiIndex(vs[once], ids[once], labels[once], centres)
                out = []
                for q, i, label, mark, windows in zip(vectors(asked), *(asked.column(c).to_pylist() for c in ("vec_id", "label", "mark", "windows")), strict=True):
                    out += ask(index, q, i, label, mark, windows)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)

    return together.mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchors: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` (vec_id long, label, vector of numbers) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x); a score is the whole-number product with the anchor, greater
    ones first, ties by smaller vec_id. Rows whose vec_id ``anchors`` divides are anchors; an
    anchor's positives are its first other rows of the same label, and each positive's negatives
    the first rows of other labels that score from ``low`` to ``high`` hundredths of it.

    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part; a
    vector shorter than others has zeros behind it; components beyond LARGEST count as that. Rows equal in all three count once; different
    rows of one id are rows of their own, and none is a positive of itself or of its id. An empty
    table gives no rows; other columns are not looked at.

    Rows are dealt to shards by a hash of their id, so that equal vectors spread; every shard has
    an inverted multi-index with codebooks of a bounded sample and its own radii, and every anchor
    asks every shard. The searches are exact: they stop only where no cell left can change them.
    """
    clean = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("vector")).alias("vector")).where("vec_id is not null and label is not null and vector is not null"), "vectors")
    size = clean.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    schema = "anchor_id long, mark long, positive_id long, positive_score long"
    if not size.n or size.width < 2:
        clean, width = clean.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), 2))), size.width + 2
    else:
        width = size.width
    shards = max(LEAST_SHARDS, -(-size.n // shard_rows))
    sample = [r.vector + [0] * (width - len(r.vector)) for r in clean.select("vector", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()]
    fitted = np.array(sample or [[0] * width], float)
    centres = codebook(fitted[:, : width // 2], WORDS), codebook(fitted[:, width // 2 :], WORDS)

    asked = clean.where(F.col("vec_id") % anchors == 0).distinct().withColumn("mark", F.xxhash64("label", "vector"))
    least = -(1 << 62)

    def first_positives(index: MultiIndex, q: np.ndarray, i: int, label: int, mark: int, windows) -> list[tuple]:
        [(ids, scores)], _ = index.best(q, lambda r: (index.labels[r] == label) & (index.ids[r] != i), [(least, -least)], positives)
        return [(i, mark, int(a), int(s)) for a, s in zip(ids, scores, strict=True)]

    place = lambda *key, score, by: F.row_number().over(W.partitionBy(*key).orderBy(F.col(score).desc(), by))
    near = _searched(clean, asked.withColumn("windows", F.lit(None).cast("array<long>")), shards, width, centres, first_positives, schema)
    found = cut(near.withColumn("k", place("anchor_id", "mark", score="positive_score", by="positive_id")).where(F.col("k") <= positives).drop("k"), "positives")
    scores = found.groupBy("anchor_id", "mark").agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))
    again = asked.join(scores, (F.col("vec_id") == F.col("anchor_id")) & (asked.mark == scores.mark)).select("vec_id", "label", "vector", asked.mark, "windows")

    def first_negatives(index: MultiIndex, q: np.ndarray, i: int, label: int, mark: int, windows: list[int]) -> list[tuple]:
        # 100 * score in low * p .. high * p, as whole numbers
        ranges = [(-(-low * p // 100), high * p // 100) for p in windows]
        held, _ = index.best(q, lambda r: index.labels[r] != label, ranges, negatives)
        return [(i, mark, p, int(a), int(s)) for p, (ids, scores) in zip(windows, held, strict=True) for a, s in zip(ids, scores, strict=True)]

    far = _searched(clean, again, shards, width, centres, first_negatives, "a_id long, a_mark long, p_score long, negative_id long, negative_score long")
    ranked = far.withColumn("rank", place("a_id", "a_mark", "p_score", score="negative_score", by="negative_id")).where(F.col("rank") <= negatives)
    met = found.join(ranked, (F.col("anchor_id") == F.col("a_id")) & (F.col("mark") == F.col("a_mark")) & (F.col("positive_score") == F.col("p_score")))
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
