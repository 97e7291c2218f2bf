"""Quality rules by bands of zstandard compression ratios."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from kotonoha.llm.common import WORD, slices

#: Compressed size over size of a text or chunk (UTF-8), by its number of bytes: lowest and highest
#: ratio that passes; between two lines of the table, along the logarithm of the bytes. Set on a
#: sample: of the rows of sf0.1 labelled good that pass the base rule those with an even crc32 of
#: doc_id's digits (1,652); 0.01 under the least and 0.03 over the highest ratio among texts within
#: a quarter of that length; up to 400 bytes among the first and last bytes of such texts as well,
#: the last two lines on such texts joined. The other rows check it.
LIMITS = (
    (100, 0.720, 1.120), (140, 0.676, 0.980), (200, 0.625, 0.870), (250, 0.594, 0.838), (300, 0.583, 0.837), (400, 0.544, 0.782),
    (550, 0.530, 0.738), (750, 0.506, 0.671), (1_000, 0.494, 0.637), (1_400, 0.473, 0.610), (2_000, 0.460, 0.573), (2_800, 0.443, 0.540), (4_096, 0.430, 0.518),
    (5_600, 0.426, 0.496), (8_192, 0.417, 0.484), (11_500, 0.410, 0.477), (16_384, 0.404, 0.468), (23_000, 0.404, 0.458), (131_072, 0.369, 0.455), (1_048_576, 0.356, 0.450),
)

#: Shorter texts have no limits: they have little to repeat and carry the frame's overhead.
LEAST = 100

#: Chunks of so many bytes, a rest under LEAST joined to the last; a text fails if more than this
#: share of its chunks lies outside the limits of their length.
CHUNK, CHUNK_SHARE = 4_096, 0.2

LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_lowest, _highest = (np.array([x[k] for x in LIMITS]) for k in (1, 2))
_bytes = np.log([x[0] for x in LIMITS])
_word, _symbol = re.compile(WORD), re.compile(r"[#*$%&|<>]")


def ratio_of(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    return len(compressor.compress(data)) / max(1, len(data))


def within_limits(ratio: float, n: int) -> bool:
    """Whether a ratio passes for a text of ``n`` bytes."""
    if n < LEAST:
        return True
    at = math.log(n)
    return float(np.interp(at, _bytes, _lowest)) <= ratio <= float(np.interp(at, _bytes, _highest))


def chunks(data: bytes) -> list[bytes]:
    """All of ``data`` in order, in pieces of CHUNK bytes; a rest under LEAST stays with the piece before it."""
    starts = list(range(0, len(data), CHUNK)) or [0]
    if len(starts) > 1 and len(data) - starts[-1] < LEAST:
        starts.pop()
    return [data[i:j] for i, j in zip(starts, [*starts[1:], len(data)], strict=True)]


def within_bands(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of chunks outside their limits, and whether the text passes."""
    ratio = ratio_of(data, compressor)
    passes, parts = within_limits(ratio, len(data)), chunks(data)
    if len(parts) == 1:
        return ratio, float(not passes), passes
    share = sum(not within_limits(ratio_of(x, compressor), len(x)) for x in parts) / len(parts)
    return ratio, share, passes and share <= CHUNK_SHARE


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _word.search(x)]
    return len(lines) - len(set(lines))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in slices(batches, "text"):
        out: list[tuple] = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            words = _word.findall(text)
            repeats = repeated_words(words)
            failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
            ratio, share, passes = within_bands(text.encode(), compressor)
            out.append((len(words), sum(map(len, words)), len(_symbol.findall(text)), repeated_lines(text), repeats, ratio, share, failed, passes and not failed))
        ids = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*ids, *[pa.array(x) for x in zip(*out)]], names=[*names, *COLUMNS])


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "ratio": "double", "odd_chunks": "double", "base_failed": "boolean", "kept": "boolean"}


def judge_quality(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, the base counts, the compression figures and ``kept``, a row for each row.

    ``ratio`` is compressed over plain bytes of the whole text, ``odd_chunks`` the share of its
    chunks outside the limits of their length. A text is kept if it passes the base rule, its
    ratio is within the limits of its length, and at most CHUNK_SHARE of its chunks are odd.
    Null and empty texts have no words, so they fail the base rule. A very long text is judged
    whole in one task, a batch by itself, in time that grows with its length. Repeated rows are
    judged each, an empty table gives no rows. Extra columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_judge, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))
