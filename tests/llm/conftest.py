from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, SIZE string"

#: Nulls, empty and blank texts, repeated rows, ties, a long text, and columns that clash with results.
PROSE = "the cat sat on the mat and looked at the moon while the dog slept by the door of the old house near the river"
GERMAN = "der hund und die katze schlafen nicht im haus weil der alte mann mit dem kind über die straße geht"


def rows() -> list[tuple]:
    texts = [PROSE, PROSE.replace(" ", "  \t"), None, "", " \n\t ", PROSE, GERMAN, "日本語 テキスト 𠮷野家", "x" * 5000, "a b c", "1 2 3 !!", (PROSE + "\n") * 40, "<|endoftext|> and <|endoftext|>", "naïve café\r\n\r\nline  two"]
    langs = ["en", "en", "en", None, "en", "en", "de", "ja", "en", "en", None, "en", "en", "fr"]
    out = [(i, t, lang, ["s1", "s2", None][i % 3], None, i, "x", "y") for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return [*out, out[0], out[0], (None, PROSE, "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
