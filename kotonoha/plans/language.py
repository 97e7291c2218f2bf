"""A language: what counts as worth looking up, its preprocessors, and its rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions import readings
from kotonoha.functions import text as T
from kotonoha.plans.rules import Rule, japanese_rules


@dataclass(frozen=True)
class Preprocessor:
    """Ways to write a text; ``forms`` are tried beside the text as it is."""

    name: str
    forms: Sequence[Callable[[Column], Column]]


@dataclass(frozen=True)
class Language:
    code: str
    worthy: Callable[[Column], Column]
    preprocessors: Sequence[Preprocessor]
    rules: list[Rule] = field(default_factory=list)


JAPANESE = Language(
    "ja",
    T.is_partially_japanese,
    [
        Preprocessor("half width kana to full width", [T.halfwidth_kana_to_full]),
        Preprocessor("Latin letters to kana", [readings.alphabetic_to_kana]),
        Preprocessor("combining marks", [T.normalize_combining]),
        Preprocessor("compatibility characters", [T.normalize_compatibility]),
        Preprocessor("radicals", [T.normalize_radicals]),
        Preprocessor("width of Latin letters", [T.to_halfwidth_alnum, T.to_fullwidth_alnum]),
        Preprocessor("hiragana and katakana", [T.hiragana_to_katakana, T.katakana_to_hiragana]),
        Preprocessor("emphatic repetition", [T.collapse_emphatic, lambda c: T.collapse_emphatic(c, full=True)]),
    ],
    japanese_rules(),
)


def text_variants(df: DataFrame, column: str, preprocessors: Sequence[Preprocessor]) -> DataFrame:
    """Distinct texts in ``column`` -> (text, variant_no, variant): the text and all that the preprocessors make of it, each applied to the variants so far; of equal variants the first stays.

    Variants are merged after each preprocessor, so their number follows the different
    results, not the product of the options. A preprocessor's forms run on exploded rows, where
    Python forms work on batches.
    """
    rows = df.select(F.col(column).alias("text")).where("text is not null").distinct().withColumns({"variant": F.col("text"), "order": F.array().cast("array<int>")})
    for p in preprocessors:
        forms = F.array(F.col("variant"), *[f(F.col("variant")) for f in p.forms])
        opened = rows.withColumn("forms", forms).select("text", "order", F.posexplode(F.array_distinct("forms")).alias("i", "variant"))
        rows = opened.groupBy("text", "variant").agg(F.min(F.concat("order", F.array("i"))).alias("order"))
    listed = rows.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("order", "variant"))).alias("v"))
    return listed.select("text", F.posexplode("v.variant").alias("variant_no", "variant"))
