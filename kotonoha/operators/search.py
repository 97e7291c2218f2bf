"""Search in dictionary tables and joins of its results with metadata and tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.functions.scratch import scratch
from kotonoha.functions.structured import structured_html
from kotonoha.plans.deinflect import deinflect
from kotonoha.plans.rules import Rule

MODES = ("exact", "prefix", "suffix", "contains")

#: Parts in which all terms meet an empty query.
SPREAD = 64


def matches(column: Column, query: Column | str, mode: str = "exact", like_compat: bool = False) -> Column:
    """The condition of one search. ``prefix`` means that the text ends with the query, ``suffix`` that it starts with it.

    With ``like_compat`` the query is a LIKE pattern (``%`` and ``_`` match any text and any
    character) and ASCII letters match in either case.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    q = F.lit(query) if isinstance(query, str) else query
    if not like_compat or mode == "exact":
        return {"exact": column == q, "prefix": F.endswith(column, q), "suffix": F.startswith(column, q), "contains": F.contains(column, q)}[mode]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = lambda c: F.translate(c, upper, lower)
    pattern = F.concat(F.lit("" if mode == "suffix" else "%"), folded(q), F.lit("" if mode == "prefix" else "%"))
    return F.like(folded(column), pattern, F.lit("\x01"))


def search(df: DataFrame, column: str, query: str, mode: str = "exact", dictionaries: Sequence[str] = (), like_compat: bool = False) -> DataFrame:
    """Rows whose ``column`` matches; with ``dictionaries`` only theirs. Both conditions reach the scan."""
    found = df.where(matches(F.col(column), query, mode, like_compat))
    return found.where(F.col("dictionary").isin(*dictionaries)) if dictionaries else found


def search_by_sequence(terms: DataFrame, number: int, dictionaries: Sequence[str] = ()) -> DataFrame:
    found = terms.where(F.col("sequence_number") == number)
    return found.where(F.col("dictionary").isin(*dictionaries)) if dictionaries else found


def search_term_meta(meta: DataFrame, term: str, dictionaries: Sequence[str] = ()) -> DataFrame:
    return search(meta, "term", term, "exact", dictionaries)


def search_kanji(kanji: DataFrame, query: str, mode: str = "exact", dictionaries: Sequence[str] = (), column: str = "kanji") -> DataFrame:
    return search(kanji, column, query, mode, dictionaries)


def search_tags(tags: DataFrame, query: str, mode: str = "exact", dictionaries: Sequence[str] = (), column: str = "tag") -> DataFrame:
    return search(tags, column, query, mode, dictionaries)


def count_dictionaries(dictionaries: DataFrame) -> DataFrame:
    return dictionaries.agg(F.count_distinct("title").alias("n"))


def imported_dictionaries(dictionaries: DataFrame) -> DataFrame:
    return dictionaries.select("title").distinct()


def is_imported(dictionaries: DataFrame, title: str) -> bool:
    return not dictionaries.where(F.col("title") == title).isEmpty()


def are_imported(dictionaries: DataFrame, titles: DataFrame) -> DataFrame:
    """``titles`` (title, ...) with ``imported``: whether there is such a dictionary."""
    known = dictionaries.select("title").distinct().withColumn("imported", F.lit(True))
    return titles.join(known, "title", "left").withColumn("imported", F.coalesce("imported", F.lit(False)))


def new_dictionaries(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose title is not among the existing ones."""
    return incoming.join(existing.select("title").distinct(), "title", "left_anti")


def batch_lookup(queries: DataFrame, terms: DataFrame, mode: str = "exact", key: str = "candidate", least: int = 3) -> DataFrame:
    """Each row of ``queries`` with each row of ``terms`` that its ``key`` finds; null finds nothing.

    ``exact`` is an equi-join. The others are made one equi-join on the first (``suffix``) or last
    (``prefix``) ``least`` characters, or (``contains``) on the query's first ones against all runs
    of as many in the term; a shorter query has as many characters as it is long, so terms have
    keys of each size. The full condition then decides. An empty query, which all terms match,
    meets them in SPREAD parts.
    """
    if mode == "exact":
        return queries.join(terms, F.col(key) == F.col("term"))
    end = F.right if mode == "prefix" else F.left

    def keys(n: int) -> Column:
        size = F.lit(n)
        if mode == "contains":
            starts = F.sequence(F.lit(1), F.greatest(F.length("term") - n + 1, F.lit(1)))
            found = F.array_distinct(F.transform(starts, lambda i: F.substr("term", i, size)))
        else:
            found = F.array(end("term", size))
        return F.transform(found, lambda k: F.struct(size.alias("n"), k.alias("k")))

    size = F.least(F.length(key), F.lit(least))
    parts = F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: i.cast("string"))
    part = F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("string")
    asked = queries.where(F.col(key).isNotNull()).withColumns({"_n": size, "_k": F.explode(F.when(size == 0, parts).otherwise(F.array(end(F.col(key), size))))})
    keyed = terms.where("term is not null").withColumn("_run", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("n"), part.alias("k"))), *map(keys, range(1, least + 1)))))
    met = asked.join(keyed, (F.col("_n") == F.col("_run.n")) & (F.col("_k") == F.col("_run.k")))
    return met.where(matches(F.col("term"), F.col(key), mode)).drop("_n", "_k", "_run")


def search_terms(texts: DataFrame, terms: DataFrame, column: str = "text", mode: str = "exact", dictionaries: Sequence[str] = (), deinflected: bool = True, chains: bool = False, rules: list[Rule] | None = None) -> DataFrame:
    """Terms found for each distinct text, by all its candidates in order (``cand_pos``), with ``chains`` also by which rules; duplicates stay. Without ``deinflected`` by the text alone."""
    wanted = terms.where(F.col("dictionary").isin(*dictionaries)) if dictionaries else terms
    if deinflected:
        return batch_lookup(deinflect(texts, column, rules, chains), wanted, mode)
    plain = texts.select(F.col(column).alias("text")).where("text is not null").distinct().withColumn("candidate", F.col("text"))
    return batch_lookup(plain, wanted, mode)


# The labels in ``meta_text``, which readers of the data model see.
def meta_text(meta: DataFrame) -> Column:
    """What a reader sees of a row of metadata: its dictionary, and below it the frequency as displayed and as it is, the pitch with its morae and tags, or the transcription with its tags. Null for an unknown type. Whole numbers are shown without decimals; columns that ``meta`` lacks count as null."""
    have = lambda c, kind: F.col(c) if c in meta.columns else F.lit(None).cast(kind)
    number = have("frequency", "double")
    shown = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c.cast("array<string>"), " ")))
    tags = listed("<br> Tags: ", have("tags", "array<string>"))
    texts = {
        "frequency": F.concat_ws(" ", F.concat(F.lit("Frequency: "), have("display_frequency", "string")), F.concat(F.lit("Actual Value: "), shown)),
        "pitch": F.concat_ws(" ", F.concat(F.lit("Downstep on mora "), have("downstep_position", "int").cast("string")), listed("<br>Devoice on these morae: ", have("devoice_positions", "array<int>")), listed("<br>Nasal on these morae: ", have("nasal_positions", "array<int>")), tags),
        "ipa": F.concat_ws(" ", F.concat(F.lit("Transcription: "), have("transcription", "string")), tags),
    }
    chosen = F.coalesce(*[F.when(F.col("meta_type") == kind, text) for kind, text in texts.items()])
    return F.concat("dictionary", F.lit("<br>"), chosen)


def attach_term_meta(terms: DataFrame, meta: DataFrame) -> DataFrame:
    """Terms with ``meta``, the texts of all metadata of the term, in order of dictionary and text; grouped before the join, so that frequent terms don't multiply. Terms without any have an empty list."""
    shown = meta.select("term", "dictionary", meta_text(meta).alias("shown")).where("shown is not null")
    grouped = shown.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("dictionary", "shown"))).alias("m")).select("term", F.col("m.shown").alias("meta"))
    return terms.join(grouped, "term", "left").withColumn("meta", F.coalesce("meta", F.array().cast("array<string>")))


def attach_tags(terms: DataFrame, tags: DataFrame, column: str = "term_tags") -> DataFrame:
    """A row for each term and tag with the tag's category, order, notes and popularity; unknown tags have nulls."""
    opened = terms.withColumn("tag", F.explode(column))
    return opened.join(tags, ["dictionary", "tag"], "left")


def render_lookup(terms: DataFrame) -> DataFrame:
    """A row for each definition (JSON) of each term (with ``meta``): the term's heading and, below it, the definition as HTML. A malformed definition has no HTML."""
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"<br>{label}: "), F.array_join(c, " "))).otherwise("")
    heading = F.concat(F.array_join("meta", "<br>"), listed("Term Tags", "term_tags"), listed("Definition Tags", "definition_tags"))
    opened = terms.withColumn("heading", heading).select("*", F.posexplode("definitions").alias("def_no", "definition")).withColumn("shown", structured_html("definition", "dictionary"))
    return opened.withColumn("html", F.concat("heading", F.when(F.col("heading") != "", "<br>").otherwise(""), "shown")).drop("heading", "shown")


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each text and candidate: number of ways and least place."""
    return candidates.groupBy("text", "candidate").agg(F.count("*").alias("ways"), F.min("cand_pos").alias("first_pos"))


def dedupe_lookup(found: DataFrame, entry: Sequence[str], source: str = "text") -> DataFrame:
    """For each entry the matches (with ``rules``, the names of the rules that led to it, and ``kind``) of the longest source text: the text, their number, and their chains.

    ``chains`` is an array of (rules, kind), each chain once and in order; a chain that was found
    in more than one kind has ``both``. Chains are merged before they meet by entry.
    """
    best = W.partitionBy(*entry)
    longest = found.withColumn("_n", F.length(source)).withColumn("_most", F.max("_n").over(best)).where("_n = _most")
    kind = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("both").alias("kind")
    merged = longest.groupBy(*entry, "rules").agg(kind, F.min(source).alias("source"), F.count("*").alias("n"))
    return merged.groupBy(*entry).agg(F.min("source").alias("source"), F.sum("n").alias("matches"), F.array_sort(F.collect_list(F.struct("rules", "kind"))).alias("chains"))


def dictionary_deinflections(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Entries whose definition is ``[uninflected, [rules]]`` lead to the uninflected term's entries.

    ``rules`` is the chain that led to the entry (a column ``rules`` of ``found``, none without
    it) and behind it the definition's own; ``kind`` is ``dictionary``, or ``both`` behind a chain.
    """
    led = F.col("rules") if "rules" in found.columns else F.array().cast("array<string>")
    pointed = found.select("text", F.col("term").alias("via"), led.alias("led"), F.explode("definitions").alias("definition")).where(F.startswith("definition", F.lit("[")))
    own = F.coalesce(F.from_json(F.get_json_object("definition", "$[1]"), "array<string>"), F.array().cast("array<string>"))
    named = pointed.select("text", "via", F.get_json_object("definition", "$[0]").alias("uninflected"), F.concat("led", own).alias("rules"), F.when(F.size("led") > 0, "both").otherwise("dictionary").alias("kind"))
    return named.where("uninflected <> ''").join(terms, F.col("uninflected") == F.col("term"))


def rank_terms(found: DataFrame, key: Sequence[str], top: int | None = None) -> DataFrame:
    """Rank by popularity within ``key``, ties by term, dictionary and sequence; with ``top`` only the first."""
    order = W.partitionBy(*key).orderBy(F.col("popularity").desc_nulls_last(), "term", "dictionary", "sequence_number")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked


def ranked(rows: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank in ``order`` within ``key``, from 1, where a key may have any number of rows.

    Rows are dealt by ranges of key and order and written so; ranks inside a range come from
    a sort of that range alone, and the numbers of a key's rows in the ranges before it are added.
    """
    spark, where = rows.sparkSession, scratch(rows.sparkSession)
    rows.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()).write.parquet(where)
    dealt = spark.read.schema(f"{', '.join(f'`{c}` {kind}' for c, kind in rows.dtypes)}, _range int").parquet(where)
    counts = dealt.groupBy(*key, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*key).orderBy("_range")) - F.col("_n")).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_range").alias("_r"), "_before")
    inside = dealt.withColumn("_inside", F.row_number().over(W.partitionBy(*key, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return inside.join(before, same).select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def rank_by_frequency(found: DataFrame, meta: DataFrame, key: Sequence[str], dictionary: str, mode: str = "occurrence") -> DataFrame:
    """Rank within ``key`` by one frequency dictionary: small numbers first if it holds ranks, large ones first if occurrences; terms without a number come last. No key is sorted in one task."""
    numbers = meta.where((F.col("meta_type") == "frequency") & (F.col("dictionary") == dictionary)).groupBy("term").agg((F.min if mode == "rank" else F.max)("frequency").alias("number"))
    order = F.col("number").asc_nulls_last() if mode == "rank" else F.col("number").desc_nulls_last()
    return ranked(found.join(numbers, "term", "left"), key, [order, F.col("term"), F.col("dictionary"), F.col("sequence_number")])


def group_by_sequence(terms: DataFrame) -> DataFrame:
    """Terms that share a sequence number in a dictionary. The number 0, which all terms of version 1 have, says nothing: there only rows of one term and reading are together."""
    own = F.when(F.col("sequence_number") == 0, F.struct("term", "reading")).alias("own")
    return terms.groupBy("dictionary", "sequence_number", own).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.count("*").alias("n")).drop("own")
