"""The corpus read as running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions.batches import tasks
from kotonoha.operators import scan as S
from kotonoha.plans.rules import japanese_rules
from kotonoha.queries.adapters import KANA, LETTERS, TERMS_SQL, kana, table, terms
from kotonoha.queries.lookup_queries import _FITS_PAIRS, _key
from kotonoha.queries.registry import query

#: Transforms of the language that the scan of the corpus uses; all of them are in the tests.
_TRANSFORMS = ("-た", "-て", "-たい", "-ず")
RULES = [r for r in japanese_rules() if r.transform in _TRANSFORMS]

_RULES_SQL = ", ".join(f"('{r.suffix}', '{r.plain}', '{_key(r.before)}', '{_key(r.after)}', '{' '.join(r.after)}')" for r in RULES)
#: Terms go forward to all their inflected forms, which then are sought in the texts, in letters: there a place in a text is found at once.
_SOURCES_SQL = f"""{TERMS_SQL}, rules(suffix, plain, before, after, conditions) AS (VALUES {_RULES_SQL}), fits(r, c) AS (VALUES {_FITS_PAIRS}),
    ends AS (SELECT *, length(plain) AS n FROM rules), words AS (SELECT DISTINCT term FROM terms),
    g(term, conditions, need, form) AS (
        SELECT term, conditions, before, left(term, length(term) - n) || suffix FROM words JOIN ends ON right(term, n) = plain
        UNION
        SELECT term, g.conditions, before, left(form, length(form) - n) || suffix FROM g JOIN ends ON right(form, n) = plain AND after = need WHERE length(form) < 40),
    entries AS (SELECT term, dictionary, sequence_number, unnest(inflection_rules) AS r FROM terms),
    led AS (SELECT DISTINCT term, form AS source, unnest(string_split(conditions, ' ')) AS c FROM g),
    sources AS (SELECT term AS source, term, dictionary, sequence_number FROM terms UNION SELECT source, led.term, dictionary, sequence_number FROM led JOIN fits USING (c) JOIN entries ON entries.term = led.term AND entries.r = fits.r),
    letters AS MATERIALIZED (SELECT *, translate(source, '{KANA}', '{LETTERS}') AS latin FROM sources),
    kept AS MATERIALIZED (SELECT DISTINCT latin FROM letters WHERE length(latin) BETWEEN 1 AND {S.LONGEST} AND regexp_full_match(latin, '[a-z]+')), sizes AS (SELECT DISTINCT length(latin) AS n FROM kept),
    running AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS text FROM documents),
    pieces AS (SELECT doc_id, p, substring(text, p + 1, 63 + {S.LONGEST}) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 64)) AS p FROM running)),
    places AS (SELECT doc_id, p, piece, unnest(range(1, least(64, length(piece)) + 1)) AS i FROM pieces),
    longest AS (SELECT doc_id, p + i - 1 AS start, max_by(latin, n) AS latin, max(n) AS length FROM (SELECT doc_id, p, i, n, substring(piece, i, n) AS latin FROM places JOIN sizes ON i + n - 1 <= length(piece)) JOIN kept USING (latin) GROUP BY doc_id, p, i)"""


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in kana without anything between words, dealt to tasks: a scan is work for the processor, and small tables come in one file."""
    return table(spark, sf_dir, "documents").repartition(tasks(spark), "doc_id").select("doc_id", kana(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("text"))


@query(f"WITH RECURSIVE {_SOURCES_SQL} SELECT doc_id, count(*) AS places, sum(length)::BIGINT AS characters, md5(string_agg(start || ':' || length, ',' ORDER BY start)) AS digest FROM longest GROUP BY doc_id")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each place of the running texts the longest source of a term."""
    found = S.scan_lists(running(spark, sf_dir), terms(spark, sf_dir), rules=RULES, told=["start", "length"]).where(F.size("places") > 0)
    shown = F.array_join(F.transform("places", lambda x: F.concat_ws(":", x["start"].cast("string"), x["length"].cast("string"))), ",")
    characters = F.aggregate("places.length", F.lit(0).cast("long"), lambda n, x: n + x)
    return found.select("doc_id", F.size("places").cast("long").alias("places"), characters.alias("characters"), F.md5(shown.cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {_SOURCES_SQL}, met AS (SELECT latin, count(*) AS n FROM longest GROUP BY latin)
    SELECT term, dictionary, sequence_number, sum(n)::BIGINT AS places FROM met JOIN letters USING (latin) GROUP BY ALL""")
def scan_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, and at how many places of the running texts the longest source leads to them."""
    found = S.scan_texts(running(spark, sf_dir), terms(spark, sf_dir), rules=RULES, told=["variant"]).groupBy("variant").agg(F.count("*").alias("n"))
    met = S.scan_entries(found, terms(spark, sf_dir), ["term", "dictionary", "sequence_number"], rules=RULES)
    return met.groupBy("term", "dictionary", "sequence_number").agg(F.sum("n").alias("places"))
