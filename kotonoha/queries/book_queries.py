"""Books made of ``pages`` and ``documents``, and reading progress made of ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions import readings
from kotonoha.functions import text as T
from kotonoha.operators import books as K
from kotonoha.queries.adapters import KANA, LETTERS, PAGES_SQL, SURFACES_SQL, pages, surfaces, table
from kotonoha.queries.registry import query
from kotonoha.sources import epub
from kotonoha.streaming import progress as P

_LINKS = '(src|href)="([^"]*)"'


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, item_id, item_href, attribute, value) of each page."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(_LINKS), F.lit(1)).alias("attribute"), F.regexp_extract_all("html", F.lit(_LINKS), F.lit(2)).alias("value"))
    return pages(spark, sf_dir).select("book", "item_id", F.col("href").alias("item_href"), F.explode(both).alias("l")).select("book", "item_id", "item_href", "l.attribute", "l.value")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of each book, and files for its short links."""
    own = pages(spark, sf_dir).select("book", "item_id", "href", F.lit(epub.XHTML).alias("media_type"))
    short = links(spark, sf_dir).where("length(value) between 2 and 5 and startswith(value, '/')").select("book", F.concat(F.lit("x"), F.substring("value", 2, 10)).alias("item_id"), F.col("value").alias("href"), F.lit("text/plain").alias("media_type")).distinct()
    return own.unionByName(short)


_LINKS_SQL = f"{PAGES_SQL}, links AS (SELECT book, item_id, href AS item_href, unnest(regexp_extract_all(html, '{_LINKS}', 1)) AS attribute, unnest(regexp_extract_all(html, '{_LINKS}', 2)) AS value FROM spine)"
_MANIFEST_SQL = f"{_LINKS_SQL}, manifest AS (SELECT book, item_id, href, 'application/xhtml+xml' AS media_type FROM spine UNION ALL SELECT DISTINCT book, 'x' || value[2:], value, 'text/plain' FROM links WHERE length(value) BETWEEN 2 AND 5 AND starts_with(value, '/'))"
_RESOLVED_SQL = f"{_MANIFEST_SQL}, resolved AS (SELECT l.*, m.item_id AS target, CASE WHEN m.item_id IS NOT NULL THEN '!' || m.item_id END AS resolved FROM links l LEFT JOIN manifest m ON l.book = m.book AND l.value = m.href)"


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resolve_links(links(spark, sf_dir), manifest(spark, sf_dir))


@query(f"WITH {_RESOLVED_SQL} SELECT book, item_id, attribute, value, target, resolved, CASE WHEN target IS NULL THEN 'not in manifest' END AS error FROM resolved")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("book", "item_id", "attribute", "value", "target", "resolved", "error")


@query(f"WITH {_RESOLVED_SQL} SELECT book, item_id, value, CASE WHEN length(target) % 2 = 0 THEN '#part-' || target END AS inlined, CASE WHEN target IS NULL THEN 'not in manifest' WHEN length(target) % 2 <> 0 THEN 'not in spine' END AS error FROM resolved")
def inline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with ids of even length count as in the spine."""
    spine = manifest(spark, sf_dir).where("length(item_id) % 2 = 0").select("book", "item_id")
    return K.inline_links(resolved(spark, sf_dir), spine).select("book", "item_id", "value", "inlined", "error")


@query(f"WITH {_MANIFEST_SQL}, s AS (SELECT book, pos, CASE WHEN pos % 4 = 3 THEN 'lost' || pos ELSE item_id END AS item_id FROM spine) SELECT s.book, pos, s.item_id, m.href, m.media_type FROM s JOIN manifest m ON s.book = m.book AND s.item_id = m.item_id")
def resolve_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resolve_spine(_spine(spark, sf_dir), manifest(spark, sf_dir)).select("book", "pos", "item_id", "href", "media_type")


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.when(F.col("pos") % 4 == 3, F.concat(F.lit("lost"), F.col("pos").cast("string"))).otherwise(F.col("item_id"))
    return pages(spark, sf_dir).select("book", "pos", lost.alias("item_id"))


@query(f"WITH {PAGES_SQL} SELECT book, pos, 'lost' || pos AS item_id FROM spine WHERE pos % 4 = 3")
def spine_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spine_rejects(_spine(spark, sf_dir), manifest(spark, sf_dir))


_COUNTS_SQL = f"sections AS (SELECT book, pos, item_id, length(regexp_replace(html, '[^{T.COUNTED_CLASS}]', '', 'g'))::BIGINT AS characters, CASE WHEN pos % 3 = 1 THEN regexp_extract(html, '<title>([^<]*)', 1) END AS chapter FROM spine)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = F.when(F.col("pos") % 3 == 1, F.regexp_extract("html", "<title>([^<]*)", 1))
    return pages(spark, sf_dir).select("book", "pos", "item_id", T.count_characters(F.col("html")).cast("long").alias("characters"), chapter.alias("chapter"))


@query(f"WITH {PAGES_SQL}, {_COUNTS_SQL} SELECT book, pos, characters, coalesce(sum(characters) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sections")
def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.section_offsets(sections(spark, sf_dir)).select("book", "pos", "characters", "start")


@query(f"WITH {PAGES_SQL}, {_COUNTS_SQL} SELECT book, pos, coalesce(last_value(chapter IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Preface') AS chapter FROM sections")
def section_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.section_chapters(sections(spark, sf_dir)).select("book", "pos", "chapter")


@query(f"WITH {PAGES_SQL} SELECT book, href, string_agg(item_id, ' ' ORDER BY pos) AS items FROM (SELECT book, pos, item_id, 'css/' || (page % 3) || '.css' AS href FROM (SELECT *, pos + length(item_id) AS page FROM spine)) GROUP BY book, href")
def stylesheet_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = pages(spark, sf_dir).select("book", "pos", "item_id", F.concat(F.lit("css/"), ((F.col("pos") + F.length("item_id")) % 3).cast("string"), F.lit(".css")).alias("href"))
    return K.stylesheet_refs(styles).withColumn("items", F.array_join("items", " "))


@query(f"WITH {_MANIFEST_SQL} SELECT book, item_id, item_id || '-' || regexp_extract(href, '([^/]*)$', 1) AS asset FROM manifest")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.asset_paths(manifest(spark, sf_dir)).select("book", "item_id", "asset")


@query(f"""WITH {PAGES_SQL}, p AS (SELECT book, pos, '<div id="part-' || item_id || '"' || CASE WHEN pos % 2 = 0 THEN ' class="c' || pos || '"' ELSE '' END || '>' || regexp_extract(html, '(?s)<article>.*</article>') || '</div>' AS div FROM spine)
    SELECT book, 'book ' || book AS title, md5('<!DOCTYPE html><html><head><meta charset="UTF-8"/><title>book ' || book || '</title></head><body><div id="wrapper-part" style="{K.WRAPPER}"><div id="main-part">' || string_agg(div, '' ORDER BY pos) || '</div></div></body></html>') AS digest FROM p GROUP BY book""")
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body_class = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("c"), F.col("pos").cast("string")))
    parts = pages(spark, sf_dir).select("book", F.concat(F.lit("book "), F.col("book").cast("string")).alias("title"), "pos", "item_id", body_class.alias("body_class"), F.regexp_extract("html", "(?s)<article>.*</article>", 0).alias("body"))
    return K.merge_parts(parts).select("book", "title", F.md5("html").alias("digest"))


@query(f"""WITH {PAGES_SQL}, p AS (SELECT book, pos, '<div id="part-' || item_id || '">' || regexp_extract(html, '(?s)<article>.*</article>') || '</div>' AS div FROM spine)
    SELECT book, 'book ' || book AS title, md5('<div id="wrapper-part" style="{K.WRAPPER}"><div id="main-part">' || string_agg(div, '' ORDER BY pos) || '</div></div>') AS digest FROM p GROUP BY book""")
def book_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body of the merged books."""
    parts = pages(spark, sf_dir).select("book", F.concat(F.lit("book "), F.col("book").cast("string")).alias("title"), "pos", "item_id", F.lit(None).cast("string").alias("body_class"), F.regexp_extract("html", "(?s)<article>.*</article>", 0).alias("body"))
    return K.book_record(K.merge_parts(parts)).select("book", "title", F.md5("body").alias("digest"))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT book, item_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a href="([^"]*)">([^<]*)</a>', 1) AS t, regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a href="([^"]*)">([^<]*)</a>', 2) AS a FROM spine)
    SELECT item_id AS book, (i - 1)::INT AS no, replace(a[i], '&amp;', '&') AS title, replace(t[i], '&amp;', '&') AS target FROM n, range(1, 100) r(i) WHERE i <= len(t)""")
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = pages(spark, sf_dir).select(F.col("item_id").alias("book"), F.lit("3.0").alias("version"), F.concat(F.lit("<html>"), F.regexp_extract("html", "(?s)<nav>.*?</nav>", 0), F.lit("</html>")).alias("xml"))
    return epub.toc_entries(nav)


@query()
def xhtml_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's counted characters, links and body, by one walk over its markup."""
    items = pages(spark, sf_dir).select("book", "item_id", "html")
    return epub.item_parts(items).select("book", "item_id", "characters", F.size("links").alias("n_links"), F.md5("body").alias("body_md5"))


@query(rf"""WITH {PAGES_SQL}, v AS (SELECT book, item_id, unnest(range(len(hrefs)))::INT AS link_pos, unnest(hrefs) AS value FROM (SELECT book, item_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM spine))
    SELECT book::VARCHAR AS book, item_id, link_pos, 'a' AS tag, 'href' AS attribute, replace(replace(replace(replace(value, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS value FROM v""")
def xhtml_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page in their order, as the walk over its markup finds them."""
    walked = epub.item_parts(pages(spark, sf_dir).select("book", "item_id", "html"))
    return walked.select("book", "item_id", F.posexplode("links").alias("link_pos", "l")).select("book", "item_id", "link_pos", "l.tag", "l.attribute", "l.value")


_BOOKS_SQL = f"books AS (SELECT md5(text) AS file_hash, split_part(text, chr(10), 1) AS primary_title, (['epub', 'manga', 'mokuro'])[doc_id % 3 + 1] AS type, length(regexp_replace(text, '[^{T.COUNTED_CLASS}]', '', 'g'))::BIGINT AS length, (doc_id % 100)::DOUBLE AS current_progress, doc_id, source FROM documents)"


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("epub", "manga", "mokuro"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.md5("text").alias("file_hash"), F.substring_index("text", "\n", 1).alias("primary_title"), kind.alias("type"), T.count_characters(F.col("text")).cast("long").alias("length"), (F.col("doc_id") % 100).cast("double").alias("current_progress"), "doc_id", "source")


@query(f"WITH {_BOOKS_SQL} SELECT doc_id, primary_title, type FROM books WHERE type = 'epub' AND contains(primary_title, 'the')")
def search_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search_books(library(spark, sf_dir), "the").select("doc_id", "primary_title", "type")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each title, by its least hash."""
    return library(spark, sf_dir).groupBy("primary_title").agg(F.min("file_hash").alias("file_hash")).withColumn("current_progress", F.lit(5.0))


_TITLES_SQL = f"{_BOOKS_SQL}, titles AS (SELECT primary_title, min(file_hash) AS file_hash FROM books GROUP BY primary_title)"


@query(f"WITH {_TITLES_SQL}, c AS (SELECT doc_id, file_hash, CASE WHEN doc_id % 4 = 0 THEN 'no such title' ELSE primary_title END AS primary_title FROM books) SELECT doc_id, EXISTS (SELECT 1 FROM titles t WHERE t.primary_title = c.primary_title) AS known, EXISTS (SELECT 1 FROM titles t WHERE t.primary_title = c.primary_title AND t.file_hash = c.file_hash) AS conflicting FROM c")
def book_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates, some with a title that no book has: whether the title is known, and whether with this hash."""
    candidates = library(spark, sf_dir).select("doc_id", "file_hash", F.when(F.col("doc_id") % 4 == 0, "no such title").otherwise(F.col("primary_title")).alias("primary_title"))
    marked = lambda conflicting, name: K.book_exists(candidates, _titles(spark, sf_dir), conflicting).select("doc_id", F.lit(True).alias(name))
    both = candidates.select("doc_id").join(marked(False, "known"), "doc_id", "left").join(marked(True, "conflicting"), "doc_id", "left")
    return both.select("doc_id", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("conflicting", F.lit(False)).alias("conflicting"))


@query(f"WITH {_TITLES_SQL} SELECT primary_title, file_hash, 5.0::DOUBLE AS current_progress FROM titles UNION ALL SELECT DISTINCT primary_title, file_hash, 0.0::DOUBLE FROM books WHERE (primary_title, file_hash) NOT IN (SELECT (primary_title, file_hash) FROM titles)")
def merge_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library with one book for each title, to which all documents are added."""
    added = library(spark, sf_dir).select("file_hash", "primary_title").distinct()
    return K.merge_library(_titles(spark, sf_dir), added).select("primary_title", "file_hash", "current_progress")


@query(f"WITH {_BOOKS_SQL} SELECT doc_id, length, CASE WHEN length > 0 THEN current_progress / length ELSE 0 END AS share FROM books")
def book_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.book_progress(library(spark, sf_dir)).select("doc_id", "length", "share")


@query(f"""WITH {_BOOKS_SQL}, last AS (SELECT user_id, arg_max(value, row(ts, event_id)) AS progress FROM events GROUP BY user_id), b AS (SELECT DISTINCT doc_id AS primary_title, current_progress FROM books)
    SELECT b.primary_title::VARCHAR AS primary_title, coalesce(progress, current_progress) AS current_progress FROM b LEFT JOIN last ON b.primary_title = last.user_id""")
def update_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books named by their document's id; users of ``events`` stand for titles."""
    owned = library(spark, sf_dir).select(F.col("doc_id").cast("string").alias("primary_title"), "current_progress").distinct()
    updates = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("primary_title"), F.col("value").alias("progress"), F.struct("ts", "event_id").alias("at"))
    return K.update_progress(owned, updates)


@query("SELECT user_id AS book, floor(arg_max(value, row(ts, event_id)) / 100 * 1000 + 0.5) / 10 AS progress, count(*) AS n FROM events GROUP BY user_id")
def progress_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.latest_progress(table(spark, sf_dir, "events"))


@query("SELECT date_trunc('hour', ts) AS start, user_id AS book, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.heartbeats(table(spark, sf_dir, "events")).select("start", "book", "n", F.round("total", 6).alias("total"))


_MIXED = "山ば木だて父が母い字く等まん尾お毛る詩た羽ぶ和わさよ図"
#: Letters whose kana in _MIXED isn't that of the reading: words with one can't be aligned.
_OFF = "".join(c for c, m, k in zip(LETTERS, _MIXED, KANA) if readings.is_kana(m) and m != k)
_MIXED_SQL = f"""m AS (SELECT w, translate(w, '{LETTERS}', '{_MIXED}') AS term, s AS reading, regexp_matches(w, '[{_OFF}]') AS off FROM surfaces),
    u AS (SELECT w, term, reading, off, unnest(regexp_extract_all(term, '[{T.KANA_CLASS}]+|[^{T.KANA_CLASS}]+')) AS run, generate_subscripts(regexp_extract_all(term, '[{T.KANA_CLASS}]+|[^{T.KANA_CLASS}]+'), 1) AS i FROM m),
    r AS (SELECT *, (coalesce(sum(length(run)) OVER (PARTITION BY w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start, regexp_matches(run, '^[{T.KANA_CLASS}]') AS kana FROM u)"""


def _shown(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat(s["text"], F.lit(":"), s["reading"])), "|")


@query(f"""WITH {SURFACES_SQL}, {_MIXED_SQL}
    SELECT w, CASE WHEN off THEN term || ':' || reading ELSE string_agg(run || ':' || CASE WHEN kana THEN '' ELSE reading[start + 1 : start + length(run)] END, '|' ORDER BY i) END AS segments FROM r GROUP BY w, term, reading, off""")
def furigana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words half in kanji aligned with their reading, of the same length; in some the kana disagree."""
    mixed = F.translate("w", LETTERS, _MIXED)
    return surfaces(spark, sf_dir).select("w", _shown(readings.distribute_furigana(mixed, F.col("s"))).alias("segments"))


@query(f"""WITH {SURFACES_SQL}, {_MIXED_SQL},
    c AS (SELECT w, term, off, length(term) - 1 AS stem, i, start, CASE WHEN off THEN term[1 : length(term) - 1] ELSE run[1 : length(term) - 1 - start] END AS text, CASE WHEN off OR kana OR start + length(run) > length(term) - 1 THEN '' ELSE reading[start + 1 : start + length(run)] END AS read FROM r WHERE start < length(term) - 1 AND (NOT off OR i = 1)),
    j AS (SELECT w, string_agg(text || ':' || read, '|' ORDER BY i) AS s FROM c GROUP BY w)
    SELECT m.w, CASE WHEN length(m.w) = 1 OR term[1 : length(term) - 1] = reading[1 : length(term) - 1] THEN term[1 : length(term) - 1] || 'った:' WHEN suffix(s, ':') THEN s[1 : length(s) - 1] || 'った:' ELSE s || '|った:' END AS segments
    FROM m LEFT JOIN j ON m.w = j.w""")
def furigana_inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words with another ending instead of their last character."""
    mixed = F.translate("w", LETTERS, _MIXED)
    source = F.concat(F.left(mixed, F.length(mixed) - 1), F.lit("った"))
    return surfaces(spark, sf_dir).select("w", _shown(readings.distribute_furigana_inflected(mixed, F.col("s"), source)).alias("segments"))


@query(f"""WITH RECURSIVE {SURFACES_SQL}, romaji(k, v) AS (VALUES {", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in sorted(readings.romaji_table().items()))}),
    d(w, rest, kana) AS (
        SELECT w, w, '' FROM surfaces
        UNION ALL
        SELECT w, CASE WHEN twice THEN rest[2:] ELSE rest[greatest(1, coalesce(length(c.k), length(b.k), length(a.k), 1)) + 1 :] END, kana || CASE WHEN twice THEN 'っ' ELSE coalesce(c.v, b.v, a.v, rest[1]) END
        FROM (SELECT *, length(rest) > 1 AND rest[1] = rest[2] AND contains('kgsztdhbpmyrlwfjcv', rest[1]) AS twice FROM d WHERE rest <> '')
        LEFT JOIN romaji c ON c.k = rest[1:3] AND length(c.k) = 3
        LEFT JOIN romaji b ON b.k = rest[1:2] AND length(b.k) = 2 AND NOT (b.k = 'nn' AND length(rest) > 2 AND contains('aiueoy', rest[3]))
        LEFT JOIN romaji a ON a.k = rest[1:1])
    SELECT w, kana FROM d WHERE rest = ''""")
def romaji(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces(spark, sf_dir).select("w", readings.alphabetic_to_kana("w").alias("kana"))
