"""Whole flows: variants of texts, archives, and streams over the given tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kotonoha.functions import text as T
from kotonoha.functions.scratch import scratch
from kotonoha.operators.books import WRAPPER
from kotonoha.operators.books import ingest_books as ingest
from kotonoha.plans.language import Preprocessor
from kotonoha.plans.language import text_variants as variants
from kotonoha.queries.adapters import HIRA, KATA, SURFACES_SQL, surfaces, table
from kotonoha.queries.bank_queries import archives_of, item, js, parts
from kotonoha.queries.registry import query
from kotonoha.sources import banks as B
from kotonoha.sources import epub, members
from kotonoha.streaming import progress as P

_WIDE = Preprocessor("width", [T.to_fullwidth_alnum])
_KANA = Preprocessor("kana", [T.hiragana_to_katakana])


@query(f"""WITH {SURFACES_SQL}, v AS (SELECT w || 'った' AS text, p || q AS variant, [i, j] AS o
        FROM (SELECT w, unnest([w, translate(w, '{T._ALNUM}', '{T._WIDE}')]) AS p, unnest([0, 1]) AS i FROM surfaces), (VALUES ('った', 0), (translate('った', '{HIRA}', '{KATA}'), 1)) k(q, j))
    SELECT text, (row_number() OVER (PARTITION BY text ORDER BY o) - 1)::INT AS variant_no, variant FROM v""")
def text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(surfaces(spark, sf_dir).select(F.concat("w", F.lit("った")).alias("text")), "text", [_WIDE, _KANA])


def tag_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives (one for each brand) with tag banks made of ``part`` and an index."""
    rows = parts(spark, sf_dir).select("archive", item(js("p_type"), js("p_brand"), F.lit("1"), js("p_name"), F.lit("2")).alias("item"))
    bank = archives_of(rows, "tag_bank").select("archive", "path", "content")
    index = bank.select("archive").distinct().select("archive", F.lit("index.json").alias("path"), F.concat(F.lit('{"revision":"1","format":3,"title":"'), "archive", F.lit('"}')).cast("binary").alias("content"))
    return bank.unionByName(index)


_BRANDS_SQL = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'))"


@query(f"""SELECT {_BRANDS_SQL} AS archive, min(p_partkey) % 7 NOT IN (0, 1, 3, 5, 6) AS ok, (['index', 'numbering', NULL, 'items', NULL, 'index', 'items'])[min(p_partkey) % 7 + 1] AS reason FROM part GROUP BY ALL""")
def validate_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each brand with a tag bank and a term bank; by its first part it lacks an index, has a bank numbered from 2, is sound, has a bank that is cut short, is sound in version 1, names an unknown language, or has items of no version."""
    own = parts(spark, sf_dir)
    k = F.col("k")
    kind = own.groupBy("archive").agg((F.min("p_partkey") % 7).alias("k"))
    tags = own.select("archive", item(js("p_type"), js("p_brand"), F.lit("1"), js("p_name"), F.lit("2")).alias("item"))
    old = item(js("p_name"), js(F.lit("")), js(F.lit("n")), js(F.lit("v1")), F.lit("1"), js("p_type"))
    new = item(js("p_name"), js(F.lit("")), F.lit("null"), js(F.lit("")), F.lit("1"), item(js("p_type")), F.lit("7"), js(F.lit("")))
    wrong = item(js("p_name"), js(F.lit("")), F.lit("[]"))
    terms = own.join(kind, "archive").select("archive", F.when(k == 4, old).when(k == 6, wrong).otherwise(new).alias("item"))
    later = F.concat(F.lit("tag_bank_"), (F.col("bank_no") + 1).cast("string"), F.lit(".json"))
    text = F.col("content").cast("string")
    cut_short = F.when((k == 3) & (F.col("bank_no") == 1), F.left(text, F.length(text) - 1)).otherwise(text).cast("binary")
    tag_banks = archives_of(tags, "tag_bank").join(kind, "archive").select("archive", F.when(k == 1, later).otherwise(F.col("path")).alias("path"), "content")
    term_banks = archives_of(terms, "term_bank").join(kind, "archive").select("archive", "path", cut_short.alias("content"))
    language = F.when(k == 5, "xx").otherwise("ja")
    index = kind.where("k <> 0").select("archive", F.lit("index.json").alias("path"), F.concat(F.lit('{"revision":"1","sourceLanguage":"'), language, F.lit('","format":'), F.when(k.isin(4, 6), "1").otherwise("3"), F.lit(',"title":"'), "archive", F.lit('"}')).cast("binary").alias("content"))
    return B.validate_archive(B.route_entries(tag_banks.unionByName(term_banks).unionByName(index)))


#: Entries of a zip, on average, where an archive has more than that.
ZIP_ENTRIES = 64


def _zipped(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path, content in zip(group["path"], group["content"], strict=True):
            z.writestr(path, content)
    return pd.DataFrame({"path": [f"{key[0]}/{key[1]}.zip"], "content": [buffer.getvalue()]})


def zips(entries: DataFrame, most: int = ZIP_ENTRIES) -> DataFrame:
    """Zips (path, content) of the entries, in a folder for each archive; one of more than ``most`` comes as several, its entries dealt by a hash of their paths."""
    sizes = entries.groupBy("archive").agg(F.ceil(F.count("*") / most).alias("zips"))
    dealt = entries.select("archive", "path", "content").join(sizes, "archive").withColumn("part", F.pmod(F.xxhash64("path"), F.col("zips")))
    return dealt.groupBy("archive", "part").applyInPandas(_zipped, "path string, content binary")


def unpacked(spark: SparkSession, entries: DataFrame, most: int = ZIP_ENTRIES) -> DataFrame:
    """The entries after a way through zip files, which are written and read again."""
    where = scratch(spark)
    B.write_files(zips(entries, most), where)
    return B.read_archives(spark, where).withColumn("archive", F.regexp_extract("archive", r"([^/]+)/[^/]+\.zip$", 1))


@query(f"SELECT {_BRANDS_SQL} AS archive, count(*) AS tags FROM part GROUP BY ALL")
def read_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag banks made of ``part``, zipped, opened again and parsed."""
    opened = B.route_entries(unpacked(spark, tag_entries(spark, sf_dir)))
    return B.parse_tag_bank(B.bank_items(opened, "tag_bank")).groupBy("archive").agg(F.count("*").alias("tags"))


@query(f"SELECT {_BRANDS_SQL} AS archive, count(*) AS tags, 1::BIGINT AS indexed FROM part GROUP BY ALL")
def read_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same banks by the directories of their zips: members are dealt to tasks by where they lie, pictures are left out before they are read."""
    where, entries = scratch(spark), tag_entries(spark, sf_dir)
    picture = entries.where("path = 'index.json'").select("archive", F.lit("img/p.png").alias("path"), F.repeat(F.lit("png"), 5_000).cast("binary").alias("content"))
    B.write_files(zips(entries.unionByName(picture)), where)
    wanted = B.route_entries(members.zip_members(spark, where)).where("kind <> 'media'")
    opened = members.read_members(wanted, split=4_096).withColumn("archive", F.regexp_extract("archive", r"([^/]+)/[^/]+\.zip\z", 1))
    opened.write.parquet(f"{where}-read")
    routed = B.route_entries(spark.read.schema(B.ENTRY).parquet(f"{where}-read"))
    tags = B.parse_tag_bank(B.bank_items(routed, "tag_bank")).groupBy("archive").agg(F.count("*").alias("tags"))
    return tags.join(routed.where("kind = 'index'").groupBy("archive").agg(F.count("*").alias("indexed")), "archive")


@query(f"SELECT {_BRANDS_SQL} AS archive, min(p_partkey) % 3 <> 0 AS ok, CASE WHEN min(p_partkey) % 3 = 0 THEN 'zip' END AS reason FROM part GROUP BY ALL")
def validate_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives as zips, of which those whose first part three divides are cut short; the others are sound."""
    where, entries = scratch(spark), tag_entries(spark, sf_dir)
    short = parts(spark, sf_dir).groupBy("archive").agg((F.min("p_partkey") % 3 == 0).alias("short"))
    packed = zips(entries).withColumn("archive", F.split("path", "/")[0]).join(short, "archive")
    B.write_files(packed.select("path", F.when(F.col("short"), F.substring("content", F.lit(1), F.length("content") - 30)).otherwise(F.col("content")).alias("content")), where)
    opened = B.read_archives(spark, where).withColumn("archive", F.regexp_extract("archive", r"([^/]+)/[^/]+\.zip\z", 1))
    return B.validate_archive(B.route_entries(opened))


@query(f"""WITH a AS (SELECT {_BRANDS_SQL} AS archive, count(*) AS n FROM part GROUP BY ALL), f AS (SELECT left(archive, 6) AS dictionary, min(archive) AS archive FROM a GROUP BY left(archive, 6))
    SELECT f.dictionary, n FROM f JOIN a USING (archive)""")
def import_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several archives have one title; two writers who know nothing of each other publish them all. Each title is there once, with the tags of its first archive."""
    where, entries = scratch(spark), tag_entries(spark, sf_dir)
    titled = F.when(F.col("path") == "index.json", F.regexp_replace(F.col("content").cast("string"), '"title":"(.{6})[^"]*"', '"title":"$1"').cast("binary")).otherwise(F.col("content"))
    tables = B.import_dictionaries(B.route_entries(entries.withColumn("content", titled)))
    for writer in ("one", "two"):
        B.write_dictionaries({name: tables[name] for name in ("dictionaries", "tags")}, f"{where}/tables", writer)
    return B.read_table(spark, f"{where}/tables", "tags").groupBy("dictionary").agg(F.count("*").alias("n"))


#: Documents of a book: their ids share all but what is under this.
BOOK_IDS = 1_000
#: A document in so many begins a chapter.
CHAPTER = 7
_BOOK_SQL = f"source || '-' || (doc_id // {BOOK_IDS})"


def shelf(spark: SparkSession, sf_dir: str, bodies: bool = False) -> DataFrame:
    """Entries of EPUBs, for each source one for every BOOK_IDS ids: a package that lists its documents, a table of contents, a picture and, with ``bodies``, an XHTML file for each document."""
    book = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / BOOK_IDS).cast("string")).alias("archive")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", book)
    d = docs.groupBy("archive").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    listed = lambda ids, parts: F.array_join(F.transform(ids, lambda i: F.concat(*[F.lit(x) if x else i.cast("string") for x in parts])), "")
    items = listed("ids", ['<item id="d', "", '" href="text/../d', "", '.xhtml" media-type="application/xhtml+xml"/>'])
    refs = listed("ids", ['<itemref idref="d', "", '"/>'])
    chapters = listed(F.filter("ids", lambda i: i % CHAPTER == 0), ['<a href="./d', "", '.xhtml#top">Chapter ', "", "</a>"])
    opf = F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">id-'), "archive", F.lit("</dc:identifier><dc:title>Book "), "archive", F.lit('</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="pic" href="img/p.png" media-type="image/png" properties="cover-image"/>'), items, F.lit("</manifest><spine>"), refs, F.lit("</spine></package>"))
    nav = F.concat(F.lit("<html><body><nav>"), chapters, F.lit("</nav></body></html>"))
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    files = F.array(*[F.struct(F.lit(p).alias("path"), c.cast("binary").alias("content")) for p, c in (("mimetype", F.lit(epub.EPUB)), ("META-INF/container.xml", F.lit(container)), ("OPS/package.opf", opf), ("OPS/nav.xhtml", nav), ("OPS/img/p.png", F.lit("png")))])
    entries = d.select("archive", F.explode(files).alias("f")).select("archive", "f.*")
    if not bodies:
        return entries
    plain = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    following = F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string"), F.lit(".xhtml"))
    html = F.concat(F.lit("<html><head></head><body><p>"), plain, F.lit("</p><img src='img/p.png'/><a href=\""), following, F.lit('#top">next</a></body></html>'))
    return entries.unionByName(docs.select("archive", F.concat(F.lit("OPS/d"), F.col("doc_id").cast("string"), F.lit(".xhtml")).alias("path"), html.cast("binary").alias("content")))


_ESCAPED_SQL = "replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;')"
_SHELF_SQL = f"docs AS (SELECT *, {_BOOK_SQL} AS book, 'd' || doc_id AS item_id, replace({_ESCAPED_SQL}, '>', '&gt;') AS escaped FROM documents), c AS (SELECT book, item_id, doc_id, (row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1)::INT AS pos, length(regexp_replace(coalesce(text, ''), '[^{T.COUNTED_CLASS}]', '', 'g'))::BIGINT AS characters FROM docs)"


@query(f"SELECT {_BOOK_SQL} AS book, 'Book ' || {_BOOK_SQL} AS title, 'id-' || {_BOOK_SQL} AS identifier, count(*) AS items, 'nav' AS toc_id FROM documents GROUP BY ALL")
def read_epubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of each source, zipped as EPUB, opened again and parsed."""
    packages = epub.parse_package(epub.read_epubs(unpacked(spark, shelf(spark, sf_dir))))
    return packages.select("book", F.col("titles")[0].alias("title"), "identifier", F.size("spine").cast("long").alias("items"), "toc_id")


@query(f"""WITH {_SHELF_SQL} SELECT book, item_id, pos, characters, coalesce(sum(characters) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    coalesce(last_value(CASE WHEN doc_id % {CHAPTER} = 0 THEN 'Chapter ' || doc_id END IGNORE NULLS) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Preface') AS chapter FROM c""")
def ingest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the books made of ``documents``: characters of each and before each, and the chapter by the table of contents."""
    return ingest(shelf(spark, sf_dir, bodies=True))["sections"].select("book", "item_id", "pos", "characters", "start", "chapter")


@query(f"""WITH {_SHELF_SQL} SELECT d.book, d.item_id, v AS attribute, CASE v WHEN 'src' THEN 'pic-p.png' ELSE CASE WHEN n.doc_id IS NOT NULL THEN '#part-d' || (d.doc_id + 1) END END AS inlined, CASE WHEN v = 'href' AND n.doc_id IS NULL THEN 'not in manifest' END AS error
    FROM docs d CROSS JOIN (VALUES ('src'), ('href')) t(v) LEFT JOIN docs n ON n.doc_id = d.doc_id + 1 AND n.book = d.book""")
def ingest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of these books: a picture, and the document with the next id, which the same book may have or not."""
    return ingest(shelf(spark, sf_dir, bodies=True))["links"].select("book", "item_id", "attribute", "inlined", "error")


@query(f"""WITH {_SHELF_SQL}, p AS (SELECT d.book, d.doc_id, '<div id="part-d' || d.doc_id || '"><p>' || d.escaped || '</p><img src="pic-p.png"/><a href="' || CASE WHEN n.doc_id IS NULL THEN 'd' || (d.doc_id + 1) || '.xhtml#top' ELSE '#part-d' || (d.doc_id + 1) END || '">next</a></div>' AS div FROM docs d LEFT JOIN docs n ON n.doc_id = d.doc_id + 1 AND n.book = d.book)
    SELECT book, md5('<!DOCTYPE html><html><head><meta charset="UTF-8"/><title>Book ' || book || '</title></head><body><div id="wrapper-part" style="{WRAPPER}"><div id="main-part">' || string_agg(div, '' ORDER BY doc_id) || '</div></div></body></html>') AS digest FROM p GROUP BY book""")
def ingest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged books, whose links lead to their own parts and to files beside them."""
    return ingest(shelf(spark, sf_dir, bodies=True))["books"].select("book", F.md5("html").alias("digest"))


@query(f"WITH {_SHELF_SQL} SELECT book, 'Book ' || book AS primary_title, 'A' AS author_string, 'epub' AS type, sum(characters)::BIGINT AS length, 'OPS/img/p.png' AS cover_path FROM c GROUP BY book")
def ingest_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same books as the library lists them."""
    return ingest(shelf(spark, sf_dir, bodies=True))["library"].select("book", "primary_title", "author_string", "type", "length", "cover_path")


@query(f"SELECT DISTINCT {_BOOK_SQL} AS book, 'pic' AS item_id, {_BOOK_SQL} || '/pic-p.png' AS path, false AS missing, 'png' AS content FROM documents")
def join_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that lie beside the merged books."""
    return ingest(shelf(spark, sf_dir))["media"].withColumn("content", F.col("content").cast("string"))


@query(f"WITH {_SHELF_SQL} SELECT book, item_id, length(regexp_replace(escaped, '[^{T.COUNTED_CLASS}]', '', 'g'))::BIGINT AS characters FROM docs")
def raw_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document's XHTML with entities counted by their letters."""
    files = shelf(spark, sf_dir, bodies=True).where("path like 'OPS/d%'")
    items = files.select(F.col("archive").alias("book"), F.regexp_extract("path", r"(d\d+)\.xhtml$", 1).alias("item_id"), F.col("content").cast("string").alias("html"))
    return epub.item_parts(items, raw_entities=True).select("book", "item_id", "characters")


@query("SELECT user_id AS book, floor(arg_max(value, row(ts, event_id)) / 100 * 1000 + 0.5) / 10 AS progress, count(*) AS n FROM events GROUP BY user_id")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as a stream; each batch's changed books are written, and the last state of each is read back."""
    where = scratch(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    sink = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{where}/out/at={n}")
    P.progress_stream(events, f"{where}/checkpoint", sink).awaitTermination()
    out = spark.read.parquet(f"{where}/out")
    return out.groupBy("book").agg(F.max_by(F.struct("progress", "n"), "batch").alias("s")).select("book", "s.progress", "s.n")


#: ``events`` in three steps by their day; of the first ten days some come last, and with ``mixed`` a seventh of all comes one step late.
_STEP_SQL = "least((day(ts) - 1) // 10, 2)"
_ARRIVED_SQL = "CASE WHEN event_id % 50 = 0 AND {step} = 0 THEN 2 {mixed}ELSE {step} END"
_MIXED_SQL = "WHEN event_id % 7 = 0 THEN least({step} + 1, 2) "


def _arrivals_sql(mixed: bool) -> str:
    """Events with their step and ``mark``, the last time of the steps before."""
    step = _ARRIVED_SQL.format(step=_STEP_SQL, mixed=_MIXED_SQL.format(step=_STEP_SQL) if mixed else "")
    return f"a AS (SELECT *, ({step})::INT AS step FROM events), m AS (SELECT step, max(ts) AS top FROM a GROUP BY step), e AS (SELECT a.*, (SELECT max(top) FROM m WHERE m.step < a.step) AS mark FROM a)"


def streamed(spark: SparkSession, sf_dir: str, mixed: bool, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let ``run`` read ``events`` as a stream, of which each step arrives when the one before has been read."""
    where = scratch(spark)
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    step = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    arrived = F.when((F.col("event_id") % 50 == 0) & (step == 0), 2)
    arrived = (arrived.when(F.col("event_id") % 7 == 0, F.least(step + 1, F.lit(2))) if mixed else arrived).otherwise(step)
    for n in range(3):
        events.where(arrived == n).write.mode("append").parquet(where)
        run(spark.readStream.schema(events.schema).parquet(where)).awaitTermination()


@query(f"""WITH {_arrivals_sql(True)} SELECT time_bucket(INTERVAL 1 hour, ts) AS start, user_id AS book, count(*) AS n, round(sum(value), 2) AS total FROM e
    WHERE (mark IS NULL OR time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour > mark - INTERVAL 2 hour) AND time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 2 hour GROUP BY ALL""")
def heartbeat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the events in time, appended when the watermark has passed them; a seventh of the events comes out of order."""
    where = scratch(spark)
    streamed(spark, sf_dir, True, lambda events: P.append_stream(P.heartbeats(events), f"{where}/out", f"{where}/checkpoint"))
    return spark.read.parquet(f"{where}/out").withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 2)})


@query(f"""WITH {_arrivals_sql(False)}, g AS (SELECT *, lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 hour AS opens FROM e WHERE mark IS NULL OR ts + INTERVAL 12 hour > mark - INTERVAL 2 hour WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
    SELECT user_id AS book, min(ts) AS start, max(ts) AS last, floor(arg_max(value, row(ts, event_id)) / 100 * 1000 + 0.5) / 10 AS progress, count(*) AS n FROM s GROUP BY user_id, no
    HAVING max(ts) + INTERVAL 12 hour <= (SELECT max(ts) FROM events) - INTERVAL 2 hour""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of reading, appended when they are over; late events are ignored."""
    where = scratch(spark)
    streamed(spark, sf_dir, False, lambda events: P.append_stream(P.reading_sessions(events), f"{where}/out", f"{where}/checkpoint"))
    return spark.read.parquet(f"{where}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})


@query(f"WITH {_arrivals_sql(True)} SELECT event_id, user_id, coalesce(ts < mark - INTERVAL 2 hour, false) AS late FROM e")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream tells those in time from those that are late."""
    where = scratch(spark)
    schema = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).schema
    streamed(spark, sf_dir, True, lambda events: P.split_late_stream(events, f"{where}/out", f"{where}/checkpoint"))
    told = [P.split_events(spark, f"{where}/out", schema, late).select("event_id", "user_id", F.lit(late).alias("late")) for late in (True, False)]
    return told[0].unionByName(told[1])


_TAGS_SQL = f"SELECT {_BRANDS_SQL} AS dictionary, count(*) AS n FROM part GROUP BY ALL"


@query(_TAGS_SQL)
def import_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives made of ``part`` arrive as files of entries; the stream imports them, and the tags they left are counted."""
    where = scratch(spark)
    tag_entries(spark, sf_dir).write.parquet(f"{where}/in")
    stream = spark.readStream.schema(B.ENTRY).parquet(f"{where}/in")
    P.import_stream(stream, f"{where}/tables", f"{where}/checkpoint").awaitTermination()
    return B.read_table(spark, f"{where}/tables", "tags").groupBy("dictionary").agg(F.count("*").alias("n"))


@query(_TAGS_SQL)
def import_split_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each archive arrive in several batches; it is imported once, when it is whole."""
    where = scratch(spark)
    tag_entries(spark, sf_dir).withColumn("file", F.pmod(F.xxhash64("archive", "path"), F.lit(3))).repartition(3, "file").write.partitionBy("file").parquet(f"{where}/in")
    stream = spark.readStream.schema(B.ENTRY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{where}/in")
    P.held_import_stream(stream, f"{where}/tables", f"{where}/checkpoint", quiet=3).awaitTermination()
    P.finish_held(spark, f"{where}/tables", f"{where}/checkpoint")
    return B.read_table(spark, f"{where}/tables", "tags").groupBy("dictionary").agg(F.count("*").alias("n"))


@query(_TAGS_SQL)
def import_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of archives three times under one id: broken off before it is published, whole, and once more. The tags are there once."""
    where = scratch(spark)
    entries = tag_entries(spark, sf_dir)
    tables = B.import_dictionaries(B.route_entries(entries))
    B.write_dictionaries({"tags": tables["tags"]}, f"{where}/tables", "one")
    for _ in range(2):
        P.import_batch(entries, f"{where}/tables", "one")
    return B.read_table(spark, f"{where}/tables", "tags").groupBy("dictionary").agg(F.count("*").alias("n"))


@query(f"SELECT 'copy' AS kept, count(*) AS tags, count(DISTINCT {_BRANDS_SQL}) AS dictionaries FROM part UNION ALL SELECT 'reset', 0, 0")
def export_and_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported tables are copied, then emptied."""
    where = scratch(spark)
    B.write_dictionaries(B.import_dictionaries(B.route_entries(tag_entries(spark, sf_dir))), f"{where}/tables")
    B.export_tables(spark, f"{where}/tables", f"{where}/copy", ["tags"])
    B.reset_tables(spark, f"{where}/tables", ["tags"])
    counted = lambda name, path: B.read_table(spark, path, "tags").agg(F.lit(name).alias("kept"), F.count("*").alias("tags"), F.count_distinct("dictionary").alias("dictionaries"))
    return counted("copy", f"{where}/copy").unionByName(counted("reset", f"{where}/tables"))
