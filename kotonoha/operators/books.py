"""Books: spines, links, sections, merging, and the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.functions.batches import tasks
from kotonoha.functions.scratch import scratch
from kotonoha.sources import epub
from kotonoha.sources.epub import SKIPPED, XHTML, resolve_path

#: In front of ids of parts of a merged book.
PREFIX = "part"


def resolve_spine(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine positions (book, pos, item_id) with their manifest items."""
    return spine.join(manifest, ["book", "item_id"])


def spine_rejects(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine positions whose item the manifest lacks."""
    return spine.join(manifest.select("book", "item_id"), ["book", "item_id"], "left_anti")


def spine_content(resolved: DataFrame, entries: DataFrame) -> DataFrame:
    """Resolved positions with the content of their file and a ``reject``: ``skipped`` (tables of contents, images), ``type``, ``missing``, or null."""
    joined = resolved.join(entries.select(F.col("archive").alias("book"), F.col("path").alias("href"), F.col("content").cast("string").alias("html")), ["book", "href"], "left")
    return joined.withColumn("reject", F.when(F.col("media_type").isin(SKIPPED), "skipped").when(F.col("media_type") != XHTML, "type").when(F.col("html").isNull(), "missing"))


def scheme(c: Column) -> Column:
    return F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)


def resolve_links(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """Links (book, item_href, value, ...) with ``target`` (manifest item or null), ``resolved`` and ``error``.

    Links without a scheme or with ``file`` become ``!<id>`` and, behind a space, their
    fragment; all others stay. Files that the manifest lacks are errors.
    """
    local = scheme(F.col("value")).isin("", "file")
    path = F.regexp_replace(F.regexp_replace("value", "^file:(//)?", ""), "[?#].*$", "")
    fragment = F.regexp_extract("value", "#(.*)$", 1)
    named = links.withColumns({"local": local, "href": F.when(local, F.when(path == "", F.col("item_href")).otherwise(resolve_path(F.col("item_href"), path)))})
    items = manifest.select("book", "href", F.col("item_id").alias("target"))
    joined = named.join(items, ["book", "href"], "left")
    inner = F.concat(F.lit("!"), "target", F.when(fragment != "", F.concat(F.lit(" #"), fragment)).otherwise(""))
    return joined.withColumns({"resolved": F.when(~F.col("local"), F.col("value")).otherwise(inner), "error": F.when(F.col("local") & F.col("target").isNull(), "not in manifest")})


def inline_links(resolved: DataFrame, spine: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Resolved links (book, attribute, resolved, target, href, perhaps in_svg and error) with ``inlined``, the value for a merged book, and ``error``.

    Links (``href`` outside SVG) to documents of the spine become ``#<prefix>-<id>``, without their
    fragment; those to other items are errors. Media (``src``, and any ``href`` inside SVG) become the
    name of their file beside the book and may not have a fragment. An error in the input stays,
    and what has an error has no value.
    """
    inside = spine.select("book", F.col("item_id").alias("target")).distinct().withColumn("in_spine", F.lit(True))
    joined = resolved.join(inside, ["book", "target"], "left")
    in_svg = F.coalesce(F.col("in_svg"), F.lit(False)) if "in_svg" in resolved.columns else F.lit(False)
    internal = F.coalesce(F.startswith("resolved", F.lit("!")), F.lit(False))
    document = internal & (F.col("attribute") == "href") & ~in_svg
    error = F.when(document & F.col("in_spine").isNull(), "not in spine").when(internal & ~document & F.contains("resolved", F.lit(" #")), "media with fragment")
    if "error" in resolved.columns:
        error = F.coalesce(F.col("error"), error)
    value = F.when(document, F.concat(F.lit(f"#{prefix}-"), "target")).when(internal, asset_name(F.col("target"), F.col("href"))).otherwise(F.col("resolved"))
    return joined.withColumn("error", error).withColumn("inlined", F.when(F.col("error").isNull(), value)).drop("in_spine")


def relinked(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Parts (book, item_id, pieces, links, ...) with their ``body`` made anew from the pieces and the values of ``links`` (book, item_id, no, inlined); a link without a value keeps the one it had."""
    placed = links.groupBy("book", "item_id").agg(F.array_sort(F.collect_list(F.struct("no", "inlined"))).alias("made"))
    joined = parts.join(placed, ["book", "item_id"], "left")
    values = F.zip_with("links.value", "made.inlined", lambda old, new: F.coalesce(new, old))
    return joined.withColumn("values", F.when(F.col("made").isNull(), F.col("links.value")).otherwise(values)).withColumn("body", epub.filled("pieces", "values")).drop("made", "values")


def section_offsets(sections: DataFrame) -> DataFrame:
    """Sections (book, pos, characters) with ``start``: characters before them in the book."""
    before = W.partitionBy("book").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return sections.withColumn("start", F.coalesce(F.sum("characters").over(before), F.lit(0).cast("long")))


def section_chapters(sections: DataFrame, preface: str = "Preface") -> DataFrame:
    """Sections (book, pos, chapter or null) with the last chapter seen; before the first it is ``preface``."""
    seen = W.partitionBy("book").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return sections.withColumn("chapter", F.coalesce(F.last("chapter", ignorenulls=True).over(seen), F.lit(preface)))


def stylesheet_refs(styles: DataFrame) -> DataFrame:
    """(book, pos, item_id, href) -> (book, href, items): in order, the items that use a stylesheet."""
    return styles.groupBy("book", "href").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("u")).select("book", "href", F.col("u.item_id").alias("items"))


def asset_name(item_id: Column, href: Column) -> Column:
    return F.concat(item_id, F.lit("-"), F.regexp_extract(href, "([^/]*)$", 1))


def asset_paths(manifest: DataFrame) -> DataFrame:
    """Manifest items with the name that their file has beside a merged book."""
    return manifest.withColumn("asset", asset_name(F.col("item_id"), F.col("href")))


def join_media(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that lie beside a merged book: (book, item_id, path, content), the path being ``<book>/<asset>``; ``missing`` where the archive has no such entry."""
    media = asset_paths(manifest.where(F.col("media_type") != XHTML))
    files = entries.select(F.col("archive").alias("book"), F.col("path").alias("href"), "content")
    joined = media.join(files, ["book", "href"], "left")
    return joined.select("book", "item_id", F.concat("book", F.lit("/"), "asset").alias("path"), "content", F.col("content").isNull().alias("missing"))


#: Style of the element around all parts.
WRAPPER = "margin: 0 auto; max-width: 100%;"


def merge_parts(parts: DataFrame, prefix: str = PREFIX, style: str = WRAPPER) -> DataFrame:
    """Parts (book, title, pos, item_id, body_class, body) -> (book, title, html), a document for each book with a ``div`` for each part in order. Sizes follow the books, so it belongs at the end of a job."""
    quoted = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    klass = F.when(F.col("body_class").isNotNull(), F.concat(F.lit(' class="'), quoted("body_class"), F.lit('"'))).otherwise("")
    div = F.concat(F.lit(f'<div id="{prefix}-'), quoted("item_id"), F.lit('"'), klass, F.lit(">"), "body", F.lit("</div>"))
    joined = parts.select("book", "title", "pos", div.alias("div")).groupBy("book", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "div"))).alias("d"))
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="UTF-8"/><title>'), quoted(F.coalesce("title", F.lit(""))), F.lit(f'</title></head><body><div id="wrapper-{prefix}" style="{style}"><div id="main-{prefix}">'))
    return joined.select("book", "title", F.concat(head, F.array_join("d.div", ""), F.lit("</div></div></body></html>")).alias("html"))


def book_record(merged: DataFrame) -> DataFrame:
    """Title (the document's) and body of merged books."""
    return merged.select("book", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<body>(.*)</body>", 1).alias("body"))


def chapters_of(packages: DataFrame, manifest: DataFrame, entries: DataFrame, n: int | None = None) -> DataFrame:
    """(book, item_id, chapter): for each item that the table of contents names, the first title it has there. ``n`` is the number of packages, if it is known: where they are few the entries aren't moved."""
    listed = packages.select("book", "version", F.col("toc_id").alias("item_id")).join(manifest.select("book", "item_id", F.col("href").alias("toc_href")), ["book", "item_id"])
    files = entries.select(F.col("archive").alias("book"), F.col("path").alias("toc_href"), F.col("content").cast("string").alias("xml"))
    contents = (listed if n is None else epub.few(listed, n)).join(files, ["book", "toc_href"])
    named = epub.toc_entries(contents.select("book", "version", "xml")).join(contents.select("book", "toc_href"), "book")
    placed = named.withColumn("href", resolve_path(F.col("toc_href"), F.regexp_replace("target", "[?#].*$", ""))).join(manifest.select("book", "href", "item_id"), ["book", "href"])
    return placed.groupBy("book", "item_id").agg(F.min_by("title", "no").alias("chapter"))


def library_rows(packages: DataFrame, manifest: DataFrame, sections: DataFrame) -> DataFrame:
    """The books as the library lists them: book, primary_title, other_titles, author_string, type, length (counted characters), cover_path."""
    lengths = sections.groupBy("book").agg(F.sum("characters").alias("length"))
    covers = packages.select("book", F.col("cover_id").alias("item_id")).join(manifest, ["book", "item_id"]).select("book", F.col("href").alias("cover_path"))
    named = packages.select("book", F.get("titles", F.lit(0)).alias("primary_title"), F.slice("titles", F.lit(2), F.greatest(F.size("titles") - 1, F.lit(0))).alias("other_titles"), F.array_join("authors", ", ").alias("author_string"), F.lit("epub").alias("type"))
    return named.join(lengths, "book", "left").join(covers, "book", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))


def ingest_books(entries: DataFrame, prefix: str = PREFIX, work: str | None = None) -> dict[str, DataFrame]:
    """EPUB entries (archive, path, content) -> packages, sections (with characters, start and chapter), parts (bodies with their links rewritten), links (resolved and inlined), media, stylesheets, rejects, library and merged books.

    All but the packages, the library and the merged books are keyed by (book, item), so that
    large books are many rows; a merged book is one row. Packages are read once, and XHTML files are
    walked once: what was found in them is written to ``work`` (the scratch folder where it is not
    given), from which all that follows reads its own columns. ``entries`` are read several times, and moved
    once, to the places that the spines give their XHTML files.
    """
    spark, work = entries.sparkSession, work or scratch(entries.sparkSession)
    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    packages = kept(epub.parse_package(epub.read_epubs(entries).repartition(tasks(spark), "book")), "packages")
    usable = packages.where("error is null")
    manifest, spine = epub.manifest_rows(usable), epub.spine_rows(usable)
    content = spine_content(resolve_spine(spine, manifest), entries)
    walked = epub.item_parts(content.where("reject is null").withColumn("item_href", F.col("href")), keep=["pos", "item_href"])
    parts = kept(walked.drop("body"), "parts")  # the pieces hold the body
    links = parts.select("book", "item_id", "item_href", F.posexplode("links").alias("no", "l")).select("book", "item_id", "item_href", "no", "l.*")
    inlined = inline_links(resolve_links(links, manifest), spine, prefix)
    styles = parts.select("book", "pos", "item_id", F.explode("stylesheets").alias("link"), "item_href").select("book", "pos", "item_id", resolve_path(F.col("item_href"), F.col("link")).alias("href"))
    rejects = spine_rejects(spine, manifest).select("book", "item_id", F.lit("not in manifest").alias("reason")).unionByName(content.where("reject is not null").select("book", "item_id", F.col("reject").alias("reason")))
    titled = parts.select("book", "pos", "item_id", "characters").join(chapters_of(usable, manifest, entries, packages.count()), ["book", "item_id"], "left")
    sections = section_chapters(section_offsets(titled))
    bodies = relinked(parts, inlined).select("book", "pos", "item_id", "body_class", "body")
    merged = merge_parts(bodies.join(usable.select("book", F.get("titles", F.lit(0)).alias("title")), "book"), prefix)
    return {"packages": packages, "sections": sections, "parts": bodies, "links": inlined, "media": join_media(manifest, entries), "stylesheets": stylesheet_refs(styles), "rejects": rejects, "library": library_rows(usable, manifest, sections), "books": merged}


def search_books(books: DataFrame, title: str | None = None, kind: str = "epub") -> DataFrame:
    found = books.where(F.col("type") == kind)
    return found.where(F.contains("primary_title", F.lit(title))) if title else found


def book_exists(candidates: DataFrame, books: DataFrame, conflicting: bool = False) -> DataFrame:
    """Candidates whose title (with ``conflicting``: whose hash and title) the library has."""
    return candidates.join(books, ["file_hash", "primary_title"] if conflicting else ["primary_title"], "left_semi")


def merge_library(books: DataFrame, added: DataFrame) -> DataFrame:
    """The library with books added at progress 0; books it has stay as they are."""
    new = added.join(books, ["file_hash", "primary_title"], "left_anti").withColumn("current_progress", F.lit(0.0))
    return books.unionByName(new, allowMissingColumns=True)


def book_progress(books: DataFrame) -> DataFrame:
    return books.withColumn("share", F.when(F.col("length") > 0, F.col("current_progress") / F.col("length")).otherwise(0.0))


def update_progress(books: DataFrame, updates: DataFrame) -> DataFrame:
    """Books with the last progress of ``updates`` (primary_title, progress, at); titles without a book are ignored."""
    last = updates.groupBy("primary_title").agg(F.max_by("progress", F.struct("at", "progress")).alias("progress"))
    return books.join(last, "primary_title", "left").withColumn("current_progress", F.coalesce("progress", "current_progress")).drop("progress")


def unknown_updates(books: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.select("primary_title").distinct().join(books, "primary_title", "left_anti")
