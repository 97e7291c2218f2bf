"""EPUB archives: package documents, manifests, spines, and parts of XHTML items."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.batches import slices
from kotonoha.functions.text import count_characters

# Media types, package versions, and attributes that refer to files.
EPUB, OPF, XHTML = "application/epub+zip", "application/oebps-package+xml", "application/xhtml+xml"
SKIPPED = ["application/x-dtbncx+xml", "image/svg+xml"]
VERSIONS = ["2.0", "3.0"]
REFERENCES = ("src", "href", "xlink:src", "xlink:href")
UNCOUNTED = ("rt", "rp")

#: Rows of short texts, one for each book, that may be broadcast.
FEW = 200_000

_PACKAGE = "`_version` string, manifest struct<item: array<struct<`_id`: string, `_href`: string, `_media-type`: string, `_properties`: string>>>, spine struct<`_toc`: string, itemref: array<struct<`_idref`: string>>>"


def resolve_path(base: Column, href: Column) -> Column:
    """``href`` as seen from the file ``base``: absolute paths as they are, others from base's folder, without ``.`` and ``..``."""
    whole = F.when(F.startswith(href, F.lit("/")), href).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), href))
    step = lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def read_epubs(entries: DataFrame) -> DataFrame:
    """(archive, path, content) -> (book, opf_path, opf) of archives whose mimetype entry names EPUB: the first package that the container lists."""
    text = entries.withColumn("xml", F.col("content").cast("string"))
    named = text.where((F.col("path") == "mimetype") & F.contains("xml", F.lit(EPUB))).select("archive")
    container = text.where("path = 'META-INF/container.xml'")
    roots = container.join(named, "archive", "left_semi").select("archive", F.xpath_string("xml", F.lit(f"container/rootfiles/rootfile[@media-type='{OPF}'][1]/@full-path")).alias("path"))
    return few(roots, container.count()).join(text, ["archive", "path"]).select(F.col("archive").alias("book"), F.col("path").alias("opf_path"), F.col("xml").alias("opf"))


def few(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` marked to be broadcast if they are at most ``n`` and that isn't many, so that the contents that they meet aren't moved."""
    return F.broadcast(rows) if n <= FEW else rows


def _metadata(name: str) -> Column:
    return F.xpath("opf", F.lit(f"package/metadata/*[name()='dc:{name}' or name()='{name}']/text()"))


def parse_package(epubs: DataFrame) -> DataFrame:
    """Adds version, titles, authors, identifier, toc_id, cover_id, manifest (array) and spine (array of ids); other versions give an ``error``."""
    read = epubs.withColumn("p", F.from_xml("opf", _PACKAGE))
    manifest = F.transform("p.manifest.item", lambda i: F.struct(i["_id"].alias("item_id"), resolve_path(F.col("opf_path"), i["_href"]).alias("href"), i["_media-type"].alias("media_type"), F.coalesce(i["_properties"], F.lit("")).alias("properties")))
    having = lambda word: F.get(F.filter("manifest", lambda i: F.array_contains(F.split(i["properties"], " "), word)), 0)["item_id"]
    guide = F.get(F.filter("manifest", lambda i: i["href"] == resolve_path(F.col("opf_path"), F.xpath_string("opf", F.lit("package/guide/reference[@type='cover']/@href")))), 0)["item_id"]
    meta = F.nullif(F.xpath_string("opf", F.lit("package/metadata/meta[@name='cover']/@content")), F.lit(""))
    v3 = F.col("version") == "3.0"
    out = read.withColumns({"version": F.col("p._version"), "manifest": manifest}).withColumns({
        "titles": _metadata("title"), "authors": _metadata("creator"), "identifier": F.xpath_string("opf", F.lit("package/metadata/*[@id=/package/@unique-identifier]/text()")),
        "spine": F.transform("p.spine.itemref", lambda r: r["_idref"]), "toc_id": F.when(v3, having("nav")).otherwise(F.col("p.spine._toc")), "cover_id": F.when(v3, having("cover-image")).otherwise(F.coalesce(meta, guide)),
        "error": F.when(~F.col("version").isin(VERSIONS) | F.col("version").isNull(), F.concat(F.lit("version "), F.coalesce("version", F.lit("none")))),
    })
    return out.drop("p", "opf")


def manifest_rows(packages: DataFrame) -> DataFrame:
    return packages.select("book", F.explode("manifest").alias("m")).select("book", "m.*")


def spine_rows(packages: DataFrame) -> DataFrame:
    return packages.select("book", F.posexplode("spine").alias("pos", "item_id"))


def toc_entries(documents: DataFrame) -> DataFrame:
    """(book, version, xml) -> (book, no, title, target): anchors of the nav document, or labels of the ncx."""
    nav = F.arrays_zip(F.xpath("xml", F.lit("//nav//a/@href")).alias("target"), F.xpath("xml", F.lit("//nav//a/text()")).alias("title"))
    ncx = F.arrays_zip(F.xpath("xml", F.lit("//navPoint/content/@src")).alias("target"), F.xpath("xml", F.lit("//navPoint/navLabel/text/text()")).alias("title"))
    return documents.select("book", F.posexplode(F.when(F.col("version") == "3.0", nav).otherwise(ncx)).alias("no", "t")).select("book", "no", "t.title", "t.target")


_ATTRIBUTE = re.compile(r"""\s([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


class _Parts(HTMLParser):
    """One walk over an XHTML item: its links, its counted text, and its body's child elements, cut where the links' values stand."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, raw_entities: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.raw_entities = raw_entities
        self.open: list[str] = []
        self.links: list[tuple[str, str, str, bool]] = []
        self.styles: list[str] = []
        self.body_class: str | None = None
        self.counted: list[str] = []
        self.pieces: list[list[str]] = [[]]

    def _inside(self) -> bool:
        return "body" in self.open

    def _cut(self, tag: str) -> None:
        """The text of a start tag, cut at the values of the attributes that refer to files."""
        text, at = self.get_starttag_text() or "", 0
        for m in _ATTRIBUTE.finditer(text):
            if (name := m[1].lower()) in REFERENCES:
                value = m[2]
                self.pieces[-1].append(f'{text[at : m.start(2)]}"')
                self.pieces.append(['"'])
                self.links.append((tag, name, unescape(value[1:-1] if value[0] in "\"'" else value), "svg" in self.open or tag == "svg"))
                at = m.end(2)
        self.pieces[-1].append(text[at:])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag == "body":
            self.body_class = given.get("class")
        elif self._inside():
            self._cut(tag)
        elif tag == "link" and given.get("rel") == "stylesheet" and given.get("href"):
            self.styles.append(given["href"])
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if self._inside():
                self.pieces[-1].append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        inside = self.open[self.open.index("body") + 1 :] if self._inside() else []
        if inside:
            self.pieces[-1].append(data if self.cdata_elem else escape(data, quote=False))
            if "p" in inside and inside[-1] not in UNCOUNTED:
                self.counted.append(escape(data, quote=False) if self.raw_entities else data)


#: What a walk finds, as Arrow's types.
_LINK = pa.struct([("tag", pa.string()), ("attribute", pa.string()), ("value", pa.string()), ("in_svg", pa.bool_())])
_FOUND = {"counted": pa.string(), "body_class": pa.string(), "pieces": pa.list_(pa.string()), "links": pa.list_(_LINK), "stylesheets": pa.list_(pa.string())}


def item_parts(items: DataFrame, raw_entities: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(book, item_id, html) -> (book, item_id, characters, body_class, body, pieces, links, stylesheets), and the columns ``keep`` as they are.

    ``characters`` counts the text of paragraphs but for ruby readings; entities are decoded
    first, or, with ``raw_entities``, counted by their letters. Text directly in the body is dropped.
    ``pieces`` is the body cut at the values of its ``links`` (one piece more than links), into
    which ``books.relinked`` puts others; ``body`` has the values as they were.
    """
    schema = "book string, item_id string, counted string, body_class string, pieces array<string>, links array<struct<tag:string,attribute:string,value:string,in_svg:boolean>>, stylesheets array<string>"
    schema = ", ".join([schema, *[f"`{c}` {items.schema[c].dataType.simpleString()}" for c in keep]])

    def walked(html: str | None) -> tuple:
        p = _Parts(raw_entities)
        p.feed(html or "")
        p.close()
        return "".join(p.counted), p.body_class, ["".join(x) for x in p.pieces], [dict(zip(("tag", "attribute", "value", "in_svg"), x)) for x in p.links], p.styles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_size"):  # rows may be long: a batch holds a bounded number of characters, not of rows
            found = zip(*[walked(html.as_py()) for html in batch.column("html")], strict=True)
            arrays = [pa.array(list(values), kind) for values, kind in zip(found, _FOUND.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("book"), batch.column("item_id"), *arrays, *[batch.column(c) for c in keep]], names=["book", "item_id", *_FOUND, *keep])

    given = items.select(F.col("book").cast("string").alias("book"), F.col("item_id").cast("string").alias("item_id"), F.length("html").alias("_size"), "html", *keep)
    return given.mapInArrow(run, schema).select("book", "item_id", count_characters(F.col("counted")).cast("long").alias("characters"), "body_class", filled("pieces", "links.value").alias("body"), "pieces", "links", "stylesheets", *keep)


def filled(pieces: str, values: str) -> Column:
    """Pieces of markup with the values of attributes between them, escaped. A null value is an empty one."""
    quoted = lambda v: F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(F.coalesce(p, F.lit("")), quoted(v))), "")
