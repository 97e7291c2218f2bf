from __future__ import annotations

import io
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kotonoha.functions.scratch import clear, scratch, scratch_root
from kotonoha.operators import books as K
from kotonoha.sources import banks as B
from kotonoha.sources import epub
from kotonoha.streaming import progress as P


def pack(files: dict[str, object]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in files.items():
            z.writestr(name, content if isinstance(content, (str, bytes)) else json.dumps(content, ensure_ascii=False))
    return buffer.getvalue()


def index(title, **more):
    return {"title": title, "revision": "1", **more}


ARCHIVES = {
    "good": {
        "index.json": index("Good", format=3, frequencyMode="rank-based", sequenced=True),
        "styles.css": "p{}",
        "term_bank_1.json": [["食べる", "たべる", "v1 x", "v1", 3, ["eat", {"type": "text", "text": "to eat"}, ["食う", ["-"]]], 7, "n  p"], ["猫", "", None, "", 1.5, [{"type": "structured-content", "content": "x"}], 8, ""]],
        "term_bank_2.json": [["犬", "いぬ", "", "", 0, ["dog"], 9, ""]],
        "term_meta_bank_1.json": [["a", "freq", 5], ["b", "freq", "12x"], ["c", "freq", {"value": 3, "displayValue": "三"}], ["d", "freq", {"reading": "ディ", "frequency": {"value": 9}}], ["p", "pitch", {"reading": "ピ", "pitches": [{"position": 2, "nasal": 1, "devoice": [1, 2], "tags": ["t"]}, {"position": 0}]}], ["i", "ipa", {"reading": "イ", "transcriptions": [{"ipa": "[i]"}]}]],
        "kanji_bank_1.json": [["猫", "ビョウ", "ねこ", "t1", ["cat"], {"strokes": 11}]],
        "kanji_meta_bank_1.json": [["猫", "freq", {"value": 3}]],
        "tag_bank_1.json": [["n", "pos", 1, "noun", 2.5]],
        "img/x.png": b"\x89",
        "odd_bank_1.json": [],
    },
    "old": {"index.json": index("Old", version=1), "term_bank_1.json": [["食う", "", "t", "v5", 1, "d1", "d2"], [["飲む", "のむ", "t", "v5", 1], "d3"]], "kanji_bank_1.json": [["犬", "ケン", "いぬ", "t", "dog"]]},
    "no_index": {"term_bank_1.json": []},
    "format2": {"index.json": index("Two", format=2)},
    "gap": {"index.json": index("Gap", format=3), "term_bank_2.json": []},
    "narrow": {"index.json": index("Narrow", format=3), "tag_bank_1.json": [["n", "pos", 1, "noun"]]},
    "broken": {"index.json": "{", "tag_bank_1.json": []},
    "short": {"index.json": index("Short", format=3), "term_bank_1.json": '[["a", "", "", "", 1, ["x"], 1, ""], ["b", "",', "term_bank_2.json": [["c", "", "", "", 1, ["x"], 1, ""]]},
    "types": {"index.json": index("Types", format=3), "term_bank_1.json": [["a", "", "", "", "1", ["x"], 1, ""]]},
    "new_in_old": {"index.json": index("Mixed", version=1), "kanji_bank_1.json": [["犬", "ケン", 7, "t"]]},
    "language": {"index.json": index("Language", format=3, sourceLanguage="english")},
    "mode": {"index.json": index("Mode", format=3, frequencyMode="other")},
    "meta": {"index.json": index("Meta", format=3), "term_meta_bank_1.json": [["a", "pitch", {"reading": "x"}]]},
    "empty": {"index.json": index("Empty", format=3, targetLanguage="ja"), "term_bank_1.json": []},
}


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    for name, files in ARCHIVES.items():
        (folder / f"{name}.zip").write_bytes(pack(files))
    read = B.read_archives(spark, str(folder)).withColumn("archive", F.regexp_extract("archive", r"(\w+)\.zip$", 1))
    return B.route_entries(read).cache()


def test_routing_and_checks(entries):
    kinds = {(r.archive, r.path): (r.kind, r.bank_no) for r in entries.collect()}
    assert kinds["good", "term_bank_2.json"] == ("term_bank", 2) and kinds["good", "img/x.png"] == ("media", None) and kinds["good", "odd_bank_1.json"] == ("ignored", None) and kinds["good", "index.json"][0] == "index"
    assert {r.archive: r.reason for r in B.validate_archive(entries).collect()} == {
        "good": None, "old": None, "no_index": "index", "format2": "format", "gap": "numbering", "narrow": "items", "broken": "index", "short": "items", "types": "items", "new_in_old": "items", "language": "index", "mode": "index", "meta": "items", "empty": None,
    }


def test_import_write_and_import_again(spark, entries, tmp_path):
    tables = B.import_dictionaries(entries)
    terms = {r.term: r for r in tables["terms"].collect()}
    assert terms["食べる"].definitions == ['"eat"', '{"type":"text","text":"to eat"}', '["食う",["-"]]'] and terms["食べる"].term_tags == ["n", "p"] and terms["食べる"].sequence_number == 7
    assert terms["猫"].definition_tags == [] and terms["猫"].reading == "" and terms["猫"].popularity == 1.5
    assert terms["食う"].reading == "食う" and terms["食う"].definitions == ['"d1"', '"d2"'] and terms["飲む"].definitions == ['"d3"'] and terms["飲む"].sequence_number == 0
    assert {r.dictionary for r in terms.values()} == {"Good", "Old"}
    meta = {(r.term, r.downstep_position): r for r in tables["terms_meta"].collect()}
    assert meta["a", None].frequency == 5 and meta["b", None].display_frequency == "12x" and meta["c", None].display_frequency == "三" and meta["d", None].reading == "ディ" and meta["d", None].frequency == 9
    assert meta["p", 2].nasal_positions == [1] and meta["p", 2].devoice_positions == [1, 2] and meta["p", 0].tags == [] and meta["i", None].transcription == "[i]"
    assert {r.kanji: r.stats for r in tables["kanji"].collect()} == {"猫": {"strokes": "11"}, "犬": {}}
    d = {r.title: r for r in tables["dictionaries"].collect()}
    assert d["Good"].frequency_mode == "rank" and d["Good"].css_style == "p{}" and d["Good"].sequenced and d["Old"].format == 1
    B.write_dictionaries(tables, str(tmp_path))
    assert B.read_table(spark, str(tmp_path), "terms").count() == 5
    again = B.import_dictionaries(entries, B.read_table(spark, str(tmp_path), "dictionaries"))
    assert all(df.count() == 0 for df in again.values())
    B.export_tables(spark, str(tmp_path), f"{tmp_path}/copy", ["terms"])
    B.reset_tables(spark, str(tmp_path), ["terms"])
    assert B.read_table(spark, f"{tmp_path}/copy", "terms").count() == 5 and B.read_table(spark, str(tmp_path), "terms").count() == B.read_table(spark, str(tmp_path), "dictionaries").count() == 0


def test_an_import_that_breaks_off_shows_nothing(spark, entries, tmp_path):
    some = entries.where("archive in ('good', 'old')").select("archive", "path", "content")
    tables, path, told = B.import_dictionaries(B.route_entries(some)), str(tmp_path), []
    B.write_dictionaries({"dictionaries": tables["dictionaries"].limit(0), "terms": tables["terms"].limit(0)}, path, "zero")
    B.write_dictionaries({"terms": tables["terms"]}, path, "one")
    assert B.read_table(spark, path, "terms").count() == 0
    assert P.import_batch(some, path, "one", lambda d: told.append(d.count())) and not P.import_batch(some, path, "one")
    assert B.read_table(spark, path, "terms").count() == 5 and B.read_table(spark, path, "dictionaries").count() == 2 and told == [2]


def test_an_import_clears_its_scratch_folder(spark, entries, tmp_path):
    held = lambda: set(Path(scratch_root(spark)).glob("scratch-*"))
    before = held()
    assert P.import_batch(entries.where("archive = 'old'").select("archive", "path", "content"), str(tmp_path), "one") and held() == before
    where = scratch(spark)
    assert len(held()) == len(before) + 1
    clear(spark, where)
    assert held() == before
    with pytest.raises(ValueError, match="not a scratch folder"):
        clear(spark, str(tmp_path))


def test_files_are_written(spark, tmp_path):
    files = spark.createDataFrame([("a/x.bin", bytearray(b"1")), ("a/b/y.bin", bytearray(b"2")), ("none", None)], "path string, content binary")
    assert B.write_files(files, str(tmp_path)) == 2 and (tmp_path / "a/b/y.bin").read_bytes() == b"2" and not (tmp_path / "none").exists()
    with pytest.raises(Exception, match="not inside the folder"):
        B.write_files(spark.createDataFrame([("a/../../x", bytearray(b"1"))], "path string, content binary"), str(tmp_path))


def test_media(spark, entries):
    declared = spark.createDataFrame([("good", "img/x.png"), ("good", "img/y.png")], "archive string, path string")
    assert {r.path: r.missing for r in B.extract_media(entries, declared).collect()} == {"img/x.png": False, "img/y.png": True}


CONTAINER = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
META = '<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="u">ID</dc:identifier><dc:title id="t">本</dc:title><dc:title>Two</dc:title><dc:creator>A</dc:creator>{}</metadata>'
ITEMS = '<item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="./text/../c2.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="i/p.png" media-type="image/png"{}/>'
PAGE = '<html><head><link rel="stylesheet" href="../s.css"/></head><body class="b">loose<p>漢<ruby>字<rt>じ</rt></ruby>A &amp; b</p><a href="../c2.xhtml#x">n</a><img src="../i/p.png"/><a href="http://e.org/">e</a><a href="gone.xhtml">g</a></body></html>'


def book(version: str, meta: str = "", attributes: str = "", spine: str = "", more: str = "") -> dict[str, object]:
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" version="{version}" unique-identifier="u">{META.format(meta)}<manifest>{ITEMS.format(attributes)}{more}</manifest><spine {spine}><itemref idref="c2"/><itemref idref="c1"/><itemref idref="lost"/></spine></package>'
    return {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OPS/p.opf": opf, "OPS/text/c1.xhtml": PAGE, "OPS/c2.xhtml": "<html><body><p>x</p></body></html>"}


@pytest.fixture(scope="module")
def shelf(spark):
    nav = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav scripted"/>'
    books = {"v3": book("3.0", attributes=' properties="cover-image"', more=nav), "v2": book("2.0", meta='<meta name="cover" content="pic"/>', spine='toc="ncx"'), "bare": book("2.0"), "new": book("4.0"), "not": {"mimetype": "text/plain", "META-INF/container.xml": CONTAINER}}
    rows = [(b, p, bytearray(c.encode())) for b, files in books.items() for p, c in files.items()]
    return spark.createDataFrame(rows, B.ENTRY)


def test_packages(shelf):
    got = {r.book: r for r in epub.parse_package(epub.read_epubs(shelf)).collect()}
    assert set(got) == {"v3", "v2", "bare", "new"}
    v3 = got["v3"]
    assert v3.titles == ["本", "Two"] and v3.authors == ["A"] and v3.identifier == "ID" and v3.toc_id == "nav" and v3.cover_id == "pic" and v3.spine == ["c2", "c1", "lost"] and v3.error is None
    assert {m.item_id: m.href for m in v3.manifest} == {"c1": "OPS/text/c1.xhtml", "c2": "OPS/c2.xhtml", "pic": "OPS/i/p.png", "nav": "OPS/nav.xhtml"}
    assert got["v2"].toc_id == "ncx" and got["v2"].cover_id == "pic" and got["bare"].cover_id is None and got["new"].error == "version 4.0"


def test_from_spine_to_merged_book(shelf):
    packages = epub.parse_package(epub.read_epubs(shelf)).where("book = 'v3'")
    manifest, spine = epub.manifest_rows(packages), epub.spine_rows(packages)
    assert [r.item_id for r in K.spine_rejects(spine, manifest).collect()] == ["lost"]
    content = K.spine_content(K.resolve_spine(spine, manifest), shelf)
    assert {(r.pos, r.reject) for r in content.collect()} == {(0, None), (1, None)}
    parts = epub.item_parts(content)
    rows = {r.item_id: r for r in parts.collect()}
    assert rows["c1"].characters == 4 and rows["c1"].body_class == "b" and rows["c1"].stylesheets == ["../s.css"] and "loose" not in rows["c1"].body and len(rows["c1"].links) == 4
    links = content.join(parts.select("book", "item_id", "links"), ["book", "item_id"]).select("book", F.col("href").alias("item_href"), F.explode("links").alias("l")).select("book", "item_href", "l.*")
    resolved = K.resolve_links(links, manifest)
    got = {r.value: (r.resolved, r.error) for r in resolved.collect()}
    assert got == {"../c2.xhtml#x": ("!c2 #x", None), "../i/p.png": ("!pic", None), "http://e.org/": ("http://e.org/", None), "gone.xhtml": (None, "not in manifest")}
    inlined = {r.value: (r.inlined, r.error) for r in K.inline_links(resolved.drop("error"), spine, "k").collect()}
    assert inlined["../c2.xhtml#x"] == ("#k-c2", None) and inlined["../i/p.png"] == ("pic-p.png", None) and inlined["http://e.org/"] == ("http://e.org/", None)
    merged = K.merge_parts(parts.join(content.select("book", "item_id", "pos"), ["book", "item_id"]).withColumn("title", F.lit("本")), "k").first()
    assert merged.html.index('id="k-c2"') < merged.html.index('<div id="k-c1" class="b">') and "<title>本</title>" in merged.html


def test_parts_keep_their_markup(spark):
    html = '<html><body><p title="a href=b">1 &lt; 2 &amp; 3</p><svg viewBox="0 0 1 1"><image xlink:href="x.png"/></svg><A HREF=\'q?a=1&amp;b=2\' id="k">t</A><script>a < b</script></body></html>'
    part = epub.item_parts(spark.createDataFrame([("b", "i", html)], "book string, item_id string, html string")).first()
    assert [(x.tag, x.attribute, x.value, x.in_svg) for x in part.links] == [("image", "xlink:href", "x.png", True), ("a", "href", "q?a=1&b=2", False)]
    assert part.body == '<p title="a href=b">1 &lt; 2 &amp; 3</p><svg viewBox="0 0 1 1"><image xlink:href="x.png"/></svg><A HREF="q?a=1&amp;b=2" id="k">t</a><script>a < b</script>' and part.characters == 3
    raw = epub.item_parts(spark.createDataFrame([("b", "i", html)], "book string, item_id string, html string"), raw_entities=True).first()
    assert raw.characters == 8


def test_ingested_books(spark, shelf):
    picture = spark.createDataFrame([("v3", "OPS/i/p.png", bytearray(b"p")), ("v3", "OPS/nav.xhtml", bytearray(b'<html><body><nav><a href="text/c1.xhtml">One</a><a href="text/c1.xhtml#b">Again</a></nav></body></html>'))], B.ENTRY)
    got = K.ingest_books(shelf.unionByName(picture), "k")
    html = {r.book: r.html for r in got["books"].collect()}
    assert set(html) == {"v3", "v2", "bare"} and '<a href="#k-c2">n</a><img src="pic-p.png"/><a href="http://e.org/">e</a><a href="gone.xhtml">g</a>' in html["v3"]
    assert {r.item_id: r.chapter for r in got["sections"].where("book = 'v3'").collect()} == {"c1": "One", "c2": "Preface"}
    media = {(r.book, r.path): (r.content and bytes(r.content), r.missing) for r in got["media"].collect()}
    assert media["v3", "v3/pic-p.png"] == (b"p", False) and media["bare", "bare/pic-p.png"] == (None, True)
    library = {r.book: r for r in got["library"].collect()}
    assert library["v3"].primary_title == "本" and library["v3"].other_titles == ["Two"] and library["v3"].length == 5 and library["v3"].cover_path == "OPS/i/p.png" and library["bare"].cover_path is None
    assert {r.error for r in got["links"].collect()} == {None, "not in manifest"}


def test_sections(spark):
    rows = [(1, p, n, c) for p, (n, c) in enumerate([(5, None), (3, "One"), (0, None), (4, "Two"), (2, None)])]
    df = spark.createDataFrame(rows, "book int, pos int, characters long, chapter string")
    starts = [r.start for r in K.section_offsets(df).orderBy("pos").collect()]
    assert starts == [0, 5, 8, 8, 12] and starts[-1] + 2 == 14
    assert [r.chapter for r in K.section_chapters(df).orderBy("pos").collect()] == ["Preface", "One", "One", "Two", "Two"]


def test_library(spark):
    books = spark.createDataFrame([("h1", "A", "epub", 10, 5.0), ("h2", "B", "manga", 0, 0.0)], "file_hash string, primary_title string, type string, length long, current_progress double")
    added = spark.createDataFrame([("h1", "A", "epub", 10), ("h3", "A", "epub", 7)], "file_hash string, primary_title string, type string, length long")
    assert sorted((r.file_hash, r.current_progress) for r in K.merge_library(books, added).collect()) == [("h1", 5.0), ("h2", 0.0), ("h3", 0.0)]
    updates = spark.createDataFrame([("A", 7.0, 2), ("A", 6.0, 1), ("Z", 1.0, 1)], "primary_title string, progress double, at int")
    assert {r.primary_title: r.current_progress for r in K.update_progress(books, updates).collect()} == {"A": 7.0, "B": 0.0}
    assert [r.primary_title for r in K.unknown_updates(books, updates).collect()] == ["Z"]
    assert K.book_exists(added, books).count() == 2 and K.book_exists(added, books, conflicting=True).count() == 1
    assert {r.primary_title: r.share for r in K.book_progress(books).collect()} == {"A": 0.5, "B": 0.0}


def test_progress_as_stream_and_batch_agree(spark, tmp_path):
    rows = [(i, 1_700_000_000 + i * 977 % 9000, i % 5, float(i * 7 % 101)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{tmp_path}/in")
    seen: dict = {}
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    P.progress_stream(stream, f"{tmp_path}/cp", lambda b, _: seen.update({r.book: (r.progress, r.n) for r in b.collect()})).awaitTermination()
    assert seen == {r.book: (r.progress, r.n) for r in P.latest_progress(events).collect()}


def test_imports_as_stream(spark, entries, tmp_path):
    entries.select("archive", "path", "content").where("archive in ('good', 'old')").coalesce(1).write.parquet(f"{tmp_path}/in")
    told: list = []
    for _ in range(2):
        P.import_stream(spark.readStream.schema(B.ENTRY).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/cp", lambda d: told.append(d)).awaitTermination()
    assert B.read_table(spark, f"{tmp_path}/t", "terms").count() == 5 and len(told) == 1


def test_large_archives_are_split(spark):
    from kotonoha.queries.bank_queries import archives_of
    from kotonoha.queries.flow_queries import unpacked, zips

    items = [(("a" if i < 900 else "b"), f'["n{i}","x",1,"y",2]') for i in range(905)]
    banks = archives_of(spark.createDataFrame(items, "archive string, item string"), "tag_bank", most=50).cache()
    found = sorted((r.archive, r.bank_no, bytes(r.content).count(b"[") - 1) for r in banks.collect())
    assert [n for a, n, _ in found if a == "a"] == list(range(1, 19)) and [x for x in found if x[0] == "b"] == [("b", 1, 5)]
    assert max(n for *_, n in found) < 150
    names = [r.path.split("/")[0] for r in zips(banks, most=4).collect()]
    assert names.count("a") > 1 and names.count("b") == 1
    tags = B.parse_tag_bank(B.bank_items(B.route_entries(unpacked(spark, banks, most=4)), "tag_bank"))
    assert sorted((r.archive, r.tag) for r in tags.select("archive", "tag").collect()) == sorted((a, f"n{i}") for i, (a, _) in enumerate(items))


def _zip(files: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return buffer.getvalue()


def _dictionary(title: str, *terms: str, definition: str = '"d"') -> dict[str, str]:
    items = ",".join(f'["{t}","","","",1,[{definition}],1,""]' for t in terms)
    return {"index.json": f'{{"title":"{title}","revision":"1","format":3}}', "term_bank_1.json": f"[{items}]", "img/a.png": "png"}


def test_broken_zips_are_reasons(spark, tmp_path):
    """A good archive is imported beside one that is no zip, one cut short, one with a torn member and one that is encrypted."""
    good = _zip(_dictionary("good", "a", "b"))
    torn = bytearray(_zip(_dictionary("torn", *map(str, range(200)))))
    at = torn.index(b"term_bank_1.json") + 40
    torn[at : at + 20] = bytes(20)
    locked = bytearray(_zip({"index.json": "{}"}))
    for sign, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(sign) + offset] |= 1
    for name, data in {"good": good, "none": b"no zip", "short": good[:-30], "torn": bytes(torn), "locked": bytes(locked)}.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    entries = B.route_entries(B.read_archives(spark, str(tmp_path)))
    got = {r.archive.rsplit("/", 1)[1]: r.reason for r in B.validate_archive(entries).collect()}
    assert got == {"good.zip": None, "none.zip": "zip", "short.zip": "zip", "torn.zip": "zip", "locked.zip": "zip"}
    tables = B.import_dictionaries(entries)
    assert [r.title for r in tables["dictionaries"].collect()] == ["good"] and tables["terms"].count() == 2
    assert [(r.dictionary, r.path, bytes(r.content)) for r in tables["media"].collect()] == [("good", "img/a.png", b"png")]
    assert B.read_archives(spark, str(tmp_path), errors=False).where(F.col("path") == B.BROKEN).count() == 0


def test_one_title_twice(spark, tmp_path):
    """In one batch the archive with the smallest name; of two writers the first to commit; a number without a name is passed over."""
    frame = lambda archives: B.route_entries(spark.createDataFrame([(a, p, bytearray(c.encode())) for a, files in archives.items() for p, c in files.items()], B.ENTRY))
    path = str(tmp_path / "t")
    one = B.import_dictionaries(frame({"x2": _dictionary("same", "late"), "x1": _dictionary("same", "early"), "y": _dictionary("other", "o")}))
    two = B.import_dictionaries(frame({"z": _dictionary("same", "second"), "w": _dictionary("third", "t")}))  # began before the first was published
    B.write_dictionaries(one, path, "a")
    (tmp_path / "t" / "commits" / "000000001").write_bytes(b"")
    B.write_dictionaries(two, path, "b")
    B.write_dictionaries(one, path, "a")
    assert B.commits(spark, path) == {"id-a": 0, "id-b": 2}
    assert sorted(r.title for r in B.read_table(spark, path, "dictionaries").collect()) == ["other", "same", "third"]
    assert sorted((r.dictionary, r.term) for r in B.read_table(spark, path, "terms").collect()) == [("other", "o"), ("same", "early"), ("third", "t")]
    assert sorted(r.dictionary for r in B.read_table(spark, path, "media").collect()) == ["other", "same", "third"]


@pytest.mark.parametrize("kind,item,good", [
    ("term_bank", '["t","","","",1,["d",{"type":"text","text":"x"},{"type":"image","path":"p"},{"type":"structured-content","content":[]},["u",["v1"]]],1,""]', True),
    ("term_bank", '["t","","","",1,[5],1,""]', False),
    ("term_bank", '["t","","","",1,["d",{"type":"odd"}],1,""]', False),
    ("term_bank", '["t","","","",1,[{"type":"image"}],1,""]', False),
    ("term_bank", '["t","","","",1,[["u"]],1,""]', False),
    ("term_meta_bank", '["t","pitch",{"reading":"r","pitches":[{"position":0},{"position":2,"nasal":1}]}]', True),
    ("term_meta_bank", '["t","pitch",{"reading":"r","pitches":[{"position":0},{"nasal":1}]}]', False),
    ("term_meta_bank", '["t","pitch",{"pitches":[{"position":0}]}]', False),
    ("term_meta_bank", '["t","ipa",{"reading":"r","transcriptions":[{"ipa":"a"},{"ipa":"b"}]}]', True),
    ("term_meta_bank", '["t","ipa",{"reading":"r","transcriptions":[{"ipa":"a"},{"ipa":5}]}]', False),
    ("term_meta_bank", '["t","freq",5]', True),
])
def test_checks_of_items(spark, kind, item, good):
    assert B.validate_items(spark.createDataFrame([("a", item)], "archive string, item string"), kind).first().bad == (0 if good else 1)


def test_text_behind_a_bank(spark):
    texts = {'[["t","c",1,"n",2]]': True, ' [["t","c",1,"n",2]] \n': True, "[]": True, '[["t","c",1,"n",2]] junk': False, "[1] ]": False, "[1]}": False, "[1],[2]": False, '[1],"b":[2]': False, "[1": False, "": False, "{}": False, "5": False, "null": False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", B.is_array(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in got} == texts


def test_archives_in_several_batches(spark, tmp_path):
    """Three batches: one archive comes in all of them, one in the first, one never gets its index; a late entry of a settled archive is left out."""
    bank = lambda t: f'[["{t}","","","",1,["d"],1,""]]'
    index = lambda t: f'{{"title":"{t}","revision":"1","format":3}}'
    batches = [
        [("slow", "term_bank_1.json", bank("s1")), ("fast", "index.json", index("fast")), ("fast", "term_bank_1.json", bank("f")), ("lost", "term_bank_1.json", bank("l"))],
        [("slow", "term_bank_3.json", bank("s3")), ("slow", "index.json", index("slow"))],
        [("slow", "term_bank_2.json", bank("s2")), ("other", "index.json", index("other"))],
        [("fast", "term_bank_2.json", bank("late"))],
    ]
    told: list[str] = []
    for n, rows in enumerate(batches):
        spark.createDataFrame([(a, p, bytearray(c.encode())) for a, p, c in rows], B.ENTRY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(B.ENTRY).parquet(str(tmp_path / "in"))
        P.held_import_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), quiet=1, patience=3, after=lambda new: told.extend(r.title for r in new.collect())).awaitTermination()
        if n == 2:
            assert told == ["fast"]
    P.finish_held(spark, str(tmp_path / "t"), str(tmp_path / "c"), after=lambda new: told.extend(r.title for r in new.collect()))
    assert told == ["fast", "slow"]
    assert sorted(r.term for r in B.read_table(spark, str(tmp_path / "t"), "terms").collect()) == ["f", "s1", "s2", "s3"]
    assert {r.archive: r.imported for r in P.settled(spark, str(tmp_path / "t")).collect()} == {"fast": True, "slow": True, "lost": False, "other": False}
    assert not list((tmp_path / "t" / "waiting").glob("batch=*"))
