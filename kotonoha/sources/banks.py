"""Dictionary archives: zip entries, banks of positional JSON, checks, and writing."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions.scratch import scratch

ENTRY = "archive string, path string, content binary"

#: Path of the row that stands for an archive that can't be opened, or a member that can't be read; its content says why.
BROKEN = "\x00broken"

# Bank kinds, the kinds of their items' values (see ``value_kinds``), allowed formats, metadata types, language codes.
KINDS = ["term_bank", "term_meta_bank", "kanji_bank", "kanji_meta_bank", "tag_bank"]
SHAPES = {"term_bank": "ss[s0]sdads", "term_meta_bank": "ss[dso]", "kanji_bank": "ssssao", "kanji_meta_bank": "ss[dso]", "tag_bank": "ssdsd"}
SHAPES_V1 = {"term_bank": "ss[s0]sd", "kanji_bank": "ssss"}
FORMATS = [1, 3]
META_TYPES = {"term_meta_bank": ["freq", "pitch", "ipa"], "kanji_meta_bank": ["freq"]}
FREQUENCY_MODES = ["occurrence-based", "rank-based"]
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn grc gu gv "
    "ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my "
    "na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty "
    "ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()

#: Partition column of the imports in a table's folder.
IMPORT = "import"


def read_archives(spark: SparkSession, path: str, glob: str = "*.zip", errors: bool = True) -> DataFrame:
    """(archive, path, content) of every file inside the archives under ``path``. A zip is read by one task; its entries are then dealt out.

    A zip that can't be opened, and each member that is encrypted, cut short or of an unknown
    method, gives a row with the path BROKEN and the reason as its content, which
    ``validate_archive`` shows as ``zip``; the other archives are read. Without ``errors`` such
    rows are left out. Files of no bytes are not seen, as Spark's reader leaves them out.
    """

    def unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                for name, data in opened_zip(content):
                    if errors or name != BROKEN:
                        yield pd.DataFrame([(archive, name, data)], columns=["archive", "path", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(unzip, ENTRY).repartition("archive", "path")


def opened_zip(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of each file in a zip; under the name BROKEN a reason where the zip or a file can't be read."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError, EOFError, NotImplementedError) as e:
        yield BROKEN, f"archive: {e}".encode()
        return
    with archive:
        for member in archive.infolist():
            if member.is_dir():
                continue
            try:
                yield member.filename, archive.read(member)
            except (zipfile.BadZipFile, RuntimeError, OSError, ValueError, EOFError, zlib.error, NotImplementedError) as e:
                yield BROKEN, f"{member.filename}: {e}".encode()


def route_entries(entries: DataFrame) -> DataFrame:
    """Adds ``kind`` (a bank kind, ``index``, ``styles``, ``media``, ``broken``, or ``ignored`` for numbered JSON files of other kinds) and ``bank_no``."""
    stem, number = (F.regexp_extract("path", r"(?s)(.+)_(\d+)\.json\z", i) for i in (1, 2))
    kind = F.when(F.col("path") == BROKEN, "broken").when(F.col("path") == "index.json", "index").when(F.col("path") == "styles.css", "styles").when(stem.isin(KINDS), stem).when(stem != "", "ignored").otherwise("media")
    return entries.withColumn("kind", kind).withColumn("bank_no", F.when(stem.isin(KINDS), number.cast("int")))


def _text(entries: DataFrame, kind: str) -> DataFrame:
    return entries.where(F.col("kind") == kind).withColumn("json", F.col("content").cast("string"))


def bank_items(entries: DataFrame, kind: str) -> DataFrame:
    """(archive, item): a row for each item of the banks of one kind, as JSON text with its keys in their order. A file that is no JSON array has none; ``broken_banks`` names it."""
    return _text(entries, kind).select("archive", F.explode(F.from_json("json", "array<string>")).alias("item"))


def broken_banks(entries: DataFrame) -> DataFrame:
    """Bank files (archive, path) that are no JSON array, such as ones cut short."""
    banks = entries.where(F.col("kind").isin(KINDS))
    return banks.where(~is_array(F.col("content").cast("string"))).select("archive", "path")


def is_array(json: Column) -> Column:
    """Whether a text is one JSON array and nothing behind it. Readers stop at the end of the first value, so it is also read inside an array and inside an object: what is behind it breaks one of the two."""
    inside = (F.json_array_length(F.concat(F.lit("["), json, F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"a":'), json, F.lit("}")))) == 1)
    return F.coalesce(F.json_array_length(json).isNotNull() & inside, F.lit(False))


def opened(items: DataFrame, item: str = "item") -> DataFrame:
    """Items with ``at``, the values of their positions: texts as they are, anything else as JSON with its keys in their order. Each item is parsed once."""
    return items.withColumn("at", F.from_json(item, "array<string>"))


def field(i: int) -> Column:
    """Position ``i`` of an opened item; JSON null is null."""
    return F.get("at", F.lit(i))


def raw(i: int, item: str = "item") -> Column:
    """Position ``i`` of an item as JSON, by which texts and numbers differ; keys come in any order."""
    return F.to_json(F.expr(f"variant_get(try_parse_json({item}), '$[{i}]', 'variant')"))


def _variants(array: str) -> Column:
    return F.expr(f"transform(variant_get(try_parse_json({array}), '$', 'array<variant>'), d -> to_json(d))")


def value_kinds(array: str) -> Column:
    """A letter for each value of a JSON array: s text, d number, b boolean, 0 null, a array, o object. Null for what is no array."""
    letter = lambda v: F.translate(F.substring(v, 1, 1), '"[{tfn-0123456789', "saobb0ddddddddddd")
    return F.array_join(F.transform(_variants(array), letter), "")


def split_words(c: Column, clean_tags: bool = True) -> Column:
    """Space-separated words; the empty word that an empty text would give is left out unless ``clean_tags`` is false."""
    words = F.split(F.coalesce(c, F.lit("")), " ")
    return F.filter(words, lambda w: w != "") if clean_tags else words


def parse_index(entries: DataFrame) -> DataFrame:
    """A row for each archive with a usable index: title, revision and one of format and version, languages by their codes and a known frequency mode where given. ``rank-based`` gives rank, otherwise occurrence."""
    schema = "title string, revision string, sequenced boolean, format int, version int, author string, url string, description string, attribution string, sourceLanguage string, targetLanguage string, frequencyMode string"
    read = _text(entries, "index").select("archive", F.from_json("json", schema).alias("i"))
    css = _text(entries, "styles").select("archive", F.col("json").alias("css"))
    empty = lambda c: F.coalesce(f"i.{c}", F.lit(""))
    known = lambda c, values: F.col(f"i.{c}").isNull() | F.col(f"i.{c}").isin(values)
    usable = known("sourceLanguage", LANGUAGES) & known("targetLanguage", LANGUAGES) & known("frequencyMode", FREQUENCY_MODES)
    rows = read.where("i.title is not null and i.revision is not null").where(usable).select(
        "archive", "i.title", "i.revision", F.coalesce("i.sequenced", F.lit(False)).alias("sequenced"), F.coalesce("i.format", "i.version").alias("format"),
        empty("author").alias("author"), empty("url").alias("url"), empty("description").alias("description"), empty("attribution").alias("attribution"),
        empty("sourceLanguage").alias("source_lang"), empty("targetLanguage").alias("target_lang"), F.when(F.col("i.frequencyMode") == "rank-based", "rank").otherwise("occurrence").alias("frequency_mode"),
    )
    return rows.where("format is not null").join(css, "archive", "left").withColumn("css_style", F.coalesce("css", F.lit(""))).drop("css")


def json_values(array: str) -> Column:
    """The values of a JSON array, each as JSON with its keys in their order."""
    return F.zip_with(F.from_json(array, "array<string>"), _variants(array), lambda x, v: F.when(x.isNull() | F.startswith(v, F.lit('"')), v).otherwise(x))


def parse_term_bank(items: DataFrame) -> DataFrame:
    """Items of eight positions -> terms; definitions stay JSON as they are written."""
    rows = opened(items).withColumn("d", field(5))
    return rows.select("archive", field(0).alias("term"), field(1).alias("reading"), json_values("d").alias("definitions"), split_words(field(7)).alias("term_tags"), split_words(field(2)).alias("definition_tags"), split_words(field(3)).alias("inflection_rules"), field(4).cast("double").alias("popularity"), field(6).cast("long").alias("sequence_number"))


def _nested(item: str = "item") -> Column:
    return F.startswith(item, F.lit("[["))


def _v1(items: DataFrame, fixed: int) -> DataFrame:
    """Both layouts of version 1, ``[[fixed ...], def ...]`` and ``[fixed ..., def ...]``, as the positions of the head and the defs."""
    values = opened(items).withColumn("values", json_values("item"))
    head = F.when(_nested(), F.from_json(field(0), "array<string>")).otherwise(F.col("at"))
    defs = lambda n: F.slice("values", F.lit(n), F.size("values"))
    return values.select("archive", head.alias("at"), F.when(_nested(), defs(2)).otherwise(defs(fixed + 1)).alias("definitions"))


def parse_term_bank_v1(items: DataFrame) -> DataFrame:
    """An empty reading is the term; there are no term tags and the sequence is 0."""
    reading = F.when(F.coalesce(field(1), F.lit("")) == "", field(0)).otherwise(field(1))
    return _v1(items, 5).select("archive", field(0).alias("term"), reading.alias("reading"), "definitions", F.array().cast("array<string>").alias("term_tags"), split_words(field(2)).alias("definition_tags"), split_words(field(3)).alias("inflection_rules"), field(4).cast("double").alias("popularity"), F.lit(0).cast("long").alias("sequence_number"))


def parse_kanji_bank(items: DataFrame) -> DataFrame:
    rows = opened(items).withColumn("d", field(4))
    return rows.select("archive", field(0).alias("kanji"), split_words(field(1)).alias("onyomi"), split_words(field(2)).alias("kunyomi"), split_words(field(3)).alias("tags"), json_values("d").alias("definitions"), F.from_json(field(5), "map<string,string>").alias("stats"))


def parse_kanji_bank_v1(items: DataFrame) -> DataFrame:
    return _v1(items, 4).select("archive", field(0).alias("kanji"), split_words(field(1)).alias("onyomi"), split_words(field(2)).alias("kunyomi"), split_words(field(3)).alias("tags"), "definitions", F.create_map().cast("map<string,string>").alias("stats"))


def unquoted(json: Column) -> Column:
    return F.get_json_object(F.concat(F.lit("["), json, F.lit("]")), "$[0]")


def frequency_of(json: Column) -> tuple[Column, Column]:
    """Number and display text of a frequency: a number, a text, or an object with value and displayValue."""
    kind = F.substring(json, 1, 1)
    number = F.when(kind == "{", F.get_json_object(json, "$.value").cast("double")).when(kind == '"', F.lit(None).cast("double")).otherwise(json.cast("double"))
    shown = F.when(kind == "{", F.get_json_object(json, "$.displayValue")).when(kind == '"', unquoted(json))
    return number, shown


def parse_term_meta_freq(items: DataFrame) -> DataFrame:
    """Frequencies; with a reading if the item has one, else of the term read as itself."""
    rows = opened(items).where(field(1) == "freq").withColumn("data", raw(2)).withColumn("reading", F.when(F.startswith("data", F.lit("{")), F.get_json_object("data", "$.reading")))
    inner = F.to_json(F.expr("variant_get(try_parse_json(data), '$.frequency', 'variant')"))
    number, shown = frequency_of(F.when(F.col("reading").isNotNull(), inner).otherwise(F.col("data")))
    return rows.select("archive", field(0).alias("term"), F.coalesce("reading", field(0)).alias("reading"), F.lit("frequency").alias("meta_type"), number.alias("frequency"), shown.alias("display_frequency"))


def _positions(c: str) -> Column:
    """A number as a list of one, a list as it is, null as empty."""
    return F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<int>")).when(F.col(c).isNotNull(), F.array(F.col(c).cast("int"))).otherwise(F.array().cast("array<int>"))


def parse_term_meta_pitch(items: DataFrame) -> DataFrame:
    """A row for each pitch of each item."""
    schema = "reading string, pitches array<struct<position:int,nasal:string,devoice:string,tags:array<string>>>"
    rows = opened(items).where(field(1) == "pitch").select("archive", field(0).alias("term"), F.from_json(field(2), schema).alias("p"))
    each = rows.select("archive", "term", F.coalesce("p.reading", "term").alias("reading"), F.explode("p.pitches").alias("x")).select("archive", "term", "reading", "x.*")
    return each.select("archive", "term", "reading", F.lit("pitch").alias("meta_type"), F.col("position").alias("downstep_position"), _positions("nasal").alias("nasal_positions"), _positions("devoice").alias("devoice_positions"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def parse_term_meta_ipa(items: DataFrame) -> DataFrame:
    """A row for each transcription of each item."""
    rows = opened(items).where(field(1) == "ipa").select("archive", field(0).alias("term"), F.from_json(field(2), "reading string, transcriptions array<struct<ipa:string,tags:array<string>>>").alias("p"))
    each = rows.select("archive", "term", F.coalesce("p.reading", "term").alias("reading"), F.explode("p.transcriptions").alias("x"))
    return each.select("archive", "term", "reading", F.lit("ipa").alias("meta_type"), F.col("x.ipa").alias("transcription"), F.coalesce("x.tags", F.array().cast("array<string>")).alias("tags"))


def parse_term_meta_bank(items: DataFrame) -> DataFrame:
    """All metadata of terms; items of unknown type give a row with their type and nothing else, for the checks to reject."""
    known = parse_term_meta_freq(items).unionByName(parse_term_meta_pitch(items), allowMissingColumns=True).unionByName(parse_term_meta_ipa(items), allowMissingColumns=True)
    unknown = opened(items).where(~F.coalesce(field(1), F.lit("")).isin(META_TYPES["term_meta_bank"])).select("archive", field(0).alias("term"), field(1).alias("meta_type"))
    return known.unionByName(unknown, allowMissingColumns=True)


def parse_kanji_meta_bank(items: DataFrame) -> DataFrame:
    number, shown = frequency_of(raw(2))
    return opened(items).select("archive", field(0).alias("kanji"), number.alias("frequency"), shown.alias("display_frequency"))


def parse_tag_bank(items: DataFrame) -> DataFrame:
    return opened(items).select("archive", field(0).alias("tag"), field(1).alias("category"), field(2).cast("double").alias("sorting_order"), field(3).alias("notes"), field(4).cast("double").alias("popularity"))


def bank_contiguity(entries: DataFrame) -> DataFrame:
    """For each archive and bank kind: number of files, highest number, and whether they are the same."""
    numbered = entries.where("bank_no is not null").groupBy("archive", "kind")
    return numbered.agg(F.count("*").alias("files"), F.max("bank_no").alias("highest")).withColumn("contiguous", F.col("files") == F.col("highest"))


def good_item(kind: str, version: int = 3) -> Column:
    """Whether an opened item (item, at, kinds) has the values that its kind of bank asks for, by number and kind."""
    if version == 1 and kind in SHAPES_V1:
        shape = SHAPES_V1[kind]
        return F.when(_nested(), value_kinds("at[0]").rlike(f"^{shape}$")).otherwise(F.col("kinds").rlike(f"^{shape}"))
    good = F.col("kinds").rlike(f"^{SHAPES[kind]}$")
    if kind in META_TYPES:
        good = good & F.coalesce(field(1), F.lit("")).isin(META_TYPES[kind])
    if kind == "term_bank":
        good = good & F.forall(F.from_json(field(5), "array<string>"), lambda d: d.isNotNull()) & F.forall(_variants("at[5]"), good_definition)
    if kind == "term_meta_bank":
        wanted = {"pitch": ("pitches", "position", "d"), "ipa": ("transcriptions", "ipa", "s")}
        for name, (listed, part, letter) in wanted.items():
            each = F.from_json(F.get_json_object(field(2), f"$.{listed}"), "array<string>")
            kinds = F.transform(each, lambda x: value_kinds_of(x, part))  # noqa: B023
            sound = F.endswith("kinds", F.lit("o")) & F.get_json_object(field(2), "$.reading").isNotNull() & (F.size(each) > 0) & F.forall(kinds, lambda k: F.coalesce(k == letter, F.lit(False)))  # noqa: B023
            good = good & ((field(1) != name) | F.coalesce(sound, F.lit(False)))
    return good


def value_kinds_of(json: Column, part: str) -> Column:
    """The kind (see ``value_kinds``) of one value of a JSON object: d for whole numbers, s for texts, null for anything else."""
    value = F.to_json(F.try_variant_get(F.try_parse_json(json), f"$.{part}", "variant"))
    return F.when(F.startswith(value, F.lit('"')), "s").when(value.rlike(r"^-?[0-9]+\z"), "d")


def good_definition(definition: Column) -> Column:
    """Whether a definition (JSON) is a text, an object of a known type with what it needs, or ``[uninflected, [rules]]``."""
    kind, first = F.get_json_object(definition, "$.type"), F.substring(definition, 1, 1)
    has = lambda c: F.get_json_object(definition, f"$.{c}").isNotNull()
    of_type = ((kind == "text") & has("text")) | ((kind == "image") & has("path")) | ((kind == "structured-content") & has("content"))
    inflected = F.startswith(definition, F.lit('["')) & F.startswith(F.get_json_object(definition, "$[1]"), F.lit("["))
    return (first == '"') | ((first == "{") & F.coalesce(of_type, F.lit(False))) | ((first == "[") & F.coalesce(inflected, F.lit(False)))


def validate_items(items: DataFrame, kind: str, version: int = 3) -> DataFrame:
    """(archive, items, bad): items whose values differ in number or kind from what the bank asks for, or that are of an unknown metadata type."""
    rows = opened(items).withColumn("kinds", value_kinds("item"))
    return rows.groupBy("archive").agg(F.count("*").alias("items"), F.count_if(~F.coalesce(good_item(kind, version), F.lit(False))).alias("bad"))


def validate_archive(entries: DataFrame) -> DataFrame:
    """(archive, ok, reason) of routed entries: the first of a zip that can't be read whole (``zip``), a missing or unusable index, a bad format, a gap in a bank's numbers, bank files that are no JSON array or items that fail the checks of the archive's format."""
    index = parse_index(entries).select("archive", "format")
    gaps = bank_contiguity(entries).where("not contiguous").select("archive").distinct().withColumn("gap", F.lit(True))
    torn = entries.where("kind = 'broken'").select("archive").distinct().withColumn("torn", F.lit(True))
    banks = entries.where(F.col("kind").isin(KINDS)).withColumn("json", F.col("content").cast("string")).join(index, "archive").withColumn("whole", is_array(F.col("json")))
    # a file that is no array has one item, null, which is bad as well
    items = banks.select("archive", "kind", "format", F.explode_outer(F.when(F.col("whole") & (F.json_array_length("json") > 0), F.from_json("json", "array<string>"))).alias("item"), (F.col("whole") & (F.json_array_length("json") == 0)).alias("empty"))
    rows = opened(items.where("empty is null or not empty")).withColumn("kinds", value_kinds("item"))
    good = F.coalesce(*[F.when((F.col("kind") == kind) & (F.col("format") == version), good_item(kind, version)) for kind in KINDS for version in FORMATS], F.lit(False))
    bad = rows.where(~good).select("archive").distinct().withColumn("bad", F.lit(True))
    joined = entries.select("archive").distinct().join(index, "archive", "left").join(gaps, "archive", "left").join(bad, "archive", "left").join(torn, "archive", "left")
    reason = F.when(F.col("torn"), "zip").when(F.col("format").isNull(), "index").when(~F.col("format").isin(FORMATS), "format").when(F.col("gap"), "numbering").when(F.col("bad"), "items")
    return joined.select("archive", reason.isNull().alias("ok"), reason.alias("reason"))


def import_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, dictionary, n) over tables with a column ``dictionary``."""
    counts = [df.groupBy("dictionary").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "dictionary", "n") for name, df in sorted(tables.items())]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def extract_media(entries: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared media (archive, path) with their content; ``missing`` where the archive has no such entry."""
    return declared.join(entries.select("archive", "path", "content"), ["archive", "path"], "left").withColumn("missing", F.col("content").isNull())


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's ``content`` (binary) to the file ``path`` in ``folder``, and give the number of files. Null contents are left out; a task that runs again writes the same files again; a path that leads out of the folder is an error."""
    where, root = fs.FileSystem.from_uri(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not inside the folder: {path!r}")
                name = f"{root}/{path}"
                where.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(name) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    return files.where("content is not null").select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def staged(entries: DataFrame, where: str) -> DataFrame:
    """Routed entries, written to a folder for each kind and read from there: archives are opened once, and a bank's reader gets its own files alone, media none."""
    wanted = entries.where(F.col("kind").isin("index", "styles", "broken", "media", *KINDS))
    wanted.write.partitionBy("kind").parquet(where)
    return entries.sparkSession.read.schema(wanted.schema).parquet(where)


def import_dictionaries(entries: DataFrame, existing: DataFrame | None = None, work: str | None = None) -> dict[str, DataFrame]:
    """Tables of all valid archives whose title is new: dictionaries, terms, kanji, terms_meta, kanji_meta, tags, media, each with its ``dictionary``.

    Of several archives with one title in the batch the one whose name is smallest counts. Media
    are the files of its zip beside banks, index and styles (path, content). The tables are read from what is written to ``work`` first (the scratch folder where it is
    not given): the banks, and which archives are valid.
    """
    spark, work = entries.sparkSession, work or scratch(entries.sparkSession)
    entries = staged(entries, f"{work}/entries")
    valid = validate_archive(entries).where("ok").select("archive")
    dictionaries = parse_index(entries).join(valid, "archive", "left_semi")
    if existing is not None:
        dictionaries = dictionaries.join(existing.select("title").distinct(), "title", "left_anti")
    dictionaries = first_of_title(dictionaries)
    dictionaries.write.parquet(f"{work}/dictionaries")
    dictionaries = spark.read.schema(dictionaries.schema).parquet(f"{work}/dictionaries")
    of = dictionaries.select("archive", F.col("title").alias("dictionary"), "format")
    items = lambda kind, v1: bank_items(entries, kind).join(of.where("format = 1" if v1 else "format <> 1").select("archive"), "archive", "left_semi")
    named = lambda df: df.join(of.select("archive", "dictionary"), "archive").drop("archive")
    both = lambda kind, new, old: named(new(items(kind, False)).unionByName(old(items(kind, True))))
    every = lambda kind, parse: named(parse(bank_items(entries, kind)))
    return {
        "dictionaries": dictionaries.drop("archive"),
        "terms": both("term_bank", parse_term_bank, parse_term_bank_v1),
        "kanji": both("kanji_bank", parse_kanji_bank, parse_kanji_bank_v1),
        "terms_meta": every("term_meta_bank", parse_term_meta_bank),
        "kanji_meta": every("kanji_meta_bank", parse_kanji_meta_bank),
        "tags": every("tag_bank", parse_tag_bank),
        "media": named(entries.where("kind = 'media'").select("archive", "path", "content")).select("path", "content", "dictionary"),
    }


def first_of_title(dictionaries: DataFrame) -> DataFrame:
    """Of the rows with one title the one whose archive has the smallest name."""
    first = dictionaries.groupBy("title").agg(F.min("archive").alias("archive"))
    return dictionaries.join(first, ["title", "archive"], "left_semi")


def write_dictionaries(tables: dict[str, DataFrame], path: str, import_id: str | None = None) -> str:
    """Publish the tables of one import under ``path``, all or nothing, and give its id.

    A table is a folder with a partition for each import. The rows are written first, sorted by
    dictionary and key within files, so that searches skip most of them; then the import's list of
    dictionaries, and last its commit: a file of the next free number in ``commits`` that names the
    import, made only if there is none of that number yet, so that of two writers one comes
    first and the other takes the next number. ``read_table`` takes rows of committed imports
    alone, so that an import which breaks off shows nothing, and of each title those of the first
    commit that has it, so that two writers who import one title don't show it twice. An
    import that comes again with the same id replaces what it left, and is committed once.
    """
    spark = next(iter(tables.values())).sparkSession
    import_id = f"id-{import_id or uuid.uuid4().hex}"
    for name in sorted(tables, key=lambda n: n == "dictionaries"):
        df, folder = tables[name], f"{path}/{name}/{IMPORT}={import_id}"
        if name == "dictionaries":
            df.coalesce(1).write.mode("overwrite").parquet(folder)
        else:
            key = df.columns[0]
            dealt = df.repartition("dictionary", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("dictionary", key)
            dealt.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).parquet(folder)
    if "dictionaries" in tables:
        commit(spark, path, import_id)
    return import_id


def _commits_folder(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def commits(spark: SparkSession, path: str) -> dict[str, int]:
    """The number of each committed import. A number whose writer broke off before it named its import is left out."""
    files, folder = _commits_folder(spark, path)
    found: dict[str, int] = {}
    for status in files.listStatus(folder) if files.exists(folder) else []:
        stream = files.open(status.getPath())
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if name:
            number = int(status.getPath().getName())
            found[name] = min(number, found.get(name, number))
    return found


def commit(spark: SparkSession, path: str, import_id: str) -> int:
    """Commit an import under the next free number, unless it is committed, and give its number. A number belongs to the writer that makes its file; that fails for all others, who take the next one."""
    files, folder = _commits_folder(spark, path)
    if (known := commits(spark, path).get(import_id)) is not None:
        return known
    number = max([-1, *(int(s.getPath().getName()) for s in files.listStatus(folder))]) + 1 if files.exists(folder) else 0
    while True:
        file = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:09d}")
        try:
            out = files.create(file, False)
        except Py4JJavaError:
            if not files.exists(file):
                raise
            number += 1
            continue
        out.write(bytearray(import_id.encode()))
        out.close()
        return number


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's rows of all committed imports, those of each title from the first commit that has it."""
    order = commits(spark, path)
    listed = spark.read.parquet(f"{path}/dictionaries")
    numbers = F.create_map(*[F.lit(x) for pair in order.items() for x in pair]) if order else F.create_map().cast("map<string,int>")
    numbered = listed.withColumn("_commit", F.element_at(numbers, F.col(IMPORT))).where("_commit is not null")
    first = numbered.groupBy("title").agg(F.min_by(IMPORT, "_commit").alias(IMPORT))
    if name == "dictionaries":
        rows = listed.join(first, ["title", IMPORT], "left_semi")
    else:
        rows = spark.read.parquet(f"{path}/{name}").join(first.withColumnRenamed("title", "dictionary"), ["dictionary", IMPORT], "left_semi")
    return rows.drop(IMPORT)


def export_tables(spark: SparkSession, path: str, to: str, names: list[str]) -> None:
    """A copy of the published rows of the named tables, as one import of its own."""
    write_dictionaries({name: read_table(spark, path, name) for name in {*names, "dictionaries"}}, to, "export")


def reset_tables(spark: SparkSession, path: str, names: list[str]) -> None:
    """Empty tables with the schemas they have; the commits go first, so that nothing half reset shows."""
    empty = {name: read_table(spark, path, name).schema for name in {*names, "dictionaries"}}
    files, folder = _commits_folder(spark, path)
    files.delete(folder, True)
    for name in sorted(empty, key=lambda n: n != "dictionaries"):
        spark.createDataFrame([], empty[name]).withColumn(IMPORT, F.lit("id-none")).write.mode("overwrite").parquet(f"{path}/{name}")
