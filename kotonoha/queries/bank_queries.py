"""Dictionary banks made of the given tables, parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kotonoha.functions import structured
from kotonoha.queries.adapters import TERMS_SQL, table, terms
from kotonoha.queries.registry import query
from kotonoha.sources import banks as B


def js(c: Column | str) -> Column:
    """A text as JSON."""
    column = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(F.to_json(F.array(column)), r"(?s)^\[(.*)\]$", 1)


def item(*fields: Column | str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]"))


#: Items of a bank, on average, where an archive has more than that.
BANK_ITEMS = 5_000


def archives_of(rows: DataFrame, kind: str, most: int = BANK_ITEMS) -> DataFrame:
    """Rows (archive, item) as bank files of about ``most`` items, numbered from 1 on in each archive. The items are dealt by a hash; only the numbers of an archive's banks meet in one task."""
    sizes = rows.groupBy("archive").agg(F.ceil(F.count("*") / most).alias("banks"))
    dealt = rows.select("archive", "item").join(sizes, "archive").withColumn("part", F.pmod(F.xxhash64("item"), F.col("banks")))
    numbers = dealt.select("archive", "part").distinct().withColumn("number", F.row_number().over(W.partitionBy("archive").orderBy("part")))
    grouped = dealt.groupBy("archive", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("json"))
    path = F.concat(F.lit(f"{kind}_"), F.col("number").cast("string"), F.lit(".json"))
    return B.route_entries(grouped.join(numbers, ["archive", "part"]).select("archive", path.alias("path"), F.col("json").cast("binary").alias("content")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("archive", F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")))


_ARCHIVE_SQL = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS dictionary"
_text = lambda c: F.array_join(c, " ")


def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of documents: the archive is the source, the kind goes by doc_id, numbers have gaps."""
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("term_bank", "kanji_bank", "tag_bank", "other_bank", "image")]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.when(kind == "image", F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png"))).otherwise(F.concat(kind, F.lit("_"), (F.floor(F.col("doc_id") / 100) + 1).cast("string"), F.lit(".json")))
    return d.select(F.col("source").alias("archive"), name.alias("path")).distinct()


_FILES_SQL = r"files AS (SELECT DISTINCT source AS archive, CASE WHEN doc_id % 5 = 4 THEN 'img/' || doc_id || '.png' ELSE (['term_bank', 'kanji_bank', 'tag_bank', 'other_bank'])[doc_id % 5 + 1] || '_' || (doc_id // 100 + 1) || '.json' END AS path FROM documents), routed AS (SELECT archive, path, regexp_extract(path, '(.+)_(\d+)\.json$', 1) AS stem, regexp_extract(path, '(.+)_(\d+)\.json$', 2) AS no FROM files)"


@query(f"WITH {_FILES_SQL} SELECT archive, path, CASE WHEN stem IN ('term_bank', 'kanji_bank', 'tag_bank') THEN stem WHEN stem <> '' THEN 'ignored' ELSE 'media' END AS kind, CASE WHEN stem IN ('term_bank', 'kanji_bank', 'tag_bank') THEN no::INT END AS bank_no FROM routed")
def route_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.route_entries(file_entries(spark, sf_dir))


@query(f"WITH {_FILES_SQL} SELECT archive, stem AS kind, count(*) AS files, max(no::INT) AS highest, count(*) = max(no::INT) AS contiguous FROM routed WHERE stem IN ('term_bank', 'kanji_bank', 'tag_bank') GROUP BY archive, stem")
def bank_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bank_contiguity(B.route_entries(file_entries(spark, sf_dir)))


@query("SELECT source AS title, 'r' || count(*) AS revision, count(*) % 2 = 0 AS sequenced, CASE WHEN min(doc_id) % 3 = 0 THEN 1 ELSE 3 END AS format, min(lang) AS source_lang, CASE WHEN min(doc_id) % 2 = 0 THEN 'rank' ELSE 'occurrence' END AS frequency_mode, '' AS url FROM documents GROUP BY source HAVING min(doc_id) % 5 <> 4")
def parse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("lang").alias("lang"))
    title = F.when(F.col("first") % 5 != 4, F.concat(F.lit('"title":"'), "source", F.lit('",'))).otherwise("")
    version = F.when(F.col("first") % 3 == 0, '"version":1').otherwise('"format":3')
    body = F.concat(F.lit("{"), title, F.lit('"revision":"r'), F.col("n").cast("string"), F.lit('","sequenced":'), (F.col("n") % 2 == 0).cast("string"), F.lit(","), version, F.lit(',"sourceLanguage":"'), "lang", F.lit('","frequencyMode":"'), F.when(F.col("first") % 2 == 0, "rank-based").otherwise("occurrence-based"), F.lit('"}'))
    entries = B.route_entries(g.select(F.col("source").alias("archive"), F.lit("index.json").alias("path"), body.cast("binary").alias("content")))
    return B.parse_index(entries).select("title", "revision", "sequenced", "format", "source_lang", "frequency_mode", "url")


@query(f"WITH {TERMS_SQL} SELECT term, reading, dictionary, array_to_string(list_transform(definitions, lambda d: '\"' || d || '\"'), ' ') AS definitions, array_to_string(term_tags, ' ') AS term_tags, array_to_string(definition_tags, ' ') AS definition_tags, array_to_string(inflection_rules, ' ') AS inflection_rules, popularity, sequence_number FROM terms")
def parse_terms_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = terms(spark, sf_dir).select(F.col("dictionary").alias("archive"), item(js("term"), js("reading"), js(_text("definition_tags")), js(_text("inflection_rules")), F.col("popularity").cast("string"), F.to_json("definitions"), F.col("sequence_number").cast("string"), js(_text("term_tags"))).alias("item"))
    out = B.parse_term_bank(B.bank_items(archives_of(rows, "term_bank"), "term_bank"))
    return out.select("term", "reading", F.col("archive").alias("dictionary"), _text("definitions").alias("definitions"), _text("term_tags").alias("term_tags"), _text("definition_tags").alias("definition_tags"), _text("inflection_rules").alias("inflection_rules"), "popularity", "sequence_number")


@query(f"WITH {TERMS_SQL} SELECT term, CASE WHEN sequence_number % 2 = 0 THEN term ELSE reading END AS reading, dictionary, array_to_string(list_transform(definitions, lambda d: '\"' || d || '\"'), ' ') AS definitions, array_to_string(inflection_rules, ' ') AS inflection_rules, popularity, 0::BIGINT AS sequence_number FROM terms")
def parse_terms_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("sequence_number") % 2 == 0
    fixed = F.concat_ws(",", js("term"), js(F.when(even, "").otherwise(F.col("reading"))), js(_text("definition_tags")), js(_text("inflection_rules")), F.col("popularity").cast("string"))
    defs = F.regexp_extract(F.to_json("definitions"), r"(?s)^\[(.*)\]$", 1)
    rows = terms(spark, sf_dir).select(F.col("dictionary").alias("archive"), F.when(F.length("term") % 2 == 0, item(item(fixed), defs)).otherwise(item(fixed, defs)).alias("item"))
    out = B.parse_term_bank_v1(B.bank_items(archives_of(rows, "term_bank"), "term_bank"))
    return out.select("term", "reading", F.col("archive").alias("dictionary"), _text("definitions").alias("definitions"), _text("inflection_rules").alias("inflection_rules"), "popularity", "sequence_number")


@query(f"SELECT p_name AS kanji, {_ARCHIVE_SQL}, 'a ' || p_size AS onyomi, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS kunyomi, '\"' || p_type || '\"' AS definitions, p_size::VARCHAR AS strokes FROM part")
def parse_kanji(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    rows = parts(spark, sf_dir).select("archive", item(js("p_name"), js(F.concat(F.lit("a "), size)), js(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))), js(F.lit("t")), F.to_json(F.array("p_type")), F.concat(F.lit('{"strokes":'), size, F.lit("}"))).alias("item"))
    out = B.parse_kanji_bank(B.bank_items(archives_of(rows, "kanji_bank"), "kanji_bank"))
    return out.select("kanji", F.col("archive").alias("dictionary"), _text("onyomi").alias("onyomi"), _text("kunyomi").alias("kunyomi"), _text("definitions").alias("definitions"), F.col("stats")["strokes"].alias("strokes"))


@query(f"SELECT p_name AS kanji, {_ARCHIVE_SQL}, 'a ' || p_size AS onyomi, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS kunyomi, '\"' || p_type || '\" \"x\"' AS definitions, 0 AS stats FROM part")
def parse_kanji_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in both layouts of version 1."""
    size = F.col("p_size").cast("string")
    fixed = F.concat_ws(",", js("p_name"), js(F.concat(F.lit("a "), size)), js(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type"))), js(F.lit("t")))
    defs = F.concat_ws(",", js("p_type"), js(F.lit("x")))
    rows = parts(spark, sf_dir).select("archive", F.when(F.col("p_partkey") % 2 == 0, item(item(fixed), defs)).otherwise(item(fixed, defs)).alias("item"))
    out = B.parse_kanji_bank_v1(B.bank_items(archives_of(rows, "kanji_bank"), "kanji_bank"))
    return out.select("kanji", F.col("archive").alias("dictionary"), _text("onyomi").alias("onyomi"), _text("kunyomi").alias("kunyomi"), _text("definitions").alias("definitions"), F.size("stats").alias("stats"))


@query(f"""SELECT p_name AS term, {_ARCHIVE_SQL}, '{{"type":"structured-content","content":{{"tag":"' || p_size || '","style":{{"marginLeft":"1","margin":"0"}},"content":"' || p_type || '"}}}} "' || p_type || '" ["z",["a"]]' AS definitions FROM part""")
def parse_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions as they are written, their keys in their order."""
    node = F.concat(F.lit('{"type":"structured-content","content":{"tag":"'), F.col("p_size").cast("string"), F.lit('","style":{"marginLeft":"1","margin":"0"},"content":'), js("p_type"), F.lit("}}"))
    rows = parts(spark, sf_dir).select("archive", item(js("p_name"), js(F.lit("")), F.lit("null"), js(F.lit("")), F.lit("1"), item(node, js("p_type"), F.lit('["z",["a"]]')), F.lit("1"), js(F.lit(""))).alias("item"))
    out = B.parse_term_bank(B.bank_items(archives_of(rows, "term_bank"), "term_bank"))
    return out.select("term", F.col("archive").alias("dictionary"), _text("definitions").alias("definitions"))


def _meta_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata items of all forms, by p_partkey % 7."""
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    quoted = F.concat(F.lit('"'), n, F.lit('"'))
    value = F.concat(F.lit('{"value":'), n, F.lit(',"displayValue":"'), n, F.lit('x"}'))
    read = lambda x: F.concat(F.lit('{"reading":"r'), n, F.lit('","frequency":'), x, F.lit("}"))
    pitch = F.concat(F.lit('{"reading":"r'), n, F.lit('","pitches":[{"position":'), n, F.lit(',"nasal":1},{"position":0,"devoice":[1,2],"tags":["t"]}]}'))
    ipa = F.concat(F.lit('{"reading":"r'), n, F.lit('","transcriptions":[{"ipa":"/'), n, F.lit('/"}]}'))
    data = F.when(k == 0, n).when(k == 1, quoted).when(k == 2, value).when(k == 3, read(n)).when(k == 4, read(value)).when(k == 5, pitch).otherwise(ipa)
    kind = F.when(k < 5, "freq").when(k == 5, "pitch").otherwise("ipa")
    rows = parts(spark, sf_dir).select("archive", item(js("p_name"), js(kind), data).alias("item"))
    return B.bank_items(archives_of(rows, "term_meta_bank"), "term_meta_bank")


@query(f"SELECT p_name AS term, {_ARCHIVE_SQL}, CASE WHEN p_partkey % 7 IN (3, 4) THEN 'r' || p_size ELSE p_name END AS reading, CASE WHEN p_partkey % 7 <> 1 THEN p_size::DOUBLE END AS frequency, CASE p_partkey % 7 WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || 'x' WHEN 4 THEN p_size || 'x' END AS display_frequency FROM part WHERE p_partkey % 7 < 5")
def parse_term_meta_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parse_term_meta_freq(_meta_items(spark, sf_dir)).select("term", F.col("archive").alias("dictionary"), "reading", "frequency", "display_frequency")


@query(f"SELECT p_name AS term, {_ARCHIVE_SQL}, 'r' || p_size AS reading, (CASE i WHEN 0 THEN p_size ELSE 0 END)::INT AS downstep_position, CASE i WHEN 0 THEN '1' ELSE '' END AS nasal, CASE i WHEN 0 THEN '' ELSE '1 2' END AS devoice, CASE i WHEN 0 THEN '' ELSE 't' END AS tags FROM part, range(2) t(i) WHERE p_partkey % 7 = 5")
def parse_term_meta_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.parse_term_meta_pitch(_meta_items(spark, sf_dir))
    listed = lambda c: _text(F.col(c).cast("array<string>"))
    return out.select("term", F.col("archive").alias("dictionary"), "reading", "downstep_position", listed("nasal_positions").alias("nasal"), listed("devoice_positions").alias("devoice"), _text("tags").alias("tags"))


@query(f"SELECT p_name AS term, {_ARCHIVE_SQL}, 'r' || p_size AS reading, '/' || p_size || '/' AS transcription FROM part WHERE p_partkey % 7 = 6")
def parse_term_meta_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parse_term_meta_ipa(_meta_items(spark, sf_dir)).select("term", F.col("archive").alias("dictionary"), "reading", "transcription")


_FREQ_SQL = f"SELECT p_name AS term, {_ARCHIVE_SQL}, 'frequency' AS meta_type, CASE WHEN p_partkey % 7 IN (3, 4) THEN 'r' || p_size ELSE p_name END AS reading, coalesce(CASE p_partkey % 7 WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || 'x' WHEN 4 THEN p_size || 'x' END, p_size::VARCHAR) AS shown FROM part WHERE p_partkey % 7 < 5"


@query(f"""{_FREQ_SQL} UNION ALL SELECT p_name, {_ARCHIVE_SQL}, 'pitch', 'r' || p_size, (CASE i WHEN 0 THEN p_size ELSE 0 END)::VARCHAR FROM part, range(2) t(i) WHERE p_partkey % 7 = 5
    UNION ALL SELECT p_name, {_ARCHIVE_SQL}, 'ipa', 'r' || p_size, '/' || p_size || '/' FROM part WHERE p_partkey % 7 = 6 UNION ALL SELECT p_name, {_ARCHIVE_SQL}, 'odd', NULL, NULL FROM part""")
def parse_term_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of all types in one bank, and for each part an item of an unknown type."""
    odd = parts(spark, sf_dir).select("archive", item(js("p_name"), js(F.lit("odd")), F.lit("1")).alias("item"))
    out = B.parse_term_meta_bank(_meta_items(spark, sf_dir).unionByName(B.bank_items(archives_of(odd, "term_meta_bank"), "term_meta_bank")))
    shown = F.coalesce("display_frequency", F.col("frequency").cast("long").cast("string"), F.col("downstep_position").cast("string"), "transcription")
    return out.select("term", F.col("archive").alias("dictionary"), "meta_type", "reading", shown.alias("shown"))


@query(f"SELECT p_name AS kanji, {_ARCHIVE_SQL}, p_size::DOUBLE AS frequency, CASE WHEN p_partkey % 2 = 0 THEN p_size || 'x' END AS display_frequency FROM part")
def parse_kanji_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    data = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"value":'), n, F.lit(',"displayValue":"'), n, F.lit('x"}'))).otherwise(n)
    rows = parts(spark, sf_dir).select("archive", item(js("p_name"), js(F.lit("freq")), data).alias("item"))
    out = B.parse_kanji_meta_bank(B.bank_items(archives_of(rows, "kanji_meta_bank"), "kanji_meta_bank"))
    return out.select("kanji", F.col("archive").alias("dictionary"), "frequency", "display_frequency")


@query(f"SELECT p_type AS tag, {_ARCHIVE_SQL}, p_brand AS category, p_size::DOUBLE AS sorting_order, p_name AS notes, (p_partkey % 10)::DOUBLE AS popularity FROM part")
def parse_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).select("archive", item(js("p_type"), js("p_brand"), F.col("p_size").cast("string"), js("p_name"), (F.col("p_partkey") % 10).cast("string")).alias("item"))
    out = B.parse_tag_bank(B.bank_items(archives_of(rows, "tag_bank"), "tag_bank"))
    return out.select("tag", F.col("archive").alias("dictionary"), "category", "sorting_order", "notes", "popularity")


@query(f"SELECT dictionary AS archive, count(*) AS items, count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 11 = 0) AS bad FROM (SELECT {_ARCHIVE_SQL}, p_partkey FROM part) GROUP BY dictionary")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag items of which every fifth is too short and every eleventh starts with a number."""
    short = F.col("p_partkey") % 5 == 0
    first = F.when(F.col("p_partkey") % 11 == 0, F.lit("7")).otherwise(js("p_type"))
    rows = parts(spark, sf_dir).select("archive", F.when(short, item(first, js("p_brand"))).otherwise(item(first, js("p_brand"), F.lit("1"), js("p_name"), F.lit("2"))).alias("item"))
    return B.validate_items(B.bank_items(archives_of(rows, "tag_bank"), "tag_bank"), "tag_bank")


@query(f"""WITH {TERMS_SQL}, p AS (SELECT {_ARCHIVE_SQL} FROM part) SELECT 'tags' AS "table", dictionary, count(*) AS n FROM p GROUP BY dictionary UNION ALL SELECT 'terms', dictionary, count(*) FROM terms GROUP BY dictionary""")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.import_counts({"terms": terms(spark, sf_dir), "tags": parts(spark, sf_dir).withColumnRenamed("archive", "dictionary")})


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition of each kind in turn, and one that is none, made of ``part``."""
    k, name, n = F.col("p_partkey") % 6, js("p_name"), F.col("p_size").cast("string")
    content = F.concat(F.lit('{"type":"structured-content","content":["'), F.col("p_type"), F.lit('",{"tag":"br"},{"tag":"span","style":{"fontSize":"'), n, F.lit('px"},"content":'), name, F.lit("}]}"))
    image = F.concat(F.lit('{"type":"image","path":"a/'), n, F.lit('.png","width":'), n, F.lit(',"imageRendering":"crisp-edges","collapsed":true}'))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.when(k == 0, name).when(k == 1, F.concat(F.lit('{"type":"text","text":'), name, F.lit("}"))).when(k == 2, content).when(k == 3, image).when(k == 4, F.concat(F.lit("["), name, F.lit(',["v1"]]'))).otherwise(n).alias("definition"))


@query("SELECT p_partkey, (['basic', 'text', 'structured-content', 'image', 'deinflection', NULL])[p_partkey % 6 + 1] AS kind FROM part")
def definition_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions(spark, sf_dir).select("p_partkey", structured.definition_kind(F.col("definition")).alias("kind"))


@query("""SELECT p_partkey, 'a/' || p_size || '.png' AS path, '' AS title, p_size AS width, 0 AS height, false AS pixelated, true AS background, true AS collapsed, true AS collapsible, 'crispEdges' AS "imageRendering", 'auto' AS appearance FROM part WHERE p_partkey % 6 = 3""")
def image_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = definitions(spark, sf_dir).where("p_partkey % 6 = 3").withColumn("i", structured.image_defaults(F.col("definition")))
    return images.select("p_partkey", *[F.col(f"i.{c}") for c in ("path", "title", "width", "height", "pixelated", "background", "collapsed", "collapsible", "imageRendering", "appearance")])


@query("SELECT p_partkey, ' font-size:' || p_size || 'px; background-color:' || p_brand || ';' AS style FROM part")
def style_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = F.create_map(F.lit("fontSize"), F.concat(F.col("p_size").cast("string"), F.lit("px")), F.lit("backgroundColor"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", structured.style_string(styles).alias("style"))


@query("SELECT p_partkey, '/base/dictionaryMedia/' || p_brand || '/' || p_size || '.png' AS path FROM part")
def media_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", structured.media_path(F.col("p_brand"), F.concat(F.col("p_size").cast("string"), F.lit(".png")), "/base").alias("path"))


@query(r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN p_type || '<br><span style=" font-size:' || p_size || 'px;">' || p_name || '</span>' WHEN 5 THEN NULL
    WHEN 3 THEN '<details><summary> </summary><img width="' || p_size || '" height="0" title="" alt="" description="" appearance="auto" src="/dictionaryMedia/' || p_brand || '/a/' || p_size || '.png"></details>' ELSE p_name END AS html FROM part""")
def structured_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All definitions, the malformed ones included, which have no HTML."""
    return definitions(spark, sf_dir).select("p_partkey", structured.structured_html("definition", "p_brand").alias("html"))


@query("SELECT source AS archive, 'img/' || doc_id || '.png' AS path, doc_id % 5 <> 4 AS missing, CASE WHEN doc_id % 5 = 4 THEN md5(text) END AS content_md5 FROM documents")
def extract_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file declared for each document, of which the archives hold those routed as media."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png"))
    held = B.route_entries(file_entries(spark, sf_dir)).where("kind = 'media'").join(d.select(F.col("source").alias("archive"), path.alias("path"), F.col("text").cast("binary").alias("content")), ["archive", "path"])
    return B.extract_media(held, d.select(F.col("source").alias("archive"), path.alias("path"))).select("archive", "path", "missing", F.md5("content").alias("content_md5"))
