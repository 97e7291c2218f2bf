"""Zips read by ranges: their directories as a table, and any of their members in any task."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import NativeFile, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.sources.banks import BROKEN, ENTRY

MEMBER = "archive string, path string, place long, packed long, size long, method int, crc long, reason string"

#: Bytes of an archive that one task reads, and how far apart two members may be that one read takes.
SPLIT, GAP = 32 << 20, 64 << 10

# The local header of a member (format, bytes, signature), the methods that need no more than zlib, the bit that says encrypted.
HEADER, HEADER_BYTES, SIGNATURE = "<4s5H3L2H", 30, b"PK\x03\x04"
STORED, DEFLATED, ENCRYPTED = 0, 8, 1

_UNREADABLE = (zipfile.BadZipFile, RuntimeError, OSError, ValueError, EOFError, zlib.error, NotImplementedError, struct.error)


def open_file(uri: str) -> NativeFile:
    """A file for reads at any place, by the path that Spark's readers show."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    where, path = fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)
    return where.open_input_file(path)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def zip_members(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(archive, path, place, packed, size, method, crc, reason): a row for each file in the zips under ``path``, from their directories alone.

    ``place`` is where its header begins, ``packed`` the bytes it takes. A zip that can't be opened
    has one row under the path BROKEN, an encrypted file one under its own; both have a
    ``reason``. Folders inside zips, and files of no bytes, give no rows. ``banks.route_entries``
    adds the kinds, so that what isn't wanted is left out before a byte of it is read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                yield pd.DataFrame(listed_members(uri), columns=[c.split()[0] for c in MEMBER.split(", ")])

    return _files(spark, path, glob).where("length > 0").select("path").mapInPandas(run, MEMBER)


def listed_members(uri: str) -> list[tuple]:
    try:
        with open_file(uri) as file, zipfile.ZipFile(file) as archive:
            found = [m for m in archive.infolist() if not m.is_dir()]
    except _UNREADABLE as e:
        return [(uri, BROKEN, 0, 0, 0, STORED, 0, f"archive: {e}")]
    locked = lambda m: f"{m.filename}: encrypted" if m.flag_bits & ENCRYPTED else None
    return [(uri, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, locked(m)) for m in found]


def read_members(members: DataFrame, split: int = SPLIT, tasks: int | None = None) -> DataFrame:
    """Rows of ``zip_members`` -> (archive, path, content), as ``banks.read_archives`` gives them; members may be filtered before.

    Members are dealt to tasks by archive and by which ``split`` bytes of it they begin in, so that
    one archive is read by as many tasks as it has such parts; a task holds neighbours of up to
    ``split`` bytes, or one larger member. There are ``tasks`` tasks, by default one for each
    ``split`` bytes that the members take. A member that can't be read (its reason given, cut
    short, changed, of an unknown method) gives a row under BROKEN with the reason.
    """
    if tasks is None:
        tasks = max(1, -(-members.agg(F.coalesce(F.sum("packed"), F.lit(0)).alias("n")).first().n // split))
    wanted = members.select(*[c.split()[0] for c in MEMBER.split(", ")]).withColumn("part", F.floor(F.col("place") / split))
    dealt = wanted.repartition(tasks, "archive", "part").sortWithinPartitions("archive", "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, rows in frame.groupby("archive", sort=False):
                for stretch in stretches(list(rows.itertuples(index=False)), split):
                    for some in bounded(read_stretch(archive, stretch)):
                        yield pd.DataFrame([(archive, *row) for row in some], columns=["archive", "path", "content"])

    return dealt.mapInPandas(run, ENTRY)


def bounded(rows: Iterator[tuple[str, bytes]], most: int = 8 << 20) -> Iterator[list[tuple[str, bytes]]]:
    """Rows in lists whose contents reach ``most`` bytes at their last row, if at all: unpacked, a stretch may be far larger than it is in its file."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def stretches(rows: list, split: int = SPLIT, gap: int = GAP) -> Iterator[list]:
    """Members in the order of their places, in runs that one read takes: with gaps of up to ``gap`` bytes, and of up to ``split`` bytes or one member each."""
    run: list = []
    for row in rows:
        if run and (row.place - (run[-1].place + run[-1].packed) > gap or row.place + row.packed - run[0].place > split):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_stretch(uri: str, rows: list) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of neighbouring members, or BROKEN and the reason, by one read of the file: their headers name no more than 128 KB beside their data."""
    sound = [row for row in rows if not isinstance(row.reason, str)]
    for row in rows:
        if isinstance(row.reason, str):
            yield BROKEN, row.reason.encode()
    if not sound:
        return
    begin, end = sound[0].place, max(row.place + row.packed for row in sound)
    try:
        with open_file(uri) as file:
            data = file.read_at(end - begin + HEADER_BYTES + (2 << 16), begin)
    except OSError as e:
        yield from ((BROKEN, f"{row.path}: {e}".encode()) for row in sound)
        return
    for row in sound:
        try:
            yield row.path, unpack(uri, memoryview(data)[row.place - begin :], row)
        except _UNREADABLE as e:
            yield BROKEN, f"{row.path}: {e}".encode()


def unpack(uri: str, data: memoryview, row: tuple) -> bytes:
    """The content of a member whose local header ``data`` begins with."""
    if row.method not in (STORED, DEFLATED):
        with open_file(uri) as file, zipfile.ZipFile(io.BufferedReader(file)) as archive:
            return archive.read(next(m for m in archive.infolist() if m.header_offset == row.place))
    signature, *_, name, extra = struct.unpack(HEADER, data[:HEADER_BYTES])
    if signature != SIGNATURE:
        raise zipfile.BadZipFile("no header at its place")
    packed = data[HEADER_BYTES + name + extra :][: row.packed]
    if len(packed) < row.packed:
        raise EOFError("cut short")
    content = bytes(packed) if row.method == STORED else zlib.decompressobj(-zlib.MAX_WBITS).decompress(packed, row.size + 1)
    if len(content) != row.size or zlib.crc32(content) != row.crc:
        raise zipfile.BadZipFile("bad checksum")
    return content
