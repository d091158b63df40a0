"""Entries of zip archives, read inside tasks by ranges: the table at an archive's end, and single entries, however large it is."""

from __future__ import annotations

import io
import itertools
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.filters import file_class
from ..operators.ranking import best

ENTRIES = "archive string, pathname string, size long, compressed_size long, status string"
MOST = 100_000
#: Entries of a batch, and bytes that are read of an archive at once.
BATCH, CHUNK = 10_000, 1 << 20
#: Stores of which tasks can read ranges by themselves; files of others come as rows that hold them whole.
RANGES = ("file", "s3", "s3a", "gs")
#: Fixed values of the format: marks of the end of the table, of its long form and where that is, and of an entry in it and at its data.
END, END_64, AT_64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class Unreadable(Exception):
    """What is read is no zip archive, or an incomplete one."""


def opened(path: str) -> BinaryIO:
    """A file of a store of RANGES, to seek in and read."""
    scheme, _, rest = path.partition(":")
    system, name = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}:///{rest.lstrip('/')}" if scheme == "file" else f"{scheme.replace('s3a', 's3')}:{rest}")
    return system.open_input_file(name)


def _at(file: BinaryIO, start: int, size: int) -> bytes:
    file.seek(start)
    out = file.read(size)
    if len(out) < size:
        raise Unreadable
    return out


def table_entries(file: BinaryIO) -> Iterator[tuple[str, int, int, int, int]]:
    """(pathname, size, compressed size, method, where its data's head is) of each file, as the table is read on, a part at a time."""
    length = file.seek(0, 2) or file.tell()
    tail_at = max(0, length - 65_557)
    tail = _at(file, tail_at, length - tail_at)
    end = tail.rfind(END)
    if end < 0 or len(tail) < end + 22:
        raise Unreadable
    many, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    before = tail_at + end - size - start  # bytes in front of the archive, as of one that unpacks itself
    if end >= 20 and tail[end - 20 : end - 16] == AT_64:
        (long_at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        head = _at(file, long_at, 56)
        if head[:4] != END_64:
            raise Unreadable
        many, size, start = struct.unpack("<QQQ", head[32:56])
        before = 0
    at, left, held = start + before, size, b""
    for _ in range(many):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack("<HHH", held[28:34])):
            if not left:
                raise Unreadable
            part = _at(file, at, min(CHUNK, left))
            at, left, held = at + len(part), left - len(part), held + part
        if held[:4] != ENTRY:
            raise Unreadable
        flags, method = struct.unpack("<HH", held[8:12])
        packed, full, n, extra, comment = struct.unpack("<IIHHH", held[20:34])
        (local,) = struct.unpack("<I", held[42:46])
        name, more = held[46 : 46 + n], held[46 + n : 46 + n + extra]
        held = held[46 + n + extra + comment :]
        while len(more) >= 4:
            kind, many_bytes = struct.unpack("<HH", more[:4])
            if kind == 1:  # values that do not fit, in this order
                longs = iter(struct.unpack(f"<{many_bytes // 8}Q", more[4 : 4 + many_bytes // 8 * 8]))
                full, packed, local = (next(longs, x) if x == 0xFFFFFFFF else x for x in (full, packed, local))
            more = more[4 + many_bytes :]
        if not name.endswith(b"/"):
            yield name.decode("utf-8" if flags & 0x800 else "cp437"), full, packed, method, local + before


def entry_parts(file: BinaryIO, packed: int, method: int, local: int) -> Iterator[bytes]:
    """The content of an entry in parts, unpacked as it is read."""
    head = _at(file, local, 30)
    if head[:4] != LOCAL or method not in (0, 8):
        raise Unreadable
    at, left = local + 30 + sum(struct.unpack("<HH", head[26:30])), packed
    unpack = zlib.decompressobj(-15) if method == 8 else None
    while left:
        part = _at(file, at, min(CHUNK, left))
        at, left = at + len(part), left - len(part)
        yield unpack.decompress(part) if unpack else part
    if unpack:
        yield unpack.flush()


def _listed(path: str, file: BinaryIO, most: int, longest: int) -> Iterator[tuple]:
    try:
        for k, (name, full, packed, _, _) in enumerate(table_entries(file)):
            if k == most:
                yield path, None, None, None, "truncated"
                return
            yield path, name, full, packed, "too_large" if full > longest else "listed"
    except (Unreadable, struct.error, UnicodeDecodeError):
        yield path, None, None, None, "unreadable"


def entries(spark: SparkSession, root: str, most: int = MOST, longest: int = 100 * 2**20, largest: int = 2**30) -> DataFrame:
    """(archive, pathname, size, compressed_size, status, kind) of each file in each zip under root.

    Unsafe paths and system entries are left out; status is ``listed`` or ``too_large``. An archive with more files than
    most has one row ``truncated`` after so many, an unreadable one ``unreadable``, another kind than zip ``unsupported``.
    Tasks read an archive's table by ranges, so archives may be of any size; only in stores of which tasks cannot
    read ranges, one of over ``largest`` bytes has one row ``oversized``, since there a row holds a whole archive.
    """

    def run(frames):
        for frame in frames:
            rows = itertools.chain.from_iterable(found(*x) for x in frame.itertuples(index=False))
            while part := list(itertools.islice(rows, BATCH)):
                yield pd.DataFrame(part, columns=["archive", "pathname", "size", "compressed_size", "status"]).astype({"size": "Int64", "compressed_size": "Int64"})

    def found(path, content=None):
        if not path.lower().endswith(".zip"):
            yield path, None, None, None, "unsupported"
            return
        with opened(path) if content is None else io.BytesIO(content) as file:
            yield from _listed(path, file, most, longest)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{zip,7z,rar}").load(root)
    ranged = F.split("path", ":")[0].isin(*RANGES)
    # Paths alone are dealt out one by one, as the listing's own partitions follow the files' sizes.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = files.where(ranged).select("path").repartition(n, "path").mapInPandas(run, ENTRIES)
    fits = files.where(~ranged & (F.col("length") <= largest)).select("path", "content")  # pushed down: larger ones are not read
    none = [F.lit(None).cast(x) for x in ("string", "long", "long")]
    raw = raw.union(fits.mapInPandas(run, ENTRIES)).union(files.where(~ranged & (F.col("length") > largest)).select("path", *none, F.lit("oversized")))
    listed = raw.withColumn("pathname", fn.safe_entry(F.col("pathname")))
    kept = listed.where(~F.col("status").isin("listed", "too_large") | (F.col("pathname").isNotNull() & ~F.col("pathname").rlike(r"(^|/)(__MACOSX/|\._|\.DS_Store$)")))
    kind = F.when(file_class(fn.extension(F.col("pathname"))).isin("image", "mesh"), file_class(fn.extension(F.col("pathname")))).otherwise("other")
    return kept.withColumn("kind", F.when(F.col("pathname").isNotNull(), kind))


def contents(wanted: DataFrame, longest: int = 100 * 2**20) -> DataFrame:
    """(archive, pathname, content, status) of the wanted entries (archive, pathname), in stores of RANGES.

    Tasks unpack only these, as they read them. Status is ``read``, ``too_large`` for those that unpack to more than longest
    bytes, whatever the table says, ``missing`` or ``unreadable``; the others than read have a null content. Of entries that repeat
    a name the last counts. The wanted of one archive are looked up in one reading of its table.
    """
    columns = "archive string, pathname string, content binary, status string"

    def one(file, place) -> tuple:
        parts, size = [], 0
        try:
            for part in entry_parts(file, *place):
                size += len(part)
                if size > longest:
                    return None, "too_large"
                parts.append(part)
        except (Unreadable, zlib.error, struct.error):
            return None, "unreadable"
        return b"".join(parts), "read"

    def run(batches):
        for path, group in itertools.groupby(((a, p) for batch in batches for a, p in zip(batch["archive"].to_pylist(), batch["pathname"].to_pylist())), key=lambda x: x[0]):
            names, places, broken = [p for _, p in group], {}, False
            with opened(path) as file:
                try:
                    asked = set(names)
                    places = {name: (packed, method, local) for name, _, packed, method, local in table_entries(file) if name in asked}
                except (Unreadable, struct.error, UnicodeDecodeError):
                    broken = True
                for name in names:
                    content, status = (None, "unreadable") if broken else one(file, places[name]) if name in places else (None, "missing")
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([content], pa.binary()), pa.array([status])], names=["archive", "pathname", "content", "status"])

    keyed = wanted.select("archive", "pathname").where("archive is not null and pathname is not null").distinct()
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "archive").sortWithinPartitions("archive", "pathname").mapInArrow(run, columns)


def synchronise(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """(archive, pathname, action): insert, update or delete, so that stored entries become the listed ones."""
    key = ["archive", "pathname"]
    old = stored.select(*key, F.col("size").alias("_old"), F.lit(True).alias("_had"))
    new = listed.where("pathname is not null").select(*key, F.col("size").alias("_new"), F.lit(True).alias("_has"))
    both = old.join(new, key, "full")
    action = F.when(F.col("_had").isNull(), "insert").when(F.col("_has").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return both.select(*key, action.alias("action")).where("action is not null")


def largest_image(listed: DataFrame, least: int = 3000) -> DataFrame:
    """(archive, size, pathname): each archive's largest image of so many bytes at least; of equals the last name."""
    return best(listed.where((F.col("kind") == "image") & (F.col("size") >= least)), ["archive"], ["size"], ["pathname"])
