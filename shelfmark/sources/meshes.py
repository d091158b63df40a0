"""Triangles of mesh files, read by ranges: binary and text STL, and OBJ. No file is held whole, whatever its size."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archives import RANGES, opened

#: Bytes of a file that a task reads at once, and those after them that the last facet or line may reach into.
CHUNK, TAIL = 16 << 20, 1 << 16
TRIANGLE = np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("rest", "<u2")])
_FACET = re.compile(rb"(?<!end)facet\b(.*?)endfacet", re.S | re.I)
_VERTEX = re.compile(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", re.I)
_POINT = "struct<x: float, y: float, z: float>"


def _chunks(spark: SparkSession, root: str, ending: str, size: int) -> DataFrame:
    """(mesh, length, start) of each part of each file under root with that ending, whatever its case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    ours = files.where(F.lower("path").endswith(ending) & F.split("path", ":")[0].isin(*RANGES) & (F.col("length") > 0))
    parts = ours.select(F.col("path").alias("mesh"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "mesh", "start")


def _points(p: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(p[:, k] + np.float32(0), pa.float32()) for k in range(3)], names=["x", "y", "z"])  # no negative zero


def _read(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def _stl(file, length: int, start: int, size: int) -> np.ndarray:
    """Corners (n x 3 x 3) of the facets that begin in a part."""
    head = _read(file, 0, 84)
    many = struct.unpack("<I", head[80:84])[0] if len(head) == 84 else -1
    if length == 84 + 50 * many:
        lo, hi = (min(many, max(0, -(-(x - 84) // 50))) for x in (start, start + size))
        return np.frombuffer(_read(file, 84 + 50 * lo, 50 * (hi - lo)), TRIANGLE)["corner"]
    found = []
    for m in _FACET.finditer(_read(file, start, size + TAIL)):
        corners = _VERTEX.findall(m[1])
        if m.start() < size and len(corners) == 3:
            found.append([[float(x) for x in c] for c in corners])
    return np.array(found, np.float32).reshape(-1, 3, 3)


def stl_triangles(spark: SparkSession, root: str, size: int = CHUNK) -> DataFrame:
    """(mesh, a, b, c) of each facet of each STL file under root; corners are structs of x, y and z.

    Text facets that are cut or have other than three corners are left out, and so are those of over 64 KB.
    """

    def run(batches):
        for batch in batches:
            for mesh, length, start in zip(*(batch[c].to_pylist() for c in ("mesh", "length", "start"))):
                with opened(mesh) as file:
                    corners = _stl(file, length, start, size)
                yield pa.RecordBatch.from_arrays([pa.array([mesh] * len(corners), pa.string()), *(_points(corners[:, k]) for k in range(3))], names=["mesh", "a", "b", "c"])

    return _chunks(spark, root, ".stl", size).mapInArrow(run, f"mesh string, a {_POINT}, b {_POINT}, c {_POINT}")


def _lines(file, length: int, start: int, size: int):
    """The lines that begin in a part."""
    data = _read(file, max(start - 1, 0), size + 1 + TAIL)
    at = 0 if start == 0 else data.find(b"\n") + 1
    if start and not at:
        return
    end = size + (start > 0)
    while at < min(end, len(data)):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop + 1


def obj_triangles(spark: SparkSession, root: str, size: int = CHUNK) -> DataFrame:
    """(mesh, a, b, c) of each face of each OBJ file under root, of more than three corners as a fan.

    Faces name vertices by their numbers in the file, or back from where they stand; parts of a file count theirs first, so
    that each part knows the number of its first. Faces that name what is not there are left out.
    """

    def count(batches):
        for batch in batches:
            for mesh, length, start in zip(*(batch[c].to_pylist() for c in ("mesh", "length", "start"))):
                with opened(mesh) as file:
                    n = sum(1 for words in _lines(file, length, start, size) if words[:1] == [b"v"])
                yield pa.RecordBatch.from_arrays([pa.array([mesh]), pa.array([length]), pa.array([start]), pa.array([n], pa.int64())], names=["mesh", "length", "start", "n"])

    def read(batches):
        for batch in batches:
            for mesh, length, start, before in zip(*(batch[c].to_pylist() for c in ("mesh", "length", "start", "before"))):
                rows, at = [], before
                with opened(mesh) as file:
                    for k, words in enumerate(_lines(file, length, start, size)):
                        if words[:1] == [b"v"] and len(words) > 3:
                            at += 1
                            rows.append((at, None, None, None, *(float(x) for x in words[1:4])))
                        elif words[:1] == [b"f"]:
                            named = [int(w.split(b"/")[0]) for w in words[1:]]
                            named = [x if x > 0 else at + 1 + x for x in named]
                            rows += [(None, (start << 24) + (k << 8) + j, corner, named[i], None, None, None) for j in range(1, len(named) - 1) for corner, i in enumerate((0, j, j + 1))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.float32()] * 3]
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([mesh] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["mesh", "number", "face", "corner", "named", "x", "y", "z"])

    counted = _chunks(spark, root, ".obj", size).mapInArrow(count, "mesh string, length long, start long, n long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("mesh").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counted.withColumn("before", before).mapInArrow(read, "mesh string, number long, face long, corner int, named long, x float, y float, z float")
    zero = lambda c: (F.col(c) + F.lit(0).cast("float")).alias(c)
    vertices = rows.where("number is not null").select("mesh", F.col("number").alias("named"), F.struct(*[zero(c) for c in "xyz"]).alias("p"))
    corners = rows.where("face is not null").select("mesh", "face", "corner", "named").join(vertices, ["mesh", "named"])
    faces = corners.groupBy("mesh", "face").agg(*[F.max(F.when(F.col("corner") == k, F.col("p"))).alias(c) for k, c in enumerate("abc")])
    return faces.where("a is not null and b is not null and c is not null").drop("face")
