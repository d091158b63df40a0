"""Mesh files in parts of any size, and surfaces against counts of all edges."""

import collections
import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import detectors, geometry
from shelfmark.sources import meshes

CUBE = [(x, y, z) for x in (0.0, 1.5) for y in (-0.0, 2.0) for z in (0.0, 3.25)]
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
FACES = [t for a, b, c, d in QUADS for t in ((a, b, c), (a, c, d))]


def binary(faces):
    return b"solid no text".ljust(80) + struct.pack("<I", len(faces)) + b"".join(struct.pack("<12fH", 0, 0, 0, *itertools.chain(*(CUBE[k] for k in f)), 0) for f in faces)


def text(faces):
    facet = lambda f: "facet normal 0 0 0\n outer loop\n" + "".join("  VERTEX {} {} {}\n".format(*CUBE[k]) for k in f) + " endloop\nendfacet\n"
    return ("solid x\n" + "".join(map(facet, faces)) + "endsolid x\n").encode()


def rows(df):
    point = lambda p: (p.x, p.y, p.z)
    return collections.Counter((r.mesh.rsplit("/", 1)[1], frozenset((point(r.a), point(r.b), point(r.c)))) for r in df.collect())


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_triangles_of_files(spark, tmp_path, size):
    (tmp_path / "bin.STL").write_bytes(binary(FACES))
    (tmp_path / "text.stl").write_bytes(text(FACES))
    (tmp_path / "none.stl").write_bytes(b"")
    (tmp_path / "cut.stl").write_bytes(text(FACES)[:100])
    cube = [frozenset((x + 0.0, y + 0.0, z) for x, y, z in (CUBE[k] for k in f)) for f in FACES]
    got = rows(meshes.stl_triangles(spark, str(tmp_path), size))
    assert got == collections.Counter((n, f) for n in ("bin.STL", "text.stl") for f in cube)
    lines = ["# cube", *("v {} {} {}".format(*p) for p in CUBE[:4]), "vn 0 0 1", "f 1 2 4 3", *("v {} {} {} 1.0".format(*p) for p in CUBE[4:])]
    lines += ["f " + " ".join(f"{k + 1}//7" if n % 2 else f"{k - 8}/1/2" for k in q) for n, q in enumerate(QUADS[1:])] + ["f 1 2 99", "g end"]
    (tmp_path / "c.obj").write_text("\n".join(lines))
    assert rows(meshes.obj_triangles(spark, str(tmp_path), size)) == collections.Counter(("c.obj", f) for f in cube)
    (one,) = geometry.manifold(meshes.obj_triangles(spark, str(tmp_path), size)).collect()
    assert (one.triangles, one.edges, one.open_edges, one.crowded_edges, one.manifold) == (12, 18, 0, 0, True)
    (box,) = geometry.bounds(meshes.obj_triangles(spark, str(tmp_path), size)).collect()
    assert tuple(box.size) == (1.5, 2.0, 3.25)


def test_surfaces_equal_counts_of_all_edges(spark):
    rng = random.Random(6)
    data = [(m, *(rng.choice([rng.randrange(4), rng.randrange(4), None if m == 3 else 1]) for _ in range(3))) for m in range(12) for _ in range(rng.randrange(1, 8))] + [(None, 1, 2, 3), (50, 1, 1, 2)]
    data += [(60, *f) for f in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
    want = {}
    for m in {d[0] for d in data}:
        faces = [set(d[1:]) for d in data if d[0] == m and None not in d[1:] and len(set(d[1:])) == 3]
        n = collections.Counter(frozenset(e) for f in faces for e in itertools.combinations(sorted(f), 2))
        want[m] = (len(faces), len(n), sum(c == 1 for c in n.values()), sum(c > 2 for c in n.values()), bool(n) and set(n.values()) == {2})
    df = spark.createDataFrame(data, "mesh long, a int, b int, c int")
    assert {r.mesh: tuple(r)[1:] for r in geometry.manifold(df).collect()} == want and want[60][-1]
    bad = {r.id for r in detectors.detect({"triangles": df.where("mesh >= 50")}, ["non_manifold"]).collect()}
    assert bad == {50} and geometry.manifold(df.limit(0)).count() == 0


def test_edges_are_counted_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(geometry, "TASK_ROWS", 10)
    one = spark.range(0, 100).coalesce(1).select((F.col("id") % 3).alias("mesh"), *[F.struct((F.col("id") + k).alias("x")).alias(c) for k, c in enumerate("abc")])
    found = geometry.manifold(one)
    assert ", 11), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.mesh: r.triangles for r in found.collect()} == {0: 34, 1: 33, 2: 33}
