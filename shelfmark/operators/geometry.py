"""Meshes as rows of triangles: whether they are closed surfaces, and what space they take. A mesh lies in as many tasks as it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ("a", "b", "c")
#: Triangles whose edges a task counts, so that its memory does not grow with the table.
TASK_ROWS = 200_000


def manifold(triangles: DataFrame, mesh: str = "mesh") -> DataFrame:
    """(mesh, triangles, edges, open_edges, crowded_edges, manifold) of each mesh.

    triangles has the mesh and three corners a, b and c, of any kind that can be compared and grouped, as structs of coordinates; equal
    ones are one corner. A mesh is manifold if each undirected edge belongs to two triangles exactly: open edges have
    one, crowded ones more. Triangles with two equal corners have no area and do not count; a mesh of such alone is not
    manifold, and null corners make a triangle count for nothing. Edges are counted by partial aggregation, so a large mesh is no
    task's own.
    """
    whole = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    solid = whole & (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c"))
    edge = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    parts = int(triangles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    triangles = triangles.select(mesh, *CORNERS).repartition(max(parts, triangles.count() // TASK_ROWS + 1), mesh, *CORNERS)
    faces = triangles.where(solid)
    edges = faces.select(mesh, F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("a", "c"))).alias("edge")).groupBy(mesh, "edge").agg(F.count("*").alias("n"))
    found = edges.groupBy(mesh).agg(F.sum("n").alias("sides"), F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("open_edges"), F.count_if(F.col("n") > 2).alias("crowded_edges"))
    meshes = triangles.select(mesh).distinct().alias("m").join(found.alias("f"), F.col(f"m.{mesh}").eqNullSafe(F.col(f"f.{mesh}")), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    closed = (F.col("edges") > 0) & (F.col("open_edges") == 0) & (F.col("crowded_edges") == 0)
    return meshes.select(
        F.col(f"m.{mesh}").alias(mesh), count((F.col("sides") / 3).cast("long")).alias("triangles"), *[count(F.col(c)).alias(c) for c in ("edges", "open_edges", "crowded_edges")], F.coalesce(closed, F.lit(False)).alias("manifold")
    )


def bounds(triangles: DataFrame, mesh: str = "mesh") -> DataFrame:
    """(mesh, low, high, size): the box round each mesh's corners, structs of x, y and z, and its extent along each axis."""
    axes = ("x", "y", "z")
    each = triangles.select(mesh, F.explode(F.array(*CORNERS)).alias("p")).where("p is not null")
    found = each.groupBy(mesh).agg(*[f(f"p.{c}").alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in axes])

    def box(of) -> Column:
        return F.struct(*[of(c).alias(c) for c in axes])

    return found.select(mesh, box(lambda c: F.col(f"min_{c}")).alias("low"), box(lambda c: F.col(f"max_{c}")).alias("high"), box(lambda c: F.col(f"max_{c}") - F.col(f"min_{c}")).alias("size"))
