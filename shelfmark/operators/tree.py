"""Trees by parent references, and paths as trees. All by equi-joins; loops in the data end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..staging import staged


def below(nodes: DataFrame, roots: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, depth): the roots (depth 0) and all nodes under them, each once, at its least depth.

    Each level joins the frontier with its children and drops what is known, so it ends at any depth and with loops of
    any length. Each frontier is staged, so that no level computes an earlier one again.
    """
    edges = nodes.select(F.col(key), F.col(parent)).where(F.col(parent).isNotNull())
    frontier = known = staged(roots.select(key).distinct().withColumn("depth", F.lit(0)), "roots")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        found = edges.join(frontier.select(F.col(key).alias("_up")), F.col(parent) == F.col("_up"), "left_semi").select(key).distinct()
        frontier = staged(found.join(known.select(key), key, "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        known = known.unionByName(frontier)
    return known


def climb(nodes: DataFrame, key: str, parent: str, stop: Column) -> DataFrame:
    """(key, at): for each node the nearest one on its way up, itself included, where stop holds or the way ends.

    Ways are halved in each round, as every node takes over what the node that it has come to has come to, so a chain of
    a thousand takes ten rounds. A parent that is no node ends the way at its child. Nodes whose way runs into a loop have
    null. Keys are unique and not null; a null stop counts as false.
    """
    own = staged(nodes.select(F.col(key).alias("key"), F.col(parent).alias("up"), F.coalesce(stop, F.lit(False)).alias("stop")), "nodes")
    there = own.select(F.col("key").alias("up"), F.lit(True).alias("there"))
    ends = F.col("stop") | F.col("there").isNull()
    begun = own.join(there, "up", "left").select("key", F.when(ends, F.col("key")).otherwise(F.col("up")).alias("at"), ends.alias("ended"))
    begun = staged(begun, "ways")
    open_, done = begun.where("not ended"), begun.where("ended").select("key", "at")
    known = begun
    for _ in range(max(begun.count(), 1).bit_length() + 1):
        if open_.isEmpty():
            break
        over = known.select(F.col("key").alias("at"), F.col("at").alias("_to"), F.col("ended").alias("_ended"))
        stepped = staged(open_.join(over, "at").select("key", F.col("_to").alias("at"), F.col("_ended").alias("ended")), "ways")
        done = done.unionByName(stepped.where("ended").select("key", "at"))
        open_ = stepped.where("not ended")
        known = done.withColumn("ended", F.lit(True)).unionByName(open_)
    found = done.unionByName(open_.select("key", F.lit(None).cast(own.schema["key"].dataType).alias("at")))
    return found.select(F.col("key").alias(key), "at")


def under_roots(nodes: DataFrame, wanted: DataFrame, key: str, parent: str) -> DataFrame:
    """The wanted nodes that hang off a root, at any depth."""
    roots = nodes.where(F.col(parent).isNull())
    return below(nodes, roots, key, parent).join(wanted.select(key).distinct(), key, "left_semi")


def between(nodes: DataFrame, top: DataFrame, wanted: DataFrame, key: str, parent: str) -> DataFrame:
    """The wanted nodes strictly under the top nodes."""
    under = below(nodes, top, key, parent).where("depth > 0").select(key)
    return under.join(wanted.select(key).distinct(), key, "left_semi")


def nested(items: DataFrame, key: str, path: str, group: list[str]) -> DataFrame:
    """(outer, inner): keys of items of a group of which one's path lies under the other's.

    The ancestors of each path are exploded and joined for equality, so there is no comparison of all pairs.
    """
    inner = items.select(*group, F.col(key).alias("inner"), F.explode(fn.ancestors(F.col(path))).alias("_at"))
    outer = items.select(*group, F.col(key).alias("outer"), F.col(path).alias("_at"))
    return inner.join(outer, [*group, "_at"]).select("outer", "inner")


def common_root(items: DataFrame, group: list[str], path: str, root: str = "root") -> DataFrame:
    """The longest common folder of each group's paths: positions at which all parts agree, as far as the first that differs."""
    sized = items.select(*group, F.split(path, "/").alias("p"))
    rows = sized.select(*group, F.size("p").alias("n"), F.posexplode("p").alias("pos", "part"))
    least = items.groupBy(*group).agg(F.count("*").alias("rows"))
    agree = rows.groupBy(*group, "pos").agg(F.count("*").alias("have"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    agree = agree.join(least, group).where((F.col("have") == F.col("rows")) & (F.col("lo") == F.col("hi")))
    parts = agree.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lo").alias("part")))).alias("a"))
    run = F.filter("a", lambda x, i: x["pos"] == i)
    out = parts.select(*group, F.array_join(F.transform(run, lambda x: x["part"]), "/").alias(root))
    return least.select(*group).join(out, group, "left").select(*group, F.coalesce(root, F.lit("")).alias(root))


def deletion_order(items: DataFrame, chosen: DataFrame, key: str, path: str, group: list[str]) -> DataFrame:
    """(root, key, step): what goes with each chosen item: all items under its path, the longest paths first, itself last."""
    under = nested(items, key, path, group).join(chosen.select(F.col(key).alias("outer")).distinct(), "outer", "left_semi")
    rows = under.select(F.col("outer").alias("root"), F.col("inner").alias(key)).unionByName(chosen.select(F.col(key).alias("root"), key).distinct())
    sized = rows.join(items.select(key, F.length(path).alias("_n")), key)
    order = Window.partitionBy("root").orderBy(F.desc("_n"), key)
    return sized.withColumn("step", F.row_number().over(order)).select("root", key, "step")


def without_self_parents(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """nodes, of which none is its own parent."""
    return nodes.withColumn(parent, F.when(F.col(parent) != F.col(key), F.col(parent)))
