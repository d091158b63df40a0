"""Who may see and index what: grants as an edge table (object, subject, permission); a null subject is everyone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import having, lacking
from .tree import climb


def presets(grants: DataFrame) -> DataFrame:
    """(object, preset): private (one owner's edge), member (another edge to a role), public (another edge to everyone), else custom."""
    n = grants.groupBy("object").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("permission") == "own").alias("own"),
        F.count_if(F.col("subject").startswith("role::")).alias("role"),
        F.count_if(F.col("subject").isNull()).alias("every"),
    )
    owned = F.col("own") == 1
    preset = F.when((F.col("n") == 1) & owned, "private").when((F.col("n") == 2) & owned & (F.col("role") == 1), "member").when((F.col("n") == 2) & owned & (F.col("every") == 1), "public")
    return n.select("object", preset.otherwise("custom").alias("preset"))


def with_preset(grants: DataFrame, objects: DataFrame, preset: str, role: str = "role::member") -> DataFrame:
    """grants after a preset is applied to objects (column object): owners stay, other edges go, the preset's edge comes."""
    touched = grants.join(objects.select("object").distinct(), "object", "left_semi")
    kept = grants.join(objects.select("object"), "object", "left_anti").unionByName(touched.where("permission = 'own'"))
    edge = {"private": None, "member": (role, "view"), "public": (None, "view")}[preset]
    if edge is None:
        return kept
    added = objects.select("object").distinct().select("object", F.lit(edge[0]).cast("string").alias("subject"), F.lit(edge[1]).alias("permission"))
    return kept.unionByName(added)


def indexable(items: DataFrame, creators: DataFrame, default: str = "no") -> DataFrame:
    """(id, indexable): an item's own value, else its creator's, else the default. Its collection does not count.

    Items have id, creator_id and indexable, creators id and indexable; an unset value is null or ``inherit``.
    """
    own = F.nullif("indexable", F.lit("inherit"))
    k = creators.select(F.col("id").alias("creator_id"), own.alias("_k"))
    return items.join(k, "creator_id", "left").select("id", F.coalesce(own, "_k", F.lit(default)).alias("indexable"))


def collections_indexable(collections: DataFrame, creators: DataFrame, default: str = "no") -> DataFrame:
    """(id, indexable): a collection's own value, else that of the nearest collection above with one.

    Where none has, the topmost collection's creator decides, then the default, which is also what a loop of collections
    comes to. Collections have id, parent_id, creator_id and indexable.
    """
    own = F.nullif("indexable", F.lit("inherit"))
    way = climb(collections, "id", "parent_id", own.isNotNull())
    top = indexable(collections, creators, default).select(F.col("id").alias("at"), "indexable")
    return way.join(top, "at", "left").select("id", F.coalesce("indexable", F.lit(default)).alias("indexable"))


def searchable(items: DataFrame, actors: DataFrame) -> DataFrame:
    """Items of local actors, and of remote ones that may be indexed (item column indexable; actors id, local)."""
    a = actors.select(F.col("id").alias("actor_id"), "local")
    return items.join(a, "actor_id").where(F.col("local") | F.coalesce(F.col("indexable") == "yes", F.lit(False))).drop("local")


def local_only(items: DataFrame, actors: DataFrame) -> DataFrame:
    """Items whose actor (item column actor_id; actors id, local) is local."""
    return having(items, actors.where("local"), "actor_id", "id")


def remote_only(items: DataFrame, actors: DataFrame) -> DataFrame:
    """Items whose actor is remote."""
    return having(items, actors.where("not local"), "actor_id", "id")


def mergeable(items: DataFrame, actors: DataFrame) -> DataFrame:
    """Items that may be merged: those of local actors and those without an actor."""
    return lacking(items, actors.where("not local"), "actor_id", "id")


def repaired_actors(actors: DataFrame, hostname: str) -> DataFrame:
    """actors (server, local, entity_type, entity_id), of which those of other servers are remote and those that own nothing have no type."""
    foreign = F.col("server").isNotNull() & (F.col("server") != hostname)
    fixed = actors.withColumn("local", F.col("local") & ~foreign)
    return fixed.withColumn("entity_type", F.when(F.col("entity_id").isNotNull(), F.col("entity_type")))


def visible_files(files: DataFrame, full: DataFrame, preview_only: DataFrame, previewable: str) -> DataFrame:
    """All files of items in full, and of items in preview_only those with the flag previewable. Items are in column id."""
    whole = having(files, full, "item_id", "id")
    part = having(lacking(files.where(F.col(previewable)), full, "item_id", "id"), preview_only, "item_id", "id")
    return whole.unionByName(part)


def without_sensitive(items: DataFrame, preference: str | None, flag: str = "sensitive") -> DataFrame:
    """Items without sensitive ones if the preference is ``hide``."""
    return items.where(~F.coalesce(F.col(flag), F.lit(False))) if preference == "hide" else items
