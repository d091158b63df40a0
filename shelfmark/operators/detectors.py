"""Problem detectors and their report: each finds keys with a problem; the report updates stored problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, format_note
from ..staging import dealt
from . import geometry
from .filters import FILE_CLASSES, file_class, having, lacking
from .tree import nested

#: The severity of each category unless a user sets another.
SEVERITY = {
    "missing": "danger", "missing_item": "danger", "missing_library": "danger", "empty": "info", "empty_file": "info", "nesting": "warning", "duplicate": "warning", "no_image": "silent", "no_mesh": "silent",
    "no_license": "silent", "no_links": "silent", "no_creator": "silent", "no_tags": "silent", "inefficient": "info", "file_naming": "silent", "non_manifold": "warning",
}
RANK = {"silent": 0, "info": 1, "warning": 2, "danger": 3}

Detector = Callable[[dict[str, DataFrame]], DataFrame]
REGISTRY: dict[str, tuple[str, Detector, tuple[str, ...]]] = {}


def detector(category: str, kind: str, *needs: str):
    """Register a function from the catalogue's frames to a frame with the column id; it needs these frames or columns (``frame.column``)."""

    def register(f: Detector) -> Detector:
        REGISTRY[category] = (kind, f, needs)
        return f

    return register


def duplicates(df: DataFrame, digest: str, key: str = "id") -> DataFrame:
    """Rows that share a digest with others; rows are dealt out once, for the counts and for the join with them."""
    rows = df.where(F.col(digest).isNotNull()).select(key, digest)
    rows = dealt(rows, rows.count(), digest)
    return rows.join(repeated(rows, [digest]), digest, "left_semi").select(key)


def _fileless(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items without any of the files; an item's files count once before the join, however many they are."""
    return lacking(items, files.select("item_id").distinct(), "id", "item_id").select("id")


@detector("missing", "file", "listing.filename")
def missing(t):
    return t["files"].join(t["listing"], ["item_id", "filename"], "left_anti").select("id")


@detector("missing_item", "item", "listing.item_id")
def missing_item(t):
    """Items of whose folder the listing has no file; listing has path or item_id."""
    return lacking(t["items"], t["listing"], "id", "item_id").select("id")


@detector("missing_library", "library", "libraries", "mounted")
def missing_library(t):
    """Libraries (id, path) whose path is not among the mounted ones."""
    return lacking(t["libraries"], t["mounted"], "path", "path").select("id")


@detector("empty_file", "file")
def empty_file(t):
    """Files of no byte; an unknown size is not empty."""
    return t["files"].where(F.col("size") == 0).select("id")


@detector("file_naming", "item", "items.formatted_path")
def file_naming(t):
    """Items whose path is not the one that the template gives (column formatted_path), unless other items lie under them."""
    holding = nested(t["items"], "id", "path", ["library_id"]).select(F.col("outer").alias("id")).distinct()
    return t["items"].where(~F.col("path").eqNullSafe(F.col("formatted_path"))).join(holding, "id", "left_anti").select("id")


@detector("inefficient", "file", "files.head")
def inefficient(t):
    """Files of which the format is inefficient, by ending and first bytes (column head, text)."""
    return t["files"].where(format_note(extension(F.col("filename")), F.col("head")).isNotNull()).select("id")


@detector("empty", "item")
def empty(t):
    return _fileless(t["items"], t["files"])


@detector("nesting", "item")
def nesting(t):
    return nested(t["items"], "id", "path", ["library_id"]).select(F.col("outer").alias("id")).distinct()


@detector("duplicate", "file")
def duplicate(t):
    kind = F.coalesce(file_class(extension(F.col("filename"))), F.lit(""))
    return duplicates(t["files"].where((F.col("size") > 0) & (kind != "document")), "digest")


def _without(kind: str) -> Detector:
    return lambda t: _fileless(t["items"], t["files"].where(extension(F.col("filename")).isin(FILE_CLASSES[kind])))


detector("no_image", "item")(_without("image"))
detector("no_mesh", "item")(_without("mesh"))


@detector("non_manifold", "file", "triangles")
def non_manifold(t):
    """Meshes that are no closed surfaces; triangles has the file in column mesh."""
    return geometry.manifold(t["triangles"]).where("not manifold").select(F.col("mesh").alias("id"))


def _blank(column: str) -> Detector:
    return lambda t: t["items"].where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "").select("id")


detector("no_license", "item")(_blank("license"))
detector("no_creator", "item")(_blank("creator_id"))
detector("no_links", "item", "links")(lambda t: lacking(t["items"], t["links"], "id", "item_id").select("id"))
detector("no_tags", "item", "tags")(lambda t: lacking(t["items"], t["tags"], "id", "item_id").select("id"))


def detect(tables: dict[str, DataFrame], categories: list[str] | None = None) -> DataFrame:
    """(category, kind, id) of every problem that the detectors of the categories find, or all those whose inputs are there."""
    given = {*tables, *(f"{name}.{c}" for name, df in tables.items() for c in df.columns)}
    out = None
    for category in categories or sorted(c for c, (_, _, needs) in REGISTRY.items() if given.issuperset(needs)):
        kind, f, _ = REGISTRY[category]
        found = f(tables).select(F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"))
        out = found if out is None else out.unionByName(found)
    return out


def update(stored: DataFrame, detected: DataFrame, key: list[str]) -> DataFrame:
    """Stored problems (key, state, ignored) after a run: what was not found goes, new ones are open and not ignored,
    and known ones lose their ignored mark but keep being resolved."""
    old = stored.select(*key, F.col("state").alias("_state"), F.lit(True).alias("_old"))
    joined = detected.select(*key).distinct().join(old, key, "left")
    state = F.when(F.col("_state") == "resolving", "resolving").otherwise("detected")
    return joined.select(*key, state.alias("state"), F.lit(False).alias("ignored"), F.coalesce("_old", F.lit(False)).alias("known"))


def severity(category: Column, own: dict[str, str] | None = None) -> Column:
    """The severity of a category, by the defaults and a user's own settings."""
    pairs = [F.lit(x) for k, v in (SEVERITY | (own or {})).items() for x in (k, v)]
    return F.create_map(*pairs)[category]


def worst(problems: DataFrame, group: list[str]) -> DataFrame:
    """The worst severity of each group's problems."""
    rank = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)])
    return problems.withColumn("severity", severity(F.col("category"))).groupBy(*group).agg(F.max_by("severity", rank[F.col("severity")]).alias("severity"))


def orphans(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, n): how many rows of each frame refer to a missing row (frame, reference, target, key)."""
    out = None
    for name, (df, reference, target, key) in checks.items():
        lost = df.where(F.col(reference).isNotNull()).join(target.select(F.col(key).alias("_key")), F.col(reference) == F.col("_key"), "left_anti")
        n = lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def problems_with_files(problems: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, category): problems (category, kind, id) of items and of their files."""
    own = problems.where("kind = 'item'").select(F.col("id").alias("item_id"), "category")
    of_files = problems.where("kind = 'file'").join(files.select("id", "item_id"), "id").select("item_id", "category")
    return own.unionByName(of_files)


def shown(problems: DataFrame, own: dict[str, str] | None = None) -> DataFrame:
    """problems (category, ignored, in_progress) that a user sees, with severity and rank: neither ignored nor silent; the worst sort first."""
    rank = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)])
    graded = problems.where(~F.coalesce("ignored", F.lit(False))).withColumn("severity", severity(F.col("category"), own))
    return graded.where(F.coalesce("severity", F.lit("info")) != "silent").withColumn("rank", rank[F.col("severity")])


def unpublishable(items: DataFrame, creators: DataFrame, public: DataFrame) -> DataFrame:
    """(id, issues): public items (id, license, creator_id) that may not be: without licence or creator, or with a creator that is not public.

    public has kind (``item`` or ``creator``) and id of what everyone may see; issues are in a fixed order.
    """
    shown_items = having(items, public.where("kind = 'item'"), "id", "id")
    open_creators = public.where("kind = 'creator'").select(F.col("id").alias("_c"), F.lit(True).alias("_open")).distinct()
    known = creators.select(F.col("id").alias("_k"), F.lit(True).alias("_known")).distinct()
    joined = shown_items.join(known, F.col("creator_id") == F.col("_k"), "left").join(open_creators, F.col("creator_id") == F.col("_c"), "left")
    issues = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("license"), F.lit("")) == "", "license"),
        F.when(F.col("_known").isNull(), "creator"),
        F.when(F.col("_known") & F.col("_open").isNull(), "creator_private"),
    ))
    return joined.select("id", issues.alias("issues")).where(F.size("issues") > 0)


def integrity(t: dict[str, DataFrame]) -> DataFrame:
    """(check, n) of the catalogue's eleven checks: references to missing rows, repeated file names, files without digest.

    Frames: items (id, library_id, collection_id, creator_id, preview_id), files (id, item_id, filename, digest), creators,
    collections, libraries, groups, users (id), merges (source_library_id, target_id), memberships (group_id, user_id).
    """
    items, files = t["items"], t["files"]
    lost = orphans({
        "files.item": (files, "item_id", items, "id"),
        "items.creator": (items, "creator_id", t["creators"], "id"),
        "items.collection": (items, "collection_id", t["collections"], "id"),
        "items.library": (items, "library_id", t["libraries"], "id"),
        "items.preview": (items, "preview_id", files, "id"),
        "merges.source_library": (t["merges"], "source_library_id", t["libraries"], "id"),
        "merges.target": (t["merges"], "target_id", items, "id"),
        "memberships.group": (t["memberships"], "group_id", t["groups"], "id"),
        "memberships.user": (t["memberships"], "user_id", t["users"], "id"),
    })
    names = repeated(files, ["item_id", "filename"]).agg(F.count("*").alias("n")).select(F.lit("files.repeated_name").alias("check"), "n")
    bare = files.where(F.col("digest").isNull()).agg(F.count("*").alias("n")).select(F.lit("files.no_digest").alias("check"), "n")
    return lost.unionByName(names).unionByName(bare)
