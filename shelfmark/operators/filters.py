"""Facet filters of a catalogue: a specification becomes one lazy plan of predicates, semi and anti joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = ""  #: asks for rows without a value
ALL = "all"  #: asks for no filter


def by_value(df: DataFrame, column: str, value) -> DataFrame:
    """No filter for None and ``all``, rows without a value for the empty string, else equality."""
    if value is None or value == ALL:
        return df
    return df.where(F.col(column).isNull() if value == NONE else F.col(column) == value)


def having(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows with a match in other."""
    other = other.select(F.col(other_key or key).alias("_key"))
    return df.join(other, F.col(key) == F.col("_key"), "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows without a match in other: an anti join, not a correlated count."""
    other = other.select(F.col(other_key or key).alias("_key"))
    return df.join(other, F.col(key) == F.col("_key"), "left_anti")


def meeting_or_having(df: DataFrame, test: Column, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows that meet a test or have a match in other, each once: the semi join sees only rows that fail the test."""
    met = F.coalesce(test, F.lit(False))
    return df.where(met).unionByName(having(df.where(~met), other, key, other_key))


def having_all(df: DataFrame, tags: DataFrame, values: list, key: str, tag: str, other_key: str | None = None) -> DataFrame:
    """Rows that have every value: relational division by one aggregation, so one shuffle however many values."""
    other = other_key or key
    found = tags.where(F.col(tag).isin(values)).groupBy(other).agg(F.count_distinct(tag).alias("_n"))
    return having(df, found.where(F.col("_n") == len(set(values))), key, other)


def lacking_match(df: DataFrame, tags: DataFrame, pattern: str, key: str, tag: str, other_key: str | None = None) -> DataFrame:
    """Rows of which no tag matches the pattern."""
    return lacking(df, tags.where(F.col(tag).rlike(pattern)), key, other_key)


def linking_to(df: DataFrame, links: DataFrame, text: str, key: str, url: str, other_key: str | None = None) -> DataFrame:
    """Rows with a link that contains the text; the empty string asks for rows without links."""
    if text == NONE:
        return lacking(df, links, key, other_key)
    return having(df, links.where(F.col(url).contains(text)), key, other_key)


#: Extensions of the file classes.
FILE_CLASSES = {
    "image": "bmp gif jpeg jpg png svg tif tiff webp".split(),
    "video": "avi mkv mov mp4 mpeg webm".split(),
    "document": "doc docx epub htm html md odt pdf rtf txt".split(),
    "archive": "7z bz2 gz rar tar zip".split(),
    "mesh": "3ds 3mf dae fbx glb gltf lys obj ply scad step stl stp".split(),
}


def file_class(extension: Column) -> Column:
    """The class of a lower-cased extension; null if it is of none."""
    out = None
    for name, extensions in FILE_CLASSES.items():
        out = (F if out is None else out).when(extension.isin(extensions), name)
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the folder or the name of a path matches one of the patterns."""
    folder, name = F.regexp_replace(path, "/?[^/]*$", ""), F.regexp_extract(path, "([^/]*)$", 1)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | folder.rlike(p) | name.rlike(p)
    return hit


def visible(df: DataFrame, grants: DataFrame, subjects: DataFrame, key: str, permissions: list[str]) -> DataFrame:
    """Rows with a grant of one of the permissions to one of the subjects, or to everyone (a null subject).

    grants has object, subject and permission; subjects one column, subject, with a user's own key, roles and groups.
    """
    given = grants.where(F.col("permission").isin(permissions))
    own = given.join(subjects.select("subject").distinct(), "subject", "left_semi")
    return having(df, own.select("object").union(given.where(F.col("subject").isNull()).select("object")), key, "object")


@dataclass(frozen=True)
class FilterSpec:
    """Facets of a browse request. Unset facets filter nothing; ``""`` asks for rows without a value."""

    library: object = None
    collections: tuple | str | None = None  # ids of a whole subtree, or ""
    creator: object = None
    tags: tuple = ()
    missing_tag: str | None = None
    link: str | None = None
    listed: str | None = None  # name of a personal list
    unlisted: str | None = None
    has_image: bool = False
    words: tuple = field(default=())

    @classmethod
    def of(cls, params: dict, default_has_image: bool = False) -> FilterSpec:
        """From request parameters: unknown keys go, ``all`` and blank texts are unset, the image facet has a default
        unless words are searched, and the last of repeated values counts."""
        known = {k: v for k, v in params.items() if k in cls.__dataclass_fields__ and v != ALL}
        for k in ("link", "words"):
            if k in known and not known[k]:
                known.pop(k)
        value = known.get("has_image", default_has_image and not known.get("words"))
        value = value[-1] if isinstance(value, list | tuple) else value
        known["has_image"] = str(value).lower() in ("1", "true", "on")
        if isinstance(known.get("tags"), str | list):
            known["tags"] = (known["tags"],) if isinstance(known["tags"], str) else tuple(known["tags"])
        return cls(**known)


@dataclass(frozen=True)
class Catalogue:
    """The frames that filters need. items: id, library_id, collection_id, creator_id, name; the others refer to id by item_id."""

    items: DataFrame
    tags: DataFrame | None = None  # item_id, tag
    links: DataFrame | None = None  # item_id, url
    lists: DataFrame | None = None  # item_id, list
    files: DataFrame | None = None  # item_id, filename

    def filtered(self, spec: FilterSpec) -> DataFrame:
        """Items that pass every facet of the specification."""
        df = by_value(by_value(self.items, "library_id", spec.library), "creator_id", spec.creator)
        if spec.collections is not None:
            df = df.where(F.col("collection_id").isNull() if spec.collections == NONE else F.col("collection_id").isin(list(spec.collections)))
        if spec.tags == (NONE,):
            df = lacking(df, self.tags, "id", "item_id")
        elif spec.tags:
            df = having_all(df, self.tags, list(spec.tags), "id", "tag", "item_id")
        if spec.missing_tag:
            df = lacking_match(df, self.tags, spec.missing_tag, "id", "tag", "item_id")
        if spec.link is not None:
            df = linking_to(df, self.links, spec.link, "id", "url", "item_id")
        if spec.listed:
            df = having(df, self.lists.where(F.col("list") == spec.listed), "id", "item_id")
        if spec.unlisted:
            df = lacking(df, self.lists.where(F.col("list") == spec.unlisted), "id", "item_id")
        if spec.has_image:
            images = self.files.where(F.lower("filename").rlike(r"\.(" + "|".join(FILE_CLASSES["image"]) + ")$"))
            df = having(df, images, "id", "item_id")
        for word in spec.words:
            df = df.where(F.lower("name").contains(word.lower()))
        return df
