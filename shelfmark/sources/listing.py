"""File listings of a library, as frames. Contents are not read unless asked for: only path, size and time are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.filters import FILE_CLASSES, ignored

#: Sub-folders that belong to the model in the folder above.
COMMON_SUBFOLDERS = "files images stl stls supported unsupported presupported parts renders".split()
#: Folders that systems keep for themselves.
SYSTEM_FOLDERS = ("#recycle", "@eaDir")


def files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, size, modified) of all files under root, path relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.element_at(F.split(F.col("path"), F.lit(base.replace(".", r"\.") + "/"), 2), -1)
    return reader.load(root).select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def indexable(listing: DataFrame, ignore: list[str] = (), classes: tuple[str, ...] = ("image", "mesh", "archive", "document", "video")) -> DataFrame:
    """Files of the classes, outside hidden and system folders, not ignored; meshes in an images folder are left out."""
    known = [e for c in classes for e in FILE_CLASSES[c]]
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SYSTEM_FOLDERS))
    stray = fn.extension(F.col("path")).isin(FILE_CLASSES["mesh"]) & F.arrays_overlap(F.transform(parts, F.lower), F.array(F.lit("images")))
    return listing.where(fn.extension(F.col("path")).isin(known) & ~hidden & ~stray & ~ignored(F.col("path"), list(ignore)))


def model_folder(path: str = "path"):
    """The folder that a file's model lives in: its parent, without one trailing common sub-folder, whatever its case."""
    return F.regexp_replace(fn.parent(F.col(path)), "(?i)(^|/)(" + "|".join(COMMON_SUBFOLDERS) + ")$", "")


def new_folders(listing: DataFrame, known: DataFrame, depth: int = 6) -> DataFrame:
    """(folder): model folders of so many levels at most that hold files, outside known folders (column folder)."""
    found = listing.select(model_folder().alias("folder")).distinct().where("folder <> ''").where(F.size(F.split("folder", "/")) <= depth)
    reach = found.select("folder", F.explode(F.concat(fn.ancestors(F.col("folder")), F.array("folder"))).alias("_at"))
    taken = reach.join(known.select(F.col("folder").alias("_at")), "_at", "left_semi").select("folder").distinct()
    return found.join(taken, "folder", "left_anti")


def changes(listing: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, missing): paths that only the listing has, and paths that only the known files have. Two anti joins."""
    return listing.join(known.select("path"), "path", "left_anti"), known.join(listing.select("path"), "path", "left_anti")


def category_models(listing: DataFrame) -> DataFrame:
    """(category, model, files, size): folders exactly two levels deep, with what lies in them."""
    parts = F.split("path", "/")
    rows = listing.where(F.size(parts) >= 3).select(parts[0].alias("category"), parts[1].alias("model"), "size")
    return rows.groupBy("category", "model").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def fingerprints(spark: SparkSession, root: str, most: int = 80, largest: int = 2_000_000) -> DataFrame:
    """(folder, name, size, digest): the first files of each folder by path; digests of small files of known kinds that are no archives."""
    listed = files(spark, root).withColumn("folder", fn.parent(F.col("path")))
    rank = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    listed = listed.withColumn("_n", rank).where(F.col("_n") <= most)
    small = ~fn.extension(F.col("path")).isin(FILE_CLASSES["archive"]) & F.col("size").between(1, largest)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    # Archives and large files are not read: names are matched by the listing, lengths before contents are opened.
    kinds = ",".join(e for c, known in FILE_CLASSES.items() if c != "archive" for x in known for e in (x, x.upper()))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{kinds}}}")
    content = reader.load(root).where(F.col("length").between(1, largest))
    relative = F.element_at(F.split(F.col("path"), F.lit(base.replace(".", r"\.") + "/"), 2), -1)
    digests = content.select(relative.alias("path"), F.substring(F.sha2("content", 256), 1, 16).alias("digest"))
    joined = listed.withColumn("_small", small).join(digests, "path", "left")
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    return joined.select("folder", name.alias("name"), "size", F.when(F.col("_small"), F.col("digest")).alias("digest"))


def shallow(listing: DataFrame, folder: str) -> DataFrame:
    """Files of a folder and of the common sub-folders one level below it, whatever their case."""
    rest = F.substr("path", F.lit(len(folder) + 2))
    parts = F.split(rest, "/")
    near = (F.size(parts) == 1) | ((F.size(parts) == 2) & F.lower(parts[0]).isin(COMMON_SUBFOLDERS))
    return listing.where(F.col("path").startswith(f"{folder}/") & near)


def folders_with_changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(folder): model folders of files that are not known."""
    new, _ = changes(listing, known)
    return new.select(model_folder().alias("folder")).distinct().where("folder <> ''")


def models_with_new_files(listing: DataFrame, known: DataFrame, models: DataFrame, since) -> DataFrame:
    """Known models (folder) that hold unknown files changed at or after a time."""
    new, _ = changes(listing.where(F.col("modified") >= since), known)
    return models.join(new.select(model_folder().alias("folder")), "folder", "left_semi")
