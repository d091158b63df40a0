"""Curation decisions from scores and labels: image picks, sensitive content, folder moves, and imports from two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from .naming import free_names


#: The bonus for telling names, the penalties for junk names and for a level of depth, and the cap of the size.
TELLING, JUNK, DEPTH, LARGEST = 1_000_000, 1_500_000, 50_000, 2_000_000


def image_score(path: Column, size: Column, hints: str = "preview|render|cover|main", junk: str = "logo|icon|thumb|banner", cap: int = LARGEST) -> Column:
    """Capped size with a bonus for telling names, and penalties for junk names and depth."""
    low = F.lower(path)
    depth = F.size(F.split(path, "/")) - 1
    return F.least(size, F.lit(cap)) + F.when(low.rlike(hints), TELLING).otherwise(0) - F.when(low.rlike(junk), JUNK).otherwise(0) - depth * DEPTH


def ranked_images(images: DataFrame, group: str, path: str, size: str, n: int = 3) -> DataFrame:
    """The n best images of each group, with their score and rank; ties by path."""
    scored = images.withColumn("score", image_score(F.col(path), F.col(size)))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), path))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def is_sensitive(detections: Column, hot: list[str], least: float = 0.6, sure: float = 0.85) -> Column:
    """Whether an array of (label, score) holds a hot label at the threshold, or any exposed one when very sure."""
    return F.exists(detections, lambda d: (d["label"].isin(hot) & (d["score"] >= least)) | (d["label"].contains("EXPOSED") & (d["score"] >= sure)))


def detection_summary(detections: Column, most: int = 12) -> Column:
    """(count, top score, first labels) of an array of (label, score)."""
    return F.struct(F.size(detections).alias("n"), F.array_max(F.transform(detections, lambda d: d["score"])).alias("top"), F.slice(F.transform(detections, lambda d: d["label"]), 1, most).alias("labels"))


def organise(folders: DataFrame, categories: list[str], junk: str = "misc|temp|unsorted") -> DataFrame:
    """folders (category, name, new_category, new_name) with an action: keep, rename, move or skip.

    A proposal without a known category is skipped, junk names are kept.
    """
    name, category = fn.display_name(F.col("new_name"), ""), F.col("new_category")
    action = (
        F.when(F.lower("new_name").rlike(f"^({junk})$"), "keep")
        .when(~category.isin(categories) | (name == ""), "skip")
        .when(F.lower("category") != F.lower(category), "move")
        .when(F.col("name") != name, "rename")
        .otherwise("keep")
    )
    return folders.withColumn("target", F.concat_ws("/", category, name)).withColumn("action", action)


def move_plan(decided: DataFrame, taken: DataFrame, threshold: float, key: str = "id") -> DataFrame:
    """(key, action, destination, status) of each decision (action, category, target, confidence; current, where there is such a column).

    Moves and renames of enough confidence get the first of their target, ``target (2)``, ``target (3)`` ... that neither a
    folder (taken, column target) nor a decision with a smaller key has; others are ``low_confidence`` and have no destination. A target that is
    where the folder is already is ``no_move_needed``, also an action that is no move, which then reads ``keep``.
    """
    moves = F.col("action").isin("move", "rename")
    stays = F.col("current").eqNullSafe(F.col("target")) if "current" in decided.columns else F.lit(False)
    status = F.when(~moves | stays, "no_move_needed").when(F.coalesce("confidence", F.lit(0.0)) < threshold, "low_confidence").otherwise("planned")
    judged = decided.select(key, "action", "target", status.alias("status"))
    named = free_names(judged.where("status = 'planned'"), taken.select("target"), [], "target", key, "destination")
    rest = judged.where("status <> 'planned'").withColumn("destination", F.lit(None).cast("string"))
    action = F.when(F.col("status") == "no_move_needed", "keep").otherwise(F.col("action"))
    return named.unionByName(rest).select(key, action.alias("action"), "destination", "status")


def cross_source(packs: DataFrame, prefer: str, share: float = 0.95) -> DataFrame:
    """(creator, title, source, rows): which source's pack of a title stays; packs has creator, title, source, bytes, files, image.

    The preferred source wins with nearly the bytes and no fewer files of the richest; else bytes, files and image decide.
    """
    key = [F.lower(F.trim("creator")).alias("creator"), F.lower(F.trim("title")).alias("title")]
    rows = packs.select(*key, "source", "bytes", "files", "image")
    richest = F.max(F.struct("bytes", "files", "image", "source")).alias("r")
    best = rows.groupBy("creator", "title").agg(richest, F.max(F.when(F.col("source") == prefer, F.struct("bytes", "files"))).alias("p"), F.count("*").alias("rows"))
    near = F.col("p").isNotNull() & (F.col("p.bytes") >= share * F.col("r.bytes")) & (F.col("p.files") >= F.col("r.files"))
    return best.select("creator", "title", F.when(near, prefer).otherwise(F.col("r.source")).alias("source"), "rows")


def import_plan(incoming: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """incoming with an action: move (new), replace_with_richer or quarantine_loser, by (bytes, files) against what is present."""
    held = present.select(*key, F.struct(F.col("bytes"), F.col("files")).alias("_held"))
    joined = incoming.join(held, key, "left")
    action = F.when(F.col("_held").isNull(), "move").when(F.struct("bytes", "files") > F.col("_held"), "replace_with_richer").otherwise("quarantine_loser")
    return joined.withColumn("action", action).drop("_held")


def still_to_do(folders: DataFrame, files: DataFrame, done: str = "preview.jpg", open_category: str = "Unknown") -> DataFrame:
    """folders (folder, category) without those that are done: they hold the done file and have a known category; files has folder and name."""
    good = files.where(F.lower("name") == done).select("folder").distinct().withColumn("_good", F.lit(True))
    return folders.join(good, "folder", "left").where(F.col("_good").isNull() | F.coalesce(F.col("category") == open_category, F.lit(True))).drop("_good")


def import_by_url(requests: DataFrame, links: DataFrame, kinds: list[tuple[str, str]], default: str = "item") -> DataFrame:
    """(url, kind): requested addresses that no link has yet, each once, with the kind of the first pattern that fits."""
    new = requests.select("url").where(F.col("url").isNotNull()).distinct().join(links.select("url"), "url", "left_anti")
    return new.select("url", fn.guessed_category(F.col("url"), kinds, default).alias("kind"))


def present_by_name(wanted: DataFrame, have: DataFrame, name: str, least: int = 12) -> DataFrame:
    """wanted with found: whether have holds the name, its key, or a name that contains it or lies in it, both longer than least.

    Equality is an equi-join. A key that lies in another shares all its pieces of least + 1 letters with it: keys with a
    piece that the other side lacks are out, the others meet at their rarest piece, and what meets is compared.
    """
    own = have.select(fn.name_key(F.col(name)).alias("_k")).where("_k <> ''").distinct()
    keyed = wanted.withColumn("_key", fn.name_key(F.col(name)))
    exact = keyed.join(own, F.col("_key") == F.col("_k"), "left_semi").select("_key").distinct()
    long = lambda df: df.where(F.length("k") > least).distinct()
    left, right = long(keyed.select(F.col("_key").alias("k"))), long(own.select(F.col("_k").alias("k")))
    close = _inside(left, right, least + 1).select("short").union(_inside(right, left, least + 1).select("long")).toDF("_key")
    found = exact.union(close).distinct().withColumn("_f", F.lit(True))
    return keyed.join(found, "_key", "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_key", "_f")


def _inside(shorter: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """(short, long): keys (k) of shorter that lie in keys of longer."""
    piece = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("k") - (size - 1)), lambda i: F.substr("k", i, F.lit(size))))).alias("piece")
    of_long = longer.select(F.col("k").alias("long"), piece)
    many = of_long.groupBy("piece").agg(F.count("*").alias("n"))
    of_short = shorter.select(F.col("k").alias("short"), piece).join(many, "piece", "left")
    rarest = of_short.groupBy("short").agg(F.min(F.struct("n", "piece")).alias("r"), F.count_if(F.col("n").isNull()).alias("lacks")).where("lacks = 0")
    met = rarest.select("short", F.col("r.piece").alias("piece")).join(of_long, "piece")
    return met.where(F.col("long").contains(F.col("short"))).select("short", "long")
