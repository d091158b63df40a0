"""Duplicate items: candidate pairs with their evidence, the decision gate, merge plans and their undoing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_copy_name, merge_prefix, name_key, original_name, trim_slashes
from ..staging import dealt, staged
from .tree import climb

#: The shared files that count as evidence, the confidence from which a plan is applied, and what evidence alone is worth.
LEAST_OVERLAP = 3
LEAST_CONFIDENCE = 0.80
DIGEST_CONFIDENCE, NAME_CONFIDENCE = 0.85, 0.82
#: Items from which on a shared fact is common: it is then not what pairs are found by, if that can be avoided.
COMMON = 1000


def class_pairs(df: DataFrame, on: list[str], key: str) -> DataFrame:
    """(a, b): each key of a class of equal values with the class's smallest, a. All links of a class follow from them,
    and their number grows with the rows, not with the square of a class."""
    first = df.groupBy(*on).agg(F.min(key).alias("a"), F.count("*").alias("_many")).where("_many > 1")
    return df.select(*on, F.col(key).alias("b")).join(first, on).where("a < b").select("a", "b")


def name_pairs(items: DataFrame, key: str, name: str, category: str) -> DataFrame:
    """(a, b): items of one category with the same name key, as class_pairs(). Names without letters or digits pair with none."""
    keyed = items.select(key, F.lower(category).alias("_category"), name_key(F.col(name)).alias("_name")).where("_name <> ''")
    return class_pairs(keyed, ["_category", "_name"], key).distinct()


def overlap_pairs(facts: DataFrame, key: str, on: list[str], least: int = LEAST_OVERLAP) -> DataFrame:
    """(a, b, overlap): items that share so many facts, by an inverted index on the facts.

    Items with the very same facts pair with the smallest of them, which alone pairs with others, so that copies make no
    square. Facts that over COMMON of these have are counted apart: items that share enough of them share one besides the
    least - 1 commonest of either, so those propose no pairs, and what pairs share of them is counted from each item's few.
    """
    mark = F.sum(F.xxhash64(*on).cast("decimal(38,0)"))
    rows = facts.select(F.col(key).alias("_item"), *on).na.drop()
    rows = staged(dealt(rows, rows.count(), "_item").distinct(), "facts")
    total = rows.count()
    # As text, since Spark would deal floats out anew for each join; zeros and NaN are alike by now.
    rows = rows.select("_item", *[F.col(c).cast("string").alias(c) if rows.schema[c].dataType.typeName() in ("float", "double") else F.col(c) for c in on])
    rows = dealt(rows, total, "_item")
    sets = staged(rows.groupBy("_item").agg(F.count("*").alias("_size"), mark.alias("_mark")), "sets")
    sets = dealt(sets, sets.count(), "_size", "_mark")
    same = sets.groupBy("_size", "_mark").agg(F.min("_item").alias("a"), F.count("*").alias("_items"))
    copies = sets.join(same.where((F.col("_items") > 1) & (F.col("_size") >= least)), ["_size", "_mark"]).where("_item > a").select("a", F.col("_item").alias("b"), F.col("_size").alias("overlap"))
    # Spark moves a semi join below what deals out its rows, so the other side gives the number of parts.
    rows = rows.join(dealt(same.where(F.col("_size") >= least).select(F.col("a").alias("_item")), total, "_item"), "_item", "left_semi")
    rows = dealt(rows, total, *on)
    many = rows.groupBy(*on).agg(F.count("*").alias("_many")).where("_many > 1")
    known = staged(rows.join(many, on), "known")

    def met(df: DataFrame) -> DataFrame:
        df = dealt(df, total, *on)
        return df.select(*on, F.col("_item").alias("a")).join(df.select(*on, F.col("_item").alias("b")), on).where("a < b")

    rare = known.where(F.col("_many") <= COMMON)
    met_by = int(rare.agg(F.sum(F.col("_many") - 1)).first()[0] or 0) // 2  # the pairs that facts make, each as often as it shares one
    direct = dealt(met(rare), met_by, "a", "b").groupBy("a", "b").agg(F.count("*").alias("overlap"))
    common = known.where(F.col("_many") > COMMON)
    if common.isEmpty():
        return direct.where(F.col("overlap") >= least).unionByName(copies)
    rank = F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("_many"), *on))
    proposed = met(common.withColumn("_k", rank).where(F.col("_k") >= least)).select("a", "b", F.lit(0).cast("long").alias("overlap"))
    pairs = direct.unionByName(proposed).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    held = common.groupBy("_item").agg(F.collect_list(F.struct(*on)).alias("_facts"))
    a, b = (held.select(F.col("_item").alias(k), F.col("_facts").alias(f"_{k}")) for k in ("a", "b"))
    shared = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.size(F.array_intersect("_a", "_b"))).otherwise(0)
    counted = pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", (F.col("overlap") + shared).alias("overlap"))
    return counted.where(F.col("overlap") >= least).unionByName(copies)


def candidates(items: DataFrame, files: DataFrame, key: str = "id", name: str = "name", category: str = "category") -> DataFrame:
    """(a, b, signals, overlap): unordered pairs with their evidence, each once.

    files has item, name, size and digest. Signals: name_near_dupe, shared_digest and file_overlap, sorted. Names and
    digests pair each item with the first of its class.
    """
    named = name_pairs(items, key, name, category).select("a", "b", F.lit("name_near_dupe").alias("signal"), F.lit(0).cast("long").alias("overlap"))
    own = files.select(F.col("item").alias(key), F.lower("name").alias("_n"), F.col("size").alias("_s"), F.col("digest").alias("_d"))
    same = class_pairs(own.where("_d is not null").select(key, "_d").distinct(), ["_d"], key).distinct().select("a", "b", F.lit("shared_digest").alias("signal"), F.lit(0).cast("long").alias("overlap"))
    most = overlap_pairs(own, key, ["_n", "_s"]).select("a", "b", F.lit("file_overlap").alias("signal"), "overlap")
    both = named.unionByName(same).unionByName(most)
    return both.groupBy("a", "b").agg(F.sort_array(F.collect_set("signal")).alias("signals"), F.max("overlap").alias("overlap"))


def decide(pairs: DataFrame, previews: Column, verdict: Column, confidence: Column, threshold: float) -> DataFrame:
    """pairs (signals, overlap) with decision, confidence and approved.

    Without evidence, items stay separate. Without previews, a shared digest merges at 0.85 and a name at 0.82. A
    verdict decides otherwise, but no overlap under the least merges on its own.
    """
    has = {s: F.array_contains("signals", s) for s in ("name_near_dupe", "shared_digest", "file_overlap")}
    weak = ~has["name_near_dupe"] & ~has["shared_digest"] & (F.col("overlap") < LEAST_OVERLAP)
    decision = F.when((F.size("signals") == 0) | weak, "separate").when(previews, verdict).when(has["shared_digest"] | has["name_near_dupe"], "merge").otherwise("separate")
    sure = F.when((F.size("signals") == 0) | weak, 0.0).when(previews, confidence).when(has["shared_digest"], DIGEST_CONFIDENCE).when(has["name_near_dupe"], NAME_CONFIDENCE).otherwise(0.0)
    out = pairs.withColumn("decision", decision).withColumn("confidence", sure)
    return out.withColumn("approved", (F.col("decision") == "merge") & (F.col("confidence") >= threshold))


def with_target(decided: DataFrame, names: DataFrame, previews: Column, verdict: Column) -> DataFrame:
    """decided (a, b, decision) with source and target: without previews the item of the shorter name stays, of equal ones
    a; with previews the verdict says which, ``b`` or else a. Those that stay separate have neither. names has id and name."""
    own = lambda k: names.select(F.col("id").alias(k), F.length("name").alias(f"_{k}"))
    joined = decided.join(own("a"), "a", "left").join(own("b"), "b", "left")
    stays = F.when(previews, F.when(F.lower(verdict) == "b", F.col("b")).otherwise(F.col("a"))).when(F.col("_a") <= F.col("_b"), F.col("a")).otherwise(F.col("b"))
    merges = F.col("decision") == "merge"
    out = joined.withColumn("target", F.when(merges, stays)).withColumn("source", F.when(merges, F.when(stays == F.col("a"), F.col("b")).otherwise(F.col("a"))))
    return out.drop("_a", "_b")


def merge_targets(merges: DataFrame) -> DataFrame:
    """(source, target, at, status): merges in their order, with the item that each source ends up in.

    merges has source, target and at, a number that orders them. A target that is merged itself passes its sources on,
    along chains of any length; sources that are merged twice go with their first merge (status ``again`` for the others),
    and those that end in a loop stay (``loop``, without a target).
    """
    first = merges.groupBy("source").agg(F.min(F.struct("at", "target")).alias("m"))
    edges = staged(first.select("source", F.col("m.target").alias("target"), F.col("m.at").alias("at")).where("source <> target"), "merges")
    ends = edges.select("target").join(edges.select(F.col("source").alias("target")), "target", "left_anti").distinct()
    nodes = edges.select(F.col("source").alias("id"), F.col("target").alias("up")).unionByName(ends.select(F.col("target").alias("id"), F.lit(None).cast(edges.schema["target"].dataType).alias("up")))
    way = climb(nodes, "id", "up", F.lit(False)).select(F.col("id").alias("source"), F.col("at").alias("_end"))
    used = edges.join(way, "source").select("source", F.col("at").alias("_first"), "_end")
    joined = merges.join(used, "source", "left")
    status = F.when(F.col("source") == F.col("target"), "loop").when(F.col("at") > F.col("_first"), "again").when(F.col("_end").isNull(), "loop").otherwise("merge")
    return joined.select("source", F.when(status == "merge", F.col("_end")).alias("target"), "at", status.alias("status"))


def merge_plan(files: DataFrame, merges: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(source, target, at, file_id, action, new_name, same_as): what becomes of each source file.

    files has id, item, name and digest; merges source, target and at (else the source's key), as merge_targets() resolves them. With items (id,
    path, library_id), names get the prefix of the source's folder as seen from the target's. Merges happen in their
    order, and a source's files in that of their ids. A file whose name the target has by then, its own or from an earlier
    source, is dropped if the first of that name has its digest (same_as is that file), else renamed to its bare name
    with ``_`` and its digest (of files without one, a digest of the id), which is not tested again; others are adopted.

    Files are dealt out once, by the target and name that they ask for, and meet the first of that name there. Renamed
    files can hold names that others ask for, which are longer than those that they asked for themselves. Only names with
    ``_`` can be such; these alone are looked at again, in rounds until none changes.
    """
    if "at" not in merges.columns:  # then in the order of the sources
        merges = merges.withColumn("at", F.col("source"))
    kinds = {f.name: f.dataType for f in merges.schema}
    comes = merges.select(F.col("source").alias("item"), "source", "target", "at")
    stays = merges.select(F.col("target").alias("item")).distinct().select("item", F.lit(None).cast(kinds["source"]).alias("source"), F.col("item").alias("target"), F.lit(None).cast(kinds["at"]).alias("at"))
    rows = files.select("item", F.col("id").alias("file_id"), "name", "digest").join(comes.unionByName(stays), "item")
    if items is not None:
        own = lambda k: items.select(F.col("id").alias(k), F.col("path").alias(f"_{k}"), F.col("library_id").alias(f"_{k}_library"))
        prefix = merge_prefix(F.col("_target"), F.col("_source"), F.col("_source_library") == F.col("_target_library"))
        rows = rows.join(own("source"), "source", "left").join(own("target"), "target", "left")
        rows = rows.withColumn("name", F.when(F.col("source").isNull() | prefix.isNull() | (prefix == "."), F.col("name")).otherwise(F.concat_ws("/", prefix, "name")))
    # Of one name, the target's own file comes first, since it has no order; then the earliest.
    order = F.when(F.col("source").isNotNull(), F.struct("at", "source", "file_id"))
    holder = F.struct(order.alias("order"), "file_id", "digest")
    dealt = rows.select("source", "target", "at", "file_id", "name", "digest").repartition("target", "name")
    met = dealt.withColumn("first", F.min(holder).over(Window.partitionBy("target", "name"))).where("source is not null and target is not null and name is not null")
    own_order = F.struct("at", "source", "file_id")
    bare = F.regexp_extract("name", r"([^/]*)$", 1)
    stem, ending = F.regexp_replace(bare, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(bare, r"(?<=.)(\.[^.]*)$", 1)
    mark = F.coalesce(F.nullif("digest", F.lit("")), F.substring(F.md5(F.col("file_id").cast("string").cast("binary")), 1, 12))
    other_name = F.concat(stem, F.lit("_"), mark, ending)
    mine = F.coalesce(F.col("first.order") == own_order, F.lit(False)) & (F.col("first.file_id") == F.col("file_id"))
    same = F.coalesce((F.col("digest") == F.col("first.digest")) & (F.col("digest") != ""), F.lit(False))
    action = F.when(mine, "adopt").when(same, "drop").otherwise("rename")

    def plan(df: DataFrame) -> DataFrame:
        decided = df.withColumn("action", action)
        new_name = F.when(F.col("action") == "adopt", F.col("name")).when(F.col("action") == "rename", other_name)
        return decided.select("source", "target", "at", "file_id", "action", new_name.alias("new_name"), F.when(F.col("action") == "drop", F.col("first.file_id")).alias("same_as"))

    if items is None and files.where(F.col("name").contains("_")).isEmpty():
        return plan(met)
    met = staged(met.select("source", "target", "at", "file_id", "name", "digest", "first"), "met")
    hit = staged(met.where(F.col("name").contains("_")).select("target", "name").distinct().join(met.select("target", other_name.alias("name")), ["target", "name"], "left_semi"), "hit")
    if hit.isEmpty():
        return plan(met)
    sure, open_ = met.join(hit, ["target", "name"], "left_anti"), staged(met.join(hit, ["target", "name"], "left_semi"), "open")

    def renamed(df: DataFrame) -> DataFrame:
        """The files of df that are renamed to a name that is asked for, under that name."""
        holds = F.struct(own_order.alias("order"), "file_id", "digest").alias("holds")
        return df.where(action == "rename").select("target", other_name.alias("name"), holds).join(hit, ["target", "name"], "left_semi")

    always, now, before = staged(renamed(sure), "renamed"), open_, None
    while True:
        again = staged(renamed(now), "renamed")
        mark_ = tuple(again.agg(F.count("*"), F.sum(F.xxhash64("target", "name", "holds.file_id").cast("decimal(38,0)"))).first())
        if mark_ == before:
            return plan(sure).unionByName(plan(now))
        before = mark_
        firsts = always.unionByName(again).groupBy("target", "name").agg(F.min("holds").alias("holds"))
        now = open_.join(firsts, ["target", "name"], "left").withColumn("first", F.least("first", "holds")).drop("holds")


def history(plan: DataFrame) -> DataFrame:
    """(source, target, moved): one row per merge, with a struct for each file in the order of file ids."""
    return plan.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("file_id", "action", "new_name"))).alias("moved"))


def unmerge_plan(histories: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(source, target, file_id, action): dropped files are made again, others moved back; for merges that are not
    undone, no older than so many days, and whose library (source_library_id, where there is such a column) still exists."""
    open_ = histories.where(F.col("undone_at").isNull() & (F.col("merged_at") >= now - F.make_interval(days=F.lit(days))))
    if "source_library_id" in histories.columns:
        open_ = open_.where("source_library_id is not null")
    files = open_.select("source", "target", F.explode("moved").alias("m"))
    return files.select("source", "target", F.col("m.file_id").alias("file_id"), F.when(F.col("m.action") == "drop", "create").otherwise("move").alias("action"))


def unmerged_paths(histories: DataFrame, items: DataFrame) -> DataFrame:
    """histories (id, source_library_id, source_path) with the path that the item made again gets: its old one, without
    slashes at its ends, and with ``--unmerged-`` and the history's id if an item (library_id, path) has it by now."""
    path = trim_slashes(F.col("source_path"))
    taken = items.select(F.col("library_id").alias("source_library_id"), F.col("path").alias("_path"), F.lit(True).alias("_taken")).distinct()
    joined = histories.withColumn("_path", path).join(taken, ["source_library_id", "_path"], "left")
    return joined.withColumn("new_path", F.when(F.col("_taken"), F.concat("_path", F.lit("--unmerged-"), F.col("id").cast("string"))).otherwise(F.col("_path"))).drop("_path", "_taken")


def apply_status(plan: DataFrame, paths: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """plan (path_a, path_b, confidence) with a status: low_confidence, unknown_path or apply."""
    a, b = paths.select(F.col("path").alias("path_a"), F.lit(True).alias("_a")), paths.select(F.col("path").alias("path_b"), F.lit(True).alias("_b"))
    joined = plan.join(a, "path_a", "left").join(b, "path_b", "left")
    status = F.when(F.coalesce("confidence", F.lit(0.0)) < least, "low_confidence").when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown_path").otherwise("apply")
    return joined.withColumn("status", status).drop("_a", "_b")


def split_plan(files: DataFrame, chosen: DataFrame, previews: DataFrame, new_item: Column) -> tuple[DataFrame, DataFrame]:
    """(files, previews) after chosen files (column id) moved to new items; new_item names an item's copy by column item.

    A preview (item, preview_id) that moves becomes the copy's, and its old item has none.
    """
    picked = chosen.select("id").distinct().withColumn("_moves", F.lit(True))
    moved = files.join(picked, "id", "left").withColumn("item", F.when(F.col("_moves"), new_item).otherwise(F.col("item"))).drop("_moves")
    shown = previews.join(picked.withColumnRenamed("id", "preview_id"), "preview_id", "left")
    kept = shown.select("item", F.when(F.col("_moves").isNull(), F.col("preview_id")).alias("preview_id"))
    return moved, kept.unionByName(shown.where("_moves").select(new_item.alias("item"), "preview_id"))


def copy_passes(files: DataFrame, least: int = 1024) -> DataFrame:
    """(id, reason, keep_id): files that are copies, each by the first of three passes that finds it.

    files has id, folder, name, size, modified and digest. The passes: a name that says so; the same folder, bare name
    and size; the same size and digest, of so many bytes at least. The oldest of a group stays.
    """
    age = F.struct("modified", "folder", "name", "id")
    marked = F.coalesce(is_copy_name(F.regexp_replace("name", r"\.[^.]*$", "")), F.lit(False))
    known = files.withColumn("_low", F.lower(original_name(F.col("name")))).withColumn("_age", F.when(~marked, age))
    group = Window.partitionBy("folder", "_low", "size")
    known = known.withColumn("_first", F.min("_age").over(group))
    again = F.col("_age").isNotNull() & F.col("folder").isNotNull() & F.col("_low").isNotNull() & F.col("size").isNotNull() & (F.col("id") != F.col("_first.id"))
    reason = F.when(F.col("_age").isNull(), "copy-name").when(again, "same-name-size")
    known = staged(known.select("id", "folder", "name", "size", "modified", "digest", reason.alias("reason"), F.when(again, F.col("_first.id").cast("long")).alias("keep_id")), "known")
    found = known.where("reason is not null").select("id", "reason", "keep_id")
    able = known.where(F.col("reason").isNull() & F.col("digest").isNotNull() & (F.col("size") >= least))
    many = able.groupBy("size", "digest").agg(F.count("*").alias("n")).where("n > 1").select("size", "digest")
    # Few are left here for the join by id and for the last groups.
    left = able.join(many, ["size", "digest"], "left_semi").join(found.where("reason = 'same-name-size'"), "id", "left_anti").select("id", "size", "digest", age.alias("age"))
    first = left.groupBy("size", "digest").agg(F.min("age").alias("first"), F.count("*").alias("n")).where("n > 1")
    last = left.join(first, ["size", "digest"]).where("id <> first.id").select("id", F.lit("sha256").alias("reason"), F.col("first.id").cast("long").alias("keep_id"))
    return found.unionByName(last)


def numbered_copies(files: DataFrame) -> DataFrame:
    """(id, action, new_name) of files whose stem ends in `` (n)``: what becomes of them.

    files has id, folder, name and size. Where the folder has a file of the bare name, whatever its case, all go
    (``delete``); else the one with the lowest number, then size, then name, gets the bare name (``promote``) and the others go.
    """
    pattern = r"^(.*) \((\d+)\)(\.[^.]*)?$"
    part = lambda k: F.regexp_extract("name", pattern, k)
    numbered = F.col("name").rlike(pattern)
    marked = files.where(numbered).select("id", "folder", "name", "size", part(2).try_cast("long").alias("n"), F.concat(part(1), part(3)).alias("bare")).withColumn("low", F.lower("bare"))
    plain = files.where(~numbered).select("folder", F.lower("name").alias("low"), F.lit(True).alias("plain")).distinct()
    least = marked.groupBy("folder", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(1 << 62)).alias("n"), "size", "name", "id")).alias("first"))
    joined = marked.join(least, ["folder", "low"]).join(plain, ["folder", "low"], "left")
    promoted = F.col("plain").isNull() & (F.col("id") == F.col("first.id"))
    return joined.select("id", F.when(promoted, "promote").otherwise("delete").alias("action"), F.when(promoted, F.col("bare")).alias("new_name"))


def keep_oldest(files: DataFrame, group: list[str], by: list[Column]) -> DataFrame:
    """files with keep: true for the first of each group, by an order (ascending) that ends in a key. Found by an aggregation, so that a large group is never sorted."""
    aged = files.withColumn("_age", F.struct(*[c.alias(f"c{k}") for k, c in enumerate(by)])).withColumn("_group", F.struct(*group))
    first = aged.groupBy("_group").agg(F.min("_age").alias("_first"))
    return aged.join(first, "_group").withColumn("keep", F.col("_age") == F.col("_first")).drop("_age", "_group", "_first")


def fill_blanks(own: DataFrame, other: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """own with blank columns filled from other (all overwritten, where other has a value, if forced)."""
    renamed = other.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = own.join(renamed, key, "left")
    for c in columns:
        blank = F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
        out = out.withColumn(c, F.when((F.lit(force) | blank) & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_{c}" for c in columns])


def with_tags(tags: Column, add: list[str] = (), remove: list[str] = ()) -> Column:
    """Tag set arithmetic: existing and added, without the removed, sorted."""
    literal = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.sort_array(F.array_except(F.array_union(tags, literal(add)), literal(remove)))
