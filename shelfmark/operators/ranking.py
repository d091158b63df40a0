"""First rows, numbered names and scores per group: procedural picks as window functions with full orders."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import extension
from ..staging import staged
from .filters import file_class


def first(df: DataFrame, group: list[str], by: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; by must end in a key. Spark limits each partition's rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def best(df: DataFrame, group: list[str], score: list[str], value: list[str]) -> DataFrame:
    """The values of each group's row of the greatest score, by one partial aggregation: no sort of whole groups."""
    top = F.max(F.struct(*score, *value)).alias("_top")
    return df.groupBy(*group).agg(top).select(*group, *[F.col(f"_top.{c}").alias(c) for c in [*score, *value]])


def preview_priority(filename: Column, preferred: str = "preview") -> Column:
    """0 for an image of the preferred name, 10 for other images, 50 for meshes, 100 for the rest."""
    kind = file_class(extension(filename))
    return F.when((kind == "image") & F.lower(filename).startswith(preferred), 0).when(kind == "image", 10).when(kind == "mesh", 50).otherwise(100)


#: Names that begin alike, of one group, up to which they are put into sections in one task; more go round by round.
SECTION_ROWS = 200_000


def _greedy(names: dict[str, int], longest: int, shortest: int, enough: int) -> dict[str, str]:
    """The sections of lower-cased names, each with the number of its rows, from the longest prefix down; names in none are left out."""
    left, found = list(names), {}
    for n in range(min(longest - 1, max(map(len, left))), shortest - 1, -1):
        many: dict[str, int] = {}
        for x in left:
            many[x[:n]] = many.get(x[:n], 0) + names[x]
        ready = {p for p, c in many.items() if c >= enough}
        if not ready:
            continue
        lengths = sorted({len(p) for p in ready}, reverse=True)  # of a whole name, less than n
        for x in left:
            for k in lengths:
                if x[:k] in ready:
                    found[x] = x[:k]
                    break
        left = [x for x in left if x not in found]
        if not left:
            break
    return found


def prefix_sections(df: DataFrame, group: str, name: str, least_length: int = 3, share: float = 0.05, most: int = SECTION_ROWS) -> DataFrame:
    """(group, name, section) of each row: the section that its name falls into, lower-cased, or null.

    Prefixes are looked at from the longest down; one that enough names have, that are in no section yet, takes them all.
    Enough is two, and that share of the group's rows, rounded. Prefixes are as long as the longest name but one letter at
    most, and have least_length letters at least; shorter names are one whole, as equal ones make a section. So names that
    begin differently within least_length letters have nothing to do with each other and are told apart in tasks of their
    own. Where over most names of a group begin alike, each length is a round of aggregations instead. Null names
    and names under least_length letters have no section.
    """
    rows = df.select(F.col(group).alias("g"), F.col(name).alias("name"), F.lower(name).alias("low"))
    sizes = rows.groupBy("g").agg(F.greatest(F.lit(2), F.round(F.count("*") * share).cast("int")).alias("enough"), F.max(F.length("low")).alias("longest"))
    units = rows.where(F.length("low") >= least_length).groupBy("g", "low").agg(F.count("*").alias("n"))
    begin = F.substring("low", 1, least_length)
    units = staged(units.withColumn("begin", begin).join(sizes, "g"), "names")
    many = units.groupBy("g", "begin").agg(F.sum("n").alias("rows"))
    large = many.where(F.col("rows") > most).select("g", "begin")
    small = units.join(many.where(F.col("rows") <= most).select("g", "begin"), ["g", "begin"], "left_semi")

    g = small.schema["g"].dataType

    def sections(batches):
        # Rows come group by group; what is held is one group's names, of which there are as many as rows, at most.
        own, names, sizes, out = None, {}, None, []

        def done():
            if names:
                out.extend((own[0], low, section) for low, section in _greedy(names, sizes[0], least_length, sizes[1]).items())

        for batch in batches:
            for group, begin, low, n, longest, enough in zip(*(batch[c].to_pylist() for c in ("g", "begin", "low", "n", "longest", "enough"))):
                if own != (group, begin):
                    done()
                    own, names, sizes = (group, begin), {}, (longest, enough)
                names[low] = n
            yield record(out)
            out.clear()
        done()
        yield record(out)

    kind = to_arrow_type(g)

    def record(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.string(), pa.string()))], names=["g", "low", "section"])

    out = small.repartition("g", "begin").sortWithinPartitions("g", "begin").mapInArrow(sections, f"g {g.simpleString()}, low string, section string")
    left = staged(units.join(large, ["g", "begin"], "left_semi"), "left")
    for n in range((left.agg(F.max("longest")).first()[0] or 0) - 1, least_length - 1, -1):
        at = left.where(F.lit(n) < F.col("longest")).withColumn("section", F.substring("low", 1, n))
        ready = at.groupBy("g", "section").agg(F.sum("n").alias("have"), F.first("enough").alias("enough")).where("have >= enough").select("g", "section")
        taken = staged(at.join(ready, ["g", "section"]).select("g", "low", "section"), "taken")
        if taken.isEmpty():
            continue
        out = out.unionByName(taken)
        left = staged(left.join(taken.select("g", "low"), ["g", "low"], "left_anti"), "left")
    return rows.join(out, ["g", "low"], "left").select(F.col("g").alias(group), F.col("name").alias(name), "section")


def healed_previews(items: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, reason, preview_id): new previews for items (id, preview_id) whose own is broken, unset or no image.

    files has id, item_id, filename and on_disk; the best file on disk is picked. A broken preview without a successor
    becomes null; one that is no image stays unless another file is better. All three passes are one plan.
    """
    pick = first(files.where("on_disk"), ["item_id"], [preview_priority(F.col("filename")), F.col("id")]).select("item_id", F.col("id").alias("_pick"))
    own = files.select(F.col("id").alias("preview_id"), F.col("on_disk").alias("_there"), (file_class(extension(F.col("filename"))) == "image").alias("_image"))
    joined = items.select(F.col("id").alias("item_id"), "preview_id").join(pick, "item_id", "left").join(own, "preview_id", "left")
    broken, image = F.col("_there") == F.lit(False), F.coalesce("_image", F.lit(False))
    reason = F.when(F.col("preview_id").isNull(), F.when(F.col("_pick").isNotNull(), "unset")).when(broken, "broken")
    reason = reason.when(F.col("_there") & ~image & F.col("_pick").isNotNull() & (F.col("_pick") != F.col("preview_id")), "no_image")
    return joined.select("item_id", reason.alias("reason"), F.col("_pick").alias("preview_id")).where(F.col("reason").isNotNull())


def random_top(df: DataFrame, n: int, prefer: Column | None = None, seed: int | None = None) -> DataFrame:
    """n rows at random; of those that prefer names first, so that others only fill up."""
    order = [F.desc(F.coalesce(prefer, F.lit(False)))] if prefer is not None else []
    return df.orderBy(*order, F.rand(seed)).limit(n)
