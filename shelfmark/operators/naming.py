"""Names until free: each claim takes the first of ``name``, ``name (2)``, ``name (3)`` ... that nothing has yet.

Claims of one name take ever larger numbers, so the j-th of them takes the j-th free number; which that is follows from
how many taken numbers lie before it. No name's claims are sorted in one task, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


@dataclass(frozen=True)
class Numbering:
    """How a number is written: between two texts, at the end or before the ending; the second claim has the first number."""

    before: str = " ("
    after: str = ")"
    first: int = 2
    keep_ending: bool = False

    def _split(self, name: Column) -> tuple[Column, Column]:
        if not self.keep_ending:
            return name, F.lit("")
        return F.regexp_replace(name, r"(?<=.)\.[^./]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^./]*)$", 1)

    def numbered(self, name: Column, k: Column) -> Column:
        """What the k-th choice for a name is."""
        stem, ending = self._split(name)
        return F.when(k == 1, name).otherwise(F.concat(stem, F.lit(self.before), (k - 2 + self.first).cast("string"), F.lit(self.after), ending))

    def parsed(self, name: Column) -> tuple[Column, Column]:
        """(name, k) of which a name is the k-th choice, with k from 2; both null if it is none."""
        stem, ending = self._split(name)
        quoted = [f"\\Q{x}\\E" if x else "" for x in (self.before, self.after)]
        pattern = f"(?s)^(.+){quoted[0]}([1-9][0-9]{{0,17}}){quoted[1]}$"
        k = F.regexp_extract(stem, pattern, 2).try_cast("long") - self.first + 2
        own = F.regexp_extract(stem, pattern, 1)
        return F.when(k >= 2, F.concat(own, ending)), F.when(k >= 2, k)


def running(df: DataFrame, group: list[str], by: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of value over a group's rows as far as each row, by an order that ends in a key (ascending).

    Rows are laid out in ranges of group and order, so that a large group lies in many; each range sums its own, and
    the few groups that lie in several add what lies before. Groups are not null.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(df.repartitionByRange(n, *group, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = laid.groupBy(*group, "_range").agg(F.sum(value).alias("_own"))
    spread = Window.partitionBy(*group)
    before = F.sum("_own").over(spread.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    several = sums.withColumn("_ranges", F.count("*").over(spread)).withColumn("_before", before).where("_ranges > 1 and _before is not null")
    # At most two groups a range lie in more ranges than it.
    own = F.sum(value).over(Window.partitionBy(*group, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    joined = laid.withColumn(out, own).join(F.broadcast(several.select(*group, "_range", "_before")), [*group, "_range"], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def _until_free(claims: DataFrame, blocked: DataFrame, expiring: DataFrame) -> DataFrame:
    """claims (place, name, key) with their number k.

    blocked (place, name, k) are numbers that nobody gets, expiring (place, name, k, until) those that nobody with a
    key from until on gets.
    """
    group = ["place", "name"]
    ranked = staged(running(claims, group, ["key"], F.lit(1).cast("long"), "j"), "claims")
    blocked = staged(blocked.select(*group, "k").distinct(), "blocked")
    expiring = staged(expiring.join(blocked, [*group, "k"], "left_anti"), "expiring")
    skipped = blocked.limit(0)
    if not expiring.isEmpty():
        # A number expires for the claim that comes to it, which depends on the smaller numbers that expired. Taking none
        # of them for expired gives too many, these too few, and so on, until both are the same.
        bounds: list[tuple] = []
        while len(bounds) < 2 or bounds[-1] != bounds[-2]:
            taken = blocked.select(*group, "k", F.lit(1).alias("w"), F.lit(None).cast(claims.schema["key"].dataType).alias("until"))
            open_ = expiring.join(skipped.withColumn("w", F.lit(1)), [*group, "k"], "left").select(*group, "k", F.coalesce("w", F.lit(0)).alias("w"), "until")
            sums = running(taken.unionByName(open_), group, ["k"], F.col("w").cast("long"), "s").where("until is not null")
            asked = sums.select(*group, "k", "until", (F.col("k") - (F.col("s") - F.col("w"))).alias("j"))
            skipped = staged(asked.join(ranked, [*group, "j"]).where("key >= until").select(*group, "k"), "skipped")
            bounds.append(tuple(skipped.agg(F.count("*"), F.sum(F.xxhash64(*group, "k").cast("decimal(38,0)"))).first()))
    held = running(blocked.union(skipped), group, ["k"], F.lit(1).cast("long"), "i")
    rows = ranked.select(*group, F.col("j").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k"), "key")
    rows = rows.unionByName(held.select(*group, (F.col("k") - F.col("i")).alias("at"), F.lit(1).alias("kind"), "k", F.lit(None).cast(claims.schema["key"].dataType).alias("key")))
    return running(rows, group, ["at", "kind", "k"], F.lit(1).cast("long"), "n").where("kind = 0").select(*group, "key", F.col("n").alias("k"))


def free_names(claims: DataFrame, taken: DataFrame, group: list[str], name: str, key: str, out: str = "free_name", numbering: Numbering = Numbering()) -> DataFrame:
    """claims with the name that each gets, in the order of their keys: its own or the first numbered one that is free.

    Names are free if neither taken (columns group and name) nor given to a smaller key in the group has them, in every
    letter. A claim of ``x (2)`` takes that name from those of ``x`` that come later, and the other way round. Keys are
    unique; claims with a null name get null and take none. No claims give no rows.
    """
    place = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    rows = staged(claims.where(F.col(name).isNotNull()).select(place.alias("place"), F.col(name).alias("name"), F.col(key).alias("key")), "claims")
    held = taken.select(place.alias("place"), F.col(name).alias("name")).where("name is not null").distinct()
    up, k = numbering.parsed(F.col("name"))
    bases = staged(rows.groupBy("place", "name").agg(F.min("key").alias("first")).withColumn("up", up).withColumn("k", k), "names")
    names = bases.select("place", "name")
    both = held.withColumn("k", F.lit(1).cast("long")).unionByName(held.select("place", up.alias("name"), k.alias("k")).where("name is not null"))
    blocked = staged(both.join(names, ["place", "name"], "left_semi"), "taken")

    # Names that are numbers of other names that are claimed come after those, since these may have given them away.
    child = bases.join(names.select("place", F.col("name").alias("up")), ["place", "up"], "left_semi").select("place", "name", "first", "up", "k")
    child = staged(child, "numbered")
    level = staged(bases.join(child.select("place", "name"), ["place", "name"], "left_anti").select("place", "name"), "level")
    given: DataFrame | None = None
    while not level.isEmpty():
        mine = rows.join(level, ["place", "name"], "left_semi")
        expiring = child.join(level.select("place", F.col("name").alias("up")), ["place", "up"], "left_semi").select("place", F.col("up").alias("name"), "k", F.col("first").alias("until"))
        barred = blocked.join(level, ["place", "name"], "left_semi")
        if given is not None:
            lost = child.join(given.withColumnRenamed("name", "up"), ["place", "up", "k"]).where(F.col("key") < F.col("first"))
            barred = barred.unionByName(lost.select("place", "name", F.lit(1).cast("long").alias("k")))
        got = staged(_until_free(mine, barred, expiring), "given")
        given = got if given is None else given.unionByName(got)
        level = staged(child.join(level.select("place", F.col("name").alias("up")), ["place", "up"], "left_semi").select("place", "name"), "level")
    numbers = given if given is not None else rows.withColumn("k", F.lit(1).cast("long"))
    found = numbers.select(F.col("key").alias("_key"), numbering.numbered(F.col("name"), F.col("k")).alias(out))
    return claims.join(found, F.col(key) == F.col("_key"), "left").drop("_key")
