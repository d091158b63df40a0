"""String similarity as built-in expressions: trigrams, edit distance and character vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    of_word = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(of_word))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams; 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def word_similarity(term: Column, text: Column) -> Column:
    """The best share of the term's trigrams and those of one word of the text."""
    x = trigrams(term)
    best = F.transform(words(text), lambda w: F.size(F.array_intersect(x, trigrams(w))) / F.size(F.array_union(x, trigrams(w))))
    return F.coalesce(F.array_max(best), F.lit(0.0))


def nearest_word(term: str, text: Column, most: int = 2) -> Column:
    """Smallest edit distance, most at most, of the term to a word with its first letter and about its length; else null."""
    near = F.filter(
        words(text),
        lambda w: (F.substring(w, 1, 1) == term[:1]) & F.length(w).between(max(len(term) - 1, 3), len(term) + 1) & (F.levenshtein(w, F.lit(term)) <= most),
    )
    return F.array_min(F.transform(near, lambda w: F.levenshtein(w, F.lit(term))))


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, score) for rows of left (l, members) and right (r, members), arrays of distinct values, of which so large a share is shared.

    An index of the right side's rarest members proposes pairs: two sets that are similar enough share one of the few rarest
    of each, by one order of all members. So there is no comparison of all pairs, and members that many sets have propose none
    unless sets hold little else. Sets of unlike sizes go before they are compared. Empty sets are similar to none.
    """
    times = right.select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("times"))

    def indexed(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(key, F.size("members").alias("n"), F.explode("members").alias("m")).join(times, "m", "left")
        ordered = rows.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "m"))).alias("o"))
        few = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
        return ordered.select(key, F.col("n").alias(f"n_{key}"), F.explode(F.transform(F.slice("o", 1, few.cast("int")), lambda x: x["m"])).alias("m"))

    a, b = indexed(left, "l"), indexed(right, "r")
    near = (F.col("n_l") >= least * F.col("n_r") - 1e-9) & (F.col("n_r") >= least * F.col("n_l") - 1e-9)
    pairs = a.select("l", "n_l", "m").join(b.select("r", "n_r", "m"), "m").where(near).select("l", "r").distinct()
    held = lambda df, key: df.select(key, F.col("members").alias(f"set_{key}"))
    both = F.size(F.array_intersect("set_l", "set_r"))
    share = both / (F.size("set_l") + F.size("set_r") - both)
    return pairs.join(held(left, "l"), "l").join(held(right, "r"), "r").select("l", "r", share.alias("score")).where(F.col("score") >= least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the character counts of two strings; 0 if either is empty."""
    x, y = F.split(a, ""), F.split(b, "")

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, c: s + F.size(F.filter(q, lambda d: d == c)))

    return F.when((F.length(a) > 0) & (F.length(b) > 0), dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))).otherwise(0.0)


def _rarest(df: DataFrame, group: list[str], letters: str, times: DataFrame, least: float, out: str) -> DataFrame:
    """(group, letters, letter, share): the rarest letters of each, as far as the rest makes up the least cosine by itself.

    Of two strings that are similar enough the rarest letter that they share is among these in both, and the product of the
    shares of their lengths, as vectors, from this letter on bounds their cosine.
    """
    rows = df.select(*group, letters, F.explode(F.split(letters, "")).alias("letter")).groupBy(*group, letters, "letter").agg(F.count("*").alias("n")).join(F.broadcast(times), "letter", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    ordered = rows.groupBy(*group, letters).agg(F.array_sort(F.collect_list(F.struct("times", "letter", "n"))).alias("o"))
    square = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y["n"] * y["n"])
    shared = F.transform("o", lambda x, i: F.struct(x["letter"].alias("letter"), F.sqrt(square(F.slice("o", i + 1, F.size("o") - i)) / square(F.col("o"))).alias("share")))
    held = F.filter(shared, lambda x: x["share"] >= least - 1e-9)
    return ordered.select(*group, letters, F.explode(held).alias("h")).select(*group, letters, F.col("h.letter").alias(out), F.col("h.share").alias(f"share{letters}"))


def best_in_group(left: DataFrame, right: DataFrame, group: list[str], key: str, name: str, least: float = 0.95) -> DataFrame:
    """(key, match, score): for each row of left the row of right in its group whose name has the largest cosine over least.

    Names are compared lower-cased, by their letters alone, so each set of letters of a group is compared once; ties go to the
    smaller key. Names with the same letters meet by these; those without such a name only meet names that share one of
    the few rarest letters of both, by all names of right, so most pairs of a large group are never compared. Letters are few
    enough to be sent to every task. Empty names are similar to none.
    """
    letters = F.array_join(F.array_sort(F.split(F.lower(name), "")), "")
    keyed = left.withColumn("_a", letters)
    a = keyed.select(*group, "_a").where("_a <> ''").distinct()
    b = right.select(*group, letters.alias("_b"), F.col(key).alias("match")).where("_b <> ''").groupBy(*group, "_b").agg(F.min("match").alias("match"))
    same = a.join(b.withColumnRenamed("_b", "_a"), [*group, "_a"]).select(*group, "_a", F.lit(1.0).alias("score"), "match")
    times = b.select(F.explode(F.array_distinct(F.split("_b", ""))).alias("letter")).groupBy("letter").agg(F.count("*").alias("times"))
    rest = a.join(same, [*group, "_a"], "left_anti")
    met = _rarest(rest, group, "_a", times, least, "letter").join(_rarest(b, group, "_b", times, least, "letter"), [*group, "letter"]).where(F.col("share_a") * F.col("share_b") >= least - 1e-9).select(*group, "_a", "_b").distinct()
    near = met.join(b, [*group, "_b"]).withColumn("score", cosine(F.col("_a"), F.col("_b"))).where(F.col("score") > least).select(*group, "_a", "score", "match")
    best = same.unionByName(near).groupBy(*group, "_a").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "match")).alias("b")).where(-F.col("b.s") > least)
    return keyed.join(best, [*group, "_a"]).select(key, F.col("b.match").alias("match"), (-F.col("b.s")).alias("score"))
