"""Searches of many terms and joins of similar names against plain comparisons of all pairs."""

import collections
import math
import random

from pyspark.sql import functions as F

from shelfmark.functions import similarity
from shelfmark.operators import search


def test_many_terms_find_what_each_finds(spark):
    names = ["Rogue (Marvel)", "Wolverine Bust", "Aspan Lohia Rouge Girl", "dragon", "dragons egg", None, "", "Dragon Age", "ab cde"]
    items = spark.createDataFrame([(k, n, f"Cat/{n}") for k, n in enumerate(names)], "id long, name string, path string")
    terms = ["rouge", "Dragon", "wolvrine", "a b", "not", "cde", "zz"]
    got = {(r.term, r.id): round(r.score, 9) for r in search.fuzzy_many(items, spark.createDataFrame([(t,) for t in [*terms, "rouge"]], "term string"), "name").collect()}
    want = {(t, r.id): round(r.score, 9) for t in terms for r in search.fuzzy(items, t, "name").collect()}
    assert got == want and {k for t, k in want if t == "rouge"} >= {0, 2}
    with_path = {(r.term, r.id) for r in search.fuzzy_many(items, spark.createDataFrame([("cat",)], "term string"), "name", path="path").collect()}
    assert with_path == {("cat", r.id) for r in search.fuzzy(items, "cat", "name", path="path").collect()}


def test_index_is_joined_by_trigrams(spark):
    items = spark.createDataFrame([(1, "a b")], "id long, name string")
    plan = search.fuzzy_many(items, items.select(F.col("name").alias("term")), "name")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_similar_names_without_comparing_all(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(8, 20)))
    own = [word() for _ in range(300)]
    near = [w if k % 5 == 0 else "".join(rng.sample(w, len(w))) if k % 5 == 1 else w + rng.choice("xyz") if k % 5 == 2 else word() for k, w in enumerate(own)]
    counts = lambda s: collections.Counter(s.lower())

    def cosine(a, b):
        x, y = counts(a), counts(b)
        return sum(n * y[c] for c, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))

    want = {}
    for i, a in enumerate(own):
        scores = [(-round(cosine(a, b), 12), 1000 + j) for j, b in enumerate(near)]
        if -min(scores)[0] > 0.95:
            want[i] = min(scores)[1]
    left = spark.createDataFrame([(i, "g", a) for i, a in enumerate(own)] + [(5000, "g", ""), (5001, "g", None)], "id long, g string, n string")
    right = spark.createDataFrame([(1000 + j, "g", b) for j, b in enumerate(near)] + [(9000, "h", own[0]), (9001, "g", "")], "id long, g string, n string")
    assert {r.id: r.match for r in similarity.best_in_group(left, right, ["g"], "id", "n").collect()} == want and len(want) > 150
    times = right.select(F.explode(F.array_distinct(F.split("n", ""))).alias("letter")).groupBy("letter").agg(F.count("*").alias("times"))
    sorted_ = lambda df, out: df.where("n <> ''").select("g", F.array_join(F.array_sort(F.split(F.lower("n"), "")), "").alias(out)).distinct()
    a, b = (similarity._rarest(sorted_(df, c), ["g"], c, times, 0.95, "letter") for df, c in ((left, "_a"), (right, "_b")))
    met = a.join(b, ["g", "letter"]).where("share_a * share_b >= 0.95 - 1e-9").select("_a", "_b").distinct().count()
    assert met < len(own) * len(near) / 3, met  # letters here are all as rare; those of names are not
