"""Names until free, merges, chains, sections and gates against plain versions that go one by one."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import access, merging, naming, ranking, tree
from shelfmark.staging import staged
from shelfmark.streaming import incremental


@pytest.mark.parametrize("seed", [1, 2])
def test_names_are_given_one_after_another(spark, seed):
    rng = random.Random(seed)
    names = ["x", "x (2)", "x (3)", "x (2) (2)", "y", "x (1)", "x (02)", "x (2) (3)"]
    claims = [(k, rng.choice("ab"), rng.choices(names, [9, 2, 1, 1, 1, 1, 1, 1])[0]) for k in rng.sample(range(1000), 60)]
    taken = [(rng.choice("ab"), n) for n in ("x (4)", "x (9)", "x (2) (4)", "y")]
    have, want = set(taken), {}
    for k, g, n in sorted(claims):
        got, i = n, 2
        while (g, got) in have:
            got, i = f"{n} ({i})", i + 1
        have.add((g, got))
        want[k] = got
    found = naming.free_names(spark.createDataFrame(claims, "k long, g string, n string"), spark.createDataFrame(taken, "g string, n string"), ["g"], "n", "k")
    assert {r.k: r.free_name for r in found.collect()} == want


def test_no_claims_and_endings(spark):
    none = spark.createDataFrame([], "k long, n string")
    assert naming.free_names(none, none.select("n"), [], "n", "k").count() == 0
    claims = spark.createDataFrame([(1, "a.stl"), (2, "a.stl"), (3, "a-1.stl"), (4, ".stl"), (5, ".stl")], "k long, n string")
    style = naming.Numbering("-", "", 1, keep_ending=True)
    got = {r.k: r.free_name for r in naming.free_names(claims, none.select("n"), [], "n", "k", numbering=style).collect()}
    assert got == {1: "a.stl", 2: "a-1.stl", 3: "a-1-1.stl", 4: ".stl", 5: ".stl-1"}


def test_running_sums_over_ranges(spark):
    rows = spark.createDataFrame([("hot" if k % 10 else "cold", (k * 7919) % 3000, k % 3) for k in range(3000)], "g string, k long, v long")
    seen, want = collections.Counter(), {}
    for g, k, v in sorted(map(tuple, rows.collect())):
        seen[g] += v
        want[g, k] = seen[g]
    assert {(r.g, r.k): r.s for r in naming.running(rows, ["g"], ["k"], F.col("v"), "s").collect()} == want


def test_merges_go_file_by_file(spark):
    rng = random.Random(5)
    names = ["a.stl", "a_d1.stl", "a_d2.stl", "a_d1_d2.stl", "b", ".x"]
    files = [(k, rng.randrange(12), rng.choice(names), rng.choice(["d1", "d2", "d3", None, ""])) for k in range(120)]
    merges = [(s, 0 if s < 6 else 6, rng.random()) for s in range(12) if s % 6]
    have, want = collections.defaultdict(list), {}
    for k, item, name, digest in files:
        if item % 6 == 0:
            have[item].append((name, digest, k))
    for source, target, _ in sorted(merges, key=lambda m: m[2]):
        for k, item, name, digest in files:
            if item == source:
                hit = next((h for h in have[target] if h[0] == name), None)
                if hit and digest and digest == hit[1]:
                    want[k] = ("drop", None, hit[2])
                    continue
                if hit:
                    stem, dot, ending = name.rpartition(".") if "." in name[1:] else (name, "", "")
                    mark = digest or __import__("hashlib").md5(str(k).encode()).hexdigest()[:12]
                    want[k] = ("rename", f"{stem}_{mark}{dot}{ending}", None)
                else:
                    want[k] = ("adopt", name, None)
                have[target].append((want[k][1], digest, k))
    plan = merging.merge_plan(spark.createDataFrame(files, "id long, item long, name string, digest string"), spark.createDataFrame(merges, "source long, target long, at double"))
    assert {r.file_id: (r.action, r.new_name, r.same_as) for r in plan.collect()} == want


def test_merged_files_lie_under_their_folder(spark):
    files = spark.createDataFrame([(1, 10, "a.stl", "x"), (2, 11, "a.stl", "y"), (3, 12, "a.stl", "z"), (4, 9, "a.stl", "w")], "id long, item long, name string, digest string")
    items = spark.createDataFrame([(9, "m/t", 1), (10, "m/t/part", 1), (11, "m/side", 1), (12, "m/side", 2)], "id long, path string, library_id long")
    merges = spark.createDataFrame([(10, 9, 1), (11, 9, 2), (12, 9, 3)], "source long, target long, at long")
    assert {r.file_id: r.new_name for r in merging.merge_plan(files, merges, items).collect()} == {1: "part/a.stl", 2: "../side/a.stl", 3: "side/a.stl"}


def test_chains_of_merges_and_loops(spark):
    merges = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (4, 5, 3), (5, 4, 4), (1, 9, 5), (6, 4, 6), (7, 7, 7)], "source long, target long, at long")
    got = {(r.source, r["at"]): (r.target, r.status) for r in merging.merge_targets(merges).collect()}
    assert got == {(1, 1): (3, "merge"), (2, 2): (3, "merge"), (4, 3): (None, "loop"), (5, 4): (None, "loop"), (1, 5): (None, "again"), (6, 6): (None, "loop"), (7, 7): (None, "loop")}


def test_unmerged_items_get_a_free_path(spark):
    past = spark.createDataFrame([(1, 5, "/a/b/"), (2, 5, "c"), (3, None, "a/b")], "id long, source_library_id long, source_path string")
    items = spark.createDataFrame([(5, "a/b"), (6, "c")], "library_id long, path string")
    assert {r.id: r.new_path for r in merging.unmerged_paths(past, items).collect()} == {1: "a/b--unmerged-1", 2: "c", 3: "a/b"}


def test_long_chains_climb_in_few_rounds(spark, monkeypatch):
    rounds = []
    whole = tree.staged
    monkeypatch.setattr(tree, "staged", lambda df, name: rounds.append(name) or whole(df, name))
    nodes = spark.range(1, 1001).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("up"), F.col("id") == 400)
    got = {r.id: r["at"] for r in tree.climb(nodes.toDF("id", "up", "s"), "id", "up", F.col("s")).collect()}
    assert got == {k: 400 if k >= 400 else 1 for k in range(1, 1001)} and rounds.count("ways") <= 12


def test_collections_inherit_from_above(spark):
    rows = [(1, None, 7, None), (2, 1, 8, None), (3, 2, None, "no"), (4, 3, 7, "inherit"), (5, 6, None, None), (6, 5, None, None), (8, 99, None, None), (9, None, 8, None)]
    collections_ = spark.createDataFrame(rows, "id long, parent_id long, creator_id long, indexable string")
    creators = spark.createDataFrame([(7, "yes"), (8, None)], "id long, indexable string")
    got = {r.id: r.indexable for r in access.collections_indexable(collections_, creators, "dflt").collect()}
    assert got == {1: "yes", 2: "yes", 3: "no", 4: "no", 5: "dflt", 6: "dflt", 8: "dflt", 9: "dflt"}


@pytest.mark.parametrize("most", [200_000, 1])
def test_greedy_sections(spark, most):
    names = ["abcd1", "abcd2", "abce1", "Abcd1", "zz", "zz", "file_01", "file_02", "file_11", None, "ab"]
    df = spark.createDataFrame([("g", n) for n in names] + [("h", n) for n in ("abcd1", "abcd2", "abce1")], "g string, n string")
    got = {(r.g, r.n): r.section for r in ranking.prefix_sections(df, "g", "n", most=most).collect()}
    one = {"abcd1": "abcd1", "Abcd1": "abcd1", "abcd2": "abc", "abce1": "abc", "zz": None, "file_01": "file_0", "file_02": "file_0", "file_11": None, None: None, "ab": None}
    assert {n: got["g", n] for n in one} == one and [got["h", n] for n in ("abcd1", "abcd2", "abce1")] == ["abcd", "abcd", None]
    rng = random.Random(most)
    many = [("i", "".join(rng.choice("ab") for _ in range(rng.randrange(3, 9)))) for _ in range(80)]
    low, want, left = [n for _, n in many], {}, sorted(n for _, n in many)
    enough = max(2, int(len(low) * 0.05 + 0.5))
    for n in range(max(map(len, low)) - 1, 2, -1):
        for p, c in collections.Counter(x[:n] for x in left).items():
            if c >= enough:
                want |= {x: p for x in left if x.startswith(p)}
                left = [x for x in left if not x.startswith(p)]
    found = ranking.prefix_sections(spark.createDataFrame(many, "g string, n string"), "g", "n", most=most)
    assert {r.n: r.section for r in found.collect()} == {n: want.get(n) for n in low}


def test_posts_wait_for_the_last_post(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, "a", start + datetime.timedelta(minutes=10 * k)) for k in range(6)] + [(10, "b", start), (11, None, start), (12, "b", start + datetime.timedelta(minutes=15))]
    events = spark.createDataFrame(rows, "id long, who string, ts timestamp")
    got = {r.id for r in incremental.posts(events, ["who"], "ts", "15 MINUTES", "id").collect()}
    assert got == {0, 2, 4, 10, 11}  # at 0, 20 and 40 minutes; fifteen minutes exactly is too early


def test_locks_end_by_execution_or_age(spark):
    start = datetime.datetime(2024, 1, 1)
    kinds = [(0, "ask"), (1, "ask"), (2, "done"), (3, "ask"), (4, "ask"), (13, "ask"), (14, "ask")]
    events = spark.createDataFrame([(m, "job", k, start + datetime.timedelta(minutes=m)) for m, k in kinds], "id long, job string, kind string, ts timestamp")
    assert {r.id for r in incremental.admitted(events, ["job"], "ts", "kind", "10 MINUTES", "id").collect()} == {0, 3, 13}


def test_expired_marks_do_not_count(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = spark.createDataFrame([(1, "a", day(2)), (2, "b", day(2))], "id long, g string, ts timestamp")
    marks = spark.createDataFrame([("a", day(3)), ("b", day(20))], "g string, mark timestamp")
    assert {r.id for r in incremental.since(rows, marks, ["g"], "ts", F.lit(datetime.datetime(2024, 2, 10))).collect()} == {1}
    assert incremental.since(rows, marks, ["g"], "ts").count() == 0


def test_sections_of_many_groups_share_tasks(spark):
    df = spark.range(0, 3000).select((F.col("id") % 1000).alias("g"), F.concat(F.lit("Part"), F.col("id").cast("string")).alias("n"))
    found = ranking.prefix_sections(df, "g", "n")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.where("g = 7").select("n", "section").collect()} == {("Part7", "part"), ("Part1007", "part"), ("Part2007", "part")}
    assert {tuple(r) for r in found.where("g = 100").select("n", "section").collect()} == {("Part100", "part1"), ("Part1100", "part1"), ("Part2100", None)}


def test_files_of_a_merge_are_dealt_out_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(merging, "staged", lambda df, name: kept.append(name) or staged(df, name))
    files = spark.createDataFrame([(1, 1, "a.stl", "x"), (2, 2, "a.stl", "y"), (3, 2, "b.stl", "z"), (4, 3, "b.stl", "z")], "id long, item long, name string, digest string")
    merges = spark.createDataFrame([(2, 1), (3, 1)], "source long, target long")
    plan = merging.merge_plan(files, merges)
    assert {tuple(r)[3:] for r in plan.collect()} == {(2, "rename", "a_y.stl", None), (3, "adopt", "b.stl", None), (4, "drop", None, 3)}
    assert kept == []
    # A name that a renamed file gets is looked at again.
    more = files.union(spark.createDataFrame([(5, 3, "a_y.stl", "w")], files.schema))
    assert {r.file_id: r.new_name for r in merging.merge_plan(more, merges).collect()} == {2: "a_y.stl", 3: "b.stl", 4: None, 5: "a_y_w.stl"}
    assert kept
