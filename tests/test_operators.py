import datetime
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark import staging
from shelfmark.operators import detectors, merging, ranking, tree
from shelfmark.sources import archives, listing, records
from shelfmark.streaming import incremental


def test_trees_end_in_loops_of_any_length(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (10, 12), (11, 10), (12, 11), (20, 20)], "id long, up long")
    assert {(r.id, r.depth) for r in tree.below(nodes, nodes.where("id = 10"), "id", "up").collect()} == {(10, 0), (11, 1), (12, 2)}
    assert {r.id for r in tree.under_roots(nodes, nodes, "id", "up").collect()} == {1, 2, 3}
    assert {r.id for r in tree.between(nodes, nodes.where("id = 1"), nodes.where("id > 1"), "id", "up").collect()} == {2, 3}


def test_nesting_is_by_folders_not_by_letters(spark):
    items = spark.createDataFrame([(1, 1, "a/b"), (2, 1, "a/b/c"), (3, 1, "a/bc"), (4, 2, "a/b/c"), (5, 1, "a/b_%/x"), (6, 1, "a")], "id long, library_id long, path string")
    assert {(r.outer, r.inner) for r in tree.nested(items, "id", "path", ["library_id"]).collect()} == {(1, 2), (6, 1), (6, 2), (6, 3), (6, 5)}


def test_common_root(spark):
    df = spark.createDataFrame([(1, "a/b/c"), (1, "a/b/d"), (2, "a/b"), (2, "x/b"), (3, "q/r")], "g long, path string")
    assert {r.g: r.root for r in tree.common_root(df, ["g"], "path").collect()} == {1: "a/b", 2: "", 3: "q/r"}


def test_preview_pick_and_sections(spark):
    files = spark.createDataFrame([(1, 1, "mesh.stl"), (2, 1, "photo.png"), (3, 1, "preview.jpg"), (4, 2, "notes.txt"), (5, 2, "part.obj")], "id long, item long, filename string")
    first = ranking.first(files, ["item"], [ranking.preview_priority(F.col("filename")), F.col("id")])
    assert {(r.item, r.filename) for r in first.collect()} == {(1, "preview.jpg"), (2, "part.obj")}
    names = spark.createDataFrame([(1, n) for n in ("arm_left", "arm_right", "base", "head_a", "head_b")], "g long, name string")
    assert {r.name: r.section for r in ranking.prefix_sections(names, "g", "name").collect()} == {"arm_left": "arm_", "arm_right": "arm_", "base": None, "head_a": "head_", "head_b": "head_"}


@pytest.fixture(scope="module")
def pack(spark):
    items = spark.createDataFrame([(1, "Batman Pack", "DC"), (2, "Batman Pack (2)", "dc"), (3, "Batman Bust", "DC"), (4, "漢字", "DC"), (5, "かな", "DC"), (6, "Robin", "DC")], "id long, name string, category string")
    files = spark.createDataFrame([(1, "a.stl", 10, "d1"), (2, "A.stl", 10, "d1"), (3, "b.stl", 5, "d2"), (6, "x", 1, "d2")] + [(k, f"p{n}", n, None) for k in (3, 6) for n in (7, 8)], "item long, name string, size long, digest string")
    return items, files


def test_candidates_have_their_evidence_once(pack):
    got = {(r.a, r.b): (r.signals, r.overlap) for r in merging.candidates(*pack).collect()}
    assert got == {(1, 2): (["name_near_dupe", "shared_digest"], 0), (3, 6): (["shared_digest"], 0)}


def test_gate(spark):
    pairs = spark.createDataFrame([(1, 2, ["shared_digest"], 0), (3, 4, ["name_near_dupe"], 0), (5, 6, [], 9), (7, 8, ["file_overlap"], 2)], "a long, b long, signals array<string>, overlap long")
    without = {r.a: (r.decision, r.confidence, r.approved) for r in merging.decide(pairs, F.lit(False), F.lit("merge"), F.lit(0.99), 0.83).collect()}
    assert without == {1: ("merge", 0.85, True), 3: ("merge", 0.82, False), 5: ("separate", 0.0, False), 7: ("separate", 0.0, False)}
    seen = {r.a: r.decision for r in merging.decide(pairs, F.lit(True), F.lit("separate"), F.lit(0.9), 0.8).collect()}
    assert set(seen.values()) == {"separate"}


def test_merge_then_unmerge_restores_the_files(spark):
    files = spark.createDataFrame([(1, 10, "same.stl", "x"), (2, 10, "clash.stl", "y"), (3, 10, "new.stl", "z"), (4, 20, "same.stl", "x"), (5, 20, "clash.stl", "q")], "id long, item long, name string, digest string")
    plan = merging.merge_plan(files, spark.createDataFrame([(10, 20)], "source long, target long"))
    assert {(r.file_id, r.action, r.new_name) for r in plan.collect()} == {(1, "drop", None), (2, "rename", "clash_y.stl"), (3, "adopt", "new.stl")}
    now = datetime.datetime(2024, 3, 1)
    past = merging.history(plan).withColumn("merged_at", F.lit(now - datetime.timedelta(days=3))).withColumn("undone_at", F.lit(None).cast("timestamp"))
    undone = {(r.file_id, r.action) for r in merging.unmerge_plan(past, F.lit(now)).collect()}
    assert undone == {(1, "create"), (2, "move"), (3, "move")}
    assert merging.unmerge_plan(past, F.lit(now + datetime.timedelta(days=60))).count() == 0


def test_plan_lines(spark):
    plan = spark.createDataFrame([("a", "b", 0.91), ("a", "b", 0.5), ("a", "zz", 0.95), ("a", "b", None)], "path_a string, path_b string, confidence double")
    got = [r.status for r in merging.apply_status(plan, spark.createDataFrame([("a",), ("b",)], "path string")).collect()]
    assert sorted(got) == ["apply", "low_confidence", "low_confidence", "unknown_path"]


def test_detectors_and_their_update(spark):
    items = spark.createDataFrame([(1, 1, "a", "MIT", 5), (2, 1, "a/b", None, None), (3, 1, "c", "", 5)], "id long, library_id long, path string, license string, creator_id long")
    files = spark.createDataFrame([(1, 1, "x.stl", 5, "d"), (2, 2, "y.png", 5, "d"), (3, 2, "z.pdf", 5, "d"), (4, 1, "w.stl", 0, "d")], "id long, item_id long, filename string, size long, digest string")
    tables = {"items": items, "files": files, "listing": files.where("id <> 3"), "links": spark.createDataFrame([(1,)], "item_id long"), "tags": spark.createDataFrame([(2,)], "item_id long")}
    found = {}
    for r in detectors.detect(tables).collect():
        found.setdefault(r.category, set()).add(r.id)
    assert found == {"missing": {3}, "empty": {3}, "nesting": {1}, "duplicate": {1, 2}, "no_image": {1, 3}, "no_mesh": {2, 3}, "no_license": {2, 3}, "no_creator": {2}, "no_links": {2, 3}, "no_tags": {1, 3}, "missing_item": {3}, "empty_file": {4}}
    stored = spark.createDataFrame([(1, "resolving", True), (9, "detected", False)], "id long, state string, ignored boolean")
    now = detectors.update(stored, spark.createDataFrame([(1,), (2,)], "id long"), ["id"])
    assert {(r.id, r.state, r.ignored, r.known) for r in now.collect()} == {(1, "resolving", False, True), (2, "detected", False, False)}
    again = detectors.update(now, now.select("id"), ["id"])
    assert {(r.id, r.state) for r in again.collect()} == {(1, "resolving"), (2, "detected")}


def test_orphans_are_counted(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, ref long")
    assert detectors.orphans({"x": (rows, "ref", rows.where("id > 5"), "id")}).first().n == 2


def test_listing(spark, tmp_path):
    for p in ("m1/a.stl", "m1/images/pic.PNG", "m1/images/stray.stl", "cat/m2/STL/b.obj", ".hidden/x.stl", "@eaDir/y.stl", "m1/skip.xyz", "cat/m3/thumb.jpg", "one/two/three/four/five/six/seven/z.stl"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    found = listing.indexable(listing.files(spark, str(tmp_path)), ["^thumb"])
    assert {r.path for r in found.collect()} == {"m1/a.stl", "m1/images/pic.PNG", "cat/m2/STL/b.obj", "one/two/three/four/five/six/seven/z.stl"}
    assert {r.folder for r in listing.new_folders(found, spark.createDataFrame([("m1",)], "folder string")).collect()} == {"cat/m2"}
    new, missing = listing.changes(found, spark.createDataFrame([("m1/a.stl",), ("gone.stl",)], "path string"))
    assert "gone.stl" in {r.path for r in missing.collect()} and new.count() == 3
    assert ("cat", "m2", 1) in {(r.category, r.model, r.files) for r in listing.category_models(found).collect()}
    prints = {r.name: r.digest for r in listing.fingerprints(spark, str(tmp_path)).collect()}
    assert len(prints["a.stl"]) == 16


def test_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, size in (("readme.txt", 5), ("parts/widget.stl", 10), ("pics/shot.png", 4000), ("__MACOSX/._junk", 5), ("../evil.stl", 5)):
            z.writestr(name, b"x" * size)
    (tmp_path / "a.zip").write_bytes(raw.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.rar").write_bytes(b"Rar!")
    found = archives.entries(spark, str(tmp_path))
    rows = found.collect()
    assert {(r.pathname, r.kind) for r in rows if r.status == "listed"} == {("readme.txt", "other"), ("parts/widget.stl", "mesh"), ("pics/shot.png", "image")}
    assert {r.status for r in rows} == {"listed", "unreadable", "unsupported"}
    assert archives.largest_image(found).first().pathname == "pics/shot.png"
    stored = found.where("pathname <> 'readme.txt'").withColumn("size", F.col("size") + (F.col("kind") == "mesh").cast("int"))
    stored = stored.union(found.where("pathname = 'readme.txt'").withColumn("pathname", F.lit("old.txt")))
    assert {(r.pathname, r.action) for r in archives.synchronise(stored, found).collect()} == {("readme.txt", "insert"), ("parts/widget.stl", "update"), ("old.txt", "delete")}


def test_large_archives_are_read_by_ranges(spark, tmp_path):
    at = tmp_path / "big.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr("first.txt", b"abc" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("märz.stl", b"solid")
    with open(at, "rb+") as f:  # an archive of over 3 GB: a hole in front of it, as of one that unpacks itself
        small = f.read()
    with open(at, "wb") as f:
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(small)
    with zipfile.ZipFile(tmp_path / "long.zip", "w") as z:
        for k in range(300):
            with z.open(zipfile.ZipInfo(f"d/{k}.png"), "w", force_zip64=True) as e:
                e.write(b"x" * k)
    (tmp_path / "cut.zip").write_bytes(small[:-30])
    rows = archives.entries(spark, str(tmp_path), most=200).collect()
    assert {(r.pathname, r.size) for r in rows if r.archive.endswith("big.zip")} == {("first.txt", 3000), ("märz.stl", 5)}
    assert sum(r.status == "listed" for r in rows if "long" in r.archive) == 200 and sum(r.status == "truncated" for r in rows) == 1
    assert [r.status for r in rows if "cut" in r.archive] == ["unreadable"]
    big, long, cut = (f"file:{tmp_path}/{n}.zip" for n in ("big", "long", "cut"))
    asked = spark.createDataFrame([(big, "first.txt"), (big, "märz.stl"), (big, "none"), (long, "d/299.png"), (cut, "first.txt"), (None, "x")], "archive string, pathname string")
    got = {(r.archive, r.pathname): (r.content, r.status) for r in archives.contents(asked, longest=2999).collect()}
    assert got == {(big, "first.txt"): (None, "too_large"), (big, "märz.stl"): (b"solid", "read"), (big, "none"): (None, "missing"), (long, "d/299.png"): (b"x" * 299, "read"), (cut, "first.txt"): (None, "unreadable")}


def test_records(spark, tmp_path):
    (tmp_path / "plan.jsonl").write_text('{"path_a": "a", "confidence": 0.9, "signals": ["x"]}\n\nno json\n{"path_b": "b"}\n')
    rows, rejects = records.json_lines(spark, str(tmp_path / "plan.jsonl"))
    assert (rows.count(), [r.value for r in rejects.collect()]) == (2, ["no json"])
    package = {"title": "T", "keywords": ["k"], "homepage": "h", "links": [{"path": "l"}], "licenses": [{"name": "MIT"}], "contributors": [{"title": "Al", "roles": ["author"]}, {"title": "Bo", "roles": ["creator"]}], "resources": [{"path": "x.stl"}]}
    (tmp_path / "datapackage.json").write_text(json.dumps(package, indent=1))
    p = records.data_packages(spark, str(tmp_path / "datapackage.json")).first()
    assert (p.name, p.tags, p.links, p.license, p.creator, p.files) == ("T", ["k"], ["l", "h"], "MIT", "Bo", ["x.stl"])
    items = spark.createDataFrame([(1, "N", None, "MIT")], "id long, name string, notes string, license string")
    out = records.export_packages(items, spark.createDataFrame([(1, "b"), (1, "a")], "item_id long, tag string"), spark.createDataFrame([(1, "f.stl")], "item_id long, filename string"))
    assert json.loads(out.first().json) == {"title": "N", "keywords": ["a", "b"], "licenses": [{"name": "MIT"}], "resources": [{"path": "f.stl"}]}
    (tmp_path / "m1.json").write_text('{"items": [{"creator": "A", "name": "X", "v": 1}, {"creator": "a ", "name": "x", "v": 2}]}')
    assert records.manifest(spark, str(tmp_path / "m1.json")).first().item.v == 2
    records.write_plan(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_a_stream_applies_each_file_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, ts timestamp"
    rows = [(k % 3, datetime.datetime(2024, 1, 1, 0, k)) for k in range(6)]
    for _ in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.file_stream(spark, source, spark.createDataFrame([], schema).schema)
        once = incremental.debounced(stream, ["id"], "ts", "1 day")
        incremental.apply_once(once, lambda b: b, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_tree_of_any_depth_and_a_loop(spark):
    rows = [(k, k - 1 if k else None) for k in range(12)] + [(100, 102), (101, 100), (102, 101)]
    nodes = spark.createDataFrame(rows, "id long, up long")
    found = {r.id: r.depth for r in tree.below(nodes, nodes.where("id in (0, 100)"), "id", "up").collect()}
    assert found == {**{k: k for k in range(12)}, 100: 0, 101: 1, 102: 2}
    assert tree.below(nodes, nodes.limit(0), "id", "up").count() == 0


@pytest.mark.parametrize("common", [5, 1000])
def test_overlaps_with_a_fact_that_all_items_have(spark, monkeypatch, common):
    monkeypatch.setattr(merging, "COMMON", common)
    import itertools
    import random

    rng = random.Random(1)
    own = {k: {"readme", "license", *rng.sample("abcdefghijkl", rng.randrange(6))} for k in range(60)}
    facts = spark.createDataFrame([(k, f) for k, fs in own.items() for f in fs] + [(None, "readme"), (1, None)], "item long, name string")
    for least in (1, 2, 3, 5):
        every = {(a, b): len(own[a] & own[b]) for a, b in itertools.combinations(own, 2) if len(own[a] & own[b]) >= least}
        got = {(r.a, r.b): r.overlap for r in merging.overlap_pairs(facts, "item", ["name"], least).collect()}
        first = {k: min(j for j in own if own[j] == own[k]) for k in own}
        assert got == {(a, b): n for (a, b), n in every.items() if first[b] == a or (first[a], first[b]) == (a, b)}
        # Items with the very same facts stand for each other, so all pairs follow.
        alike = {(min(a, b), max(a, b)): n for (x, y), n in got.items() for a in own if first[a] == first[x] for b in own if first[b] == first[y] and a != b}
        assert alike | {(a, b): n for (a, b), n in every.items() if first[a] == first[b]} == every


def test_a_split_takes_the_preview_along(spark):
    files = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, item long")
    previews = spark.createDataFrame([(10, 2), (20, 3)], "item long, preview_id long")
    moved, shown = merging.split_plan(files, files.where("id = 2").select("id"), previews, F.col("item") + 1000)
    assert {(r.id, r.item) for r in moved.collect()} == {(1, 10), (2, 1010), (3, 20)}
    assert {(r.item, r.preview_id) for r in shown.collect()} == {(10, None), (1010, 2), (20, 3)}


def test_random_picks_prefer(spark):
    df = spark.range(50)
    assert {r.id for r in ranking.random_top(df, 5, F.col("id") >= 45).collect()} == set(range(45, 50))
    assert len({r.id for r in ranking.random_top(df, 8).collect()}) == 8


def test_shallow_listing_and_new_files(spark):
    at = datetime.datetime(2024, 1, 2)
    rows = [("m/a.stl", at), ("m/STL/b.stl", at), ("m/other/c.stl", at), ("m2/d.stl", datetime.datetime(2023, 1, 1))]
    files = spark.createDataFrame(rows, "path string, modified timestamp")
    assert {r.path for r in listing.shallow(files, "m").collect()} == {"m/a.stl", "m/STL/b.stl"}
    known = spark.createDataFrame([("m/a.stl",)], "path string")
    assert {r.folder for r in listing.folders_with_changes(files, known).collect()} == {"m", "m/other", "m2"}
    models = spark.createDataFrame([("m",), ("m2",), ("m3",)], "folder string")
    assert {r.folder for r in listing.models_with_new_files(files, known, models, datetime.datetime(2024, 1, 1)).collect()} == {"m"}


def test_oversized_archives_are_not_opened_where_rows_hold_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "RANGES", ("s3",))
    with zipfile.ZipFile(tmp_path / "small.zip", "w") as z:
        z.writestr("a.png", b"x" * 10)
    (tmp_path / "large.zip").write_bytes(b"x" * 5000)
    found = {r.archive.rsplit("/", 1)[1]: r.status for r in archives.entries(spark, str(tmp_path), largest=1000).collect()}
    assert found == {"small.zip": "listed", "large.zip": "oversized"}


def test_most_similar_name_of_a_group(spark):
    from shelfmark.functions import similarity

    left = spark.createDataFrame([(1, "a", "head left"), (2, "a", "base"), (3, "b", "head left")], "id long, g string, name string")
    right = spark.createDataFrame([(10, "a", "Head Lefty"), (11, "a", "head right"), (12, "a", "Head Lefty")], "id long, g string, name string")
    assert [(r.id, r.match) for r in similarity.best_in_group(left, right, ["g"], "id", "name", 0.9).collect()] == [(1, 10)]


def test_staged_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    from shelfmark import staging

    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    df = staging.staged(spark.range(3), "rows")
    assert df.count() == 3 and (tmp_path / "shelfmark").exists()
    assert staging.clear(spark) and not (tmp_path / "shelfmark").exists() and not staging.clear(spark)


def test_pairs_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(staging, "PART", 20)
    facts = spark.createDataFrame([(k, f) for k in range(40) for f in (k % 5, 10 + k % 4, 20 + k)], "item long, name long")
    found = merging.overlap_pairs(facts, "item", ["name"], 2)
    assert {(r.a, r.b): r.overlap for r in found.collect()} == {(a, b): 2 for b in range(40) for a in range(b) if (b - a) % 20 == 0}
    # Facts make 140 + 180 pairs, which are counted in 16 parts; the session has 4.
    assert "hashpartitioning(a" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 16), REPARTITION_BY_NUM" in plan


def test_problems_are_found_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(staging, "PART", 20)
    items = spark.createDataFrame([(k,) for k in range(30)], "id long")
    files = spark.createDataFrame([(k, k % 20, "a.png" if k % 2 else "b.stl", 1, None if k % 10 == 9 else f"d{k % 150}") for k in range(200)], "id long, item_id long, filename string, size long, digest string")
    found = detectors.detect({"items": items, "files": files}, ["empty", "no_image", "duplicate"])
    got = {c: {r.id for r in found.where(F.col("category") == c).collect()} for c in ("empty", "no_image", "duplicate")}
    shared = {k for k in range(200) if (k < 50 or k >= 150) and k % 10 != 9}
    assert got == {"empty": set(range(20, 30)), "no_image": {k for k in range(30) if k >= 20 or k % 2 == 0}, "duplicate": shared}
    # 180 files have a digest: 9 parts, where the session has 4. An item's files are one row before they are joined.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(digest#\d+, 9\), REPARTITION_BY_NUM", plan)
    assert plan.count("HashAggregate(keys=[item_id") >= 4


def test_facts_and_sets_of_items_lie_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(staging, "PART", 20)
    parts, seen = {}, merging.staged
    monkeypatch.setattr(merging, "staged", lambda df, name: parts.setdefault(name, df) and seen(df, name))
    facts = spark.createDataFrame([(k, f) for k in range(40) for f in (k % 5, 10 + k % 4, 20 + k)] * 2, "item long, name long")
    found = merging.overlap_pairs(facts, "item", ["name"], 2)
    assert {(r.a, r.b): r.overlap for r in found.collect()} == {(a, b): 2 for b in range(40) for a in range(b) if (b - a) % 20 == 0}
    # 240 facts are made different in 12 parts; the 120 that stay keep 6 parts when they are joined with the items that count.
    plans = {k: df._jdf.queryExecution().executedPlan().toString() for k, df in parts.items()}
    assert re.search(r"hashpartitioning\(_item#\d+L, 12\), REPARTITION_BY_NUM", plans["facts"])
    assert len(re.findall(r"hashpartitioning\(_item#\d+L, 6\)", plans["known"])) >= 2 and "hashpartitioning(_item#" in plans["known"]
    assert not re.search(r"hashpartitioning\(_item#\d+L, 4\)", plans["known"])
