from pyspark.sql import functions as F

from shelfmark.operators import access, decisions, merging, naming


def test_moves_get_free_destinations(spark):
    decided = spark.createDataFrame([(1, "move", "A/x", 0.9), (2, "move", "A/x", 0.95), (3, "rename", "B/y", 0.5), (4, "keep", "A/x", 1.0), (5, "move", "C/z", None)], "id long, action string, target string, confidence double")
    taken = spark.createDataFrame([("A/x",), ("A/x (3)",)], "target string")
    got = {r.id: (r.destination, r.status) for r in decisions.move_plan(decided, taken, 0.8).collect()}
    assert got == {1: ("A/x (2)", "planned"), 2: ("A/x (4)", "planned"), 3: (None, "low_confidence"), 4: (None, "no_move_needed"), 5: (None, "low_confidence")}


def test_preferred_source_wins_near_ties(spark):
    packs = spark.createDataFrame([("A", "T", "s1", 100, 3, True), ("a ", "t", "s2", 97, 3, False), ("B", "U", "s1", 100, 3, True), ("B", "U", "s2", 50, 9, True)], "creator string, title string, source string, bytes long, files long, image boolean")
    assert {(r.creator, r.source) for r in decisions.cross_source(packs, "s2").collect()} == {("a", "s2"), ("b", "s1")}


def test_presence_by_containment(spark):
    have = spark.createDataFrame([("The Great Dragon of Winterfell (2)",), ("Small",)], "name string")
    want = spark.createDataFrame([("great dragon of winterfell",), ("SMALL copy",), ("all",), ("Great Eagle of Winterfell",)], "name string")
    assert {r.name: r.found for r in decisions.present_by_name(want, have, "name").collect()} == {"great dragon of winterfell": True, "SMALL copy": True, "all": False, "Great Eagle of Winterfell": False}


def test_detection_summary_and_sensitivity(spark):
    d = spark.createDataFrame([(1, [("HOT", 0.7), ("ARM_EXPOSED", 0.2)]), (2, [("ARM_EXPOSED", 0.9)]), (3, [])], "id long, d array<struct<label: string, score: double>>")
    rows = {r.id: r for r in d.select("id", decisions.is_sensitive(F.col("d"), ["HOT"]).alias("s"), decisions.detection_summary(F.col("d"), 1).alias("m")).collect()}
    assert [rows[k].s for k in (1, 2, 3)] == [True, True, False]
    assert (rows[1].m.n, rows[1].m.top, rows[1].m.labels) == (2, 0.7, ["HOT"]) and rows[3].m.top is None


def test_presets_keep_owners(spark):
    grants = spark.createDataFrame([(1, "u1", "own"), (1, None, "view"), (2, "u2", "own")], "object long, subject string, permission string")
    now = access.with_preset(grants, grants.where("object = 1").select("object"), "member")
    assert {(r.object, r.subject, r.permission) for r in now.collect()} == {(1, "u1", "own"), (1, "role::member", "view"), (2, "u2", "own")}
    assert {(r.object, r.preset) for r in access.presets(now).collect()} == {(1, "member"), (2, "private")}


def test_sensitive_items_hide_on_request(spark):
    items = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, sensitive boolean")
    assert access.without_sensitive(items, "hide").count() == 2 and access.without_sensitive(items, None).count() == 3


def test_forced_filling_and_unique_names(spark):
    own, other = (spark.createDataFrame(r, "id long, a string") for r in ([(1, "x"), (2, " "), (3, "y")], [(1, "n"), (2, "m")]))
    assert {r.id: r.a for r in merging.fill_blanks(own, other, "id", ["a"]).collect()} == {1: "x", 2: "m", 3: "y"}
    assert {r.id: r.a for r in merging.fill_blanks(own, other, "id", ["a"], force=True).collect()} == {1: "n", 2: "m", 3: "y"}
    names = spark.createDataFrame([(1, "g", "A"), (2, "g", "A"), (3, "h", "A"), (4, None, "A"), (5, "g", None), (6, "g", "a")], "id long, grp string, name string")
    got = {r.id: r.free_name for r in naming.free_names(names, names.limit(0), ["grp"], "name", "id").collect()}
    assert got == {1: "A", 2: "A (2)", 3: "A", 4: "A", 5: None, 6: "a"}


def test_indexability_of_items_collections_and_creators(spark):
    from shelfmark.plans import registry

    d = "/root/testdata/sf0.001"
    found = {r.kind: r["count"] for r in registry.QUERIES["effective_indexability"](spark, d).groupBy("kind").count().collect()}
    assert found == {kind: spark.read.parquet(f"{d}/{t}.parquet").count() for kind, t in (("item", "customer"), ("collection", "supplier"), ("creator", "nation"))}
