"""Filters and search on the four-item fixture."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import search
from shelfmark.operators.browse import Window
from shelfmark.operators.filters import Catalogue, FilterSpec
from shelfmark.operators.search import And, Field, Not, Or, Word

A, B, C, D = "cat in the hat", "hat on the cat", "bat on a mat", "bat on a hat"


@pytest.fixture(scope="module")
def catalogue(spark):
    items = spark.createDataFrame(
        [(1, 1, None, 10, A, "lorem ipsum", None), (2, 2, None, 10, B, None, "dolor sit amet"), (3, 3, 20, None, C, None, None), (4, 4, 20, None, D, None, None)],
        "id long, library_id long, collection_id long, creator_id long, name string, notes string, caption string",
    )
    tags = spark.createDataFrame([(1, t) for t in ("dog", "log", "frog", "cat")] + [(3, "log"), (4, "frog")], "item_id long, tag string")
    links = spark.createDataFrame([(3, "https://thingiverse.com/thing:1234")], "item_id long, url string")
    lists = spark.createDataFrame([(4, "printed")], "item_id long, list string")
    files = spark.createDataFrame([(1, "preview.JPG"), (2, "cover.txt"), (3, "mesh.stl"), (4, "big_hat.stl")], "item_id long, filename string")
    return Catalogue(items, tags, links, lists, files)


@pytest.mark.parametrize(
    ("params", "names"),
    [
        ({}, {A, B, C, D}),
        ({"words": ("cat",)}, {A, B}),
        ({"collections": (20,)}, {C, D}),
        ({"collections": ""}, {A, B}),
        ({"creator": 10}, {A, B}),
        ({"creator": ""}, {C, D}),
        ({"tags": ["log"]}, {A, C}),
        ({"tags": [""]}, {B}),
        ({"tags": ["log", "frog"]}, {A}),
        ({"missing_tag": "log"}, {B, D}),
        ({"library": 4}, {D}),
        ({"link": "thingiverse.com"}, {C}),
        ({"listed": "printed"}, {D}),
        ({"unlisted": "printed"}, {A, B, C}),
        ({"has_image": "1"}, {A}),
        ({"has_image": ["1", "0"]}, {A, B, C, D}),
        ({"library": "all", "creator": "all", "unknown": 3, "link": ""}, {A, B, C, D}),
    ],
)
def test_filters(catalogue, params, names):
    assert {r.name for r in catalogue.filtered(FilterSpec.of(params)).collect()} == names


def test_image_default_does_not_hold_while_searching(catalogue):
    assert FilterSpec.of({}, default_has_image=True).has_image
    assert not FilterSpec.of({"words": ("cat",)}, default_has_image=True).has_image


FREE = ["name", "caption", "creator", "collection", "tag"]


@pytest.mark.parametrize(
    ("query", "names"),
    [
        (Word("cat"), {A, B}),
        (Word("dog"), {A, B}),
        (Word("seuss"), {A, B}),
        (Word("chiro"), {C, D}),
        (Or((Word("cat"), Word("in"), Word("the"), Word("hat"))), {A, B, D}),
        (And((Word("the"), Word("hat"))), {A, B}),
        (Word("the hat"), {A}),
        (And((Word("hat"), Not(Word("cat")))), {D}),
        (And((Not(Word("cat")), Not(Word("hat")))), {C}),
        (Or((Not(Word("cat")), Not(Word("hat")))), {C, D}),
        (And((Or((Word("cat"), Word("hat"))), Not(Word("on")))), {A}),
        (And((Or((Word("cat"), Word("bat"))), Word("hat"))), {A, B, D}),
        (And((Word("hat"), Field("tag", "=", "cat"))), {A}),
        (And((Word("bat"), Not(Field("tag", "=", "frog")))), {C}),
        (And((Field("tag", "=", "frog"), Field("tag", "=", "dog"))), {A}),
        (Or((Field("tag", "=", "frog"), Field("tag", "=", "dog"))), {A, B, D}),
        (And((Word("hat"), Field("creator", "~", "dr"))), {A, B}),
        (And((Word("hat"), Field("collection", "~", "chiro"))), {D}),
        (Field("description", "~", "lorem"), {A}),
        (Word("dolor"), {B}),
        (Field("filename", "~", "big"), {D}),
        (Field("collection", "set"), {C, D}),
    ],
)
def test_search(spark, catalogue, query, names):
    assert found(spark, catalogue, query) == names


#: Queries as users type them, and the items that they find.
TYPED = [
    ("cat", {A, B}), ("dog", {A, B}), ("seuss", {A, B}), ("chiro", {C, D}), ("cat or in or the or hat", {A, B, D}), ("the hat", {A, B}), ('"the hat"', {A}),
    ("hat and not cat", {D}), ("not cat and not hat", {C}), ("not cat or not hat", {C, D}), ("(cat or hat) and not on", {A}), ("(cat or bat) and hat", {A, B, D}),
    ("cat hat", {A, B}), ("hat tag=cat", {A}), ("bat tag != frog", {C}), ("on tag=frog", {D}), ("tag=frog tag=dog", {A}), ("tag=frog or tag=dog", {A, B, D}),
    ("hat creator~dr", {A, B}), ("hat collection~chiro", {D}), ("description ~ lorem", {A}), ("dolor", {B}), ("filename ~ big", {D}), ("set collection", {C, D}),
    ("-cat bat", {C, D}), ("hat !on", {A}), ("notes ~ lorem", {A}), ('(hat "on a', {D}),
]


@pytest.mark.parametrize(("text", "names"), TYPED)
def test_typed_search(spark, catalogue, text, names):
    assert found(spark, catalogue, search.typed(text, {"notes": "description"})) == names


def test_nothing_typed():
    assert all(search.typed(t) is None for t in ("", "  ", "((", "or", "and"))
    assert search.fuzzy_term(" Rouge ") == "rouge" and not any(map(search.fuzzy_term, ("ro", "two words", "a=b", "not")))


def found(spark, catalogue, query):
    tags = catalogue.tags.where("not (item_id = 2)").union(spark.createDataFrame([(2, "dog")], "item_id long, tag string"))
    items = catalogue.items.withColumn("creator", F.when(F.col("creator_id") == 10, "Dr Seuss")).withColumn("collection", F.when(F.col("collection_id") == 20, "Chiroptera"))
    items = search.with_related(items, "id", tag_list=(tags, "item_id", "tag"), file_list=(catalogue.files, "item_id", "filename"))
    columns = {"name": "name", "caption": "caption", "creator": "creator", "collection": "collection", "description": "notes"}
    hit = search.condition(query, columns, {"tag": "tag_list", "filename": "file_list"}, FREE)
    return {r.name for r in items.where(hit).collect()}


def test_typo_is_found_and_ranked_after_the_exact_word(spark):
    items = spark.createDataFrame([(1, "Rogue (Marvel)"), (2, "Wolverine Bust"), (3, "Aspan Lohia Rouge Girl")], "id long, name string")
    found = {r.id: r.score for r in search.fuzzy(items, "rouge", "name").collect()}
    assert set(found) == {1, 3} and found[3] >= found[1]
    assert search.fuzzy(items, "ro", "name").count() == 0


@pytest.mark.parametrize(("given", "window"), [((None, None), Window(0, 48)), (("-5", "500"), Window(0, 96)), (("x", "0"), Window(0, 1)), ((2_000_000, 10), Window(1_000_000, 10))])
def test_windows_are_clamped(given, window):
    assert Window.of(*given) == window


def test_pages_partition_the_ordered_rows(spark):
    from shelfmark.operators import browse

    df = spark.createDataFrame([(k, None if k % 5 == 0 else f"N{k % 3}") for k in range(23)], "id long, name string")
    by = browse.order("name", "id")
    pages = [r.id for at in range(0, 30, 7) for r in Window(at, 7).cut(df, by).collect()]
    assert pages == [r.id for r in df.orderBy(*by).collect()]
    assert all(df.where(F.col("id") == k).first().name is None for k in pages[-5:])
