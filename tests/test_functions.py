import pytest
from pyspark.sql import functions as F

from shelfmark.functions import similarity
from shelfmark.functions import text as fn


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (fn.name_key, " Batman Pack (2)", "batmanpack"),
        (fn.name_key, "Batman copy 3", "batman"),
        (fn.name_key, "漢字", ""),
        (fn.display_name, "Copy of copy of a/b:c   d", "a b c d"),
        (fn.display_name, "", "Unnamed"),
        (fn.without_copy_prefix, "Copy of Copy of X", "X"),
        (fn.copy_number, "thing (12) ", 12),
        (fn.copy_number, "thing", None),
        (fn.is_copy_name, "thing (1)", True),
        (fn.dashed, " A  B_c! ", "a-b-c"),
        (fn.title, "some_model-NAME x", "Some Model NAME X"),
        (fn.trim_slashes, "/a/b/", "a/b"),
        (fn.parent, "a/b/c.stl", "a/b"),
        (fn.parent, "c.stl", ""),
        (fn.ancestors, "a/b/c", ["a", "a/b"]),
        (fn.extension, "x/y.tar.GZ", "gz"),
        (fn.extension, "x.d/y", ""),
        (fn.host, "https://WWW.example.com:8080/x?y", "www.example.com"),
        (fn.site, "https://www.example.com", "example"),
        (fn.site, "https://boop", "boop"),
        (fn.server_and_port, "http://a.b:81/x", "a.b:81"),
        (fn.server_and_port, "https://a.b:443/x", "a.b"),
        (fn.masked_email, "joe@mail.example.org", "j***@***.org"),
        (fn.subject_kind, "role::public", "public"),
        (fn.subject_kind, "group::4", "group"),
        (fn.safe_entry, ".\\a\\b.stl", "a/b.stl"),
        (fn.safe_entry, "../a", None),
        (fn.safe_entry, "C:/a", None),
        (fn.recovered_json, 'x ```json\n{"a": {"b": 1}}\n``` y', '{"a": {"b": 1}}'),
        (fn.recovered_json, "none", None),
    ],
)
def test_text(spark, f, given, wanted):
    assert value(spark, f(F.lit(given))) == wanted


def test_folder_tags_and_keywords(spark):
    assert value(spark, fn.folder_tags(F.lit("x/The big-Bat a"), ["the"])) == ["big", "bat"]
    assert value(spark, fn.has_keyword(F.lit("a/Pre_Supported/x.stl"), ["supported"]))


def test_path_template(spark):
    path = F.lit("/top/middle/bottom/prefix - name#42")
    got = {k: value(spark, v) for k, v in fn.PathTemplate("{creator}/{collection}/{tags}/{model_name}").parse(path).items()}
    assert got == {"creator": "top", "collection": "middle", "tags": ["bottom"], "model_name": "prefix - name"}
    assert value(spark, fn.PathTemplate("{tags}/prefix - {model_name}").parse(path)["model_name"]) == "name"
    formatted = fn.PathTemplate("{creator}/{tags}/{model_name}").format(F.lit(None).cast("string"), F.lit("c"), F.lit("My Model"), F.array(), F.lit(7))
    assert value(spark, formatted) == "@unattributed/@untagged/my-model#7"


def test_public_ids_are_stable_and_spread(spark):
    rows = spark.range(200).select(fn.public_id(F.col("id")).alias("v")).collect()
    assert len({r.v for r in rows}) == 200 and all(len(r.v) == 12 and set(r.v) <= set(fn.PUBLIC_ALPHABET) for r in rows)


def test_trigrams(spark):
    assert value(spark, similarity.trigram_similarity(F.lit("rouge"), F.lit("rogue"))) == pytest.approx(0.2)
    assert value(spark, similarity.trigram_similarity(F.lit(""), F.lit("!"))) == 0.0
    assert value(spark, similarity.word_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 7)


def test_edit_distance(spark):
    assert value(spark, similarity.nearest_word("rouge", F.lit("The Rogue one"))) == 2
    assert value(spark, similarity.nearest_word("rouge", F.lit("mouse"))) is None


def test_cosine(spark):
    assert value(spark, similarity.cosine(F.lit("model_supported.stl"), F.lit("model_supported.stl"))) == pytest.approx(1)
    assert value(spark, similarity.cosine(F.lit("abc"), F.lit("xyz"))) == 0
    assert value(spark, similarity.cosine(F.lit(""), F.lit("x"))) == 0
