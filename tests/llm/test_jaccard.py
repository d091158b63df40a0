"""Trie joins of shingle sets against comparisons of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import jaccard, shingling
from shelfmark.llm.queries import QUERIES
from tests.llm.test_simhash import roots


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows):
    """(size, component) of each row (id, text) of unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = roots(sorted(sets), linked)
    return {i: (len(s), top[i]) for i, s in sets.items()}


@pytest.mark.parametrize("text", ["", None, "One", "a b c d", "a b c d e", "A b\tC d\x0bE f\r\n", "x " * 40, "é à \x85 ü b c", "a b c d e f " * 30])
def test_sets_are_as_large_as_said(text):
    batch = pa.RecordBatch.from_arrays([pa.array(["zz", text, "q r s t u v"], pa.string())], names=["t"])
    ((_, _, data, ends),) = shingling.slices(batch, "t")
    sets = shingling.shingle_sets(data, ends, 5)
    assert [len(s) for s in sets] == [1, len(shingles(text)), 2]
    counted = shingling.shingle_sets(data, ends, 5, True)[1]
    assert len(counted) == max(0, len((text or "").encode().split()) - 4) or len(counted) == len(sets[1])
    assert (np.diff(counted.astype(object)) > 0).all()


def test_hashes_know_words_order_and_case():
    one = lambda *texts: [s.tolist() for x in shingling.slices(pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), "t") for s in shingling.shingle_sets(x[2], x[3], 5)]
    a, b, c, d, e = one("a b c d e", " A  b\nc d E ", "b a c d e", "ab c d e", "a b c de")
    assert a == b and len({tuple(x) for x in (a, c, d, e)}) == 4


def families(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 150))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 9)):
            texts.append(list(base))
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(base))
                base = [*base[:at], *(word() for _ in range(rng.randrange(0, 5))), *base[at + rng.randrange(0, 5) :]]
    for n in range(0, 12):
        base = [word() for _ in range(n)]
        texts += [base, base[:-1], [*base, word()], base]
    rng.shuffle(texts)
    return [(k * 3, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("cell", [jaccard.CELL, 3000])
def test_families_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "BLOCK", 2000)  # many blocks, ranges and parts, and groups that are too much for a cell
    monkeypatch.setattr(jaccard, "RANGE", 5000)
    monkeypatch.setattr(jaccard, "PART", 20)
    rows = families(random.Random(cell))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.similar_groups(docs, cell=cell).collect()}
    assert got == expected(rows)


def test_pages_stay_small_with_a_range_for_every_few_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    monkeypatch.setattr(jaccard, "RANGE", 16)
    pages, staged = [], jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: pages.extend([out := staged(df, name)] * (name == "pages")) or (out if name == "pages" else staged(df, name)))
    rows = families(random.Random(9))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = expected(rows)
    assert {r.doc_id: (r.n_shingles, r.component) for r in jaccard.similar_groups(docs).collect()} == want
    # Each shingle has 4 bytes, and 7 at most tell whose it is, though nearly each is the only one of its set in a range; once they were 12.
    dealt = pages[0].where("range >= 0").selectExpr("sum(octet_length(alone))", "sum(octet_length(nodes) + octet_length(many))").first()
    assert dealt[0] > 4000 and dealt[1] <= 7 * dealt[0] / 4


def test_tags_are_packed_and_unpacked():
    node = np.array([0, 1, -1, 1 << 62, -(1 << 62) + 12345, (1 << 48) - 1], np.int64)
    assert jaccard._unpacked(jaccard._packed(jaccard._tag(node))).tolist() == [n % (1 << 48) for n in node.tolist()]
    assert len(jaccard._unpacked(b"")) == 0


def test_a_large_family_that_differs_from_its_smallest(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(120):  # each next to the last, the ends far apart
        base = [*base[: k % 200], f"n{k}", *base[k % 200 + 1 :]]
        texts.append((rng.randrange(10**6), " ".join(base)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.component for r in jaccard.similar_groups(docs, cell=2000).collect()} == {min(i for i, _ in texts)}


def test_nulls_repeats_and_clashing_names(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (7, " \n"), (None, text), (6, "one two"), (4, "ONE\ttwo"), (2, "one two three"), (1, text), (1, "something else of five words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS id", "2 AS component", "3 AS n")
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in jaccard.similar_groups(docs).collect()), key=str)
    assert got == sorted([(5, 5, 1), (3, 5, 1), (1, 5, 1), (1, 2, 1), (9, 0, 9), (8, 0, 8), (7, 0, 7), (None, 5, None), (6, 1, 4), (4, 1, 4), (2, 1, 2)], key=str)
    assert jaccard.similar_groups(docs.limit(0)).collect() == []


def test_tries_link_what_is_similar():
    rng = random.Random(7)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 20)))) for _ in range(25)]
        sets += [np.array(sorted({*s.tolist(), rng.randrange(30)})) for s in sets[:8]]
        size = np.array([len(s) + rng.randrange(2) for s in sets])
        alike = lambda i, j: 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (size[i] + size[j])
        found = jaccard.trie_links(sets, size, np.arange(len(sets)), 80)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(i, j)]
        assert all(alike(i, j) for i, j in found) and roots(range(len(sets)), found) == roots(range(len(sets)), pairs)


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_ngram_jaccard"](spark, sf).collect()}
    assert got == expected(rows)
