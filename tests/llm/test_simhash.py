import random
import re

import numpy as np
import pytest
import xxhash

from shelfmark.llm import simhash
from shelfmark.llm.components import components


def brute_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "One", "two Words", "a b c", "Ä ä\x0bB\tc\x85d e", "x " * 3000, "one two three " * 4])
def test_fingerprints(text):
    assert simhash.majority(simhash.shingle_hashes((text or "").encode(), 3)) == brute_fingerprint(text)


@pytest.mark.parametrize("group", [3, simhash.GROUP])
def test_links_equal_brute_force_on_planted_fingerprints(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # the driver cuts groups
    rng = random.Random(group)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 5)):
            fps.add(f)
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    rows = [(k, f - (1 << 64) if f >> 63 else f, 0, 0) for k, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "rep long, fp long, fp2 long, band long")
    want = roots(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    for parts in (0, 1, 4):
        found = {r.node: r.root for r in components(simhash.links(df, 2, parts, False)).collect()}
        assert {k: found.get(k, k) for k in want} == want


def test_near_duplicates_with_nulls_ties_and_repeats(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away " * 8
    rows = [(9, base), (4, base.upper()), (7, base + "home"), (2, None), (5, ""), (3, " \n"), (8, "other text"), (8, "other text"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component")
    out = {(r.doc_id, r.component) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    want = roots(prints, [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert out == {*want.items(), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def edited(words, rng, share):
    return [rng.choice(["alpha", "beta", "gamma"]) + str(rng.random()) if rng.random() < share else w for w in words]


def test_keep_first_takes_near_copies_and_leaves_others(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    bases = [[word() for _ in range(rng.randrange(80, 400))] for _ in range(60)]
    rows = [(k, " ".join(b)) for k, b in enumerate(bases)]
    rows += [(1000 + k, " ".join(edited(b, rng, 0.01))) for k, b in enumerate(bases)]
    rows += [(2000, "a b"), (2001, "a b"), (2002, "a c"), (2002, "a c"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_first(docs, words=5, bits=128, radius=26, parts=0, length_ratio=1.25, few=8).collect()]
    assert len(kept) == len(set(kept))
    assert set(range(60)) | {2000, 2002, None} <= set(kept)
    assert sum(k is not None and 1000 <= k < 2000 for k in kept) <= 1 and 2001 not in kept


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(600, 700)] + [(1, 1), (None, 3), (7, 6), (6, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 100 for k in range(101, 141)} | {k: 500 for k in range(600, 700)} | {7: 6}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("tile", [20, 2_000_000])
def test_forest_connects_what_links_connect(monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 60, (300, 2), np.uint64) & np.uint64(0xF3)
    near = lambda a, b: int(np.bitwise_count(fp[a] ^ fp[b]).sum()) <= 2
    u, v = simhash._forest(fp, np.arange(200), np.arange(100, 300), 2)
    assert all(near(a, b) for a, b in zip(u, v)) and len(u) < 300
    assert roots(range(300), zip(u.tolist(), v.tolist())) == roots(range(300), [(a, b) for a in range(200) for b in range(100, 300) if near(a, b)])


def test_a_family_of_near_copies_is_one(spark):
    import corpus_pipeline

    rng = random.Random(8)
    base = [f"w{rng.random()}" for _ in range(150)]
    texts = [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(0, 150, 1)] + [[f"y{k}", *base[:4]] for k in range(50)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()}
    assert {found[k] for k in range(150)} == {0} and all(found[k] == k for k in range(150, 200))


def test_pipeline_links_are_verified_and_short_texts_compared(spark):
    import collections

    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    texts = []
    for k in range(40):
        base = [word() for _ in range(rng.randrange(120, 300))]
        texts += [base, base[: int(len(base) * 0.82)] + [word() for _ in range(int(len(base) * 0.18))], base[:-3] + [word()]]
    for n in (5, 8, 9, 10, 11, 12, 14, 19, 22):
        base = [word() for _ in range(n)]
        texts += [base, base[:-1], base[1:], [*base, word()], [*base[: n // 2], word(), *base[n // 2 :]]]
    line = [word() for _ in range(6)]
    texts += [line * 30 + [word() for _ in range(100)] for _ in range(3)]
    sets = [collections.Counter(simhash.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in texts]
    alike = lambda a, b: (a & b).total() / (a | b).total() >= 0.8
    want = roots(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()} == want


def chains(rng, families):
    """Families of texts of which neighbours are at 0.8 or more and ends are not, with texts at 0.7 to 0.79 to several members between them."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(2, 5)):
            texts.append(list(base))
            n = len(base)
            for share in (0.10, 0.13, 0.16):  # a passage of another wording, or two
                at, size = rng.randrange(n), int(n * share)
                texts.append([*base[:at], *(word() for _ in range(size)), *base[at + size :]])
            at, size = rng.randrange(n), max(1, int(n * 0.09))
            base = [*base[:at], *(word() for _ in range(size)), *base[at + size :]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("group", [40, simhash.GROUP])
def test_links_next_to_false_proposals_hold(spark, monkeypatch, group):
    import collections

    import corpus_pipeline

    monkeypatch.setattr(simhash, "GROUP", group)
    texts = chains(random.Random(3), 40)
    sets = [collections.Counter(simhash.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in texts]
    alike = lambda a, b: (a & b).total() / (a | b).total() >= 0.8
    want = roots(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()} == want


def test_unequal_texts_of_one_id_stay(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, one, "s"), (1, two, "s"), (1, one, "s"), (2, one, "t"), (3, two, "t"), (None, one, "u"), (4, None, "v"), (5, "", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    kept = sorted(map(tuple, simhash.keep_first(docs, **corpus_pipeline.NEAR).collect()), key=str)
    assert kept == sorted([(1, one, "s"), (1, two, "s"), (None, one, "u"), (4, None, "v")], key=str)
    assert simhash.keep_first(docs.limit(0), **corpus_pipeline.NEAR).count() == 0
