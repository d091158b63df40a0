import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import decontam


def words(t):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if w]


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        s = shingles(words(t))
        for i, u in items:
            c = shingles(words(u))
            if not c or not s:
                continue
            m, ci = len(c), collections.Counter(c)
            for a in range(max(1, len(s) - m + 1)):
                w = collections.Counter(s[a : a + m])
                o = sum((w & ci).values())
                j = o / (sum(w.values()) + m - o)
                if j >= least and j > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (j, a)
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randrange(14, 60)))) for k in range(25)] + [(100, "only four words here"), (101, None), (102, "")]
    items.append((103, items[0][1]))
    docs = []
    for k in range(80):
        body = text(rng.randrange(0, 200))
        if k % 2:
            own = items[rng.randrange(25)][1].split()
            if k % 4 == 1:
                own[rng.choice((0, len(own) - 1))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((k, rng.choice((" ", ", ", "\n")).join(body).title() if k % 3 else " ".join(body)))
    docs += [(200, None), (201, ""), (202, items[3][1]), (202, items[4][1]), (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("broadcast", [0, decontam.BROADCAST_ROWS])
def test_leaks_equal_brute_force(spark, planted, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    docs, items = planted
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontam.find(d, i).collect()}
    want = {k: round(j, 9) for k, (j, _) in brute(docs, items).items()}
    assert {k: round(r.similarity, 9) for k, r in found.items()} == want and len(want) > 30
    texts, others = {k: [shingles(words(t)) for j, t in docs if j == k] for k, _ in docs}, dict(items)
    for (k, j), r in found.items():  # the window that is named has the similarity that is named
        c, n = collections.Counter(shingles(words(others[j]))), r.words - 4
        windows = [collections.Counter(s[r.start : r.start + n]) for s in texts[k]]
        assert r.similarity in [pytest.approx(sum((w & c).values()) / sum((w | c).values())) for w in windows]


def test_clean_keeps_the_rest_and_its_columns(spark, planted):
    docs, items = planted
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS start")
    i = spark.createDataFrame(items, "item_id long, text string")
    kept = decontam.clean(d, i)
    assert kept.columns == d.columns
    leaked = {k for k, _ in brute(docs, items)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in leaked)


def test_empty_tables(spark, planted):
    docs, items = planted
    d, i = spark.createDataFrame(docs[:3], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find(d.limit(0), i).collect() == [] == decontam.find(d, i.limit(0)).collect()
    assert decontam.clean(d, i.limit(0)).count() == 3


def test_an_item_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE", 30)
    items = [(1, " ".join(f"w{k}" for k in range(100))), (2, " ".join(f"v{k}" for k in range(31)))]  # pieces of 25, of 15 and 16 words
    docs = [(1, "before " + " ".join(f"w{k}" for k in range(25, 50)) + " after"), (2, "nothing of it " * 20), (3, "only the tail v26 v27 v28 v29 v30 of an item"), (4, " ".join(f"v{k}" for k in range(31)))]
    found = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (4, 2)}


def test_inserted_and_deleted_words_and_a_long_text(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(rng.randrange(50, 100)))) for k in range(60)]
    docs = []
    for k, t in items:
        own = t.split()
        at, n = rng.randrange(0, 12), rng.randrange(1, 6)
        docs.append((2 * k, " ".join(text(rng.randrange(40)) + own[:at] + text(n) + own[at:] + text(20))))
        docs.append((2 * k + 1, " ".join(text(rng.randrange(40)) + own[:at] + own[at + n :] + text(20))))
    docs.append((1000, " ".join(text(30_000) + items[5][1].split() + text(30_000))))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.find(d, i).collect()}
    assert got.pop((1000, 5)) == 1.0
    want = {k: round(j, 9) for k, (j, _) in brute(docs[:-1], items).items()}
    assert got == want and len(want) > 60


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for k, n in enumerate(n for n in (0, 1, decontam.RADIUS, decontam.RADIUS) for _ in range(50)):
        x, y = rng.getrandbits(192), sum(1 << b for b in rng.sample(range(192), n))
        rows.append((k, *(signed(v >> lo & (1 << 64) - 1) for v in (x, x ^ y) for lo in (0, 64, 128))))
    df = spark.createDataFrame(rows, "k long, a0 long, a1 long, a2 long, b0 long, b1 long, b2 long")
    listed = lambda c, off, k="k": decontam.blocks(df.selectExpr(f"{k} AS k", *[f"{c}{j} AS fp{j}" for j in range(3)]), off)
    a = listed("a", decontam.WINDOW_OFF)
    assert a.join(listed("b", decontam.ITEM_OFF), ["k", "block", "value"]).select("k").distinct().count() == len(rows)
    other = listed("b", decontam.ITEM_OFF, "k + 1")  # of unrelated ones nearly nine tenths are not looked at
    assert a.join(other, ["k", "block", "value"]).select("k").distinct().count() < 0.18 * len(rows)


def test_fingerprints_are_majorities_of_shingles(spark):
    rng = random.Random(4)
    h = [rng.getrandbits(64) - (1 << 63) for _ in range(301)]
    df = spark.createDataFrame([(x,) for x in h], "h long").select("h", *[F.xxhash64("h", F.lit(k)) for k in (1, 2)])
    own = list(zip(*df.collect()))
    sums = df.agg(*[F.sum(x).alias(f"d{k}") for k, x in enumerate(decontam.lanes("h"))])
    got = sums.select(*decontam.majorities(sums.columns, "301")).first()
    assert len(got) == 3
    for part, fp in zip(own, got):
        assert fp % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > 301)


def test_names_that_clash(spark, planted):
    docs, items = planted
    names = ["_id", "_leak", "_row", "id", "row", "s", "w", "doc", "h", "item", "pos", "size", "own", "fp"]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)])
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)])
    leaked = {k for k, _ in brute(docs, items)}
    kept = decontam.clean(d, i)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in leaked)
    assert {r.doc_id for r in decontam.find(d, i).collect()} == leaked


def test_plan_runs_no_python(spark, planted):
    docs, items = planted
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontam.find(d, i)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_swapped_moved_and_repeated_parts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7)))
    text = lambda n: [word() for _ in range(n)]
    items, docs = [], []
    for k in range(30):
        own = text(rng.randrange(60, 90))
        if k % 5 == 4:  # an item that repeats a passage
            own[40:55] = own[:15]
        items.append((k, " ".join(own)))
        cut = rng.randrange(20, 40)
        swapped = own[cut:] + own[:cut]
        moved = own[10:cut] + own[:10] + own[cut:]
        docs += [(10 * k, " ".join(text(70) + swapped + text(80))), (10 * k + 1, " ".join(moved + text(50))), (10 * k + 2, " ".join(text(30) + moved)), (10 * k + 3, " ".join(swapped[: len(own) - 5]))]
        docs.append((10 * k + 4, " ".join(text(9) + own[:15] * 3 + own + own[:30] + text(9))))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sum(k % 10 == 0 for k, _ in want) >= 25
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in decontam.find(d, i).collect()} == {k: (round(j, 9), a) for k, (j, a) in want.items()}
