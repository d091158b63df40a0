"""Phrases against plain counts."""

import collections
import random
import re

import numpy as np
import pytest

from shelfmark.llm import phrases


def brute(rows, least, covered, top):
    count, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                count.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    held = {k: c for k, c in count.items() if len(k[1]) > 1 and c >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in held.items():
        if any(w[0] == lang and len(w[1]) > len(p) and p in (w[1][:2], w[1][1:]) and 100 * c >= covered * a for w, c in held.items()):
            continue
        cuts = [(1_000_000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def texts(rng):
    words = ["The", "the", "new", "York", "york", "times", "über", "a-b", "x\x0by", " ", "\xa0", "$1"] + [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts += rng.choice([["New", "York", "Times"], ["new\tyork"], ["the", "new"], ["Über", "a-b"], rng.choices(words, k=3)]) + [rng.choice(["", ".", "\n", " ,", "!?"])]
        rows.append((rng.choice(["en", "de", None, "und"]), " ".join(parts)))
    return rows + [("en", None), ("fr", ""), (None, "...")]


@pytest.mark.parametrize(("most", "held"), [(phrases.MOST_WORDS, phrases.HELD), (6, 50), (0, 50)])
def test_phrases_equal_brute_force(spark, monkeypatch, most, held):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "RANGE", 40)
    monkeypatch.setattr(phrases, "HELD_WORDS", 30)
    rows = texts(random.Random(most))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).selectExpr("*", "'x' AS word", "1 AS h", "2 AS n", "3 AS a")
    got = {tuple(r) for r in phrases.mine(docs, least=5, covered=50, top=20, most_words=most).collect()}
    assert got == brute(rows, 5, 50, 20) and {r[0] for r in got} == {"en", "de", "und"}


def test_no_rows_and_no_phrases(spark):
    docs = spark.createDataFrame([("en", "one two"), ("en", None)], "lang string, text string")
    assert phrases.mine(docs).collect() == [] and phrases.mine(docs.limit(0)).collect() == []


def test_exact_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 3_037_000_500
    df = spark.createDataFrame([(big * 1000, big * 1000 + 7, big * 1000 + 1), (10, 10, 11)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases._score("a", "l", "r").alias("s")).collect()]
    want = [1_000_000 * a * a // (x * y) for a, x, y in df.collect()]
    assert got == want and df.select(F.max("a")).first()[0] ** 2 * 1_000_000 > 1 << 64


def test_radix_sort_and_runs():
    rng = np.random.default_rng(3)
    for high in (1, 50, 1 << 20, 1 << 63):
        keys = rng.integers(0, high, 5000, np.uint64)
        many = rng.integers(1, 9, 5000)
        got, also = phrases.radix_sorted(keys, np.arange(5000))
        assert (got == np.sort(keys)).all() and (keys[also] == got).all()
        found, total = phrases.counted(keys, many)
        want = collections.Counter()
        for k, m in zip(keys.tolist(), many.tolist()):
            want[k] += m
        assert dict(zip(found.tolist(), total.tolist())) == want
        assert dict(zip(*(x.tolist() for x in phrases.counted(keys)))) == collections.Counter(keys.tolist())
    assert [len(x) for x in phrases.counted(np.zeros(0, np.uint64))] == [0, 0]


def test_ranges_divide_also_the_keys_of_one_word():
    n = np.array([1000, 10, 10, 500, 10], np.int64)
    cuts = phrases._ranges(n, 8, 10)
    assert (np.diff(cuts.astype(object)) > 0).all() and {int(c) >> 8 & 255 for c in cuts if int(c) >> 16 == 1} == {1, 4}
