"""Runs of words against the definition, word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import periodic
from shelfmark.llm.queries import QUERIES


def brute(words, least=24, periods=3):
    runs = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, periods * q) and not any(all(words[k] == words[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                runs.append((i, n, q))
            i = max(j, i) + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def made(rng):
    n = rng.choice([0, 5, 23, 24, 30, 80, 200, 300])
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 30:
            a, p = rng.randrange(n), rng.randrange(1, 20)
            for i in range(a + p, min(n, a + p * rng.randrange(2, 9))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("long", "least", "periods"), [(4096, 24, 3), (10, 24, 3), (10, 8, 3), (10, 40, 4), (10, 10, 2), (4096, 10, 2)])
def test_runs_equal_the_definition(monkeypatch, long, least, periods):
    monkeypatch.setattr(periodic, "LONG", long)
    monkeypatch.setattr(periodic, "PACK", 700)
    rng = random.Random(long + least)
    texts = [made(rng) for _ in range(200)]
    texts += [[1] * 24, [1, 2] * 12, [1] * 23, texts[3], texts[3], [1, 2, 3] * 20 + [1, 2] * 20]
    found = periodic.find_runs([np.array(t, np.int64) for t in texts], least, periods)
    assert found == [brute(t, least, periods) for t in texts] and sum(map(len, found)) > 20


def report(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if key is not None and n and zlib.crc32(str(key).encode()) % 10 == 0:
        g = zlib.crc32(str(key).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *named, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert got == {i: report(i, t) for i, t in rows} and sum(r[0] > 0 for r in got.values()) > 5


def test_nulls_long_texts_repeats_and_clashing_names(spark):
    long = " ".join(f"w{k % 700}" for k in range(9000)) + " " + " ".join(f"u{k}" for k in range(2000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 20), (4, "A a " * 20), (4, "A a " * 20), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS runs", "2 AS start")
    out = periodic.run_report(docs, plant=True).collect()
    assert len(out) == 7
    got = {(r[0], t): tuple(r)[1:] for r, (_, t) in zip(sorted(out, key=lambda r: (r[0] is None, r[0] or 0)), [*rows[:3], *rows[4:], rows[3]])}
    for key, text in rows[:-1]:
        assert got[key, text] == report(key, text)
    runs = {r.doc_id: r for r in periodic.collapse(docs).collect()}
    assert [tuple(x) for x in runs[5].runs] == [(0, 9000, 700)] and len(runs[5].text.split()) == 2700
    assert runs[1].text is None and runs[3].text == " \t\n" and runs[4].text == "A a"
    assert periodic.run_report(docs.limit(0)).collect() == [] and periodic.collapse(docs.limit(0)).collect() == []
