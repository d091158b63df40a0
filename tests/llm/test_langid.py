import numpy as np
import pytest

from shelfmark.llm import langid
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def model(texts):
    lang, code = [], []
    for k, t in texts:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            lang.append(k)
            code.append(b[i - 3] << 24 | b[i - 2] << 16 | b[i - 1] << 8 | b[i])
    both, n = np.unique(np.stack([lang, code]), axis=1, return_counts=True)
    return langid.PpmModel(["a", "b"], both[0], both[1], n)


def probability(counts, known, context, byte):
    """Plain recursion: share of the context, or escape to the shorter one without the seen bytes."""
    if context not in known:
        return probability(counts, known, context[1:], byte)
    seen = counts.get(context, {})
    shorter = (lambda b: probability(counts, known, context[1:], b)) if context else (lambda b: 1 / 256)
    if not seen:
        return shorter(byte)
    n, q = sum(seen.values()), len(seen)
    if byte in seen:
        return seen[byte] / (n + q)
    return q / (n + q) * shorter(byte) / (1 - sum(shorter(b) for b in seen))


def test_code_lengths_equal_the_recursive_definition():
    texts = [(0, "the cat and the hat that the cat had"), (1, "der hund und die katze und der hut")]
    m = model(texts)
    counts = [{}, {}]
    total = {}
    for k, t in texts:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            for n in range(4):
                c = b[i - n : i]
                counts[k].setdefault(c, {}).setdefault(b[i], 0)
                counts[k][c][b[i]] += 1
                total[c] = total.get(c, 0) + 1
    known = {*total}
    probes = ["the hut", "", "zebra", "und that"]
    data = np.frombuffer("".join(probes).encode(), np.uint8)
    ends = np.cumsum([0, *(len(p) for p in probes)])
    bits = m.code_lengths(data, ends)
    for i, p in enumerate(probes):
        b = b"\0\0\0" + p.encode()
        for k in (0, 1):
            want = -sum(np.log2(probability(counts[k], known, b[j - 3 : j], b[j])) for j in range(3, len(b)))
            assert bits[i, k] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_probabilities_sum_to_one():
    tables = model([(0, "abracadabra" * 5 + "".join(map(chr, range(1, 128)))), (1, "simsalabim" * 4)]).tables()
    for node in range(len(tables.parent)):
        bits = tables.look_up(np.full(256, node), np.arange(256))
        assert np.allclose((2.0 ** -bits.astype(float)).sum(axis=0), 1, atol=1e-4)


def test_a_language_of_one_very_long_text_is_learned(spark):
    rows = [(k, "the cat and the hat on the mat", "en") for k in range(50)] + [(1000, "der hund und die katze " * 5000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs, max_bytes=200)
    assert m.langs == ["de", "en"] and set(m.lang.tolist()) == {0, 1}
    asked = spark.createDataFrame([(1, "die katze und der hund"), (2, "the hat"), (3, "der hund " * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, m).collect()} == {1: "de", 2: "en", 3: "de"}


def test_windows_do_not_change_lengths(monkeypatch):
    m = model([(0, "the cat and the hat"), (1, "der hund und die katze")])
    data = np.frombuffer(b"the hund and a katze in the hat", np.uint8)
    ends = np.array([0, 4, 4, 20, len(data)])
    whole = m.code_lengths(data, ends)
    monkeypatch.setattr(langid, "WINDOW", 5)
    assert np.allclose(whole, m.code_lengths(data, ends))


def test_nulls_empty_tables_and_clashing_names(spark):
    rows = [(1, "en", "the cat and the hat"), (2, "de", "der hund und die katze"), (3, None, "the hat"), (4, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "'x' AS score", "'y' AS lang_pred")
    m = langid.train(docs)
    out = {r.doc_id: r for r in langid.predict(docs.union(docs.selectExpr("5L", "'en'", "'1234 !!'", "''", "''")), m).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["en", "de", "en"]
    assert (out[4].lang_pred, out[5].lang_pred, out[5].score) == ("und", "und", 0.0)
    assert all(0 <= r.score <= 1 for r in out.values())
    empty = docs.limit(0)
    assert langid.predict(empty, m).collect() == []
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out and docs[r.doc_id]]
    assert held and sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.99


def test_sample_and_prediction_equal_brute_force(spark):
    import collections
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    words = {"a": "the cat and hat that had on mat".split(), "b": "der hund und die katze der hut".split(), "c": "le chat et la souris du toit".split()}
    rows = [(k, lang, " ".join(rng.choices(words[lang], k=rng.randrange(1, 9)))) for k, lang in enumerate(rng.choices("abc", [6, 3, 1], k=90))]
    rows += [(100, "a", None), (101, None, "the hat"), (102, "c", ""), (3, "a", "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    m = langid.train(docs, max_bytes=400)
    place = {(r.doc_id, r.text): r.p for r in docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("p")).collect()}
    want, counts, known = collections.Counter(), {}, set()
    for lang in "abc":
        own = [(place[i, t], t) for i, k, t in rows if k == lang and t]
        share = min(1.0, 400 / sum(len(t) for _, t in own))
        sample = [t for p, t in own if p < max(int(share * (1 << 40)), min(own)[0] + 1)]
        assert 0 < len(sample) <= len(own) and (share == 1) == (len(sample) == len(own))
        counts[lang] = {}
        for t in sample:
            b = b"\0\0\0" + t.encode()
            for i in range(3, len(b)):
                want[lang, int.from_bytes(b[i - 3 : i + 1], "big")] += 1
                for n in range(4):
                    c = b[i - n : i]
                    known.add(c)
                    at = counts[lang].setdefault(c, {})
                    at[b[i]] = at.get(b[i], 0) + 1
    assert m.langs == ["a", "b", "c"]
    assert {(m.langs[k], c): n for k, c, n in zip(m.lang.tolist(), m.code.tolist(), m.count.tolist())} == want
    asked = [(k, " ".join(rng.choices(sum(words.values(), []), k=rng.randrange(1, 4)))) for k in range(25)] + [(99, "12 !")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), m).collect()}
    assert got.pop(99) == ("und", 0.0)
    for k, t in asked[:-1]:
        b = b"\0\0\0" + t.encode()
        bits = [-sum(np.log2(probability(counts[x], known, b[j - 3 : j], b[j])) for j in range(3, len(b))) for x in "abc"]
        odds = [2.0 ** (min(bits) - x) for x in bits]
        assert got[k][1] == pytest.approx(max(odds) / sum(odds), rel=1e-3)
        assert got[k][0] == "abc"[int(np.argmin(bits))] or sorted(bits)[1] - min(bits) < 1e-3
