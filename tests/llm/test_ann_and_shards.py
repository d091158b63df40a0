import zlib

import numpy as np

from shelfmark.llm import ann, sharding
from shelfmark.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            out[q] = sorted((-float((y * x).sum()), i) for i, y in ok if i != q)[:k]
    return out


def test_recall_and_exact_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 20)
    got = {}
    for r in QUERIES["op6_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = {i: np.array(v, float) for i, v in rows}
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - x[v] @ x[q]) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_copies_nulls_ties_and_few_candidates(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [(k, v) for k in range(0, 60)] + [(100, [0.5, 0.5, 0.0, 0.0]), (101, None), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan"), 1.0, 0.0, 0.0]), (105, [float("inf"), 1.0, 0.0, 0.0]), (106, [1.0]), (None, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100}
    assert [i for _, i, _ in sorted(got[20])] == [k for k in range(21) if k != 20]
    assert [i for _, i, _ in sorted(got[100])] == list(range(20))
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0, k=20)
    assert sorted((r.rank, r.vec_id) for r in few.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.search(df.where("vec_id = 102"), F.col("vec_id") % 2 == 0).collect() == []


def test_larger_norms_win(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)) * rng.uniform(0.2, 3, (400, 1))
    rows = [(k, r.tolist()) for k, r in enumerate(x)]
    want = brute(rows, 10)
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) / (10 * len(want)) >= 0.9


def test_clustered_vectors_and_outliers_are_routed_and_found(spark, monkeypatch):
    monkeypatch.setattr(ann, "SMALL_SHARD", 100)  # the driver cuts shards
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    x = np.concatenate([centres[k % 20] + 0.15 * rng.normal(size=32) for k in range(3000)]).reshape(-1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::500] = rng.normal(size=(6, 32))  # far from all others: fewer than k codes within the radius
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    want, got = brute(rows, 20), {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) / (20 * len(want)) >= 0.95


def test_queries_go_once_to_a_group_of_shards_and_leave_their_best(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 50)  # 40 shards or more, in 4 groups
    x = np.random.default_rng(7).normal(size=(2000, 32))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    dealt, found, staged = [], [], ann.staged

    def counted(df, name):
        out = staged(df, name)
        dealt.extend([out.count()] * (name == "dealt"))
        return out

    monkeypatch.setattr(ann, "staged", counted)
    for block in (1 << 22, 30 * 32):
        monkeypatch.setattr(ann, "QUERY_BLOCK", block, raising=False)
        found.append({(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(vectors, F.col("vec_id") % 20 == 0, k=20).collect()})
        monkeypatch.setattr(ann, "FOUND", 100, raising=False)
    assert dealt[0] <= 2000 + 4 * 100 and found[0] == found[1]
    want = brute([(k, v.tolist()) for k, v in enumerate(x)], 20)
    pairs = {(q, i) for q, _, i, _ in found[0]}
    assert sum((q, i) in pairs for q, w in want.items() for _, i in w) >= 0.95 * 20 * len(want)


def test_the_best_of_several_shards_are_kept(monkeypatch):
    monkeypatch.setattr(ann, "FOUND", 10)
    rng, best, rows = np.random.default_rng(2), ann.Best(3), {}
    for _ in range(40):
        query, ids, score = rng.integers(0, 4, 6), rng.integers(0, 30, 6), rng.integers(0, 50, 6).astype(float)
        best.add(query, ids, score)
        for q, i, v in zip(query.tolist(), ids.tolist(), score.tolist()):
            rows[q, i] = max(v, rows.get((q, i), v))
    want = [(q, i, v) for q in range(4) for v, i in sorted(((-v, i) for (p, i), v in rows.items() if p == q))[:3] for v in [-v]]
    assert list(zip(*(c.tolist() for c in best.cut()))) == want and best.rows <= 30


def test_within_holds_every_code_of_the_radius():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 24))
    m = ann.fit(x, float(np.linalg.norm(x, axis=1).max()))
    shard = ann.Shard(m, x, [[k] for k in range(500)])
    for r in (0, 5, 17, 40):
        m.radius = r
        shard.probes = m.probes(16)
        for code in m.codes(x[:20], query=True):
            want = np.flatnonzero(np.bitwise_count(shard.codes ^ code).sum(axis=1) <= r)
            assert shard.within(code).tolist() == want.tolist()


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(3).integers(0, 2**63, 2000).astype(np.uint64)
    before = None
    for n in (1, 2, 7, 8, 9, 50):
        shard = sharding.jump(keys, n)
        assert shard.tolist() == [plain_jump(int(k), n) for k in keys]
        more = sharding.jump(keys, n + 1)
        assert ((more == shard) | (more == n)).all()
        before = shard
    assert np.bincount(before).min() > 10


def test_slots_sizes_and_checksums(spark):
    rows = [(k, f"text {k}") for k in range(300)] + [(5, "again"), (5, "again"), (None, "no id"), (None, None), (999, None), (998, "é" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS size")
    out = sharding.assign(docs, 8).collect()
    assert len(out) == len(rows)
    for s in {r.shard for r in out}:
        own = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)
    raw = lambda t: (t or "").encode()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len(raw(t)) + 1, zlib.crc32(raw(t))) for _, t in rows)
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    assert sharding.assign(docs.limit(0)).collect() == []
