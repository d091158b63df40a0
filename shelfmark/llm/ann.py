"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

The rotation (principal axes turned to fit their signs), the radius and the cells are learned from a bounded sample; every
vector is indexed. The index is cut into shards of bounded size, each a part of one cell, so that near codes lie
together. A shard keeps, for each substring of the codes, the positions listed by substring value; a query probes the
values within so many bits of its own that, by the pigeonhole principle, no code within the radius is missed, and codes
within the radius are reranked by their floats. A query looks only into shards that hold a value that it probes. Shards
lie in as many groups as there are partitions: a query goes once to each group that it has to see, a group's shards
stream past its queries, and only each query's best of all these shards are left, to be merged with other groups' at the
end. So queries sent and rows found grow with the queries, whatever the number of shards. A query with fewer than k codes
within the radius is then compared with all vectors.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

#: Vectors that the rotation and the radius are learned from, at most, about.
SAMPLE = 6_000
#: Vectors of a shard, about; more, if there would be more shards than MOST_SHARDS.
SHARD = 25_000
#: Bounds the table by which queries find shards: a bit for each substring value and shard, 512 bytes a shard, 32 MB in all.
MOST_SHARDS = 65_536
#: Cells of near vectors, at most.
CELLS = 256
#: Below that, shards of so many keep the partitions busy.
SMALL_SHARD = 2_000
#: Components of the queries that a group's shards stream past at once, about; with more queries, they do so several times.
QUERY_BLOCK = 1 << 22
#: Rows found, of all queries of a block, beyond which all but each query's best are left out.
FOUND = 1 << 18
#: Bits of a substring.
WIDTH = 8
#: Share of the sample's true neighbours that the radius has to hold.
TARGET = 0.99
MASKS = np.array(sorted(range(1 << WIDTH), key=lambda m: (m.bit_count(), m)))
WITHIN = np.cumsum([math.comb(WIDTH, k) for k in range(WIDTH + 1)])


@dataclass
class Rotation:
    """Codes of vectors; a last coordinate makes up for norms below the largest, so that near codes mean large products."""

    mean: np.ndarray
    axes: np.ndarray
    norm: float
    radius: int = 0
    cells: np.ndarray | None = None

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest cell of each vector."""
        return (x @ self.cells.T - (self.cells**2).sum(axis=1) / 2).argmax(axis=1)

    def probes(self, substrings: int) -> list[np.ndarray]:
        """The masks by which a query's value in each substring is changed: within the radius, one of the first `more`
        substrings differs in `bits` at most, or a later one in fewer."""
        bits, more = divmod(self.radius, substrings)
        return [MASKS[: WITHIN[min(bits if k <= more else bits - 1, WIDTH)]] if k <= more or bits else MASKS[:0] for k in range(substrings)]

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Substrings of each vector's code, as bytes."""
        size = np.linalg.norm(x, axis=1, keepdims=True)
        scale = size if query else self.norm
        more = np.zeros_like(size) if query else np.sqrt(np.maximum(self.norm**2 - size**2, 0))
        return np.packbits((np.hstack([x, more]) / scale - self.mean) @ self.axes > 0, axis=1)


def means(x: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """So many centres of x at most, by a few rounds of k-means."""
    centres = x[rng.permutation(len(x))[:many]]
    for _ in range(8):
        own = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(x: np.ndarray, norm: float, bits: int = 128, k: int = 20, seed: int = 5, cells: int = 1) -> Rotation:
    """Learn a rotation from vectors x, the smallest radius that holds TARGET of their own nearest neighbours, and cells."""
    rng = np.random.default_rng(seed)
    full = np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1, keepdims=True), 0))]) / norm
    mean = full.mean(axis=0)
    axes = np.linalg.svd(full - mean, full_matrices=True)[2].T if len(full) <= full.shape[1] else np.linalg.eigh((full - mean).T @ (full - mean))[1][:, ::-1]
    while axes.shape[1] < bits:
        axes = np.hstack([axes, axes[:, : x.shape[1]] @ np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]])
    axes = axes[:, :bits]
    z, turn = (full - mean) @ axes, np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(25):
        u, _, v = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (u @ v).T
    model = Rotation(mean, axes @ turn, norm)
    asked = rng.permutation(len(x))[:300]
    product = x[asked] @ x.T
    product[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-product, axis=1)[:, : min(k, len(x) - 1)]
    apart = np.bitwise_count(model.codes(x[asked], query=True)[:, None] ^ model.codes(x)[near]).sum(axis=2) if near.size else np.zeros(1)
    model.radius = int(np.quantile(apart, TARGET, method="higher"))
    model.cells = means(x, cells, rng)
    return model


class Shard:
    """Vectors of a shard with their substring tables."""

    def __init__(self, model: Rotation, x: np.ndarray, ids: list[list[int]]):
        self.model, self.x = model, x
        self.length = np.array([len(i) for i in ids])
        self.flat, self.at = np.concatenate(ids), np.cumsum(self.length) - self.length
        self.codes = model.codes(x)
        m = self.codes.shape[1]
        self.order = [np.argsort(self.codes[:, k], kind="stable") for k in range(m)]
        self.first = [np.searchsorted(self.codes[o, k], np.arange(257)) for k, o in enumerate(self.order)]
        self.probes = model.probes(m)

    def within(self, code: np.ndarray) -> np.ndarray:
        """Positions of all codes within the radius."""
        hit = np.zeros(len(self.x), bool)
        for order, first, masks, value in zip(self.order, self.first, self.probes, code):
            values = masks ^ value
            n = first[values + 1] - first[values]
            total = int(n.sum())
            hit[order[np.repeat(first[values] - (np.cumsum(n) - n), n) + np.arange(total)]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= self.model.radius]

    def search(self, query: np.ndarray, code: np.ndarray | None, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of the shard's codes within the radius, or of all its vectors if no code is given, best first."""
        found = np.arange(len(self.x)) if code is None else self.within(code)
        score = (self.x[found] * query).sum(axis=1)
        if len(found) > k + 1:  # ties of the last stay
            keep = score >= np.partition(score, -k - 1)[-k - 1]
            found, score = found[keep], score[keep]
        n = self.length[found]
        ids = self.flat[np.repeat(self.at[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        score = np.repeat(score, n)
        ids, score = ids[ids != own], score[ids != own]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


class Best:
    """The k best ids of each of so many queries, of all that are added."""

    def __init__(self, k: int):
        self.k, self.held, self.rows, self.most = k, [], 0, FOUND

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        self.rows += len(query)
        if self.rows > self.most:
            self.held = [self.cut()]
            self.rows = len(self.held[0][0])
            self.most = max(FOUND, 2 * self.rows)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries' positions, ids, scores), best first; an id counts once, with its best score."""
        query, ids, score = (np.concatenate(c) for c in zip(*self.held)) if self.held else (np.zeros(0, t) for t in (np.int64, np.int64, float))
        order = np.lexsort((-score, ids, query))
        query, ids, score = query[order], ids[order], score[order]
        once = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(query)]
        query, ids, score = query[once], ids[once], score[once]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < self.k], ids[rank < self.k], score[rank < self.k]


def valid(vector: str) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", bits: int = 128) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row that the condition queries picks.

    Nearness is the inner product in double precision; ties go to the smaller id; a query's own id is left out, equal
    vectors under other ids are not. Null, zero and non-finite vectors, null ids, and vectors of another length than the
    commonest take no part. A query with fewer than k candidates has them all. Rows that repeat an id with the same
    vector count once. No vectors give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(valid(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    lengths = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    rows = rows.where(F.size("x") == lengths.n)
    rows = staged(rows, "rows")
    # Equal vectors are one index entry, with as many ids as a result can use.
    numbered = rows.select("id", "x").distinct().withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("n") <= k + 1)
    index = numbered.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    norm = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("norm")).first().norm
    share = min(1.0, SAMPLE / lengths.rows)
    sample = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < share * (1 << 20)).select("x").distinct().collect()
    sample = sample or rows.select("x").limit(100).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(min(SHARD, max(lengths.rows // parts, SMALL_SHARD)), -(-lengths.rows // MOST_SHARDS))
    model = spark.sparkContext.broadcast(fit(np.array([r.x for r in sorted(sample)]), norm, bits, k, cells=int(min(CELLS, -(-lengths.rows // size)))))

    def place(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            codes = model.value.codes(x)
            yield pa.RecordBatch.from_arrays([pa.array(model.value.cell(x)), *batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", *batch.schema.names, "code"])

    index = staged(index.mapInArrow(place, "cell long, x array<double>, ids array<long>, code binary"), "index")
    # A cell of many vectors is cut by hash, so that no shard is large.
    counts = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}
    cuts, shards = {}, 0
    for cell, many in counts.items():
        cuts[cell] = (shards, -(-many // size))
        shards += cuts[cell][1]
    table = spark.createDataFrame([(c, *v) for c, v in cuts.items()], "cell long, first long, many long")
    index = index.join(F.broadcast(table), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("x"), F.col("many"))).cast("int")).select("shard", "x", "ids", "code")

    def values(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            m = codes.shape[1]
            keys = np.unique((batch["shard"].to_numpy().astype(np.int64)[:, None] * m + np.arange(m)) * 256 + codes)
            yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    substrings = bits // WIDTH
    keys = index.select("shard", "code").mapInArrow(values, "key long").distinct()
    held = np.zeros((substrings, 256, -(-shards // 8)), np.uint8)  # bit s of held[m, v]: shard s has value v in substring m
    for r in keys.groupBy(F.shiftright("key", 8).alias("at")).agg(F.collect_set(F.col("key").bitwiseAND(255)).alias("v")).toLocalIterator():
        held[r["at"] % substrings, r["v"], r["at"] // substrings // 8] |= 1 << (r["at"] // substrings % 8)
    reach = np.zeros_like(held)
    fitted = model.value
    for m, masks in enumerate(fitted.probes(substrings)):
        for mask in masks:
            reach[m] |= held[m, np.arange(256) ^ mask]
    # A group is a run of shards, so that parts of a cell lie together, with about as many vectors as others.
    sizes = np.concatenate([np.full(n, many / n) for _, n, many in sorted((first, n, counts[c]) for c, (first, n) in cuts.items())])
    groups = min(parts, shards)
    group_of = np.minimum((np.cumsum(sizes) - sizes / 2) * groups // sizes.sum(), groups - 1).astype(np.int64)
    routes = spark.sparkContext.broadcast((reach, group_of))
    block_rows = max(1, QUERY_BLOCK // lengths.n)

    def reached(codes: np.ndarray) -> np.ndarray:
        """For each code, the shards that it has to see, as packed bits."""
        return np.bitwise_or.reduce([routes.value[0][m, codes[:, m]] for m in range(codes.shape[1])], axis=0)

    def route(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            codes = model.value.codes(x, query=True)
            for at in range(batch.num_rows):
                shard = np.flatnonzero(np.unpackbits(reached(codes[at : at + 1])[0], bitorder="little"))
                to = np.unique(routes.value[1][shard])
                row = batch.slice(at, 1).take(pa.array(np.zeros(len(to), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(to), row["id"], row["x"]], names=["group", "id", "x"])

    def probe(everything: bool):
        def run(batches):
            task = shard = codes = bits = best = None
            asked, held = [], []

            def look():
                """Search the shard that is held for the queries that have to see it."""
                nonlocal asked, codes, bits, best, held
                if held and asked:
                    if best is None:
                        asked = [tuple(np.concatenate(c) for c in zip(*asked))]
                        best = Best(k)
                        if not everything:
                            codes = model.value.codes(asked[0][1], query=True)
                            bits = reached(codes)
                    own, x = asked[0]
                    to = np.arange(len(own)) if everything else np.flatnonzero(bits[:, shard // 8] >> (shard % 8) & 1)
                    if len(to):
                        index = Shard(model.value, np.concatenate([h[0] for h in held]), [i for h in held for i in h[1]])
                        for q in to.tolist():
                            ids, score = index.search(x[q], None if everything else codes[q], own[q], k)
                            best.add(np.full(len(ids), q), ids, score)
                held = []

            def result():
                query, ids, score = best.cut()
                return pa.RecordBatch.from_arrays([pa.array(asked[0][0][query]), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])

            for batch in batches:
                at, tasks = batch["shard"].to_numpy(), batch["task"].to_numpy()
                flat = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
                cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(tasks) != 0)) + 1
                for lo, hi in itertools.pairwise([0, *cuts, len(at)]):
                    if hi == lo:
                        continue
                    if (tasks[lo], at[lo]) != (task, shard):
                        look()
                    if tasks[lo] != task:
                        if best is not None:
                            yield result()
                        asked, best = [], None
                    task, shard = tasks[lo], at[lo]
                    if shard < 0:
                        asked.append((batch["id"].to_numpy()[lo:hi], flat[lo:hi]))
                    else:
                        held.append((flat[lo:hi], batch["ids"].slice(lo, hi - lo).to_pylist()))
            look()
            if best is not None:
                yield result()

        return run

    none = F.array().cast("array<long>")
    shelves = spark.createDataFrame([(s, int(g)) for s, g in enumerate(group_of)], "shard int, group long")
    stored = index.join(F.broadcast(shelves), "shard").select("group", "shard", F.lit(0).cast("long").alias("id"), "x", "ids")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def best(sent: DataFrame, rows: int, everything: bool) -> DataFrame:
        """The best of the queries sent, so many rows, to groups: each block of them sees all shards of its groups."""
        blocks = -(-rows // block_rows)
        task = lambda block: (block * groups + F.col("group")).alias("task")
        mine = sent.select(task(F.pmod(F.xxhash64("id"), F.lit(blocks))), F.lit(-1).alias("shard"), "id", "x", none.alias("ids"))
        every = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(task(F.col("block")), "shard", "id", "x", "ids")
        both = staged(mine.union(every), "dealt")
        local = both.repartitionByRange(blocks * parts, "task").sortWithinPartitions("task", "shard").mapInArrow(probe(everything), "query_id long, id long, score double")
        top = local.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return staged(top.select("query_id", "rank", F.col("id").alias(id_col), "score"), "best")

    asked = staged(rows.where("asks").select("id", "x").distinct(), "asked")
    first = best(asked.mapInArrow(route, "group long, id long, x array<double>"), max(1, asked.count()), False)
    enough = min(k, numbered.select("id").distinct().limit(k + 1).count() - 1)
    full = first.where(F.col("rank") == enough).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti") if enough > 0 else asked.limit(0)
    few = short.count()
    if few == 0:
        return first
    all_groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
    second = best(short.select("id", "x", all_groups).select("group", "id", "x"), few, True)
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(second)
