"""N-gram Jaccard join by tries of globally ordered shingle sets.

Equal sets are one set first. Then sets go that cannot be similar to another, as too few of their shingles occur in one:
shingles are dealt out by ranges of their hashes, and each range tells how many of a set's shingles it has met in other
sets. Those left are ordered by one global order, the commonest shingle first, by counts over all of them. Similar sets
share one of their few rarest shingles; that says which sets have to meet in a task. A task stores its sets in a trie,
whose paths hold what sets have in common at their beginning, and looks up each set in it: what a path shares with
the set is counted once for all sets below, and a subtree is left where what remains cannot make up enough.

A large family of similar sets meets first round its smallest member, in cells of bounded size; what then is of one
component need not meet again, and a task leaves subtrees of the set's own component alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, staged, unvarint, varint
from .components import components
from .shingling import shingle_sets, slices

WORDS, PERCENT = 5, 80
#: Shingles of a block, that is, of the texts whose shingles a task deals out at once, and about those of a range.
BLOCK, RANGE = 1 << 20, 1 << 21
#: Sets of a part, for which what ranges have counted is summed at once.
PART = 1 << 16
#: Counters of shingles for the global order, and those of one row while they are summed. Shingles that share one only come to lie later in the order.
COUNTERS, COUNTER_ROW = 1 << 22, 1 << 16
#: What a task compares at once, in shingles; a set counts for some more.
CELL, SET = 1 << 22, 256
#: Bytes of a set's node by which ranges know it: most of a page where a set has one shingle in a range, as with large inputs.
TAG = 6
#: Sets up to which their ids are sent to every executor that reads texts again; with more, texts are shuffled.
BROADCAST_ROWS = 200_000


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles a similar set shares at least."""
    return -(-percent * n // 100)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), seed=len(s)), np.int64).tolist())


def _tag(node: np.ndarray) -> np.ndarray:
    return node & np.int64((1 << 8 * TAG) - 1)


def _packed(tags: np.ndarray) -> bytes:
    return tags.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :TAG].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    """The tags that _packed() packed."""
    out = np.zeros((len(data) // TAG, 8), np.uint8)
    out[:, :TAG] = np.frombuffer(data, np.uint8).reshape(-1, TAG)
    return out.view("<i8").reshape(-1)


def _prints(rows: DataFrame, words: int, repeats: bool) -> DataFrame:
    """(id, n, node, twin) of each row of (id, text): how many shingles its set has, and 128 bits that name the set."""
    schema = T.StructType([rows.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n", "node", "twin")]])

    def run(batches):
        for batch in batches:
            for lo, hi, data, ends in slices(batch, "text"):
                sets = shingle_sets(data, ends, words, repeats)
                node, twin = zip(*map(digest, sets))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (map(len, sets), node, twin))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _met(rows: DataFrame, words: int, repeats: bool, ranges: int, parts: int) -> DataFrame:
    """(tag, met): at least so many shingles of a set occur in another set; sets that meet none are left out.

    Counts are too large where equal sets lie in several blocks, or 32 bits of two hashes or the tags of two sets agree. They
    are too small only if two sets of different blocks share shingles and their tags, of 48 bits, agree by chance. What
    blocks and ranges have counted is summed by parts of the sets, in pages.
    """

    def paged(nodes: np.ndarray, met: np.ndarray):
        """(part, nodes, how many they have met) for each part; nodes are tags."""
        part = nodes % parts
        for k in np.unique(part).tolist():
            yield k, _packed(nodes[part == k]), varint(met[part == k])[0].tobytes()

    def deal(batches):
        """(range, alone, nodes, many, shared, met): a block's shingles of one set, by set; those of several sets, once; and how many of these a set has."""
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush():
            nodes, sets = _tag(np.array(list(held), np.int64)), list(held.values())
            h, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            _, first, many = np.unique(h, return_index=True, return_counts=True)
            single = np.zeros(len(h), bool)
            single[first[many == 1]] = True
            met = np.bincount(own[~single], minlength=len(nodes))
            alone, own, shared = h[single], own[single], h[first[many > 1]]
            of = lambda x: ((x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order, other = np.argsort(of(alone), kind="stable"), of(shared)  # shared ones are in order
            alone, own = alone[order], own[order]
            at = np.searchsorted(of(alone), np.arange(ranges + 1))
            at2 = np.searchsorted(other, np.arange(ranges + 1))
            pages = []
            for k in np.flatnonzero((np.diff(at) > 0) | (np.diff(at2) > 0)).tolist():
                who, times = np.unique(own[at[k] : at[k + 1]], return_counts=True)
                low = [x.astype(np.uint32).tobytes() for x in (alone[at[k] : at[k + 1]], shared[at2[k] : at2[k + 1]])]
                pages.append((k, low[0], _packed(nodes[who]), varint(times)[0].tobytes(), low[1]))
            # Pages without a range tell what the block has found by itself.
            pages += [(-1 - k, b"", who, times, b"") for k, who, times in paged(nodes[met > 0], met[met > 0])]
            held.clear()
            columns = list(zip(*pages))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["range", "alone", "nodes", "many", "shared"])

        for batch in batches:
            for _, _, data, ends in slices(batch, "text"):
                for s in shingle_sets(data, ends, words, repeats):
                    if len(s):
                        node = digest(s)[0]
                        size += len(s) if node not in held else 0
                        held[node] = s
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def meet(pages: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(pages[c].to_pylist()), t)
        alone, shared = join("alone", np.uint32), join("shared", np.uint32)
        node = np.repeat(_unpacked(b"".join(pages["nodes"].to_pylist())), unvarint(join("many", np.uint8)))
        order = np.lexsort((node, alone))
        alone, node = alone[order], node[order]
        new = np.append(True, alone[1:] != alone[:-1])[: len(alone)]
        other = np.append(True, node[1:] != node[:-1])[: len(alone)] | new
        alone, node, new = alone[other], node[other], new[other]  # a set once, however many blocks it is in
        first = np.flatnonzero(new)
        several = np.diff(np.append(first, len(alone))) > 1
        several |= np.isin(alone[first], shared)
        found, met = np.unique(node[np.repeat(several, np.diff(np.append(first, len(alone))))], return_counts=True)
        columns = list(zip(*paged(found, met))) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "nodes", "many"])

    def total(pages: pa.Table) -> pa.Table:
        node, many = _unpacked(b"".join(pages["nodes"].to_pylist())), unvarint(np.frombuffer(b"".join(pages["many"].to_pylist()), np.uint8))
        found, at = np.unique(node, return_inverse=True)
        return pa.table([pa.array(found), pa.array(np.bincount(at.reshape(-1), weights=many, minlength=len(found)).astype(np.int64))], names=["tag", "met"])

    pages = staged(rows.mapInArrow(deal, "range long, alone binary, nodes binary, many binary, shared binary"), "pages")
    across = pages.where("range >= 0").groupBy("range").applyInArrow(meet, "part long, nodes binary, many binary")
    within = pages.where("range < 0").select((-1 - F.col("range")).alias("part"), "nodes", "many")
    return across.unionByName(within).groupBy("part").applyInArrow(total, "tag long, met long")


def _sets(rows: DataFrame, wanted: DataFrame, words: int, repeats: bool) -> DataFrame:
    """(node, n, shingles) of the wanted sets (rep, node), read again from the rows whose ids are rep."""
    few = wanted.select(F.col("rep").alias("id")).distinct()
    few = F.broadcast(few) if wanted.count() <= BROADCAST_ROWS else few

    def run(batches):
        for batch in batches:
            for _, _, data, ends in slices(batch, "text"):
                sets = [s for s in shingle_sets(data, ends, words, repeats) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s)[0] for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "shingles"])

    found = rows.join(few, "id", "left_semi").select("text").mapInArrow(run, "node long, n long, shingles binary")
    # Rows that repeat an id can have other texts, or the same.
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _counters(sets: DataFrame) -> np.ndarray:
    """How many shingles fall to each of COUNTERS counters, as far as 16 bits go: a table of one size, whatever the input."""
    lean()

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in batch["shingles"]:
                np.add.at(total, (np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        rows = [(k, total[k * COUNTER_ROW : (k + 1) * COUNTER_ROW]) for k in range(COUNTERS // COUNTER_ROW)]
        rows = [(k, np.flatnonzero(x), x) for k, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([at.astype(np.uint32).tobytes() for _, at, _ in rows], pa.binary()), pa.array([x[at].tobytes() for _, at, x in rows], pa.binary())], names=["row", "at", "n"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(COUNTER_ROW, np.int64)
        for at, n in zip(parts["at"].to_pylist(), parts["n"].to_pylist()):
            total[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.int64)
        return pa.table([parts["row"].slice(0, 1), pa.array([np.minimum(total, 65_535).astype(np.uint16).tobytes()], pa.binary())], names=["row", "n"])

    out = np.zeros(COUNTERS, np.uint16)
    for r in sets.select("shingles").mapInArrow(count, "row long, at binary, n binary").groupBy("row").applyInArrow(add, "row long, n binary").collect():
        out[r.row * COUNTER_ROW : (r.row + 1) * COUNTER_ROW] = np.frombuffer(r.n, np.uint16)
    return out


def trie_links(sets: list[np.ndarray], size: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (positions) that connect all sets that similar ones connect; sets are ranks in ascending order.

    size are the sets' true sizes, as shingles that no other set has may be left out. Sets of one label are connected
    already. The sets, sorted, are the paths of a trie; a node is where they part. Its sets lie side by side, so that a
    node is a range of them, with the depths at which its path begins and ends.
    """
    order = sorted(range(len(sets)), key=[s.astype(">u4").tobytes() for s in sets].__getitem__)
    sets, size, label = [sets[k] for k in order], size[order], label[order].copy()
    many, length = len(sets), np.array([len(s) for s in sets])
    shared = np.zeros(many + 1, np.int64)  # words that a set has in common with the one before
    for k in range(1, many):
        m = min(length[k - 1], length[k])
        apart = np.flatnonzero(sets[k - 1][:m] != sets[k][:m])
        shared[k] = apart[0] if len(apart) else m
    nodes: list[tuple] = []  # first set, after the last, depth at its begin and end, most that follows, smallest set, children
    todo = [(0, many, 0, -1)]
    while todo:
        lo, hi, depth, parent = todo.pop()
        inner = shared[lo + 1 : hi]
        end = int(inner.min()) if hi - lo > 1 else int(length[lo])
        nodes.append((lo, hi, depth, end, int(length[lo:hi].max()) - end, int(size[lo:hi].min()), []))
        if parent >= 0:
            nodes[parent][6].append(len(nodes) - 1)
        if hi - lo > 1:
            me, cuts = len(nodes) - 1, [lo, *(lo + 1 + np.flatnonzero(inner == end)).tolist(), hi]
            todo += [(a, b, end, me) for a, b in zip(cuts[:-1], cuts[1:])]
    has, links = np.zeros(max((int(s[-1]) for s in sets if len(s)), default=0) + 1, bool), []
    for k in range(many):
        own, need = sets[k], percent * size[k]
        has[own] = True
        stack = [(0, 0)]
        while stack:
            at, both = stack.pop()
            lo, hi, depth, end, after, smallest, below = nodes[at]
            if hi <= k + 1 or (label[max(lo, k + 1) : hi] == label[k]).all():
                continue
            path = sets[lo][depth:end]
            both += int(np.count_nonzero(has[path]))
            left = len(own) - (int(np.searchsorted(own, sets[lo][end - 1], side="right")) if end else 0)
            if (100 + percent) * (both + min(left, after)) < need + percent * smallest:
                continue
            if below:
                stack += [(b, both) for b in below]
            elif hi - lo == 1:
                links.append((order[k], order[lo]))
                label[label == label[lo]] = label[k]
        has[own] = False
    return links


def _linked(cells: DataFrame, sets: DataFrame, counters, percent: int) -> DataFrame:
    """(u, v): links between sets that share a cell; cells are (cell, node, label), sets (node, n, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, size, label = (table[c].to_numpy() for c in ("node", "n", "label"))
        shingles = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"]]
        h = np.concatenate(shingles)
        known, ranked, times = np.unique(h, return_inverse=True, return_counts=True)
        known = known[times > 1]  # what one set alone has is shared with none
        rank = np.full(len(times), -1, np.int64)
        rank[times > 1] = np.argsort(np.lexsort((known, -counters.value[(known % np.uint64(COUNTERS)).astype(np.int64)].astype(np.int64))))
        ranked = rank[ranked.reshape(-1)]
        ends = np.cumsum([len(s) for s in shingles])
        ordered = [np.sort(r[r >= 0]) for r in np.split(ranked, ends[:-1])]
        enough = np.flatnonzero(100 * np.array([len(o) for o in ordered]) >= percent * size)
        links = trie_links([ordered[k] for k in enough], size[enough], label[enough], percent) if len(enough) > 1 else []
        u, v = (node[enough][[x[k] for x in links]] if links else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return cells.join(sets, "node").select("cell", "node", "n", "label", "shingles").groupBy("cell").applyInArrow(run, "u long, v long")


def links(sets: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """(u, v): links that connect all nodes that similar sets connect; sets are (node, n, shingles), staged, each node once."""
    counters = sets.sparkSession.sparkContext.broadcast(_counters(sets))

    def rarest(batches):
        for batch in batches:
            nodes, found = [], []
            for node, n, s in zip(batch["node"].to_pylist(), batch["n"].to_pylist(), batch["shingles"]):
                h = np.frombuffer(s.as_buffer(), np.uint64)
                times = counters.value[(h % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((h, times))[: n - int(_least(np.int64(n), percent)) + 1]
                first = first[times[first] > 1]  # a counter of one is of one set alone
                nodes.append(np.full(len(first), node))
                found.append(h[first])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes), pa.int64()), _longs(np.concatenate(found))], names=["node", "shingle"])

    rare = staged(sets.mapInArrow(rarest, "node long, shingle long"), "rarest")
    group = rare.groupBy("shingle").agg(F.min("node").alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many")
    rare = staged(rare.join(group, "shingle"), "rarest")

    # First each set meets the smallest member of the groups that it is in, that of the most groups.
    near = rare.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("both"))
    near = near.groupBy("node").agg(F.max_by("hub", F.struct("both", "hub")).alias("hub"))
    sizes = sets.select("node", (F.col("n") + SET).alias("weight"))
    near = staged(near.join(sizes, "node"), "near")
    parts = near.groupBy("hub").agg(F.ceil(F.sum("weight") / cell).cast("long").alias("parts"))
    dealt = near.join(parts, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("node"), "parts")).alias("cell"), "node")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(F.xxhash64("hub", "part").alias("cell"), F.col("hub").alias("node"))
    first = staged(_linked(dealt.union(hubs).withColumn("label", F.col("node")), sets, counters, percent), "links")

    # Then all that share a rare shingle and are of different components.
    found = components(first).withColumnRenamed("root", "label")
    labelled = staged(rare.select("node", "shingle").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    left = labelled.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("hub")).where("lo < hi").select("shingle", "hub")
    left = staged(labelled.join(left, "shingle"), "left")
    together = components(left.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    together = together.union(together.select("root", "root").distinct())
    meets = left.select("node", "label").distinct().join(together, "node").join(sizes, "node")
    meets = staged(meets, "meets")
    weight = meets.groupBy("root").agg(F.sum("weight").alias("all"))
    small = meets.join(weight.where(F.col("all") <= cell), "root").select(F.col("root").alias("cell"), "node", "label")
    # What is too much for a task meets by shingle: those with the same sets once, and large ones in parts, each with each.
    large = left.join(meets.join(weight.where(F.col("all") > cell), "root").select("node", "weight"), "node")
    signed = large.groupBy("shingle").agg(F.sum("weight").alias("all"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"))
    once = signed.groupBy("all", "n", "sign").agg(F.min("shingle").alias("shingle"))
    parts = once.select("shingle", F.ceil(F.col("all") / (cell / 2)).cast("long").alias("parts"))
    mine, other = F.pmod(F.xxhash64("node"), "parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = large.join(parts, "shingle").select("shingle", "node", "label", mine.alias("mine"), other)
    dealt = dealt.select(F.xxhash64("shingle", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "node", "label")
    second = _linked(small.union(dealt), sets, counters, percent)
    return staged(first.union(second), "links")


def distinct_sets(rows: DataFrame, words: int, percent: int, repeats: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text): (id, n, node, twin) of each, (node, twin, n, rep, rows) of each distinct set, and (node, n, shingles)
    of those of them that can be similar to another. rep is the smallest id; rows with a null id are in the first alone."""
    prints = staged(_prints(rows, words, repeats), "prints")
    distinct = staged(prints.where("id is not null").groupBy("node", "twin", "n").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "distinct")
    total, many = distinct.agg(F.sum("n"), F.count("*")).first()
    met = _met(rows.where("id is not null"), words, repeats, int((total or 0) // RANGE) + 1, many // PART + 1)
    wanted = staged(distinct.withColumn("tag", F.col("node").bitwiseAND((1 << 8 * TAG) - 1)).join(met, "tag").where(100 * F.col("met") >= percent * F.col("n")).select("rep", "node"), "wanted")
    return prints, distinct, staged(_sets(rows, wanted, words, repeats), "sets")


def components_of(prints: DataFrame, distinct: DataFrame, edges: DataFrame, empty: bool = False) -> DataFrame:
    """(id, n, node, root, component) of each row of prints: the smallest id that edges (u, v) between nodes, and equal sets,
    reach, and a node that stands for all of them, since components can have one smallest id where rows repeat ids.

    With empty, rows with an empty set are equal as others are; else each is by itself.
    """
    found = components(edges)
    found = found.union(found.select("root", "root").distinct())
    moved = distinct.join(found, "node", "left").where("rows > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    moved = moved if empty else moved.where("n > 0")
    least = moved.groupBy("root").agg(F.min("rep").alias("component"))
    moved = moved.join(least, "root").select("node", "twin", "n", "root", "component")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return prints.join(moved, ["node", "twin", "n"], "left").select("id", "n", "node", F.coalesce("root", "node").alias("root"), own.alias("component"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """(id, n_shingles, component) of each row: the size of its set, and the smallest id that its links reach, itself included.

    A text's set is its distinct shingles of so many words, A-Z lower-cased, separated by ASCII white space; with fewer
    words, all of them as one. Rows link if 100 times what their sets share is percent times their union at least. Null
    texts and those without words have an empty set and link with nothing. Repeated rows and equal sets share a
    component. A row with a null id has its size, links with nothing and has a null component; rows that repeat an id
    with other texts each have their own set. No rows give none; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    prints, distinct, sets = distinct_sets(rows, words, percent)
    out = components_of(prints, distinct, links(sets, percent, cell))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component")


#: The same rows in SQL, for the query's names.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {WORDS} THEN list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c ON c.doc_id = s.doc_id"""
