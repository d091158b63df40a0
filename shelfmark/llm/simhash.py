"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are grouped first, so a group of copies, however large, is one fingerprint. Distinct
fingerprints are laid out in cells by the population counts of their parts (and by text length, where a largest
length ratio holds). Two fingerprints within the radius have cells within the radius, so cell pairs further apart
are skipped whole; the others are compared exactly, with exclusive-or and bit counts, in tiles sorted by
population count. A large cell is cut into groups and its pairs into a grid of keys, so no task gets more than two
groups. A task returns a spanning forest of the links that it finds, never all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from ._shared import free_name, staged, text_buffers
from .components import components
from .shingling import mixed, shingle_sets, slices

#: A group, the rows of one side of a task's comparison, has an eighth of all fingerprints at most, and so many at most.
#: More groups would split a large cell finer, but each pair of groups proposes links of its own.
SHARE, GROUP = 8, 131_072
#: Cells of a tile's matrix.
TILE = 2_000_000
#: Where similarities are verified: sets of fewer shingles are compared whatever their fingerprints, which so few hashes spread too little.
SHORT = 32


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64, seed 42, of each shingle of a text: its words, A-Z lower-cased, joined by blanks.

    Fewer words than a shingle has make one shingle; no word makes none.
    """
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    stop = list(itertools.accumulate(map(len, parts), lambda a, b: a + b + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip([0, *(e + 1 for e in stop[: -words])], stop[words - 1 :]) if len(parts) > words else [(0, stop[-1])]
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def majority(h: np.ndarray) -> int:
    """A fingerprint whose bits are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65_536):
        part = np.ascontiguousarray(h[lo : lo + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, bits: int = 64) -> DataFrame:
    """(id, fp, fp2, shingles) of each row: signed 64-bit halves of the fingerprint (fp2 is 0 if bits is 64).

    A null text counts as empty: fingerprint zero, no shingle.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("shingles", T.LongType())])

    def run(batches):
        for batch in batches:
            data, ends = text_buffers(batch[text])
            raw, a, b, n = data.tobytes(), [], [], []
            for lo, hi in zip(ends[:-1], ends[1:]):
                h = shingle_hashes(raw[lo:hi], words)
                a.append(majority(h))
                b.append(majority(mixed(h)) if bits == 128 else 0)
                n.append(len(h))
            halves = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch[id_col], *halves, pa.array(n, pa.int64())], names=[id_col, "fp", "fp2", "shingles"])

    return docs.select(id_col, text).mapInArrow(run, schema)


def _cell(parts: int):
    """A fingerprint's cell: its band and the population counts of its parts, as digits to the base 65."""
    cell, width = F.col("band"), 64 // parts if parts else 0
    for k in range(parts):
        own = F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
        cell = cell * 65 + own
    return cell


def _steps(parts: int, radius: int, banded: bool) -> list[int]:
    """By how much the cells differ that fingerprints within the radius can lie in; each with its opposite."""
    powers = [65 ** (parts - 1 - k) for k in range(parts)]
    near = [sum(p * x for p, x in zip(powers, s)) for s in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, s)) <= radius]
    return sorted({band * 65**parts + n for n in near for band in ((-1, 0, 1) if banded else (0,))})


def _tiles(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int):
    """(rows, columns, bits apart) of the tiles of left x right, without those whose population counts differ beyond the radius."""
    ones, two = np.bitwise_count(fp).sum(axis=1, dtype=np.int64), bool(fp[:, 1].any())
    left, right = left[np.argsort(ones[left], kind="stable")], right[np.argsort(ones[right], kind="stable")]
    counts, step = ones[right], max(1, TILE // max(len(right), 1))
    for lo in range(0, len(left), step):
        rows = left[lo : lo + step]
        a, b = np.searchsorted(counts, [ones[rows[0]] - radius, ones[rows[-1]] + radius + 1])
        cols = right[a:b]
        apart = np.bitwise_count(fp[rows, 0][:, None] ^ fp[cols, 0])
        if two:
            apart = apart + np.bitwise_count(fp[rows, 1][:, None] ^ fp[cols, 1])
        yield rows, cols, apart


def _forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links between rows left and rows right of fp (n x 2) that connect what all links within the radius connect."""
    label, u, v = np.arange(len(fp)), [], []
    for rows, cols, apart in _tiles(fp, left, right, radius):
        near = (apart <= radius) & (label[rows][:, None] != label[cols])
        for k in np.flatnonzero(near.any(axis=1)):
            at = cols[np.flatnonzero(near[k])]
            found, first = np.unique(label[at], return_index=True)
            keep = found != label[rows[k]]  # earlier rows of the tile may have joined some
            if not keep.any():
                continue
            u.append(np.full(int(keep.sum()), rows[k]))
            v.append(at[first[keep]])
            joined = np.zeros(len(fp), bool)
            joined[found] = joined[label[rows[k]]] = True
            label[joined[label]] = min(found[0], label[rows[k]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def links(distinct: DataFrame, radius: int, parts: int, banded: bool) -> DataFrame:
    """(u, v): a spanning set of the links between rows (rep, fp, fp2, band) of distinct fingerprints."""
    spark = distinct.sparkSession
    cells = distinct.withColumn("cell", _cell(parts))
    counts = staged(cells.groupBy("cell").agg(F.count("*").alias("n")), "cells")  # as many as there are population counts or lengths
    size = min(-(-(counts.agg(F.sum("n")).first()[0] or 1) // SHARE), GROUP)
    groups = F.ceil(F.col("n") / size).cast("long")
    mine = F.broadcast(counts.select("cell", groups.alias("own_groups")))
    theirs = F.broadcast(counts.select(F.col("cell").alias("to"), groups.alias("to_groups")))
    reach = F.explode(F.array(*[F.lit(x).cast("long") for x in _steps(parts, radius, banded)]))
    paired = cells.join(mine, "cell").withColumn("own", F.pmod(F.xxhash64("fp", "fp2"), F.col("own_groups"))).withColumn("step", reach).withColumn("to", F.col("cell") + F.col("step")).join(theirs, "to")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_groups") - 1))
    same_cell, first = F.col("cell") == F.col("to"), F.col("cell") < F.col("to")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = paired.withColumn("other", other).select(
        F.when(same_cell, F.xxhash64("cell", "to", low, high)).when(first, F.xxhash64("cell", "to", "own", "other")).otherwise(F.xxhash64("to", "cell", "other", "own")).alias("key"),
        F.when(same_cell, (F.col("own") > F.col("other")).cast("int")).otherwise((~first).cast("int")).alias("side"),
        (same_cell & (F.col("own") == F.col("other"))).alias("same"),
        "rep", "fp", "fp2",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def run(table: pa.Table):
            key, side, rep = (table[c].to_numpy() for c in ("key", "side", "rep"))
            fp = np.stack([table["fp"].to_numpy(), table["fp2"].to_numpy()], axis=1).view(np.uint64)
            same, u, v = table["same"].to_numpy(), [], []
            for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key)]):
                left = np.flatnonzero(side[lo:hi] == 0)
                right = left if same[lo] else np.flatnonzero(side[lo:hi] == 1)
                if len(right) and hi - lo > 1 and len(left):
                    node, root = _forest(fp[lo:hi], left, right, radius)
                    u.append(rep[lo:hi][node])
                    v.append(rep[lo:hi][root])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if held and key[0] != held[-1]["key"][0].as_py():
                yield from run(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from run(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from run(pa.Table.from_batches(held))

    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, bits: int = 64, radius: int = 2, parts: int = 4, length_ratio: float | None = None, few: int = 0, similarity: float | None = None
) -> DataFrame:
    """(id, fp, fp2, component) of each row: its fingerprint and the smallest id that its links reach, itself included.

    Rows link if their fingerprints differ in radius bits at most. With length_ratio, they link only if their
    shingle counts (repeats included) fall into the same or neighbouring steps of that ratio, which keeps every
    pair within the ratio; and rows of fewer shingles than few link only if fingerprint and count are equal, as so
    few hashes spread too little. Null or empty texts have fingerprint zero and link like any other. Ties and
    repeated rows share a component; a row with a null id keeps its fingerprint, takes no part in links and has a
    null component. No documents give no rows.

    With similarity, (id, node, root, component): rows link if their shingles, counted with repeats, are as similar, that is,
    the sum of the smaller over the sum of the larger counts; node names a row's shingles, and root is one node for each component. Sets that cannot be similar to
    any other go first (see jaccard.py); of the others, fingerprints tell which have another within the radius, as far as lengths allow, and
    these are joined exactly. Sets of under SHORT shingles need no such fingerprint. Texts without words are equal.
    """
    if similarity:
        return _near_by_similarity(docs, id_col, text, words, bits, radius, parts, similarity)
    prints = staged(fingerprints(docs, id_col, text, words, bits).withColumnRenamed(id_col, "id"), "fingerprints")
    if length_ratio:
        step = F.floor(F.log(F.greatest("shingles", F.lit(1))) / float(np.log(length_ratio))).cast("long")
        prints = prints.withColumn("band", F.when(F.col("shingles") < few, -1 - F.col("shingles")).otherwise(step))
    else:
        prints = prints.withColumn("band", F.lit(0).cast("long"))
    key = ["fp", "fp2", "band"]
    distinct = staged(prints.where("id is not null").groupBy(*key).agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("rows")), "distinct")
    found = components(links(distinct.where("band >= 0").drop("rows"), radius, parts, bool(length_ratio)))
    # Only fingerprints that are shared or linked can change a row's component.
    moved = distinct.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("rows > 1 or root is not null").select(*key, F.coalesce("root", "rep").alias("component"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", F.col("id").cast("long")))
    return prints.join(moved, key, "left").select(F.col("id").alias(id_col), "fp", "fp2", own.alias("component"))


def _near_by_similarity(docs: DataFrame, id_col: str, text: str, words: int, bits: int, radius: int, parts: int, similarity: float) -> DataFrame:
    rows, percent = docs.select(docs[id_col].alias("id"), docs[text].alias("text")), round(100 * similarity)
    prints, distinct, sets = jaccard.distinct_sets(rows, words, percent, repeats=True)

    def fingerprint(batches):
        for batch in batches:
            h = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch["shingles"]]
            halves = ([majority(x) for x in h], [majority(mixed(x)) if bits == 128 else 0 for x in h])
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in halves)], names=["rep", "n", "fp", "fp2"])

    step = F.floor(F.log("n") / float(-np.log(similarity))).cast("long")
    prints_of = staged(sets.mapInArrow(fingerprint, "rep long, n long, fp long, fp2 long").withColumn("band", step), "fingerprints")
    # Sets with one fingerprint and length step are near as well; the smallest stands for them.
    one = prints_of.groupBy("fp", "fp2", "band").agg(F.min("rep").alias("hub"), F.count("*").alias("many"))
    near = links(one.select(F.col("hub").alias("rep"), "fp", "fp2", "band"), radius, parts, True)
    near = near.select(F.explode(F.array("u", "v")).alias("hub")).union(one.where("many > 1").select("hub")).distinct()
    meets = prints_of.join(one.join(near, "hub", "left_semi"), ["fp", "fp2", "band"], "left_semi").select("rep")
    meets = meets.union(prints_of.where(F.col("n") < SHORT).select("rep")).distinct()
    compared = staged(sets.join(meets, F.col("node") == F.col("rep"), "left_semi"), "compared")
    out = jaccard.components_of(prints, distinct, jaccard.links(compared, percent), empty=True)
    return out.select(F.col("id").alias(id_col), "node", "root", "component")


def _with_node(docs: DataFrame, text: str, words: int, name: str) -> DataFrame:
    """docs with the node that names a row's shingles, as near_duplicates() has it."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            for lo, hi, data, ends in slices(batch, text):
                node = [jaccard.digest(s)[0] for s in shingle_sets(data, ends, words, True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(node, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without all but the first of each component; options as for near_duplicates().

    The first is the row with the smallest id; with similarity, of rows that repeat that id in the component the one with
    the smallest node, so that texts that only share an id all stay. Of rows that repeat an id and a text one stays, and
    rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text, **options).where(F.col(id_col).isNotNull())
    if "node" not in found.columns:
        first = found.where(F.col(id_col) == F.col("component")).select(id_col).distinct()
        kept = docs.join(first, id_col, "left_semi").dropDuplicates([id_col])
        return kept.unionByName(docs.where(F.col(id_col).isNull()))
    found = staged(found, "found")
    first = staged(found.groupBy("root").agg(F.min(F.struct(F.col(id_col).alias("id"), "node")).alias("first")).select("first.id", "first.node"), "first")
    own, node = free_name(docs, "_id"), free_name(docs, "_node")
    several = staged(found.groupBy(id_col).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(F.col(id_col).alias(own)), "several")
    plain = docs.join(several, F.col(id_col) == F.col(own), "left_anti").join(first.select(F.col("id").alias(own)), F.col(id_col) == F.col(own), "left_semi")
    odd = _with_node(docs.join(several, F.col(id_col) == F.col(own), "left_semi"), text, options.get("words", 3), node)
    odd = odd.join(first.select(F.col("id").alias(own), F.col("node").alias(own + "_node")), (F.col(id_col) == F.col(own)) & (F.col(node) == F.col(own + "_node")), "left_semi")
    return plain.dropDuplicates([id_col]).unionByName(odd.dropDuplicates([id_col, node]).drop(node)).unionByName(docs.where(F.col(id_col).isNull()))
