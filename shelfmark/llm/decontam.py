"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks, with DataFrame operations only.

A window of a document has as many words as a benchmark item. A window can be similar to an item only if most of its
shingles occur in items of that size, which a running sum over a document's known shingles tells for every window; all
windows of which that holds, at every start, are fingerprinted, from running sums of their document's bits: a
window's counts are the difference of two. Fingerprints are listed by blocks of bits, those of items with every value up to
three bits off, as items are few beside windows: a fingerprint within RADIUS bits has a block at most three bits off, so
looking up a window's blocks finds every item within the radius, and few others. What is found is then verified by the exact similarity of shingle counts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_name, staged

WORDS = 5
SIMILARITY = 0.8
#: Longer items are looked for in equal pieces of at most so many words.
PIECE = 4096
#: Blocks of a fingerprint and their bits, and by how many bits those of windows and of items are listed.
BLOCKS, WIDTH, WINDOW_OFF, ITEM_OFF = 12, 16, 0, 3
#: The longs of a fingerprint.
PRINT = [f"fp{k}" for k in range(BLOCKS * WIDTH // 64)]
#: Bits, of 192, by which fingerprints may differ: one block then differs in as many as both lists make up for. At similarity
#: 0.8 they differ in 30, with a standard deviation of 5, at 0.85 in 24.
RADIUS = BLOCKS * (WINDOW_OFF + ITEM_OFF + 1) - 1
#: Bits that are counted in one long, each in so many bits of it; the last has room for carries of 16 million hashes.
LANES, LANE = 4, 13
#: Rows of tables of items or of found documents up to which they are sent to every executor; with more, documents are shuffled.
BROADCAST_ROWS = 200_000


def words(text: str) -> Column:
    """Lower-cased words: what white space and ASCII punctuation separate."""
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def shingles(words: str) -> Column:
    """Hashes of the shingles of a word array, repeats included; of fewer words than a shingle has, none."""
    last = F.greatest(F.size(words) - (WORDS - 1), F.lit(1))
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WORDS)))
    return F.when(F.size(words) >= WORDS, hashes).otherwise(F.array().cast("array<bigint>"))


def lanes(h: str) -> list[Column]:
    """The bits of a hash column and of others made of it, spread over the lanes of longs, so that sums of these count each bit.

    Differences of such sums are sums themselves, of up to 8,191 hashes, whatever the lanes below have carried over.
    """
    out = []
    for own in (h, *(f"xxhash64({h}, {k})" for k in range(1, len(PRINT)))):
        for lo in range(0, 64, LANES):
            bits = [f"shiftleft(shiftrightunsigned({own}, {b}) & 1L, {LANE * k})" for k, b in enumerate(range(lo, min(lo + LANES, 64)))]
            out.append(F.expr(" | ".join(bits)))
    return out


def majorities(sums: list[str], many: str) -> list[Column]:
    """The longs of a fingerprint: a bit is set if it is set in over half of so many hashes, of which sums of lanes() are given."""
    out, part = [], len(sums) // len(PRINT)
    for name, own in zip(PRINT, (sums[k : k + part] for k in range(0, len(sums), part))):
        # One small function for all bits, as code for each of them would be long.
        each = f"transform(array({', '.join(own)}), s -> transform(sequence(0, {LANES - 1}), k -> shiftrightunsigned(s, {LANE} * k) & {(1 << LANE) - 1}L))"
        bits = f"transform(slice(flatten({each}), 1, 64), (n, b) -> shiftleft(CAST(2 * n > {many} AS BIGINT), b))"
        out.append(F.expr(f"aggregate({bits}, 0L, (x, y) -> x | y)").alias(name))
    return out


def blocks(df: DataFrame, off: int) -> DataFrame:
    """df (a fingerprint and others) with a row for each block and each of its values that are so many bits off at most."""
    masks = [sum(1 << b for b in bits) for n in range(off + 1) for bits in itertools.combinations(range(WIDTH), n)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")) for fp in PRINT for lo in range(0, 64, WIDTH)]
    each = df.select("*", F.posexplode(F.array(*parts)).alias("block", "bits"))
    return each.select(*df.columns, "block", F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.col("bits").bitwiseXOR(m))).alias("value"))


def _small(df: DataFrame) -> DataFrame:
    """df, to be sent to every executor if it is small enough; df is staged, so that counting it is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, start, words, similarity) for each document and item of which a window is similar enough.

    start is the first word (from 0) of the most similar window (of equals the first), words its length. Similarity is
    the sum of the smaller over the sum of the larger shingle counts. Windows at every start are looked at; a
    document shorter than an item is one window. Null and empty texts and texts or
    items under five words take no part; a null document id is an id like others; rows that repeat an id count as
    one document; equal items are all reported. Items of over 4096 words are looked for in equal pieces, of which any
    counts. No documents or no items give no rows. A similar window whose fingerprint differs in more than RADIUS bits
    is missed; at similarity 0.8 that is over three standard deviations away, at 0.85 nearly five. Other columns are not read.
    """
    w = items.select(F.col(item_id).alias("item"), words(item_text).alias("w")).where(F.size("w") >= WORDS)
    many = F.ceil(F.size("w") / PIECE).cast("int")
    cut = w.select("item", "w", many.alias("many"), F.explode(F.sequence(F.lit(0), many - 1)).alias("at"))
    border = lambda k: F.floor(F.size("w") * k / F.col("many")).cast("int")
    cut = cut.select("item", "at", F.slice("w", border(F.col("at")) + 1, border(F.col("at") + 1) - border(F.col("at"))).alias("w"))
    shingled = cut.select("item", "at", shingles("w").alias("s")).withColumn("size", F.size("s"))
    wanted = shingled.select("item", "at", "size", F.explode("s").alias("h")).groupBy("item", "at", "size", "h").agg(F.count("*").cast("int").alias("many"))
    wanted = staged(wanted, "wanted")
    sums = [F.sum(x * F.col("many")).alias(f"d{k}") for k, x in enumerate(lanes("h"))]
    counted = wanted.groupBy("item", "at", "size").agg(F.sum("many").alias("all"), *sums)
    prints = staged(counted.select("item", "at", "size", *majorities([f"d{k}" for k in range(len(sums))], "`all`")), "prints")
    known = staged(wanted.groupBy("h").agg(F.collect_set("size").alias("sizes")), "known")

    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    texts = rows.select("id", words("text").alias("w")).select("id", shingles("w").alias("s"))
    # Rows that repeat an id are told apart by their shingles. No filter on s, and outer explosion, which implies none:
    # it would be pushed below the projections and split the text again for every shingle.
    placed = texts.select("id", F.xxhash64("s").alias("row"), F.size("s").alias("n"), F.posexplode_outer("s").alias("pos", "h"))
    hits = placed.join(_small(known), "h").select("id", "row", "n", "pos", F.explode("sizes").alias("size"))

    # A known shingle counts in windows that end from its position on (none ends before own - 1) until it falls out.
    group, own = ["id", "row", "size"], F.least("n", "size")
    need = similarity * (own + F.col("size")) / (1 + similarity) - 1e-9
    hits = hits.repartition(*group).dropDuplicates([*group, "pos"]).withColumn("all", F.count("*").over(Window.partitionBy(*group))).where(F.col("all") >= need)
    event = F.explode(F.array(F.struct(F.greatest("pos", own - 1).alias("last"), F.lit(1).alias("step")), F.struct((F.col("pos") + own).alias("last"), F.lit(-1).alias("step"))))
    order = Window.partitionBy(*group).orderBy("last")
    running = hits.select(*group, "n", event.alias("e")).select(*group, "n", "e.last", "e.step").withColumn("held", F.sum("step").over(order)).withColumn("next", F.lead("last").over(order))
    stop = F.least("next", "n") - 1  # the last event takes the last shingle out
    ranges = staged(running.where((F.col("held") >= need) & (stop >= F.col("last"))).select(*group, "n", own.alias("own"), F.col("last").alias("first"), stop.alias("stop")), "ranges")

    # The shingles of the few documents that have such windows, and the sums of their bits up to each.
    found = staged(ranges.select(F.col("id").alias("_id"), F.col("row").alias("_row")).distinct(), "found")
    again = rows.join(_small(found.select("_id").distinct()), F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    again = again.select("id", words("text").alias("w")).select("id", shingles("w").alias("s")).withColumn("row", F.xxhash64("s")).dropDuplicates(["id", "row"])
    doc = F.struct("id", "row").alias("doc")
    again = staged(again.join(_small(found), F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_semi").select(doc, "s"), "again")
    start = F.explode(F.sequence(F.col("first") - F.col("own") + 1, F.col("stop") - F.col("own") + 1)).alias("start")
    spans = staged(ranges.select(doc, "size", "own", start).withColumn("end", F.col("start") + F.col("own")), "spans")
    asked = spans.select("doc", F.explode(F.array("start", "end")).alias("pos")).distinct().withColumn("asked", F.lit(True))
    # Only the stretches of a document that windows cover, each with sums of its own.
    covered = ranges.select(doc, (F.col("first") - F.col("own") + 1).alias("lo"), F.col("stop").alias("hi"))
    by_start = Window.partitionBy("doc").orderBy("lo", "hi")
    furthest = F.max("hi").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    covered = covered.withColumn("new", F.coalesce((F.col("lo") > furthest + 1).cast("int"), F.lit(1))).withColumn("stretch", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    covered = covered.groupBy("doc", "stretch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    placed = again.join(covered, "doc").select("doc", "stretch", "lo", F.posexplode(F.slice("s", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("p", "h"))
    placed = placed.select("doc", "stretch", (F.col("lo") + F.col("p") + 1).alias("pos"), "h").join(asked, ["doc", "pos"], "left")
    # Dealt out and sorted before the sums are made of the hashes, and only those kept that a window begins or ends at.
    dealt = placed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "stretch").sortWithinPartitions("doc", "stretch", "pos")
    at = [f"d{k}" for k in range(len(sums))]
    upto = Window.partitionBy("doc", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.select("doc", "stretch", "pos", "asked", *[x.alias(c) for c, x in zip(at, lanes("h"))]).select("doc", "pos", "asked", *[F.sum(c).over(upto).alias(c) for c in at])
    running = staged(running.where("asked").drop("asked"), "running")

    last = running.select("doc", F.col("pos").alias("end"), *[F.col(c).alias(f"e{c}") for c in at])
    summed = spans.join(last, ["doc", "end"]).join(running.withColumnRenamed("pos", "start"), ["doc", "start"], "left")
    window = ["doc", "size", "own", "start"]
    printed = summed.select(*window, *[(F.col(f"e{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in at])
    printed = staged(printed.select(*window, *majorities(at, "own")), "windows")

    listed = staged(blocks(prints, ITEM_OFF).withColumnsRenamed({fp: f"item_{fp}" for fp in PRINT}), "listed")
    apart = sum((F.bit_count(F.col(fp).bitwiseXOR(F.col(f"item_{fp}"))) for fp in PRINT), F.lit(0))
    near = blocks(printed, WINDOW_OFF).join(_small(listed), ["size", "block", "value"]).where(apart <= RADIUS)
    near = staged(near.select(*window, "item", "at").distinct(), "near")

    pair = [*window, "item", "at"]
    held = near.join(again, "doc").select(*pair, F.explode(F.slice("s", F.col("start") + 1, F.col("own"))).alias("h"))
    counts = held.groupBy(*pair, "h").agg(F.count("*").cast("int").alias("own_many"))
    kept = [F.col(f"c.{x}").alias(x) for x in pair]
    of_item = _small(wanted).alias("i")
    shared = counts.alias("c").join(of_item, (F.col("c.h") == F.col("i.h")) & F.col("c.item").eqNullSafe(F.col("i.item")) & (F.col("c.at") == F.col("i.at"))).select(*kept, F.least("own_many", "many").alias("both"))
    total = shared.groupBy(*pair).agg(F.sum("both").alias("shared"))
    ratio = F.col("shared") / (F.col("own") + F.col("size") - F.col("shared"))
    similar = total.select("doc.id", "item", "start", "own", ratio.alias("similarity")).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "own")).alias("b")
    out = similar.groupBy("id", "item").agg(best)
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias(item_id if item_id != id_col else free_name(docs, item_id)),
        (-F.col("b.start")).alias("start"), (F.col("b.own") + WORDS - 1).alias("words"), F.col("b.similarity").alias("similarity"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in which no item is found; options as for find()."""
    leak = free_name(docs, "_leak")
    leaks = find(docs, items, id_col, **options).select(F.col(id_col).alias(leak)).distinct()
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col(leak)), "left_anti")
