"""Phrase collocations: word sequences that occur far more often than their parts would let expect, by language.

Frequent words get ids, from a table of their 64-bit hashes, and pieces of text break at all other words, since no
frequent phrase holds one. Ids of two or three words are packed into a key of fixed width; each task sorts its keys by radix and counts runs of equal ones, so
that a common phrase is one row a task. Keys are dealt out by ranges that the words' counts divide evenly, then sorted
and counted again. All that follows, on phrases that are frequent, are joins and aggregations.
"""

from __future__ import annotations

import collections
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged
from .shingling import mixed, slices, word_hashes

LEAST, COVERED, TOP = 10, 50, 2000
#: Words that get an id and are sent to every executor as their hashes (32 MB), the most frequent first. Phrases with other frequent words are counted by a shuffle of their hashes.
MOST_WORDS = 1 << 22
#: Keys that a task holds until it counts them, and about how many a range has.
HELD, RANGE = 1 << 22, 1 << 20
#: Distinct words that a task holds until it passes their counts on.
HELD_WORDS = 1 << 19
#: Parts of a language whose best phrases are picked apart first.
PARTS = 16
UNKNOWN = "und"

#: What separates words, and of it what ends a piece.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CUTS, _GAPS = (np.isin(np.arange(256), list(x)) for x in (_BREAKS, _BREAKS + b" \t"))
#: Small letters, and a blank for all that separates words.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b" " * (len(_BREAKS) + 1))


def _count_words(batches):
    """(lang, word, n): the words of a task; word is null for all words of a language."""
    held: dict[str, collections.Counter] = {}

    def flush():
        for lang, count in held.items():
            words = [w.decode() for w in count]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.string()), pa.array([*count.values(), sum(count.values())], pa.int64())], names=["lang", "word", "n"])
        held.clear()

    for batch in batches:
        langs = batch["lang"].to_pylist()
        for lo, hi, data, ends in slices(batch, "text"):
            raw = data.tobytes().translate(_FOLD)
            for k in range(lo, hi):
                held.setdefault(langs[k], collections.Counter()).update(raw[ends[k - lo] : ends[k - lo + 1]].split())
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
    yield from flush()


def radix_sorted(keys: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, ...]:
    """keys (unsigned 64-bit) in ascending order, and the others with them, by stable passes over digits of 16 bits, the lowest first."""
    digits = keys.view(np.uint16).reshape(-1, 4) if len(keys) else np.zeros((0, 4), np.uint16)
    order = None
    for k in range(4):
        digit = digits[:, k]
        if not len(digit) or (digit == digit[0]).all():
            continue
        ranked = np.argsort(digit if order is None else digit[order], kind="stable")  # of 16 bits, so by counting
        order = ranked if order is None else order[ranked]
    return tuple(x if order is None else x[order] for x in (keys, *also))


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and how often each occurs, by the lengths of runs (or what counts sum to in them)."""
    keys, *rest = radix_sorted(keys) if counts is None else radix_sorted(keys, counts)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(rest[0], first) if rest and len(first) else np.diff(np.append(first, len(keys)))


def _ranges(n: np.ndarray, width: int, ranges: int) -> np.ndarray:
    """Keys that divide all keys, by their first word's count, into about so many equal ranges; also the keys of one word, by the second's."""
    share = n * (ranges / max(n.sum(), 1))
    whole, first = np.floor(np.cumsum(share)), np.arange(1, len(n) + 1)
    cut = [first[1:][(whole[1:] > whole[:-1]) | (share[1:] >= 1)].astype(np.uint64) << np.uint64(2 * width)]
    sums = np.cumsum(n)
    for i in np.flatnonzero(share >= 2).tolist():
        parts = int(share[i]) + 1
        second = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts).astype(np.uint64) + np.uint64(1)
        cut.append((np.uint64(i + 1) << np.uint64(2 * width)) | (second << np.uint64(width)))
    return np.unique(np.concatenate(cut))


def _words(batch: pa.RecordBatch, seed: int):
    """(hashes of words with their languages, whether a word follows the one before in a piece, bytes, first and last byte) of slices of a batch."""
    langs = [str(x).encode() for x in batch["lang"].to_pylist()]
    of = {x: np.uint64(xxhash.xxh64_intdigest(x, seed)) for x in set(langs)}
    seeds = np.array([of[x] for x in langs], np.uint64)
    for lo, hi, data, ends in slices(batch, "text"):
        h, begin, first = word_hashes(data, ends, _GAPS)
        cuts = np.cumsum(_CUTS[data], dtype=np.int64)
        follows = np.append(False, cuts[begin[1:]] == cuts[begin[:-1]])[: len(begin)]
        follows[first[:-1][first[:-1] < len(begin)]] = False
        yield mixed(h + np.repeat(seeds[lo:hi], np.diff(first))), follows, data, begin


def _named(words: DataFrame, seed: int) -> DataFrame:
    """words (lang, word, n) with the hash that stands for a word of a language."""

    def run(batches):
        for batch in batches:
            part = pa.RecordBatch.from_arrays([batch["lang"], batch["word"]], names=["lang", "text"])
            h = [x[0] for x in _words(part, seed)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.uint64), *h]).view(np.int64))], names=["lang", "word", "n", "h"])

    return words.mapInArrow(run, "lang string, word string, n long, h long")


def _phrases(rows: DataFrame, words: DataFrame, least: int, most_words: int) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, h3, a): phrases of two (h3 is null) and three words that occur so often, by the words' hashes; and words with these."""
    spark = rows.sparkSession
    for seed in itertools.count():
        named = staged(_named(words, seed), "named")
        twice = named.groupBy("h").count().where("count > 1")
        if twice.isEmpty():  # else two words have one hash
            break
    many = named.count()
    top = named.select("h", "n")
    top = (top if many <= most_words else top.orderBy(F.desc("n"), "h").limit(most_words)).toPandas()  # at most MOST_WORDS, whatever the input
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    ids = spark.sparkContext.broadcast(h[order])  # a word's id is its place among them
    width = max(1, len(h).bit_length())
    cuts = _ranges(n[order], width, int(2 * n.sum() // RANGE) + 1)

    def coded(h: np.ndarray) -> np.ndarray:
        own, at = np.unique(h, return_inverse=True)
        place = np.minimum(np.searchsorted(ids.value, own), max(len(ids.value) - 1, 0))
        return np.where(ids.value[place] == own, place + 1, 0)[at.reshape(-1)] if len(ids.value) else np.zeros(len(h), np.int64)

    def pack(batches):
        """(range, keys, counts): what the words of a task come to, in pages."""
        held, size = [], 0

        def flush():
            keys, counts = counted(np.concatenate(held))
            at = np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))
            pages = [(k, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for k, (a, b) in enumerate(itertools.pairwise(at.tolist())) if b > a]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pages], pa.int64()), *(pa.array([p[k] for p in pages], pa.binary()) for k in (1, 2))], names=["range", "keys", "counts"])

        for batch in batches:
            for h, follows, _, _ in _words(batch, seed):
                word = coded(h).astype(np.uint64)
                a, b, c = word[:-1], word[1:], word[2:]
                two = (a > 0) & (b > 0) & follows[1:]
                pair = (a << np.uint64(2 * width)) | (b << np.uint64(width))
                held += [pair[two], (pair[:-1] | c)[two[:-1] & (c > 0) & follows[2:]]]
                size += len(held[-1]) + len(held[-2])
                if size > HELD:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def merge(pages: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(b"".join(pages[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("counts", np.uint32)))
        keys, counts = counted(keys, counts.astype(np.int64))
        keys, counts = keys[counts >= least], counts[counts >= least]
        mask = np.uint64((1 << width) - 1)
        one, two, three = ((keys >> np.uint64(s * width) & mask).astype(np.int64) - 1 for s in (2, 1, 0))
        back = lambda ids_: pa.array(ids.value[ids_].view(np.int64), mask=ids_ < 0)
        return pa.table([back(one), back(two), back(three), pa.array(counts)], names=["h1", "h2", "h3", "a"])

    schema = "h1 long, h2 long, h3 long, a long"
    found = rows.mapInArrow(pack, "range long, keys binary, counts binary").groupBy("range").applyInArrow(merge, schema)
    if many <= most_words:
        return found, named

    def others(batches):
        """Phrases with a word that has no id, by hashes."""
        for batch in batches:
            for h, follows, _, _ in _words(batch, seed):
                none, signed, rows_ = coded(h) == 0, h.view(np.int64), []
                for size in (2, 3):
                    at = np.arange(max(len(h) - size + 1, 0))
                    whole = np.logical_and.reduce([follows[at + k] for k in range(1, size)]) if len(at) else np.zeros(0, bool)
                    some = np.logical_or.reduce([none[at + k] for k in range(size)]) if len(at) else np.zeros(0, bool)
                    at = at[whole & some]
                    rows_.append([pa.array(signed[at + k]) if k < size else pa.nulls(len(at), pa.int64()) for k in range(3)])
                yield from (pa.RecordBatch.from_arrays(r, names=["h1", "h2", "h3"]) for r in rows_)

    known = lambda df, k: df.join(named.select(F.col("h").alias(k)), k, "left_semi")
    rest = staged(known(known(rows.mapInArrow(others, "h1 long, h2 long, h3 long"), "h1"), "h2"), "others")  # other words are in no frequent phrase
    rest = rest.where("h3 is null").unionByName(known(rest.where("h3 is not null"), "h3"))
    rest = rest.groupBy("h1", "h2", "h3").agg(F.count("*").alias("a")).where(F.col("a") >= least)
    return found.unionByName(rest.select("h1", "h2", "h3", "a")), named


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)); products have up to 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, top: int = TOP, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language, by score, then a, then phrase.

    Texts, A-Z lower-cased, are cut at ``. , ; : ! ?`` and line ends into pieces, and these at blanks and tabs into
    words. A phrase is two or three words that follow each other in a piece least times (a, overlaps included). Cut
    after some of its words, with the parts' own counts l and r, it scores floor(1000000 a a / (l r)); of its cuts the
    lowest counts, of equals the first. A phrase within a longer one that has covered percent of its count is left out.
    n is the count of all words of the language. Null texts are empty, a null language is ``und``; repeated rows count
    each; other columns are not read; no rows, or none with a phrase, give none. Counts may have 15 digits.
    """
    rows = docs.select(F.coalesce(docs[lang], F.lit(UNKNOWN)).alias("lang"), docs[text].alias("text"))
    words = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = staged(words.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    total, words = words.where("word is null").select("lang", "n"), words.where("word is not null")
    found, named = _phrases(rows, words, least, most_words)
    found = staged(found, "phrases")

    two, three = found.where("h3 is null").drop("h3"), found.where("h3 is not null")
    word = lambda k, f: named.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f))
    pair = lambda x, y, f: two.select(F.col("h1").alias(x), F.col("h2").alias(y), F.col("a").alias(f))
    over = three.select("h1", "h2", "a").union(three.select("h2", "h3", "a")).groupBy("h1", "h2").agg(F.max("a").alias("over"))
    kept = two.join(over, ["h1", "h2"], "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a")))
    first_word = named.select(F.col("h").alias("h1"), "lang", F.col("word").alias("w1"), F.col("n").alias("l1"))
    kept = kept.join(first_word, "h1").join(word(2, "r"), "h2")
    kept = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("l1").alias("l"), "r", _score("a", "l1", "r").alias("score"))
    cut = three.join(first_word, "h1").join(pair("h2", "h3", "r1"), ["h2", "h3"])
    cut = cut.join(pair("h1", "h2", "l2"), ["h1", "h2"]).join(word(3, "r2"), "h3").join(word(2, "n2"), "h2")
    cut = cut.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    cut = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("l1", "l2", "l"), pick("r1", "r2", "r"), pick("s1", "s2", "score"))

    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    spread = kept.unionByName(cut).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # The best of each part first, so that the last sort of a language has a fixed number of rows.
    best = spread.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("at") <= top).drop("at", "part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return best.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in SQL.
SQL = f"""WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {LEAST}),
o AS (SELECT lang, phrase, max(a) AS over FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, i, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score FROM c, range(1, 3) t(i)
 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:i], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[i + 1:], ' ') WHERE i < c.k),
b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE over IS NULL OR 100 * over < {COVERED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) QUALIFY rank <= {TOP}"""
