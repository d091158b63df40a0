"""Byte-level BPE as a global distinct-word shuffle.

Encoding: each input partition is cut into blocks of whole documents. In a block the texts are split into
pre-tokens, the positions are kept as codes into the block's own word list, and the words are dealt by hash to
buckets that gather equal words of all blocks. A bucket encodes each distinct word once; the ids go back to the
blocks, where documents are put together by position. Texts are split once: positions and words are written as one
table in the shared folder, bucketed by block, so that positions are not shuffled to meet their ids and a lost
executor cannot make a block meet other words. A block is named by a digest of its word list.

No word is a hot key: a block lists a word once, however often it occurs. Decoding joins the token-byte table,
whose size the vocabulary fixes, and is map-side.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import binary_array, free_name, ragged, shared_dir, text_buffers, unvarint, varint

LETTER, NUMBER, OTHER, SPACE = range(4)

#: The code points of Unicode's White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)

#: Text bytes of a block, at least; a longer document makes a longer block.
BLOCK_BYTES = 16_000_000
#: Text bytes whose code points are looked at together.
SLICE_BYTES = 2_000_000


@functools.cache
def _kinds() -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def token_starts(data: bytes, documents: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of public_tokenizers.PATTERN start.

    data is the UTF-8 of texts laid end to end; documents are the byte offsets at which texts start. No
    pre-token crosses into another text. The pre-tokens of a text cover it without gaps.
    """
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    byte_at = None if n == len(data) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    first = np.zeros(n + 3, bool)
    first[documents if byte_at is None else np.searchsorted(byte_at, documents)] = True
    first[n:] = True
    kind = _kinds()[points]
    new = first.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    start = new.copy()
    # The last white-space character before other text of the document stands alone or, as a blank, joins that text.
    after = np.flatnonzero(new[1 : n + 1] & (kind == SPACE)) + 1
    after = after[~first[after]]
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # Contractions: an apostrophe at the start of a match, with the letters that belong to it.
    a = np.flatnonzero(points == 39)
    before = np.maximum(a - 1, 0)
    a = a[first[a] | (kind[before] < OTHER) | ((kind[before] == SPACE) & (points[before] != 32))]
    a = a[~first[a + 1]]
    near = np.concatenate((points, np.zeros(3, points.dtype)))
    one, two = near[a + 1], np.where(first[a + 2], 0, near[a + 2])
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    size = np.where(single, 2, np.where(double, 3, 0))
    a, size = a[size > 0], size[size > 0]
    start[a + 1] = False
    start[a + size] = True
    at = np.flatnonzero(start[:n])
    return at if byte_at is None else byte_at[at]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Rank by token bytes, from the content of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) < 40:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # Long words: a heap of pairs over a linked list.
    n = len(word)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class RankEncoder:
    """Encodes words by a rank file's content. Sent to executors whole; the vocabulary bounds it."""

    def __init__(self, lines: bytes):
        self.lines, self._ranks = lines, None

    def __getstate__(self):
        return {"lines": self.lines, "_ranks": None}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words."""
        self._ranks = self._ranks or read_ranks(self.lines)
        ids = [merge(w, self._ranks) for w in words]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter((i for x in ids for i in x), np.int64)


def special_spans(data: bytes, documents: np.ndarray, specials: tuple[bytes, ...]) -> np.ndarray:
    """(start, end) of the special tokens in texts laid end to end: the leftmost first, the longest of those, none across texts."""
    if not any(x in data for x in specials):
        return np.zeros((0, 2), np.int64)
    pattern = re.compile(b"|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
    ends = np.append(documents, len(data))
    touched = np.unique(np.searchsorted(ends, [m.start() for x in specials for m in re.finditer(re.escape(x), data)], "right") - 1)
    return np.array([m.span() for k in touched for m in pattern.finditer(data, ends[k], ends[k + 1])], np.int64).reshape(-1, 2)


class _Block:
    """Whole documents with the words of their texts, the most frequent first. Special tokens are words of their own."""

    def __init__(self, table: pa.Table, text: str, specials: tuple[bytes, ...] = ()):
        data, documents = text_buffers(table[text])
        starts, lo = [], 0
        while lo < len(documents) - 1:
            hi = max(lo + 1, int(np.searchsorted(documents, documents[lo] + SLICE_BYTES, "right")) - 1)
            a, b = documents[lo], documents[hi]
            raw, first = data[a:b].tobytes(), documents[lo:hi] - a
            spans = special_spans(raw, first, specials)
            own = token_starts(raw, np.union1d(first, spans) if len(spans) else first)
            if len(spans):  # no start within a special token
                at = np.searchsorted(spans[:, 0], own, "right") - 1
                own = own[(at < 0) | (own == spans[at, 0]) | (own >= spans[at, 1])]
            starts.append(own.astype(np.int32) + np.int32(a))
            lo = hi
        at = np.concatenate(starts) if starts else np.zeros(0, np.int32)
        del starts
        self.tokens_of = np.diff(np.searchsorted(at, documents))
        coded = binary_array(data, np.append(at, np.int32(len(data)))).dictionary_encode() if len(at) else None
        codes = coded.indices.to_numpy() if coded is not None else np.zeros(0, np.int32)
        count = np.bincount(codes)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes, self.count = rank[codes], count[order]
        self.words = coded.dictionary.take(pa.array(order)) if coded is not None else pa.array([], pa.binary())
        raw, ends = text_buffers(self.words)
        digest = hashlib.blake2b(ends.tobytes(), digest_size=8)
        digest.update(raw)
        self.key = int.from_bytes(digest.digest(), "little", signed=True)
        self.table = table


def _blocks(batches: Iterator[pa.RecordBatch], text: str, specials: tuple[bytes, ...] = (), size_bytes: int = BLOCK_BYTES) -> Iterator[_Block]:
    """Blocks of the rows of all batches: one ends with the row that brings its text to size_bytes, wherever batches end."""
    held, size = [], 0
    for batch in batches:
        ends = text_buffers(batch[text])[1]
        lo = 0
        while lo < batch.num_rows:
            hi = min(int(np.searchsorted(ends, ends[lo] + size_bytes - size)), batch.num_rows)
            held.append(batch.slice(lo, hi - lo))
            size += int(ends[hi] - ends[lo])
            lo = hi
            if size >= size_bytes:
                yield _Block(pa.Table.from_batches(held), text, specials)
                held, size = [], 0
    if held:
        yield _Block(pa.Table.from_batches(held), text, specials)


IDS = "block long, bucket int, codes binary, ids binary, counts binary"


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of integers or of raw bytes in one compressed value."""
    parts = [c.tobytes() if c.dtype == np.uint8 else varint(c)[0].tobytes() for c in columns]
    head, _ = varint(np.array([len(p) for p in parts]))
    return zstandard.compress(len(head).to_bytes(2, "little") + head.tobytes() + b"".join(parts), 3)


def _unpacked(value: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(value), np.uint8)
    head = int(raw[0]) | int(raw[1]) << 8
    ends = np.cumsum(unvarint(raw[2 : 2 + head])) + 2 + head
    return np.split(raw[2 + head :], ends[:-1] - 2 - head)


def dealt(raw: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each word raw[ends[i]:ends[i + 1]], from a polynomial hash of its bytes."""
    if len(ends) < 2:
        return np.zeros(0, np.int64)
    size = np.diff(ends)  # no word is empty
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    own = np.add.reduceat(raw.astype(np.uint64) * power[ragged(size, np.zeros(len(size), np.int64))], ends[:-1])
    return ((own ^ (own >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


class Split:
    """The split texts of docs: positions (docs without text, with block and codes) and pages (the words of each block by bucket)."""

    def __init__(self, docs: DataFrame, text: str, buckets: int | None = None, specials: tuple[bytes, ...] = (), block_bytes: int = BLOCK_BYTES):
        spark = docs.sparkSession
        self.kept = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != text]
        names = [free_name(docs, f"_{x}") for x in ("block", "codes", "bucket", "page", "words", "counts")]
        self.block, self.codes, bucket, page, words, counts = names
        own = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.BinaryType(), T.IntegerType(), T.BinaryType(), T.BinaryType(), T.BinaryType()))]
        schema, parts = T.StructType([*self.kept, *own]), int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = buckets or 4 * parts

        def split(batches):
            for block in _blocks(batches, text, specials, block_bytes):
                table, first = block.table.drop_columns([text]), np.concatenate(([0], np.cumsum(block.tokens_of)))
                for lo in range(0, len(block.tokens_of), 1000):
                    at = first[lo : lo + 1001]
                    n, raw, ends = len(at) - 1, block.codes[at[0] : at[-1]].astype("<u4").view(np.uint8), 4 * (at - at[0])
                    empty = [pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(3))]
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, 1000).combine_chunks() for c in table.columns), pa.array(np.full(n, block.key), pa.int64()), binary_array(raw, ends), *empty], names=schema.names)
                raw, ends = text_buffers(block.words)
                deal = dealt(raw, ends, buckets)
                order = np.argsort(deal, kind="stable")
                rows = []
                for at in np.split(order, np.flatnonzero(np.diff(deal[order])) + 1) if len(order) else []:
                    size = ends[at + 1] - ends[at]
                    rows.append((int(deal[at[0]]), _packed(np.diff(at, prepend=0)), _packed(size, raw[ragged(size, ends[at])]), _packed(block.count[at])))
                if rows:
                    n, columns = len(rows), list(zip(*rows))
                    empty = [*(pa.nulls(n, table.schema.field(f.name).type) for f in self.kept), pa.array(np.full(n, block.key), pa.int64()), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=schema.names)

        name = f"spark_catalog.default.split_{uuid.uuid4().hex}"
        writer = docs.select(*(f"`{f.name}`" for f in self.kept), text).mapInArrow(split, schema).write.format("parquet").option("compression", "zstd")
        writer.bucketBy(parts, self.block).option("path", f"{shared_dir(spark)}/shelfmark/{name}").saveAsTable(name)
        whole = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # its files stay, like those of staged()
        self.positions = whole.where(F.col(bucket).isNull()).select(*(f"`{f.name}`" for f in self.kept), self.block, self.codes)
        self.pages = whole.where(F.col(bucket).isNotNull()).select(F.col(self.block).alias("block"), F.col(bucket).alias("bucket"), F.col(page).alias("codes"), F.col(words).alias("words"), F.col(counts).alias("counts"))


def encoded_pages(pages: DataFrame, encoder: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The pages with ids for words: equal words of all blocks meet in their bucket and are encoded once."""
    shared = pages.sparkSession.sparkContext.broadcast(encoder)

    def encode(group: pa.Table) -> pa.Table:
        unpacked = [_unpacked(v) for v in group["words"].to_pylist()]
        sizes = [unvarint(s) for s, _ in unpacked]
        words = binary_array(np.concatenate([d for _, d in unpacked]), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))).dictionary_encode()
        length, flat = shared.value(words.dictionary.to_pylist())
        at = np.cumsum(length) - length
        out, lo, which = [], 0, words.indices.to_numpy()
        for size in sizes:
            own = which[lo : lo + len(size)]
            lo += len(size)
            out.append(_packed(length[own], flat[ragged(length[own], at[own])]))
        return pa.table([group["block"], group["bucket"], group["codes"], pa.array(out, pa.binary()), group["counts"]], ["block", "bucket", "codes", "ids", "counts"])

    return pages.groupBy("bucket").applyInArrow(encode, IDS)


def _word_table(pages: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code: how many ids a word has and where they start; the ids of all words."""
    codes, length, flat = [], [], []
    for c, v in zip(pages["codes"].to_pylist(), pages["ids"].to_pylist()):
        n, ids = _unpacked(v)
        codes.append(np.cumsum(unvarint(_unpacked(c)[0])))
        length.append(unvarint(n))
        flat.append(unvarint(ids))
    codes, length, flat = (np.concatenate(x) for x in (codes, length, flat))
    n, at = np.zeros(codes.max() + 1, np.int64), np.zeros(codes.max() + 1, np.int64)
    n[codes], at[codes] = length, np.cumsum(length) - length
    return n, at, flat.astype(np.uint32)


def with_ids(split: Split, ids: str, pages: DataFrame, then: tuple[Callable[[pa.Table], pa.Table], str] | None = None) -> DataFrame:
    """The split docs with ids instead of their text, from the encoded pages of the same split.

    then, a function of a block's rows and the schema of what it makes of them, runs in the same Python worker.
    """
    block, codes, kept = split.block, split.codes, split.kept

    def reassemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        data, ends = text_buffers(left[codes])
        out, sizes = [], []
        if len(data):
            n, at, flat = _word_table(right)
            for lo in range(0, left.num_rows, 500):
                hi = min(lo + 500, left.num_rows)
                tokens = np.frombuffer(data[ends[lo] : ends[hi]].tobytes(), "<u4")
                own = n[tokens]
                out.append(flat[ragged(own, at[tokens])])
                sizes.append(np.diff(np.concatenate(([0], np.cumsum(own)))[(ends[lo : hi + 1] - ends[lo]) // 4]))
        flat_ids = np.concatenate(out).astype("<u4", copy=False) if out else np.zeros(0, "<u4")
        size = np.concatenate(sizes) if sizes else np.zeros(left.num_rows, np.int64)
        del out
        table = left.select([f.name for f in kept]).append_column(ids, binary_array(flat_ids.view(np.uint8), np.concatenate(([0], np.cumsum(size * 4)))))
        return then[0](table) if then else table

    right = pages.select(F.col("block").alias(block), "codes", "ids").groupBy(block)
    return split.positions.groupBy(block).cogroup(right).applyInArrow(reassemble, then[1] if then else T.StructType([*kept, T.StructField(ids, T.BinaryType())]))


def encode(docs: DataFrame, encoder: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], text: str = "text", ids: str = "ids", buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without text, with its ids: little-endian unsigned 32-bit integers in a binary column.

    Words are dealt to buckets (four for each shuffle partition, if not given).
    A null or empty text has no ids (an empty value, not null). Other columns, repeated rows and nulls in them
    pass unchanged; a column of docs that is named like ids is replaced. No documents give no rows.
    """
    docs = docs.drop(ids) if ids != text else docs
    split = Split(docs, text, buckets, block_bytes=block_bytes)
    return with_ids(split, ids, encoded_pages(split.pages, encoder))


def decode(tokens: DataFrame, table: list[bytes], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """tokens with the bytes of their ids, joined from the token-byte table (a bound vocabulary, sent whole).

    Null ids give null bytes, no ids give empty bytes; an id outside the table raises an error.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(table)
    tokens = tokens.drop(decoded)
    schema = T.StructType([*tokens.schema.fields, T.StructField(decoded, T.BinaryType())])

    def join(batches):
        size = np.array([len(b) for b in shared.value], np.int64)
        at, flat = np.cumsum(size) - size, np.frombuffer(b"".join(shared.value), np.uint8)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                raw, ends = text_buffers(batch[ids])
                own = np.frombuffer(raw.tobytes(), "<u4")
                n = size[own]
                out = binary_array(flat[ragged(n, at[own])], np.concatenate(([0], np.cumsum(n)))[ends // 4])
                if batch[ids].null_count:
                    out = pc.if_else(batch[ids].is_null(), pa.scalar(None, pa.binary()), out)
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, decoded])

    return tokens.mapInArrow(join, schema)


def token_table(lines: bytes) -> list[bytes]:
    """Token bytes by id, from the content of a rank file."""
    ranks = read_ranks(lines)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table
