"""Token-id files: canonical length-limited Huffman codes of ids, in independent blocks.

Ids come from the distinct-word shuffle of ``bpe``, with words encoded by a tokenizer library; global id counts follow
from the words' counts alone, so the code is known before any document is encoded. A document's bits start at a
byte; a lane starts at its first id and after each LANE ids, and the file holds the bit offset of every lane, so that
a block is decoded with one table, all lanes in step. Documents lie in ascending order of ids.

The container is Parquet, written by Spark's committer to any store that Spark reaches:
``blocks``: part, block, first (ids before it in the part), doc_id and n_tokens (arrays), lanes (bit offsets), payload,
crc (of the payload), the lanes' offsets within the block as differences; ``code``: id, length. The lengths alone give the canonical code.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._shared import binary_array, ragged, staged, text_buffers, unvarint, varint

LANE = 1024
#: Longest code, unless the number of ids asks for more.
LONGEST = 20
#: Payload bytes of a block, about.
BLOCK_BYTES = 2_000_000
#: Keys that are sampled to find the ranges of document ids.
SAMPLE = 20_000


class LibraryEncoder:
    """Encodes words with the tokenizers library, from a tokenizer file's content.

    specials are the file's added tokens, which the library takes out of a text before it splits words.
    """

    def __init__(self, content: bytes):
        self.content, self._tokenizer = content, None
        added = json.loads(content).get("added_tokens", [])
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.specials = tuple(x["content"].encode() for x in added)

    def __getstate__(self):
        return self.__dict__ | {"_tokenizer": None}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words."""
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_buffer(self.content)
        length, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 5000):
            part = [w.decode("utf-8") for w in words[lo : lo + 5000]]
            encoded = self._tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            length.append(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(part)))
            flat.append(np.array(encoded.ids, np.int64))
        return np.concatenate(length), np.concatenate(flat)


def code_lengths(count: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each id in an optimal prefix code of at most longest bits, by package-merge; 0 for ids without counts."""
    used = np.flatnonzero(count)
    out = np.zeros(len(count), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(count[used], kind="stable")]
    leaves = count[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate((leaves, packages))
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    need, length = 2 * (len(leaves) - 1), np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:need].sum())
        length[:own] += 1
        need = 2 * (need - own)
    out[order] = length
    return out


def canonical(length: np.ndarray) -> np.ndarray:
    """Codes for code lengths: ascending by length, then id."""
    code, out, last = 0, np.zeros(len(length), np.uint64), 0
    used = np.flatnonzero(length)
    for i in used[np.argsort(length[used], kind="stable")]:
        code <<= int(length[i]) - last
        last = int(length[i])
        out[i] = code
        code += 1
    return out


def pack(ids: np.ndarray, n: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of documents of n ids each: bytes, byte offsets of documents, and each lane's bit offset in its document."""
    size = length[ids]
    ends = np.cumsum(size)
    last = np.cumsum(n)
    begin = ends[last - n] - size[last - n]
    byte = np.concatenate(([0], np.cumsum(-(-(ends[last - 1] - begin) // 8))))
    place = ends - size + np.repeat(byte[:-1] * 8 - begin, n)
    value = (code << (64 - length).astype(np.uint64))[ids] >> (place & 31).astype(np.uint64)
    word = place >> 5
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    word = word[starts]
    out = np.zeros((byte[-1] >> 2) + 3, np.uint64)
    out[word] += np.add.reduceat(value >> np.uint64(32), starts)
    out[word + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), starts)
    lane_n = -(-n // LANE)
    lane = ragged(lane_n, np.zeros(len(n), np.int64)) * LANE + np.repeat(last - n, lane_n)
    return out.astype(">u4").view(np.uint8)[: byte[-1]], byte, place[lane] - np.repeat(byte[:-1] * 8, lane_n)


class Decoder:
    """Table-driven decoding of blocks."""

    def __init__(self, length: np.ndarray):
        self.length, self._table = length, None

    def __getstate__(self):
        return {"length": self.length, "_table": None}

    def table(self) -> tuple[int, np.ndarray, np.ndarray]:
        if self._table is None:
            width = int(self.length.max())
            used = np.flatnonzero(self.length)
            used = used[np.argsort(self.length[used], kind="stable")]
            size = self.length[used]
            ids = np.repeat(used, 1 << (width - size)).astype(np.uint32)
            bits = np.repeat(size, 1 << (width - size)).astype(np.uint8)
            room = (1 << width) - len(ids)  # only a code of one id leaves room
            self._table = width, np.pad(ids, (0, room)), np.pad(bits, (0, room), constant_values=1)
        return self._table

    def __call__(self, payload: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of lanes that start at bits start and hold n ids each, one lane after another."""
        width, ids, bits = self.table()
        data = np.concatenate((payload, np.zeros(8, np.uint8))).astype(np.uint64)
        out, to = np.empty(int(n.sum()), np.uint32), np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        place, to, falling = start[order].astype(np.int64), to[order], -n[order]
        for k in range(int(n.max(initial=0))):
            live = int(np.searchsorted(falling, -k))  # lanes of more than k ids
            p = place[:live]
            b = p >> 3
            window = data[b] << np.uint64(32) | data[b + 1] << np.uint64(24) | data[b + 2] << np.uint64(16) | data[b + 3] << np.uint64(8) | data[b + 4]
            key = (window >> (40 - width - (p & 7)).astype(np.uint64)) & np.uint64((1 << width) - 1)
            out[to[:live] + k] = ids[key]
            place[:live] = p + bits[key]
        return out


BLOCK = "part int, block int, first long, doc_id array<long>, n_tokens array<long>, lanes binary, payload binary, crc long"


def _counts(pages: DataFrame, rows: int, end: int) -> np.ndarray:
    """How often each id occurs: the words' counts times their ids, and the end id for each document."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for v, c in zip(batch["ids"].to_pylist(), batch["counts"].to_pylist()):
                n, ids = map(unvarint, bpe._unpacked(v))
                own = np.bincount(ids, np.repeat(unvarint(bpe._unpacked(c)[0]), n)).astype(np.int64)
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    found = pages.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a vocabulary at most
    out = np.zeros(max([end, *(r.id for r in found)]) + 1, np.int64)
    out[[r.id for r in found]] = [r.n for r in found]
    out[end] += rows
    return out


def write(docs: DataFrame, encoder, path: str, end: int = 2, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append the end id, and write the files under path.

    A null text has the end id alone. Ids of documents are cast to long; rows with a null id come first, and ties
    are ordered by a hash of the text, so that a repeated id is no single range. No documents give empty tables. The
    encoder's special tokens (``specials``, if it has any) are looked for in texts first, each a word of its own.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    split = bpe.Split(docs, "text", specials=getattr(encoder, "specials", ()))
    pages = staged(bpe.encoded_pages(split.pages, encoder), "pages")
    rows = split.positions.count()
    length = code_lengths(_counts(pages, rows, end))
    shared = spark.sparkContext.broadcast((length, canonical(length)))
    share = min(1.0, SAMPLE / max(rows, 1))
    sampled = split.positions.where(F.pmod(F.xxhash64("id", "tie"), F.lit(1 << 20)) < share * (1 << 20)).select("id", "tie").collect()
    keys = sorted((-1 << 63 if r.id is None else r.id, r.tie) for r in sampled)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []
    cut = spark.sparkContext.broadcast((np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)))

    def huffman(whole: pa.Table) -> pa.Table:
        size, code = shared.value
        out = [pa.schema([("part", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("lanes", pa.binary()), ("payload", pa.binary())]).empty_table()]
        for lo in range(0, whole.num_rows, 500):
            batch = whole.slice(lo, 500).combine_chunks()
            raw, ends = text_buffers(batch["ids"])
            n = np.diff(ends) // 4
            ids = np.insert(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), np.cumsum(n), end)
            data, byte, lane = pack(ids, n + 1, size, code)
            packed, width = varint(lane)
            many = -(-(n + 1) // LANE)
            lanes = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(many)))]
            key = batch["id"].fill_null(-1 << 63).to_numpy()
            tie, (a, t) = batch["tie"].to_numpy(), cut.value
            part = np.searchsorted(a, key, "left")
            for k in np.flatnonzero(np.isin(key, a)):  # ids at which ranges are cut
                part[k] += np.searchsorted(t[a == key[k]], tie[k], "right")
            columns = [pa.array(part, pa.int32()), batch["id"], batch["tie"], pa.array(n + 1), binary_array(packed, lanes), binary_array(data, byte)]
            out.append(pa.table(columns, ["part", "id", "tie", "n", "lanes", "payload"]))
        return pa.concat_tables(out)

    def blocks(batches):
        part, block, first, held, size = None, 0, 0, [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("lanes", pa.binary()), ("payload", pa.binary()), ("crc", pa.int64())])

        def row():
            ids, n, lanes, payload = zip(*held)
            start = 8 * np.cumsum([0, *map(len, payload[:-1])])
            at = unvarint(np.frombuffer(b"".join(lanes), np.uint8)) + np.repeat(start, -(-np.array(n) // LANE))
            lanes, payload = varint(np.diff(at, prepend=0))[0].tobytes(), b"".join(payload)
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": first, "doc_id": ids, "n_tokens": n, "lanes": lanes, "payload": payload, "crc": zlib.crc32(payload)}], schema=schema)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.select(["part", "id", "n", "lanes", "payload"]).columns)):
                if held and (r[0] != part or size >= BLOCK_BYTES):
                    yield row()
                    block, first, held, size = block + 1, first + sum(h[1] for h in held), [], 0
                if r[0] != part:
                    part, block, first = r[0], 0, 0
                held.append(r[1:])
                size += len(r[4])
        if held:
            yield row()

    coded = bpe.with_ids(split, "ids", pages, (huffman, "part int, id long, tie long, n long, lanes binary, payload binary"))
    sorted_ = coded.repartition(parts, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "tie")
    sorted_.mapInArrow(blocks, BLOCK).write.parquet(f"{path}/blocks")
    code = [(int(i), int(length[i])) for i in np.flatnonzero(length)]
    spark.createDataFrame(code, "id int, length int").write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are little-endian unsigned 32-bit integers.

    start is the number of ids of all documents before it. A block whose checksum differs raises an error.
    """
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    code = spark.read.parquet(f"{path}/code").collect()
    length = np.zeros(max([0, *(r.id for r in code)]) + 1, np.int64)
    length[[r.id for r in code]] = [r.length for r in code]
    total = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before, at = {}, 0
    for r in sorted(total):
        before[r.part] = at
        at += r.n
    shared = spark.sparkContext.broadcast((Decoder(length), before))

    def decode(batches):
        decoder, starts = shared.value
        for batch in batches:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if zlib.crc32(r["payload"]) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                n = np.array(r["n_tokens"], np.int64)
                lane_n = -(-n // LANE)
                lane = np.cumsum(unvarint(np.frombuffer(r["lanes"], np.uint8)))
                own = np.full(len(lane), LANE)
                own[np.cumsum(lane_n) - 1] = n - (lane_n - 1) * LANE
                ids = decoder(np.frombuffer(r["payload"], np.uint8), lane, own).astype("<u4")
                ends = np.concatenate(([0], np.cumsum(n)))
                first = starts[r["part"]] + r["first"] + ends[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"], pa.int64()), pa.array(first), pa.array(n), binary_array(ids.view(np.uint8), 4 * ends)], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
