import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import token_files as tf
from shelfmark.llm.queries import vocabulary_file


def plain_huffman_cost(count):
    import heapq

    heap = [c for c in count if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


@pytest.mark.parametrize("n", [1, 2, 3, 17, 400])
def test_lengths_are_optimal_and_limited(n):
    rng = np.random.default_rng(n)
    count = rng.integers(0, 50, n) ** 2
    count[0] = 1
    assert (count * tf.code_lengths(count, 30)).sum() == (plain_huffman_cost(count) or (count > 0).sum() and count.sum())
    steep = 2 ** np.arange(min(n, 30))
    short = tf.code_lengths(steep, 6)
    assert short.max() <= max(6, 1) and (2.0 ** -short[short > 0]).sum() <= 1


def test_pack_and_decode_round_trip():
    rng = np.random.default_rng(1)
    n = np.array([1, 5, 1024, 1025, 3000, 2])
    ids = rng.zipf(1.3, n.sum()) % 5000
    length = tf.code_lengths(np.bincount(ids))
    data, byte, lane = tf.pack(ids, n, length, tf.canonical(length))
    many = -(-n // tf.LANE)
    start = lane + np.repeat(byte[:-1] * 8, many)
    own = np.full(len(start), tf.LANE)
    own[np.cumsum(many) - 1] = n - (many - 1) * tf.LANE
    assert (tf.Decoder(length)(data, start, own) == ids).all()


def test_canonical_codes_are_prefix_free():
    length = tf.code_lengths(np.random.default_rng(2).integers(1, 1000, 60))
    codes = [f"{int(c):0{n}b}" for c, n in zip(tf.canonical(length), length)]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)


#: Texts around the added token of the file, also where two texts meet.
SPECIAL = ["<|endoftext|>", "a  <|endoftext|>  b", "<|endof", "text|>", "é<|endoftext|><|endoftext|>don't", "<|<|endoftext|>|> x", "12<|endoftext|>34 \n<|endoftext|>\n", "no"]


@pytest.mark.parametrize("rows", [[], [(7, None, "x")], [(k, t, "s") for k, t in enumerate(SPECIAL)], [(3, "Hello <|endoftext|> world's\n\n  end", "x"), (1, "", "y"), (None, "naïve 漢字", "z"), (3, "again " * 3000, "v"), (-5, None, "w")]])
def test_files_hold_the_librarys_ids_in_order(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    tf.write(docs, tf.LibraryEncoder(vocabulary_file("byte_bpe_50k.json")), str(tmp_path / "out"))
    got = sorted(tf.read(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((r[0] is not None, r[0] or 0), [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[0] for w in want]
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted(w[1] for w in want)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens


def test_ties_at_range_borders_and_small_blocks(spark, tmp_path, monkeypatch):
    rows = [(5, f"text number {k}") for k in range(60)] + [(k, "other") for k in range(20)]
    tf.write(spark.createDataFrame(rows, "doc_id long, text string"), tf.LibraryEncoder(vocabulary_file("byte_bpe_50k.json")), str(tmp_path / "out"))
    got = sorted(tf.read(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)


def test_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "out")
    tf.write(spark.createDataFrame([(1, "hello there")], "doc_id long, text string"), tf.LibraryEncoder(vocabulary_file("byte_bpe_50k.json")), path)
    blocks = spark.read.parquet(f"{path}/blocks").selectExpr("part", "block", "first", "doc_id", "n_tokens", "lanes", "payload", "crc + 1 AS crc")
    blocks.write.parquet(str(tmp_path / "bad/blocks"))
    spark.read.parquet(f"{path}/code").write.parquet(str(tmp_path / "bad/code"))
    with pytest.raises(Exception, match="damaged"):
        tf.read(spark, str(tmp_path / "bad")).collect()
    assert zlib.crc32(b"") == 0
