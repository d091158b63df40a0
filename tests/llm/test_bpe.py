import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import bpe
from shelfmark.llm._shared import unvarint, varint
from shelfmark.llm.queries import vocabulary_file

PATTERN = regex.compile(public_tokenizers.PATTERN)
RANKS = vocabulary_file("byte_bpe_50k.tiktoken")
TABLE = bpe.read_ranks(RANKS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={})


def split(texts):
    data = [t.encode() for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    raw = b"".join(data)
    at = np.append(bpe.token_starts(raw, ends[:-1]), len(raw))
    out = [[] for _ in texts]
    for a, b in zip(at[:-1], at[1:]):
        out[np.searchsorted(ends, a, "right") - 1].append(raw[a:b].decode())
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="aab'stmdrevlL  \n\t\r  é漢1²!?_　\x1c\x85😀", max_size=14), min_size=1, max_size=3))
def test_pre_tokens_are_the_patterns_matches(texts):
    assert split(texts) == [PATTERN.findall(t) for t in texts]


def test_merges_are_the_librarys():
    rng = random.Random(3)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 80))) for _ in range(200)]
    words += [b"a" * 700, b"theretherethethe" * 50, " naïveté".encode(), b"x" * 39, b"x" * 40]
    for w in words:
        assert bpe.merge(w, TABLE) == TIKTOKEN._core_bpe.encode_single_piece(w)


def test_equal_words_are_dealt_alike():
    from shelfmark.llm._shared import text_buffers
    import pyarrow as pa

    words = [b"a", b"the", b" the", b"x" * 5000, "é".encode(), b"eht"]
    bucket = {w: bpe.dealt(*text_buffers(pa.array([w, b"other"], pa.binary())), 64)[0] for w in words}
    assert bpe.dealt(*text_buffers(pa.array(words, pa.binary())), 64).tolist() == [bucket[w] for w in words] and len(set(bucket.values())) > 3
    many = bpe.dealt(*text_buffers(pa.array([f" w{k}".encode() for k in range(20_000)], pa.binary())), 16)
    assert np.bincount(many, minlength=16).min() > 1000


def test_varint_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**28, 2**34])
    assert (unvarint(varint(x)[0]) == x).all()
    assert len(unvarint(varint(x[:0])[0])) == 0


def encoded(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _block string")
    return bpe.decode(bpe.encode(docs, bpe.RankEncoder(RANKS)), bpe.token_table(RANKS))


def test_round_trip_with_nulls_repeats_and_clashing_names(spark):
    long = "many words, and don't stop " * 20_000
    rows = [(1, "Hello  world's\n end", "a"), (1, "Hello  world's\n end", "b"), (None, "naïve 漢字 12", None), (2, None, "c"), (3, "", "d"), (4, long, "e"), (5, "x" * 5000, "f")]
    out = encoded(spark, rows).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r._block or "") for r in out) == sorted((r[0] is None, r[0] or 0, r[2] or "") for r in rows)
    texts = {r[2]: r[1] or "" for r in rows}
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(texts[r._block])
        assert bytes(r.decoded).decode() == texts[r._block]


def test_empty_table_and_only_empty_texts(spark):
    assert encoded(spark, []).collect() == []
    assert [(r.ids, r.decoded) for r in encoded(spark, [(1, None, None), (2, "", None)]).collect()] == [(b"", b"")] * 2


def test_decoding_null_ids(spark):
    df = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert {r.decoded for r in bpe.decode(df, bpe.token_table(RANKS)).collect()} == {None, b""}


def test_slices_smaller_than_the_input(monkeypatch):
    import pyarrow as pa

    texts = [f"document {k} with the word{k % 7} and é{k}" for k in range(200)]
    whole = bpe._Block(pa.table({"text": texts}), "text")
    monkeypatch.setattr(bpe, "SLICE_BYTES", 50)
    small = bpe._Block(pa.table({"text": texts}), "text")
    assert small.key == whole.key and (small.codes == whole.codes).all() and (small.tokens_of == whole.tokens_of).all()


@pytest.mark.parametrize("arrow_bytes", ["64m", "20k"])
def test_many_blocks_in_the_workers(spark, arrow_bytes):
    rows = [(k, f"document {k} with the word{k % 7} and é{k} " * (1 + k % 50), "w" * 50) for k in range(600)]
    texts = {r[0]: r[1] for r in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, wide string")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", arrow_bytes)
    try:
        split = bpe.Split(docs, "text", block_bytes=5000)
        assert split.pages.select("block").distinct().count() > 20
        out = bpe.decode(bpe.encode(docs, bpe.RankEncoder(RANKS), block_bytes=5000), bpe.token_table(RANKS)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sorted(r.doc_id for r in out) == list(range(600))
    for r in out:
        assert bytes(r.decoded).decode() == texts[r.doc_id] and r.wide == "w" * 50
        assert np.frombuffer(r.ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(texts[r.doc_id])


def test_positions_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string")
    plan = bpe.encode(docs, bpe.RankEncoder(RANKS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # words to buckets, ids to blocks


def test_blocks_do_not_depend_on_batches():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [rng.choice([None, "", "é word " * rng.randrange(60), f"w{k} " * rng.randrange(40)]) for k in range(5000)]
    table = pa.table({"n": range(len(texts)), "text": texts})

    def cut(rows):
        blocks = list(bpe._blocks(iter(table.to_batches(max_chunksize=rows)), "text", (), 3000))
        assert [n for b in blocks for n in b.table["n"].to_pylist()] == list(range(len(texts)))
        return [(b.key, b.table.num_rows) for b in blocks]

    assert len(cut(5000)) > 50
    assert cut(5000) == cut(1) == cut(7) == cut(2003)
