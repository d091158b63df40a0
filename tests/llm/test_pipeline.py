"""The pipeline against a version in plain Python that shares only the trained models."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import langid, simhash, toxicity
from shelfmark.llm.queries import _fold
from tests.llm.test_bpe import TIKTOKEN
from tests.llm.test_decontam import brute
from tests.llm.test_simhash import roots

SF = "/root/testdata/sf0.001"


def near_groups(texts):
    """Smallest id that each id reaches over pairs at similarity 0.8, by comparing the shingles of all pairs."""
    seen = {i: collections.Counter(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts.items()}
    alike = lambda a, b: a == b or (a & b).total() >= 0.8 * (a | b).total() > 0
    return roots(texts, [(i, j) for i in texts for j in texts if i < j and alike(seen[i], seen[j])])


def test_stages_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    language = langid.train(table.where(_fold(5) != 0))
    kept = {}
    for i, t in docs.items():
        bits = language.code_lengths(*langid.lowered(__import__("pyarrow").array([t])))[0]
        share = 1 / np.exp2(-np.minimum(bits - bits.min(), 1000)).sum()
        if any(c.isalpha() for c in t) and share >= 0.5:
            kept[i] = t
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(_fold(3) != 1)
    ids = spark.createDataFrame([(i,) for i in kept], "doc_id long")
    model = toxicity.train(table.join(ids, "doc_id"), labels)
    if model.trees:
        kept = {i: t for i, t in kept.items() if model.curve(model.trees(np.array([model.features(t.encode())])))[0] < 0.7}
    else:
        kept = {i: t for i, t in kept.items() if model.features(t.encode())[0] == 0}
    group = near_groups(kept)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute(kept.items(), items)}
    kept = {i: t for i, t in kept.items() if i not in leaked}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        assert np.frombuffer(got[i].ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(t)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("rows", [0, 3])
def test_stages_handle_empty_tables_nulls_and_more_columns(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(rows)
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0)], docs.schema)
    docs = docs.union(odd).withColumn("score", F.lit("own")).withColumn("_block", F.lit(1)) if rows else docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        if name != "tokens":
            assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()}.isdisjoint({-1, -2})


def test_stage_order_and_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "decontamination", "tokens"]
    assert collections.Counter(callable(f) for _, f in corpus_pipeline.STAGES) == {True: 5}
