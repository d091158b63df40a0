"""The registered queries of this subpackage: op1 to op13 and the pipeline, with SQL where SQL can express one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, jaccard, langid, licenses, periodic, phrases, quality, sharding, simhash, token_files, toxicity
from ._shared import shared_dir, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> bytes:
    """Content of a vocabulary file, read by the driver alone."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary_file("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.decode(bpe.encode(docs, bpe.RankEncoder(ranks)), bpe.token_table(ranks))
    n = F.expr("octet_length(ids) div 4").cast("long")
    return tokens.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, bits=64, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def _fold(k: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(5) != 0))
    found = langid.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(_fold(3) != 1))
    found = toxicity.score(docs, model, keep_text=False)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").isNotNull().alias("has_text"))
    x = staged(quality.measured(docs, out="x"), "statistics")  # measured once, for training and for scores
    known = x.withColumn("x", F.when(F.col("has_text"), F.col("x")))
    model = quality.train(known, _table(spark, sf_dir, "labels").where(_fold(3) != 1), statistics_col="x")
    found = quality.score(x, model, keep_text=False, statistics_col="x")
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/shelfmark/{uuid.uuid4().hex}/tokens"
    encoder = token_files.LibraryEncoder(vocabulary_file("byte_bpe_50k.json"))
    token_files.write(_table(spark, sf_dir, "documents"), encoder, path, end=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=8)


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@query()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(_table(spark, sf_dir, "documents"), plant=True)


@query(jaccard.SQL)
def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_groups(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("component", "component_id")


@query(phrases.SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; it takes helpers from here

    return corpus_pipeline.run(spark, sf_dir)
