"""The corpus pipeline: documents to token ids, in stages that each keep the columns of documents but for the last.

Every stage works on all that its predecessor kept. Rows whose text is null go at the first stage, since no language
can be told of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontam, langid, simhash, toxicity
from shelfmark.llm._shared import free_name, staged
from shelfmark.llm.queries import _fold, _table, vocabulary_file

#: Documents whose best language has less of the likelihood are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Documents with this toxicity score are rejected.
TOXIC_SCORE = 0.7
#: Near duplicates: five-word shingles at similarity 0.8, verified. Fingerprints of 128 bits then differ in 19, with a standard deviation of 4.
NEAR = {"words": 5, "bits": 128, "radius": 40, "parts": 0, "similarity": 0.8}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told."""
    model = langid.train(docs.where(_fold(5) != 0))
    lang, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    found = langid.predict(docs, model, lang_pred=lang, score=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(_fold(3) != 1))
    score = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < TOXIC_SCORE).drop(score)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_first(docs, **NEAR)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents (little-endian unsigned 32-bit integers), and a digest of what they decode to."""
    ranks = vocabulary_file("byte_bpe_50k.tiktoken")
    tokens = bpe.decode(bpe.encode(docs, bpe.RankEncoder(ranks)), bpe.token_table(ranks))
    n = F.expr("octet_length(ids) div 4").cast("long")
    return tokens.select("doc_id", "lang", "source", "n_chars", "ids", n.alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("tokens", tokenize),
]

#: Models and fingerprints are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
