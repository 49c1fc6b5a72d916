"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing, token output.

Each stage takes all that its predecessor kept; all but the last return the columns of documents,
extra ones too, whatever their names. Stages work on whole texts. A null or empty text has no
language, so the first stage rejects it, with every text that has no letter; null ids, repeated rows
and empty tables are treated as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, langid, mixing, near_texts, token_planes
from quern.llm.entries import tokenizer_path
from quern.llm.storage import new_path, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, learned from this stage's own labelled rows, does not reject."""
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are similar by 0.8 or more."""
    return near_texts.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_planes.write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"))
    return token_planes.read_documents(spark, path)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL has no SimHash, no fitted model and no tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
