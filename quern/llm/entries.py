"""Queries of the corpus operators, each with production parameters over its whole table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, chat, decontaminate, langid, mixing, simhash, token_planes, toxicity, warc, weighted_sampling
from .storage import new_path, table, written


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; operators themselves take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_planes.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_planes.read_documents(spark, path)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, a table of turns, and one that is a JSON record of another layout."""
    hard = [(-7, json.dumps({"prompt": "</s>[INST] ok [/INST]", "response": "</s>[INST] ok [/INST]"}))]
    records = chat.json_turns(spark.createDataFrame(hard, "conv_id long, record string"))
    more = records.select("conv_id", F.posexplode("turns").alias("turn", "said")).select("conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text")
    turns = chat.row_turns(table(spark, sf_dir, "conversations")).union(more)
    out = written(chat.formatted(turns), "chats")
    return chat.digests(chat.parsed(out))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mixing.sized(table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(rows).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    captures = written(warc.assemble(warc.read_warc(spark, path, payloads=False)), "captures")
    found = warc.resolve(captures)

    def page(metadata: str) -> F.Column:
        return F.regexp_extract(F.col(f"{metadata}.payload").cast("string"), r"^page_id: (-?\d+)$", 1).try_cast("long")

    revisit = F.col("main.type") == "revisit"
    return found.select(
        page("metadata").alias("page_id"), F.col("stored.main.payload_bytes").alias("payload_bytes"), F.col("stored.main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.when(revisit, page("stored.metadata")).alias("refers_to"),
    )


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.compare_with_edits(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return attribution.count_lines(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = langid.held_out(folds=4, fold=2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_chat": op2_chat,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_language": op7_language,
    "op8_attribution": op8_attribution,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat": chat.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS w FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN w = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN w <> page_id THEN w END AS refers_to
FROM r
""",
}
