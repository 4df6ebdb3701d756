"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm import (
    alignment, bpe, code_search, decontamination, languages, merkle, near_dedup, personal_data, quality, secrets, substring_dedup, token_counts,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op3_minhash_near_dedup")
def op3(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_secret_scan")
def op1(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op7_decontamination")
def op7(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


@query(
    "op5_code_search",
    """
    WITH queries AS (SELECT vec_id AS query_id, embedding AS asked FROM embeddings WHERE vec_id % 100 = 0),
    held AS (
        SELECT query_id, vec_id,
            list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (asked[i] > 0) <> (embedding[i] > 0) THEN 1 ELSE 0 END))::BIGINT AS distance
        FROM queries, embeddings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM held)
    SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
    """,
)
def op5(spark, sf_dir):
    return code_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query("op10_quality")
def op10(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_personal_data")
def op2(spark, sf_dir):
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_language_id")
def op11(spark, sf_dir):
    return languages.identify(table(spark, sf_dir, "documents"))


@query("op12_cross_tokenizer_alignment")
def op12(spark, sf_dir):
    tools = alignment.tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), tools)


@query("op13_merkle_manifest", merkle.SQL)
def op13(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"))
