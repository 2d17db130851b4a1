"""The queries of the training-data operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, mixing, neighbours, pieces, quality, secrets, sharding, simhash, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neighbours": neighbours.op1_neighbours,
        "op2_mixing": mixing.op2_mixing,
        "op3_embeddings": embeddings.op3_embeddings,
        "op4_substrings": substrings.op4_substrings,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_secrets": secrets.op6_secrets,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_simhash": simhash.op8_simhash,
        "op9_sharding": sharding.op9_sharding,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.OP2_SQL, "op3_embeddings": embeddings.OP3_SQL, "op4_substrings": substrings.OP4_SQL, "op6_secrets": secrets.OP6_SQL}
