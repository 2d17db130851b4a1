"""A training-corpus pipeline: each stage works on all that its predecessor kept.

Each stage is (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet in the shared folder and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import mixing, pieces, secrets, similar, toxicity
from lexspark.llm.common import fresh, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from the labels of these documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "__lx_score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard >= 0.8 of five-word shingles stays: the one with the smallest doc_id."""
    return similar.drop_similar(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking credentials are masked; widely copied examples and all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their target weights."""
    return mixing.mix(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, begin and end ids included: doc_id, source, n_tokens, token_ids."""
    ids = pieces.encode(docs.select("doc_id", "source", "text"))
    return ids.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]

#: SQL can express neither the classifier nor the fingerprints nor the ids; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
