"""A training-data pipeline of the operators in ``orrery.llm``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes
every stage's result and reads it again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import materialise, table
from orrery.llm.decontaminate import decontaminate
from orrery.llm.packing import pack_documents
from orrery.llm.secretscan import redact
from orrery.llm.simhash import deduplicate
from orrery.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near-duplicates."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with secrets replaced in its text."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise what is left and pack it; one row per piece."""
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("simhash-near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret-scans", secret_scan),
    ("best-fit-packing", packing),
]

#: Learnt scores, random walks and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again.

    Rows are judged one by one: those that share a doc_id, or have none, may part in
    toxicity and decontamination. A null text is an empty one throughout and stays
    null until packing, where it is the end id alone. Near-duplicates keep the least doc_id of
    a group, with every row that has it; rows without doc_id stay only where their
    group has no doc_id at all. Repeated rows that stay are packed once each; an empty table gives
    an empty table; other columns of documents pass through to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
