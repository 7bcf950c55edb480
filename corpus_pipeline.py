"""From raw documents to training shards: five stages, each written as Parquet and read again by the next.

quality -> near duplicates -> decontamination -> mixing -> sharding. Every stage takes (spark, docs, sf_dir); all but the last
return the columns of documents, and the last adds shard and slot.

Defined cases: as the operators define them. Documents are told apart by doc_id and text: rows equal in both count as one document in
the near-duplicate stage, and rows without a doc_id pass it unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import decontaminate, jaccard, mixing, quality, shard
from clickloom.llm.common import materialize, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier accepts."""
    return quality.judge(docs, quality.train(docs)).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of every class of near duplicates the document that names it."""
    return jaccard.representatives(docs, similarity=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose blocks the mix takes: sources weigh their bytes to the power 0.7, so large ones lose what is beyond that, and the mix
    ends with the first source to run out (one far below the mean size does not end it)."""
    return mixing.mix(docs, fill=False, block_bytes=4096).where("chosen").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every document into its shard and slot."""
    return shard.shard(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]

#: SQL cannot express the classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
