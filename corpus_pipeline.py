"""Corpus pipeline: five stages from raw documents to token ids.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all but the last
return the columns of documents. Between stages the rows are written as Parquet and read again, so a
lost executor costs one stage's tasks at most.

quality rules           documents that fail the base rules or a rule certified in their language go
n-gram Jaccard join     of each component of near copies the document of lowest id stays
decontamination         documents with a passage of a benchmark item go
personal data           values and the terms that give them away are replaced in the text
byte-level BPE          token ids, and the digest of the text decoded from them

Word splitting, alignment scores and merges have no SQL form, so there is no statement for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haplodeck.llm import byte_bpe, decontam, jaccard_join, pii, quality_rules
from haplodeck.llm.tables import read, written

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_component(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.tokenised(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("personal data", sanitise),
    ("byte-level BPE", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: doc_id, n_tokens, ids, decoded_sha256 of what is left."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
