"""The corpus pipeline: five stages over documents, each one of the operators of maskloom.llm.

1. quality classifier: documents are dropped that are probably of low quality or toxic.
2. SimHash near-dedup: of each group of near duplicates (shingles of five words, similarity 0.8 or more)
   the document with the smallest doc_id stays.
3. benchmark decontamination: documents that hold a test item go.
4. secret scans: live secrets are masked in the texts.
5. SentencePiece segmentation: piece ids of the texts that are left, with their n best segmentations.

Each function takes (spark, docs, sf_dir), docs being what the stage before kept, and works on all of it.
All but the last return the columns of documents. No stage has an SQL form: three fit a model or search
with hashes that SQL lacks, so tests hold stages 2 to 5 against brute-force versions and stage 1 against
plain arithmetic on its evidence and held-out labels.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm.common import removed, shared_folder, table
from maskloom.llm.quality import good_documents
from maskloom.llm.secrets import secrets_masked
from maskloom.llm.segmentation import segmented
from maskloom.llm.simhash import near_duplicates_removed
from maskloom.llm.tiling import decontaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_masked(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmented(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", segmentation),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written to the shared folder and read again, and deleted once the next one is written."""
    shared, before = shared_folder(spark), None
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{shared}/pipeline-{uuid.uuid4().hex}")
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    return docs
