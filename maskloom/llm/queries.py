"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskloom.llm import secrets, url_filters
from maskloom.llm.common import table
from maskloom.llm.filter_audit import ORACLE as AUDIT
from maskloom.llm.filter_audit import filter_interactions
from maskloom.llm.lexical import ORACLE as RANKED
from maskloom.llm.lexical import ranked
from maskloom.llm.neighbours import nearest
from maskloom.llm.quality import quality_posteriors
from maskloom.llm.segmentation import segmented
from maskloom.llm.sharding import sharded
from maskloom.llm.simhash import simhash_components
from maskloom.llm.suffix import repeats_removed
from maskloom.llm.super_kmers import ORACLE as PASSAGES
from maskloom.llm.super_kmers import passages_removed
from maskloom.llm.tiling import contaminated
from maskloom.llm.warc import page_derivatives


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_derivatives(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.temporal_list_join(url_filters.dated_pages(pages), url_filters.dated_entries(pages))


def op9_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_removed(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_suffixes": op2_suffixes,
    "op3_neighbours": op3_neighbours,
    "op4_tiling": op4_tiling,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_url_filters": op8_url_filters,
    "op9_segmentation": op9_segmentation,
    "op10_secrets": op10_secrets,
    "op11_filters": op11_filters,
    "op12_search": op12_search,
    "op13_passages": op13_passages,
}
ORACLES: dict[str, str] = {"op8_url_filters": url_filters.ORACLE, "op10_secrets": secrets.ORACLE, "op11_filters": AUDIT, "op12_search": RANKED, "op13_passages": PASSAGES}
