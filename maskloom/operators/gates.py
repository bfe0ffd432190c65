"""Admission of files, manifests, and the pairing of answers with originals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import categories as C
from maskloom.functions.tagging import Options
from maskloom.sources import sinks
from maskloom.sources.ooxml import refused
from maskloom.sources.text import EXTENSIONS

# Limits on files.
MAX_BYTES, MAX_TEXT_BYTES = 100 << 20, 20 << 20
SCHEMA_VERSION, READABLE_VERSIONS = 2, (1, 2)


def sized(files: DataFrame) -> DataFrame:
    """files with ``reason``: why a file isn't admitted by its kind and size alone, else null; one that the intake gave stays."""
    text = F.col("ext").isin("txt", "csv", "html")
    reason = (
        F.when(F.col("ext") == "doc", "the older binary format is not supported")
        .when(~F.col("ext").isin(*EXTENSIONS), "unknown kind")
        .when(F.col("length") > MAX_BYTES, "too large")
        .when(text & (F.col("length") > MAX_TEXT_BYTES), "too large for text")
        .when(F.col("length") == 0, "empty")
    )
    return files.withColumn("reason", F.coalesce(F.col("reason"), reason) if "reason" in files.columns else reason)


def cell_looked_at(cell: Column, is_text: Column) -> Column:
    """Whether a typed cell is masked: texts always, numbers only with ten digits or more."""
    return is_text | (F.length(F.regexp_replace(cell, "[^0-9]", "")) >= 10)


def gated(files: DataFrame) -> DataFrame:
    """doc_id, ok, reason for every file; archives are opened and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, ext, content, reason = (c.to_pylist() for c in b.columns)
            why = [r or (refused(c) if e in ("docx", "xlsx") else None) for e, c, r in zip(ext, content, reason, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.string()), pa.array([w is None for w in why]), pa.array(why, pa.string())], ["doc_id", "ok", "reason"])

    rows = sized(files).select(F.col("doc_id").cast("string"), "ext", F.when(F.col("reason").isNull(), F.col("content")).alias("content"), "reason")
    return rows.mapInArrow(run, "doc_id string, ok boolean, reason string")


def manifests(originals: DataFrame, options: Options) -> DataFrame:
    """originals: original_name, content, output_name. A manifest row each; it never holds labels or values."""
    named = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v)) for k, v in options.as_map().items())))
    return originals.select(
        F.lit(SCHEMA_VERSION).alias("schema"), "original_name", F.sha2("content", 256).alias("original_sha256"), "output_name",
        F.lit(C.RULES_VERSION).alias("rules_version"), named.alias("options"),
    )


def matched_manifests(originals: DataFrame, manifest: DataFrame) -> DataFrame:
    """original_name, original_sha256, options, rules_version of the manifest that belongs to each original.

    Refused, with a reason, are originals without one, with conflicting options, or of other rules, whose
    labels would point elsewhere.
    """
    own = originals.select("original_name", F.sha2("content", 256).alias("original_sha256"))
    known = manifest.where(F.col("schema").isin(*READABLE_VERSIONS)).withColumn("said", F.to_json("options"))
    found = known.groupBy("original_name", "original_sha256").agg(F.count_distinct("said").alias("ways"), F.min("said").alias("options"), F.max("rules_version").alias("rules_version"))
    joined = own.join(found, ["original_name", "original_sha256"], "left")
    reason = F.when(F.col("ways").isNull(), "no manifest").when(F.col("ways") > 1, "conflicting options").when(F.col("rules_version") != C.RULES_VERSION, "other rules")
    return joined.select("original_name", "original_sha256", "options", "rules_version", reason.alias("reason"))


def pairs(answers: DataFrame, originals: DataFrame) -> DataFrame:
    """Answers (path, stem) with the originals (path, stem) of the same name without marks; ambiguous ones are marked so."""
    a = answers.select(F.col("path").alias("answer"), sinks.stripped(F.col("stem")).alias("name"))
    o = originals.where(~F.col("stem").rlike("(?iu)" + sinks._MARKS)).select(F.col("path").alias("original"), sinks.stripped(F.col("stem")).alias("name"))
    counted = o.groupBy("name").agg(F.count("*").alias("n"), F.min("original").alias("original"))
    return a.join(counted, "name", "left").select("answer", F.when(F.col("n") == 1, F.col("original")).alias("original"), F.when(F.col("n").isNull(), "no original").when(F.col("n") > 1, "several originals").alias("reason"))
