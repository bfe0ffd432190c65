"""Files from end to end: mask a table of files, restore edited answers, publish the results.

A file is admitted and read by its kind into segments; segments are masked or restored as DataFrames, all documents
together; and each file is written back with its new segments: DOCX and XLSX as what they are, text, CSV and HTML as
text. Restoring rebuilds the labels from the unchanged original with the options of its manifest; labels are stored
nowhere. A file that is refused has a reason and no content.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.tagging import Options
from maskloom.operators import entities, gates, masking
from maskloom.operators import labels as L
from maskloom.operators.rounds import kept
from maskloom.sources import ooxml, sinks, text
from maskloom.sources.publish import published  # noqa: F401

# The kinds of answers that can be restored.
ANSWERS = ("txt", "md", "docx", "xlsx")
_WRITTEN = "doc_id string, kind string, content binary, reason string"


def rewritten(ext: str, raw: bytes, change: Callable[[list[str]], list[str]]) -> tuple[str, bytes]:
    """The file with its segments changed together, and the kind of what comes out."""
    if ext == "docx":
        return "docx", ooxml.docx_changed(raw, change)
    if ext == "xlsx":
        return "xlsx", ooxml.xlsx_changed(raw, change)
    lines = {"csv": text.csv_rows, "html": lambda r: text.visible_text(text.decoded(r)).splitlines(keepends=True)}.get(ext, lambda r: text.decoded(r).splitlines(keepends=True))(raw)
    return "md" if ext == "md" else "txt", "".join(change(lines)).encode()


def segments(files: DataFrame) -> DataFrame:
    """files: doc_id, ext, content, reason. doc_id, seg_no, text of the segments of each file; one that can't be read has a reason instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(big.num_rows):
                doc, ext, content, why = (c.to_pylist()[0] for c in big.slice(k, 1).columns)
                held: list[str] = []

                def read(texts: list[str]) -> list[str]:
                    held.extend(texts)
                    return texts

                if why is None:
                    try:
                        rewritten(ext, content or b"", read)
                    except ValueError as e:
                        why, held = str(e), []
                rows = [(n, t, None) for n, t in enumerate(held)] or [(None, None, why)]
                number, texts, reasons = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.string()), pa.array(number, pa.int64()), pa.array(texts, pa.string()), pa.array(reasons, pa.string())], ["doc_id", "seg_no", "text", "reason"])

    return kept(files.select(F.col("doc_id").cast("string"), "ext", F.col("content").cast("binary"), "reason").mapInArrow(run, "doc_id string, seg_no long, text string, reason string"))


def _put_back(files: DataFrame, new: DataFrame, read: DataFrame) -> DataFrame:
    """Each file (doc_id, ext, content) written with its new segments (doc_id, seg_no, text): doc_id, kind, content, reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(big.num_rows):
                doc, ext, content, texts, why = (c.to_pylist()[0] for c in big.slice(k, 1).columns)
                kind, out = rewritten(ext, content or b"", lambda _, texts=texts: texts or []) if why is None else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([kind], pa.string()), pa.array([out], pa.binary()), pa.array([why], pa.string())], ["doc_id", "kind", "content", "reason"])

    by_file = new.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"]).alias("texts"))
    refused = read.where("reason is not null").select("doc_id", "reason")
    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "ext", F.col("content").cast("binary").alias("content")).join(by_file, "doc_id", "left").join(refused, "doc_id", "left")
    return rows.select("doc_id", "ext", "content", "texts", "reason").mapInArrow(run, _WRITTEN)


def _named(path: str, mark: str) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), r"[/\\\\]"), -1), r"\.[^.]*$", "")
    return F.when(F.col("content").isNotNull(), sinks.marked_name(stem, mark, F.concat(F.lit("."), F.col("kind"))))


def mask_files(files: DataFrame, options: Options | None = None) -> DataFrame:
    """files: doc_id (a path), ext, length, content, as ``text.intake`` gives them. Returns doc_id, output_name, content, n_labels, n_leaks, reason.

    ``n_leaks``: labelled values that the masked segments still hold; such a file must not be published.
    """
    admitted = gates.sized(files).withColumn("reason", F.coalesce("reason", F.when(F.col("ext") == "pdf", "PDF files cannot be read")))
    read = segments(admitted)
    texts = read.where("seg_no is not null").select("doc_id", "seg_no", "text")
    masked, table = masking.anonymize_segments(entities.with_rule_entities(texts), options)
    table = kept(table)
    leaks = _leaks(masked, table).groupBy("doc_id").agg(F.count("*").alias("n_leaks"))
    counts = table.groupBy("doc_id").agg(F.count("*").alias("n_labels"))
    out = _put_back(admitted, masked, read).join(counts, "doc_id", "left").join(leaks, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", _named("doc_id", sinks.MASKED).alias("output_name"), "content", none("n_labels"), none("n_leaks"), "reason")


def _leaks(masked: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, value of the labelled values that a masked document still holds."""
    from maskloom.operators import verify

    whole = sinks.whole_text(masked, "\n")
    return verify.residual_values(whole, table.select("doc_id", "value"))


def restore_files(answers: DataFrame, originals: DataFrame, manifest: DataFrame) -> DataFrame:
    """answers: answer, ext, content and original_name; originals: original_name, ext, content; manifest as ``gates.manifests`` writes it.
    Returns answer, output_name, content, restored, unresolved, samples, reason.

    Refused, with a reason, are answers of other kinds, and those whose original has no (single) manifest of these rules.
    """
    matched = gates.matched_manifests(originals, manifest).select("original_name", "options", "reason")
    known = originals.select("original_name", F.col("ext").alias("own_ext"), F.col("content").alias("own")).join(matched, "original_name")
    rows = answers.join(known.drop("own", "own_ext").withColumn("has", F.lit(True)), "original_name", "left")
    reason = F.when(~F.col("ext").isin(*ANSWERS), "answers of this kind cannot be restored").when(F.col("has").isNull(), "no original").otherwise(F.col("reason"))
    asked = rows.select(F.col("answer").alias("doc_id"), "original_name", "ext", "content", reason.alias("reason"))
    used = known.where("reason is null").join(asked.where("reason is null").select("original_name").distinct(), "original_name", "left_semi")
    source = segments(used.select(F.col("original_name").alias("doc_id"), F.col("own_ext").alias("ext"), F.col("own").alias("content"), F.lit(None).cast("string").alias("reason"))).where("seg_no is not null")
    source = source.select("doc_id", "seg_no", "text").join(used.select(F.col("original_name").alias("doc_id"), "options"), "doc_id")
    tables = []
    for said in [r[0] for r in used.select("options").distinct().collect()]:  # one for each combination of options in use
        own = Options(**{k: v == "true" for k, v in re.findall(r'"(\w+)":"?(true|false)', said)})
        tables.append(masking.anonymize_segments(entities.with_rule_entities(source.where(F.col("options") == said).drop("options")), own)[1].select("doc_id", "category", "n", "value"))
    table = tables[0] if tables else answers.sparkSession.createDataFrame([], "doc_id string, category string, n int, value string")
    for t in tables[1:]:
        table = table.unionByName(t)
    read = segments(asked)
    texts = read.where("seg_no is not null").join(asked.select("doc_id", "original_name"), "doc_id").select(F.col("original_name").alias("doc_id"), F.col("doc_id").alias("answer"), "seg_no", "text")
    back = kept(L.restored(texts, kept(table), ("answer", "seg_no")))
    sums = back.groupBy(F.col("answer").alias("doc_id")).agg(F.sum("restored").alias("restored"), F.sum("unresolved").alias("unresolved"), F.slice(F.flatten(F.collect_list("samples")), 1, 5).alias("samples"))
    out = _put_back(asked, back.select(F.col("answer").alias("doc_id"), "seg_no", "text"), read).join(sums, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("doc_id").alias("answer"), _named("doc_id", sinks.RESTORED).alias("output_name"), "content", none("restored"), none("unresolved"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "reason")
