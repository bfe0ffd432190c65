"""Checks after masking and restoring: unknown labels, invented values, residues, and refusal on any leak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.functions import native as N
from maskloom.operators import masking
from maskloom.operators import spans as S

ANY_LABEL = r"(?u)\[[\p{L}]+(_[\p{L}]+)*+_[0-9]+\]"
# English look-alikes of labels that models write by themselves.
LOOKALIKE = r"(?i)\[(name|person|company|organization|address|date|amount|phone|email|number)[ _-]?[0-9]*\]"


class Leak(RuntimeError):
    """A value still stands where it must not; the output must not be published."""


def labels_in(texts: DataFrame, pattern: str = ANY_LABEL) -> DataFrame:
    """doc_id, label: the distinct labels of each text."""
    return texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("label"))


def unknown_labels(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that a document's table lacks though it knows their category (all of it, underscores included)."""
    category = F.regexp_extract("label", r"^\[(.+)_[0-9]+\]$", 1)
    found = labels_in(answers).withColumn("category", category)
    known = labels.select("doc_id", "category").distinct()
    return found.join(labels.select("doc_id", "label").distinct(), ["doc_id", "label"], "left_anti").join(known, ["doc_id", "category"], "left_semi").select("doc_id", "label")


def residual_labels(texts: DataFrame) -> DataFrame:
    """Labels left after restoring, and look-alikes."""
    return labels_in(texts).withColumn("kind", F.lit("label")).unionByName(labels_in(texts, LOOKALIKE).withColumn("kind", F.lit("lookalike"))).distinct()


def invented_values(changed: DataFrame, labels: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Sensitive-looking values in changed texts that are neither inside labels nor related to a known value.

    ``found``: the spans of the changed texts (doc_id, start, stop, category, value); by default those of all rules.
    """
    segments = S.as_segments(changed)
    found = masking.found(changed) if found is None else found
    inside = segments.select("doc_id", F.explode(N.match_spans(F.col("text"), r"\[[^\[\]]*\]")).alias("b")).select("doc_id", F.col("b.start").alias("from"), F.col("b.stop").alias("to"))
    outside = found.join(inside, (found["doc_id"] == inside["doc_id"]) & (inside["from"] <= found["start"]) & (found["stop"] <= inside["to"]), "left_anti")
    known = labels.select(F.col("doc_id").alias("of"), F.col("value").alias("known"))
    related = (outside["doc_id"] == known["of"]) & (F.expr("contains(value, known)") | F.expr("contains(known, value)"))
    return outside.join(known, related, "left_anti").select("doc_id", "category", "value")


def residual_values(outputs: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """Values of ``least`` characters or more that an output still holds, spaces squeezed on both sides."""
    squeezed = lambda c: F.regexp_replace(c, "[ \\t\\n\\u00A0\\u202F]+", "")
    values = labels.where(F.length(F.trim("value")) >= least).select("doc_id", "value").distinct()
    return outputs.select("doc_id", squeezed(F.col("text")).alias("text")).join(values.withColumn("bare", squeezed(F.col("value"))), "doc_id").where(F.expr("contains(text, bare)")).select("doc_id", "value")


def detector_residuals(outputs: DataFrame, least: int = 3) -> DataFrame:
    """What detection still finds in an output, labels left aside: detection is not idempotent over labels."""
    bare = outputs.select("doc_id", F.regexp_replace("text", ANY_LABEL, "\u0001").alias("text"))
    return masking.found(bare).where(F.length(F.trim("value")) >= least).select("doc_id", "category", "value")


def refuse_leaks(leaks: DataFrame) -> None:
    """Raises with up to three documents if there is any leak; values are not shown."""
    if found := leaks.select("doc_id").distinct().limit(3).collect():
        raise Leak(f"values still stand in documents {[r[0] for r in found]}")


def notices(stats: DataFrame) -> DataFrame:
    """stats: doc_id, unknown, invented, residual, coverage, truncated, frozen_touched, notes_missing. doc_id, notices in a fixed order."""
    said = lambda cond, text: F.when(cond, text)
    return stats.select(
        "doc_id",
        F.array_compact(
            F.array(
                said(F.col("truncated"), F.lit("the answer seems to be cut off")),
                said(F.col("unknown") > 0, F.format_string("%d labels are not in the table", F.col("unknown"))),
                said(F.col("invented") > 0, F.format_string("%d values were not in the original", F.col("invented"))),
                said(F.col("residual") > 0, F.format_string("%d labels are left", F.col("residual"))),
                said(F.col("frozen_touched") > 0, F.lit("changes to complex tables were not taken over")),
                said(F.col("notes_missing") > 0, F.lit("notes are missing from the answer")),
            )
        ).alias("notices"),
    )
