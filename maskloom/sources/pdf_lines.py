"""Paragraphs from lines of a page layout. The contract for any PDF reader: lines (doc_id, page, top, text).

The usual step between lines is the most frequent one, the smaller of equals. A step of more than 1.6 of
it starts a new paragraph; within one, a hyphen at a line's end disappears before a small letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH_STEP = 1.6
_SEAM = "\x1f"


def usual_steps(rows: DataFrame, keys: list[str], step: Column) -> DataFrame:
    """keys, usual: the mode of the rounded steps."""
    steps = rows.select(*keys, F.bround(step).alias("step")).where("step > 0").groupBy(*keys, "step").count()
    return steps.groupBy(*keys).agg(F.min_by("step", F.struct(-F.col("count"), F.col("step"))).alias("usual"))


def islands(rows: DataFrame, keys: list[str], order: list[str], step: Column) -> DataFrame:
    """``rows`` with ``island``, from 1: within each of ``keys`` a new one begins with the first row, and behind each ``step`` (made
    with ``lag`` over the same window) of more than ``PARAGRAPH_STEP`` of the usual one."""
    window = Window.partitionBy(*keys).orderBy(*order)
    with_step = rows.withColumn("step", step)
    met = with_step.join(usual_steps(with_step, keys, F.col("step")), keys, "left")
    starts = F.when(F.col("step").isNull() | (F.col("step") > PARAGRAPH_STEP * F.col("usual")), 1).otherwise(0)
    return met.withColumn("island", F.sum(starts).over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("step", "usual")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page, para_no, text."""
    keys = ["doc_id", "page"]
    step = F.col("top") - F.lag("top").over(Window.partitionBy(*keys).orderBy("top"))
    numbered = islands(lines, keys, ["top"], step).withColumnRenamed("island", "para_no")
    held = numbered.groupBy("doc_id", "page", "para_no").agg(F.array_sort(F.collect_list(F.struct("top", "text"))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: F.trim(x["text"])), _SEAM)
    joined = F.regexp_replace(F.regexp_replace(joined, rf"-{_SEAM}(?=\p{{Ll}})", ""), _SEAM, " ")
    return held.select("doc_id", "page", "para_no", joined.alias("text"))


def has_text(lines: DataFrame) -> DataFrame:
    """doc_id, readable: whether any line of a document holds text; one without is a scan and is refused."""
    return lines.groupBy("doc_id").agg(F.bool_or(F.trim("text") != "").alias("readable"))
