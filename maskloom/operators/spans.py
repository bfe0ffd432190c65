"""Span algebra over DataFrames: detection by native rules, union of overlaps, texts, splices, section switches.

Spans are rows (doc_id, seg_no, start, stop, category, priority, ord), positions code points and half open.
All windows here partition by doc_id with more columns, so one shuffle on doc_id serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import categories as C
from maskloom.functions import native as N


def as_segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """One segment for each document."""
    return docs.select("doc_id", F.lit(0).cast("long").alias("seg_no"), F.coalesce(F.col(text), F.lit("")).alias("text"))


_BREAK = r"\n\x0B\f\r\x1C\x1D\x1E\x85\u2028\u2029"
#: A line with its break (any that Unicode knows), or the end of a text without one.
LINE = rf"[^{_BREAK}]*(?:\r\n|[{_BREAK}])|[^{_BREAK}]+"


def lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A segment for each line, with its line break."""
    return docs.select("doc_id", F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("seg_no", "text")).withColumn("seg_no", F.col("seg_no").cast("long"))


def detected(segments: DataFrame, spans: Column | None = None) -> DataFrame:
    """Rows of tagged spans of every segment, overlaps included."""
    found = N.neutral_spans(F.col("text")) if spans is None else spans
    return segments.where(F.trim("text") != "").select("doc_id", "seg_no", F.explode(found).alias("s")).select(
        "doc_id", "seg_no", "s.start", (-F.col("s.neg_stop")).alias("stop"), "s.category", "s.priority", "s.ord"
    )


def united(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a segment as one, with the category of the highest priority (the first among equals)."""
    order = Window.partitionBy("doc_id", "seg_no").orderBy("start", F.desc("stop"), "ord")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.coalesce(F.col("start") < reach, F.lit(False)), 0).otherwise(1)
    islands = spans.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by("category", F.struct(-F.col("priority"), F.col("start"), -F.col("stop"), F.col("ord")))
    return islands.groupBy("doc_id", "seg_no", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), best.alias("category")).drop("island")


def with_spans(segments: DataFrame) -> DataFrame:
    """doc_id, seg_no, text and ``spans``: merged spans with values, made within the row. No shuffle."""
    text = F.col("text")
    rows = segments.where("text is not null").select("doc_id", "seg_no", "text")
    return rows.select("doc_id", "seg_no", "text", F.explode(F.array(N.merged(N.neutral_spans(text), text))).alias("spans"))  # Generate: the matches are made once


def exploded(found: DataFrame) -> DataFrame:
    """A row for each of the spans: doc_id, seg_no, start, stop, category, value. Texts stay behind."""
    return found.where(F.size("spans") > 0).select("doc_id", "seg_no", F.explode("spans").alias("s")).select("doc_id", "seg_no", "s.start", "s.stop", "s.category", "s.value")


def spliced(segments: DataFrame, replacements: DataFrame) -> DataFrame:
    """segments with spans (start, stop, put) replaced; doc_id, seg_no, text."""
    by_segment = replacements.groupBy("doc_id", "seg_no").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "put"))).alias("spans"))
    text = N.spliced(F.col("text"), F.col("spans"), lambda s: s["put"])
    return segments.join(by_segment, ["doc_id", "seg_no"], "left").select("doc_id", "seg_no", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("text"))


def spliced_runs(runs: DataFrame, replacements: DataFrame) -> DataFrame:
    """Runs (doc_id, seg_no, run_no, start, stop, text) of formatted text with spans replaced.

    The first run that a span overlaps gets what is put in, further ones lose their part; formats stay.
    """
    cut = runs.alias("r").join(replacements.alias("s"), (F.col("r.doc_id") == F.col("s.doc_id")) & (F.col("r.seg_no") == F.col("s.seg_no")) & (F.col("s.start") < F.col("r.stop")) & (F.col("r.start") < F.col("s.stop")), "left")
    inside = F.struct(
        F.greatest(F.col("s.start") - F.col("r.start"), F.lit(0)).cast("int").alias("start"),
        (F.least("s.stop", "r.stop") - F.col("r.start")).cast("int").alias("stop"),
        F.when(F.col("s.start") >= F.col("r.start"), F.col("s.put")).otherwise("").alias("put"),
    )
    by_run = cut.groupBy("r.doc_id", "r.seg_no", "r.run_no", "r.text").agg(F.array_sort(F.collect_list(F.when(F.col("s.start").isNotNull(), inside))).alias("spans"))
    return by_run.select("doc_id", "seg_no", "run_no", N.spliced(F.col("text"), F.col("spans"), lambda s: s["put"]).alias("text"))


def switched(segments: DataFrame, off: tuple[str, ...] = C.SECTION_OFF, on: tuple[str, ...] = C.SECTION_ON) -> DataFrame:
    """``masking``: off from a section that opens the subject of a contract, on again from its details; on at first.

    A segment switches by the (lower-case) words in it; one that has both is on.
    """
    low = F.lower("text")
    any_of = lambda words: F.greatest(*(F.instr(low, w) for w in words)) if len(words) > 1 else F.instr(low, words[0])
    flag = F.when(any_of(on) > 0, F.lit(True)).when(any_of(off) > 0, F.lit(False))
    last = F.last(flag, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("masking", F.coalesce(last, F.lit(True)))
