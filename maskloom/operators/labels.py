"""Numbered labels: one number for each distinct value of a category in a document, by first appearance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import native as N
from maskloom.functions.nesting import opened
from maskloom.operators import spans as S
from maskloom.operators.rounds import kept


def numbered(spans: DataFrame) -> DataFrame:
    """spans with values get ``n`` and ``label``. Needs the spans only: texts aren't shuffled."""
    spans = spans.repartition("doc_id")
    same = Window.partitionBy("doc_id", "category", "value")
    first = spans.withColumn("first", F.min(F.struct("seg_no", "start")).over(same))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "category").orderBy("first"))
    return first.withColumn("n", n.cast("int")).drop("first").withColumn("label", N.label(F.col("category"), F.col("n")))


def label_table(numbered_spans: DataFrame) -> DataFrame:
    """doc_id, category, n, label, value: sensitive, so it is only ever returned, never written by the engine."""
    return numbered_spans.select("doc_id", "category", "n", "label", "value").distinct()


def anonymized(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masked segments and their label table, for documents of many segments.

    Spans are found and united within each row; numbering shuffles the spans, and only segments that hold
    spans are joined with their labels. All others pass as they are.
    """
    found = S.with_spans(segments.select("doc_id", "seg_no", F.coalesce("text", F.lit("")).alias("text")))
    spans = numbered(S.exploded(found))
    touched, plain = found.where(F.size("spans") > 0), found.where(F.size("spans") == 0)
    masked = S.spliced(touched.select("doc_id", "seg_no", "text"), spans.withColumn("put", F.col("label")))
    return plain.select("doc_id", "seg_no", "text").unionByName(masked), label_table(spans)


def anonymized_rows(docs: DataFrame, numbered: bool = True, **also: Column) -> DataFrame:
    """doc_id, masked, spans and columns made of the original row, for documents of one segment: a projection, without any shuffle.
    Labels that are not ``numbered`` are bare categories."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *(c.alias(k) for k, c in also.items()))
    text = F.col("text")
    found = rows.select("doc_id", "text", *also, F.explode(F.array(N.merged(N.neutral_spans(text), text))).alias("m"))  # Generate: the matches are made once
    spans = found.select("doc_id", "text", *also, F.explode(F.array(N.numbered(F.col("m")))).alias("spans"))
    name = (lambda s: N.label(s["category"], s["n"])) if numbered else (lambda s: F.concat(F.lit("["), s["category"], F.lit("]")))
    return spans.select("doc_id", N.spliced(F.col("text"), F.col("spans"), name).alias("masked"), "spans", *also)


#: Labels as answers write them: any case, and a space, hyphen or nothing for the underscore.
TOLERANT = r"(?iu)\[\s*([\p{L}]+(?:[ _-][\p{L}]+)*+)[ _-]?([0-9]+)\s*\]"


def canonical(m: Column) -> Column:
    """A tolerantly written label as the label table has it."""
    return F.concat(F.lit("["), F.regexp_replace(F.upper(F.regexp_extract(m, TOLERANT, 1)), "[ -]", "_"), F.lit("_"), F.regexp_extract(m, TOLERANT, 2), F.lit("]"))


def _references(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, label: every label in ``text``."""
    return rows.select(*keys, F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(TOLERANT), F.lit(0)), canonical)).alias("pos", "label"))


def _opened(rows: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (keys, text) with ``puts``: for each label of the text in order, its value (null if unknown) and how many circular labels that holds."""
    puts = _references(rows, *keys).join(values, ["doc_id", "label"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "value", "closed"))).alias("puts"))
    return rows.join(puts, list(keys), "left")


def circular_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label: the labels whose values lead back to themselves.

    The references between labels are a graph; its paths are doubled in each round by a join with themselves, so that
    chains of n labels take log n rounds. Only labels in values of labels are in it.
    """
    known = labels.select("doc_id", N.label(F.col("category"), F.col("n")).alias("label"), "value").distinct()
    nested = known.where(F.col("value").rlike(TOLERANT))
    links = _references(nested.select("doc_id", F.col("label").alias("of"), F.col("value").alias("text")), "doc_id", "of").select("doc_id", "of", "label").distinct()
    reach = kept(links.join(nested.select("doc_id", "label"), ["doc_id", "label"], "left_semi").select("doc_id", "of", "label"))
    n = reach.count()
    while n:
        further = reach.join(reach.select("doc_id", F.col("of").alias("label"), F.col("label").alias("next")), ["doc_id", "label"]).select("doc_id", "of", F.col("next").alias("label"))
        reach = kept(reach.unionByName(further).distinct())
        before, n = n, reach.count()
        if n == before:
            break
    return reach.where(F.col("of") == F.col("label")).select("doc_id", "label").distinct()


def opened_values(labels: DataFrame, needed: DataFrame, longest: int = 100_000_000) -> DataFrame:
    """doc_id, label, value, closed of the labels ``needed`` (doc_id, label): values with all labels in them opened, and how many
    circular ones stay in each.

    Values without labels are taken as they are. Of documents whose needed labels are nested, the label tables meet in a row each,
    as the restored text does; texts are put together once, for the labels needed alone. Circular labels are no values: they stay
    as they are, and so do labels that only come about where two pieces of text meet. Fails if a value grows beyond ``longest`` characters.
    """
    known = labels.where(F.col("value").isNotNull()).select("doc_id", N.label(F.col("category"), F.col("n")).alias("label"), "value")
    is_nested = F.col("value").rlike(TOLERANT)
    plain = known.where(~is_nested).distinct().select("doc_id", "label", "value", F.lit(0).cast("long").alias("closed"))
    roots = needed.join(known.where(is_nested).select("doc_id", "label"), ["doc_id", "label"], "left_semi").groupBy("doc_id").agg(F.collect_set("label").alias("wanted"))
    # values are taken apart only where they have met: fewer bytes move
    written = lambda r: F.regexp_extract_all(r["value"], F.lit(TOLERANT), F.lit(0))
    apart = lambda r: F.struct(r["label"].alias("label"), F.split(r["value"], TOLERANT, -1).alias("around"), written(r).alias("written"), F.transform(written(r), canonical).alias("refs"))
    met = known.groupBy("doc_id").agg(F.collect_list(F.struct("label", "value")).alias("rows")).join(roots, "doc_id")
    tables = met.select("doc_id", F.transform("rows", apart).alias("rows"), "wanted")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("label", pa.string()), ("value", pa.string()), ("closed", pa.int64())])
            for k in range(batch.num_rows):
                doc = batch.slice(k, 1).to_pylist()[0]
                found = opened({r["label"]: (r["around"], r["written"], r["refs"]) for r in doc["rows"]}, doc["wanted"], longest)
                yield pa.RecordBatch.from_pylist([{"doc_id": doc["doc_id"], "label": a, "value": v, "closed": n} for a, v, n in found], schema=schema)

    return plain.unionByName(tables.select("doc_id", "rows", "wanted").mapInArrow(task, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, label string, value string, closed long"))


def restored(answers: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """answers: doc_id, text and the columns ``keep``; labels: doc_id, category, n, value.
    Returns doc_id, keep, text, restored, unresolved, circular, samples.

    Labels are read tolerantly (see ``TOLERANT``). ``restored`` and ``unresolved`` count the labels of the answer that are
    replaced and those that stay (``samples``: the first five); values that hold labels are open to the end, however deep,
    and labels that lead back to themselves stay and count as ``circular``, within values too. A null text stays null.
    """
    keyed = answers.select("doc_id", *keep, "text", F.xxhash64("doc_id", "text").alias("key"))  # with the id, so that one text for all is no constant, and rows that have met by it stay where they are
    with_labels = F.coalesce(F.col("text").rlike(TOLERANT) & F.col("doc_id").isNotNull(), F.lit(False))
    values = opened_values(labels, _references(keyed.where(with_labels), "doc_id").select("doc_id", "label").distinct())
    touched = _opened(keyed.where(with_labels).select("doc_id", "key", "text").distinct(), values, "doc_id", "key")
    counted = lambda test: F.size(F.filter("puts", test)).cast("long")
    written = F.regexp_extract_all("text", F.lit(TOLERANT), F.lit(0))
    stay = F.array_compact(F.transform(written, lambda m, i: F.when(F.get(F.col("puts"), i)["value"].isNull(), m)))
    done = touched.select(
        "doc_id", "key",
        N.replaced(F.col("text"), TOLERANT, lambda m, i: F.coalesce(F.get(F.col("puts"), i)["value"], m)).alias("new"),
        counted(lambda p: p["value"].isNotNull()).alias("restored"),
        counted(lambda p: p["value"].isNull()).alias("unresolved"),
        F.aggregate("puts", F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p["closed"], F.lit(0))).alias("circular"),
        F.slice(stay, 1, 5).alias("samples"),
    )
    zero = F.lit(0).cast("long")
    out = ("doc_id", *keep, "text", "restored", "unresolved", "circular", "samples")
    plain = keyed.where(~with_labels).select("doc_id", *keep, "text", *(zero.alias(c) for c in ("restored", "unresolved", "circular")), F.array().cast("array<string>").alias("samples"))
    again = keyed.where(with_labels).select("doc_id", *keep, "key").join(done, ["doc_id", "key"]).withColumnRenamed("new", "text").select(*out)
    return plain.unionByName(again)
