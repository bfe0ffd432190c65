"""Running sums and runs over groups of any size, and counters of nested lists.

A window over one group puts all its rows into one task. Here rows are dealt by ranges of group and order; each part
adds up its own rows, and what earlier parts of the group hold is carried over by a window with a row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators.rounds import kept


def with_running_sum(rows: DataFrame, key: str, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``key`` up to each in ``order`` (which has no ties).

    A null key is a group of its own, a null value counts as 0. The parts are kept in the shared folder, since dealing
    by ranges again may cut elsewhere.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(n, key, order).withColumn("part", F.spark_partition_id()))
    held = F.coalesce(F.col(value), F.lit(0))
    own = F.sum(held).over(Window.partitionBy("part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    totals = dealt.groupBy("part", key).agg(F.sum(held).alias("total"))
    before = F.sum("total").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(F.col("part").alias("of"), F.col(key).alias("group"), F.coalesce(before, F.lit(0)).alias("carried"))
    local = dealt.withColumn(name, own)
    joined = local.join(carried, (local["part"] == carried["of"]) & local[key].eqNullSafe(carried["group"]))
    return joined.select(*rows.columns, (F.col(name) + F.col("carried")).cast("long").alias(name))


def longest_gaps(rows: DataFrame, key: str, order: str, has: str, parts: int | None = None) -> DataFrame:
    """key, total, matched, longest: rows of each group, those with ``has``, and the longest run without."""
    flagged = rows.select(key, order, F.when(F.col(has), 1).otherwise(0).alias("flag"))
    numbered = with_running_sum(flagged, key, order, "flag", "island", parts)
    # rows without follow the same number of rows with: they are a run
    runs = numbered.groupBy(key, "island").agg(F.count("*").alias("n"), F.sum("flag").alias("m"))
    return runs.groupBy(key).agg(F.sum("n").alias("total"), F.sum("m").alias("matched"), F.max(F.col("n") - F.col("m")).alias("longest"))


def list_numbers(items: DataFrame, levels: int = 9) -> DataFrame:
    """items: doc_id, k, level (from 1). With ``number``: the counters of the item's level and those above it, joined by dots.

    A counter goes on until an item of a higher level comes, and begins anew behind it; a level that was skipped counts as 1.
    """
    order = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = items
    for level in range(1, levels + 1):
        rows = rows.withColumn(f"seg_{level}", F.sum((F.col("level") < level).cast("int")).over(order))
    for level in range(1, levels + 1):
        own = Window.partitionBy("doc_id", f"seg_{level}").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"n_{level}", F.greatest(F.sum((F.col("level") == level).cast("int")).over(own), F.lit(1)))
    counters = F.array(*(F.col(f"n_{level}").cast("string") for level in range(1, levels + 1)))
    return rows.select(*items.columns, F.array_join(F.slice(counters, F.lit(1), F.least("level", F.lit(levels))), ".").alias("number"))


def notes_reconciled(base: DataFrame, masked: DataFrame, answer: DataFrame) -> DataFrame:
    """doc_id, note, fate, text: each note (doc_id, note, text) of an original, its masked text and an answer.

    ``kept``: the answer has the masked text; ``changed``: it has another; ``both``: so it has, where masking had changed the note
    too; ``lost``: only the masked text has it; ``added``: only the answer has it. ``text`` is what stands in the end: lost notes stay.
    Keys and texts may be null; two nulls are equal.
    """
    side = lambda df, name: df.select(F.col("doc_id").alias(f"{name}_doc"), F.col("note").alias(f"{name}_note"), F.struct("text").alias(name))
    same = lambda a, b: F.col(f"{a}_doc").eqNullSafe(F.col(f"{b}_doc")) & F.col(f"{a}_note").eqNullSafe(F.col(f"{b}_note"))
    m, a, b = side(masked, "m"), side(answer, "a"), side(base, "b")
    both = m.join(a, same("m", "a"), "full_outer")
    met = both.join(b, same("b", "m") & F.col("m").isNotNull(), "left")
    untouched = F.col("b").isNull() | F.col("b.text").eqNullSafe(F.col("m.text"))
    fate = F.when(F.col("a").isNull(), "lost").when(F.col("m").isNull(), "added").when(F.col("a.text").eqNullSafe(F.col("m.text")), "kept").when(untouched, "changed").otherwise("both")
    has_answer = F.col("a").isNotNull()
    pick = lambda c: F.when(has_answer, F.col(f"a_{c}")).otherwise(F.col(f"m_{c}"))
    return met.select(pick("doc").alias("doc_id"), pick("note").alias("note"), fate.alias("fate"), F.when(has_answer, F.col("a.text")).otherwise(F.col("m.text")).alias("text"))


def refilled(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """cells: doc_id, cell, place; texts: doc_id, place, text: the text of each place in reading order.
    doc_id, cell, text: cells with their paragraphs in order, joined by line breaks; a cell without texts is empty."""
    rows = cells.join(texts, ["doc_id", "place"], "left").groupBy("doc_id", "cell").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("held"))
    return rows.select("doc_id", "cell", F.array_join(F.transform("held", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))


def truncated(matched: Column, total: Column, longest: Column, least: float = 0.7, run: int = 3) -> Column:
    """Whether an answer seems to be cut off: too little of it is there, or too many neighbours are missing."""
    return (matched / total < least) | (longest >= run)
