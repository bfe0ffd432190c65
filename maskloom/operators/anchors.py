"""Alignment of a base and an answer by anchors: lines that both have exactly once, as joins and columns.

Patience alignment: norms that are unique on both sides are anchors; of those the longest chain that goes up in both is
what stayed in its place, and the anchors outside of it have moved. Lines between two neighbours of the chain meet by their
norm and by how often it came before there; what is left was deleted or inserted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions import native as N


def longest_chain(values: Column) -> Column:
    """Indices, in order, of a longest strictly rising subsequence of an array of distinct ints; of equals the one that ends last.

    Tails of rising sequences are kept by their length; each value takes the place of the first that is not smaller. Work
    is the length of the array times that of the chain.
    """
    ints = "array<int>"

    def place(state: Column, x: Column) -> Column:
        at = F.size(F.filter(state["tails"], lambda t: t < x))
        tails = F.concat(F.slice(state["tails"], F.lit(1), at), F.array(x), F.slice(state["tails"], at + 2, F.size(state["tails"])))
        return F.struct(tails.cast(ints).alias("tails"), F.concat(state["ranks"], F.array(at + 1)).cast(ints).alias("ranks"))

    zero = F.struct(F.array().cast(ints).alias("tails"), F.array().cast(ints).alias("ranks"))

    def back(x: Column) -> Column:
        # from the end: the last value of the highest rank, then of each rank below the last one that is smaller
        n = F.size(x["v"])
        start = F.struct(F.coalesce(F.array_max(x["ranks"]), F.lit(0)).alias("rank"), F.lit(2**31 - 1).alias("below"), F.array().cast(ints).alias("out"))

        def step(state: Column, i: Column) -> Column:
            value = F.get(x["v"], i)
            take = (F.get(x["ranks"], i) == state["rank"]) & (value < state["below"])
            return F.struct(
                F.when(take, state["rank"] - 1).otherwise(state["rank"]).alias("rank"), F.when(take, value).otherwise(state["below"]).alias("below"),
                F.when(take, F.concat(F.array(i), state["out"])).otherwise(state["out"]).cast(ints).alias("out"),
            )

        return F.when(n == 0, F.array().cast(ints)).otherwise(F.aggregate(F.sequence(n - 1, F.lit(0)), start, step, lambda s: s["out"]))

    with_ranks = lambda v: F.struct(v.alias("v"), F.aggregate(v, zero, place, lambda s: s["ranks"]).alias("ranks"))
    return N.let(values.cast(ints), lambda v: N.let(with_ranks(v), back))


def anchored(base: DataFrame, answer: DataFrame) -> DataFrame:
    """base, answer: doc_id, k, norm. doc_id, base, answer, moved: the anchors of each document, and whether they are outside the chain."""
    def once(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("norm <> ''").groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.min("k").cast("int").alias(name)).where("n = 1").drop("n")

    met = once(base, "base").join(once(answer, "answer"), ["doc_id", "norm"])
    rows = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("base", "answer"))).alias("a"))
    chain = longest_chain(F.transform("a", lambda x: x["answer"]))
    each = rows.select("doc_id", "a", F.explode(F.array(chain)).alias("chain")).select("doc_id", "chain", F.posexplode("a").alias("i", "x"))
    return each.select("doc_id", "x.base", "x.answer", (~F.array_contains("chain", F.col("i"))).alias("moved"))


def aligned(base: DataFrame, answer: DataFrame) -> DataFrame:
    """doc_id, op, base, answer: every line of both sides once, as ``equal``, ``moved``, ``deleted`` or ``inserted``.

    Equal lines that are no anchors meet within the stretch between two neighbours of the chain, the first with the first.
    """
    found = anchored(base, answer)
    chain = found.where("not moved")

    def stretched(rows: DataFrame, side: str) -> DataFrame:
        """Lines that are no anchors, with the number of chain anchors before them and how often their norm came before in that stretch."""
        marks = chain.select("doc_id", F.col(side).alias("k"), F.lit(1).alias("mark"))
        anchors = found.select("doc_id", F.col(side).alias("k"), F.lit(True).alias("anchor"))
        every = rows.join(marks, ["doc_id", "k"], "left").join(anchors, ["doc_id", "k"], "left")
        stretch = F.sum(F.coalesce("mark", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        free = every.withColumn("stretch", stretch).where("anchor is null")
        nth = F.row_number().over(Window.partitionBy("doc_id", "stretch", "norm").orderBy("k"))
        return free.select("doc_id", "stretch", "norm", nth.alias("nth"), F.col("k").alias(side))

    met = stretched(base, "base").join(stretched(answer, "answer"), ["doc_id", "stretch", "norm", "nth"], "full_outer")
    op = F.when(F.col("answer").isNull(), "deleted").when(F.col("base").isNull(), "inserted").otherwise("equal")
    rest = met.select("doc_id", op.alias("op"), "base", "answer")
    return found.select("doc_id", F.when(F.col("moved"), "moved").otherwise("equal").alias("op"), "base", "answer").unionByName(rest)
