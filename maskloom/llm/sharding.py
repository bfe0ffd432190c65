"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Law: ``bytes``. Documents of equal text are one group, which never parts. Differencing starts with one
partial partition for each group and repeatedly combines the two with the largest spread in opposite
order, largest part with smallest, until one is left. Where there are more than ``most`` groups, they
are first dealt into chunks, each chunk is differenced into as many parts as there are shards, and the
parts, with all groups too large to be balanced inside a chunk, are the items of the next round; the
last round has at most ``most`` items whatever the input. The chunks are small enough that their parts
are fine grains, so the last round evens out what the chunks leave.

Cases: a null text has no bytes and groups with the empty text; every row counts one byte more; rows
that repeat belong to one group and have a slot each; a null doc_id is kept; a group larger than its
fair share has a shard to itself. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import checkpointed, looked_up


def difference(sizes: Sequence[int], parts: int) -> list[int]:
    """The part, 0 to parts - 1, of each item; items should come in a fixed order, which decides ties."""
    n = len(sizes)
    if not n:
        return []
    sums: list[tuple] = [(int(s), *(0,) * (parts - 1)) for s in sizes]  # largest first
    made: list[tuple] = []
    heap = [(-s[0] + s[-1], k) for k, s in enumerate(sums)]
    heapq.heapify(heap)
    slots = range(parts)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        together = sorted(((x[k] + y[parts - 1 - k], k) for k in slots), reverse=True)
        made.append((a, b, [k for _, k in together]))
        sums[a] = sums[b] = ()
        sums.append(tuple(t for t, _ in together))
        heapq.heappush(heap, (together[-1][0] - together[0][0], len(sums) - 1))
    # from the last combination back: which part each slot of each partial partition has become
    became: dict[int, list[int]] = {heap[0][1]: list(slots)}
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        own = became.pop(n + k)
        to_a, to_b = [0] * parts, [0] * parts
        for slot, was in enumerate(order):
            to_a[was], to_b[parts - 1 - was] = own[slot], own[slot]
        became[a], became[b] = to_a, to_b
    return [became[k][0] for k in range(n)]


def balanced(groups: DataFrame, shards: int, most: int = 32768, chunk: int = 20000) -> DataFrame:
    """groups: item (binary, distinct), size. Returns item, shard."""
    spark, levels, items = groups.sparkSession, [], groups.select("item", "size")
    while True:
        n, total = items.agg(F.count("*"), F.sum("size")).first()
        if n <= most:
            break
        chunks = max(-(-n // chunk), min(most // (2 * shards), n // (8 * shards)))
        heavy = total / (chunks * shards)
        small = items.where(F.col("size") <= heavy).withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)))

        def parted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
            part = difference(pdf["size"].tolist(), shards)
            return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "next": [b"%d/%d" % (key[0], p) for p in part]})

        dealt = checkpointed(small.groupBy("chunk").applyInPandas(parted, "item binary, size long, next binary"))
        levels.append(dealt.select("item", "next"))
        parts = dealt.groupBy("next").agg(F.sum("size").alias("size")).select(F.col("next").alias("item"), "size")
        items = checkpointed(parts.unionByName(items.where(F.col("size") > heavy)))
    last = sorted(((r.size, bytes(r.item)) for r in items.select("item", F.col("size").alias("size")).toPandas().itertuples(index=False)), key=lambda x: (-x[0], x[1])) if n else []  # at most ``most`` rows
    part = difference([s for s, _ in last], shards)
    out = spark.createDataFrame(pd.DataFrame({"item": [i for _, i in last], "shard": np.array(part, "int32")}), "item binary, shard int") if last else spark.createDataFrame([], "item binary, shard int")
    for level in reversed(levels):
        heavy_items = out.join(level.select(F.col("next").alias("item")).distinct(), "item", "left_anti")
        inner = level.join(out.withColumnRenamed("item", "next"), "next").select("item", "shard")
        out = inner.unionByName(heavy_items)
    return out


def numbered(rows: DataFrame, by: str, order: list[str], rows_a_piece: int = 1_000_000) -> DataFrame:
    """``slot``: 0, 1, 2... within each value of ``by``, without bringing the rows of one value into one task."""
    spread = F.pmod(F.xxhash64(*order), F.lit(max(64, -(-rows.count() // rows_a_piece))))
    rows = rows.withColumn("piece", spread)
    before = Window.partitionBy(by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(by, "piece").agg(F.count("*").alias("n"))
    offsets = counts.select(by, "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(by, "piece").orderBy(*order)).cast("long") - 1
    return rows.withColumn("inside", inside).join(offsets, [by, "piece"]).withColumn("slot", F.col("inside") + F.col("offset")).drop("inside", "offset", "piece")


def sharded(docs: DataFrame, shards: int = 8, most: int = 32768) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("item"),
        )
    )
    groups = checkpointed(rows.groupBy("item").agg(F.sum("size").alias("size")))
    placed = checkpointed(looked_up(rows, balanced(groups, shards, most), "item", "doc_id"))  # copies of one text in many tasks
    return numbered(placed, "shard", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
