"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. A temporary one is made only where the session names
    none and driver and executors are one process; on a cluster a missing name is an error."""
    sc = spark.sparkContext
    if (named := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")) is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="maskloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Hands freed memory back to the system. Python workers live on between tasks, and glibc keeps what they freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task that keeps no memory: neither what the task before left nor its own."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)``, whose workers hold no memory between tasks."""
    return rows.mapInArrow(giving_back(run), schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def smallest_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links i-j: the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return label
        label = new


def looked_up(rows: DataFrame, values: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row a key; null where it has none. Rows of one key are spread
    by a hash of column ``by`` over as many keys as a shuffle has tasks, and each of those asks for the values once."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(partitions(rows.sparkSession))))
    asked = salted.select(key, "salt").distinct().join(values, key, "left")
    return salted.join(asked, [key, "salt"]).drop("salt")


def with_lowest(pairs: DataFrame, salts: int) -> DataFrame:
    """pairs x, y with low, the smallest y of each x. The pairs of one x are spread over ``salts`` keys, each of
    which learns the smallest of all from one row a key, so no task gets all pairs of a node that many share."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(salts)))
    own = salted.groupBy("x", "salt").agg(F.min("y").alias("own"))
    low = own.groupBy("x").agg(F.min("own").alias("low"))
    return salted.join(own.join(low, "x").select("x", "salt", "low"), ["x", "salt"]).drop("salt")


def components(edges: DataFrame, rows_a_task: int = 50_000, salts: int = 16) -> DataFrame:
    """Connected components by large and small stars, in a number of rounds near the log of the diameter.

    ``edges``: longs u, v. Returns u, v for every node but the smallest of its component, v being that
    smallest. Each round is two stars; the neighbours of one node are spread over ``salts`` keys, or as many as
    there are tasks, before they are aggregated or joined. The result of a star is checkpointed. A round runs in
    as many tasks as its links need, since each task of a shuffle writes files of its own however little it holds.
    """

    def down(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = checkpointed(down(edges).distinct())
    before = state(edges)
    while before[0]:
        tasks = -(-before[0] // rows_a_task)
        spread = max(salts, tasks)
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select("v", "u")).toDF("x", "y").coalesce(tasks)
        large = with_lowest(both, spread).where("y > x").select(F.col("y").alias("u"), F.least("x", "low").alias("v"))
        large = checkpointed(large.coalesce(tasks).distinct().coalesce(tasks))
        small = with_lowest(large.toDF("x", "y"), spread).select(F.explode(F.array(F.struct(F.col("y").alias("u"), F.col("low").alias("v")), F.struct(F.col("x").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(down(small).coalesce(tasks).distinct().coalesce(tasks))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int
) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Cut the stream of a partition sorted by ``keys`` into pieces of whole groups.

    Yields (rows, starts, whole): ``starts`` are the first rows of the groups in the piece, and its end.
    Groups of more than ``rows`` rows come in several pieces, one group in each, with whole=False.
    """

    def cuts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for k in keys:
            a = t.column(k).to_numpy()
            change[1:] |= a[1:] != a[:-1]
        return np.flatnonzero(change)

    key = lambda t: tuple(t.column(k)[0].as_py() for k in keys)
    held: list[pa.Table] = []
    n, open_group = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        at = cuts(t)
        if open_group is not None and key(t) == open_group:
            stop = int(at[1]) if len(at) > 1 else t.num_rows
            yield t.slice(0, stop), np.array([0, stop]), False
            t, at = t.slice(stop), at[1:] - stop
        if t.num_rows and len(at) > 1:
            open_group = None
            yield t.slice(0, int(at[-1])), at, True
            t = t.slice(int(at[-1]))
        if t.num_rows > rows:
            open_group = key(t)
            yield t, np.array([0, t.num_rows]), False
            t = t.slice(t.num_rows)
        held, n = ([t], t.num_rows) if t.num_rows else ([], 0)
    if n:
        t = pa.concat_tables(held).combine_chunks()
        at = cuts(t)
        if open_group is not None and key(t) == open_group:
            stop = int(at[1]) if len(at) > 1 else t.num_rows
            yield t.slice(0, stop), np.array([0, stop]), False
            t, at = t.slice(stop), at[1:] - stop
        if t.num_rows:
            yield t, np.append(at, t.num_rows), True


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that no task holds what it makes of more texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
