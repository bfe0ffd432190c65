"""Approximate nearest neighbours by learned partitions.

Fitting takes at most ``sample`` distinct vectors (those with the smallest hashes). Their graph of nearest
neighbours is cut into parts of nearly equal size: cuts at medians of principal directions give the first
parts, then vertices move to the part that holds most of their neighbours, best gains first, as long as
no part outgrows its limit. A small neural classifier learns from a vector the distribution of its
neighbours' parts. Every row is then indexed under its most probable part, and every query is routed to
its several most probable parts, as many as gave ``aim`` of the neighbours within the sample, and more until
they hold enough rows. Candidates are reranked by the exact distance in double precision.

A sample of that size can tell some 150 parts apart. Where the rows need more parts, each part that is too large
is parted again in the same way, by a sample of its own rows, fitted in a task of its own; the probability of
a part of a part is the product of both. So what a query scans stays the same while the corpus grows to some
20 000 times ``rows_a_part``.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so no more are indexed. A
part is searched in blocks of at most ``block`` rows and as many queries, so no task has to hold all of it.

A part is fitted to 64 vectors of the sample at least, so a table of fewer than 128 is one part, which is searched whole
and exactly by the same code.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
whose length isn't the most frequent one (the smaller of two); a null vec_id takes no part; rows that repeat one vec_id and vector count
once, of different vectors with one vec_id each takes part, and as its own row a query leaves out every row with its vec_id; ties go to the smaller
vec_id. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import checkpointed

RESULT = "query_id long, vec_id long, score double"


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part, once each."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0][0] if lengths else 0))


def nearest_graph(x: np.ndarray, k: int, rows: int = 512) -> np.ndarray:
    """Ids of the k nearest others of each row."""
    norm, out = (x * x).sum(1), np.zeros((len(x), k), int)
    for at in range(0, len(x), rows):
        d = norm[None, :] - 2 * x[at : at + rows] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + rows] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 24) -> np.ndarray:
    """A part for each vertex; parts have at most (1 + slack) times their share."""
    label = np.zeros(len(x), int)
    todo, made = [(np.arange(len(x)), parts, 0)], 0
    while todo:
        own, count, first = todo.pop()
        if count == 1:
            label[own] = first
            continue
        centred = x[own] - x[own].mean(0)
        _, vectors = np.linalg.eigh(centred.T @ centred)
        order = own[np.argsort(centred @ vectors[:, -1], kind="stable")]
        left = count // 2
        cut = len(own) * left // count
        todo += [(order[:cut], left, first), (order[cut:], count - left, first + left)]
        made += 1
    limit = int(np.ceil(len(x) / parts * (1 + slack)))
    i, j = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (i, label[j]), 1)
        np.add.at(votes, (j, label[i]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < limit:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer and a softmax over parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 256, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() or 1.0
        x = (x - self.mean) / self.scale
        sizes = [(x.shape[1], hidden), (hidden, target.shape[1])]
        p = [y for a, b in sizes for y in (rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        m, v, t = [0 * y for y in p], [0 * y for y in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                h = np.maximum(x[own] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(1, keepdims=True))
                g = (z / z.sum(1, keepdims=True) - target[own]) / len(own)
                back = (g @ p[2].T) * (h > 0)
                t += 1
                for k, grad in enumerate((x[own].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = p

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each part, up to a constant for each row."""
        return np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]


class Index:
    """A router with the number of parts that a query is sent to."""

    def __init__(self, x: np.ndarray, parts: int, k: int, aim: float):
        self.parts, self.router, self.routes = parts, None, 1
        if parts == 1:
            return
        graph = nearest_graph(x, min(k, len(x) - 1))
        label = balanced_parts(x, graph, parts)
        target = np.zeros((len(x), parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1 / graph.shape[1])
        self.router = Router(x, 0.5 * target + 0.5 * np.eye(parts)[label])
        odds = self.router(x)
        where = odds.argmax(1)  # the parts under which rows are found, which are the router's
        order = np.argsort(-odds, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
        need = np.take_along_axis(rank, where[graph], axis=1)
        found = [(need < m).mean() for m in range(1, parts + 1)]
        self.routes = next((m for m, f in enumerate(found, 1) if f >= aim), parts)

    def state(self) -> dict:
        """What it is made of, as numbers and arrays."""
        return {"parts": self.parts, "routes": self.routes, "router": vars(self.router) if self.router else None}

    @classmethod
    def of(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        index.parts, index.routes, index.router = state["parts"], state["routes"], None
        if state["router"]:
            index.router = Router.__new__(Router)
            vars(index.router).update(state["router"])
        return index

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.router(x).argmax(1) if self.router else np.zeros(len(x), int)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log probability of each part."""
        if not self.router:
            return np.zeros((len(x), 1))
        z = self.router(x)
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


class Tree:
    """Parts, some of which are parted again: ``below`` by part. ``first``: the number of each part's first part."""

    def __init__(self, root: Index, below: dict[int, Index], x: np.ndarray, k: int, aim: float):
        self.root, self.below, self.routes = root, below, root.routes
        many = [below[c].parts if c in below else 1 for c in range(root.parts)]
        self.first = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(int)
        self.parts = sum(many)
        if below:  # how many parts hold ``aim`` of the neighbours within the sample
            graph, where = nearest_graph(x, min(k, len(x) - 1)), self.part(x)
            need = np.concatenate([self._order(row)[1][where[near]] for row, near in zip(x, graph, strict=True)])
            found = np.cumsum(np.bincount(need, minlength=self.parts)) / len(need)
            self.routes = int(np.searchsorted(found, aim)) + 1

    def part(self, x: np.ndarray) -> np.ndarray:
        own = self.root.part(x)
        out = self.first[own]
        for c, index in self.below.items():
            here = np.flatnonzero(own == c)
            if len(here):
                out[here] += index.part(x[here])
        return out

    def _order(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from the most probable on, within the root's parts that are searched first, then those of the others; and ranks."""
        logs = self.root.logs(row[None, :])[0]
        order = np.argsort(-logs, kind="stable")
        out = []
        for some in (order[: self.root.routes], order[self.root.routes :]):
            parts = [(logs[c] + self.below[c].logs(row[None, :])[0]) if c in self.below else logs[c : c + 1] for c in some]
            if parts:
                names = np.concatenate([self.first[c] + np.arange(len(p)) for c, p in zip(some, parts, strict=True)])
                out.append(names[np.argsort(-np.concatenate(parts), kind="stable")])
        names = np.concatenate(out)
        rank = np.empty(self.parts, int)
        rank[names] = np.arange(self.parts)
        return names, rank

    def route(self, x: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """Parts for each query: the most probable ones, until they hold ``least`` rows."""
        out = []
        for row in x:
            order = self._order(row)[0]
            enough = int(np.searchsorted(np.cumsum(held[order]), least)) + 1
            chosen = order[: max(self.routes, enough)]
            out.append(chosen[held[chosen] > 0])
        return out


def first_parts(rows: int, fit: int, rows_a_part: int, most_parts: int) -> int:
    """Parts that a sample of ``fit`` vectors is cut into: 64 of them at least in each, and four parts even of a small table."""
    return int(max(1, min(max(4, -(-rows // rows_a_part)), most_parts, fit // 64)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _search(k: int):
    def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(c):
            return none
        x, ids = np.vstack([np.frombuffer(b) for b in c["v"]]), c["vec_id"].to_numpy()
        norm, out = (x * x).sum(1), []
        y, own = np.vstack([np.frombuffer(b) for b in q["v"]]), q["query_id"].to_numpy()
        for at in range(0, len(y), 256):
            d = norm[None, :] - 2 * y[at : at + 256] @ x.T + (y[at : at + 256] ** 2).sum(1)[:, None]
            d[own[at : at + 256, None] == ids[None, :]] = np.inf
            for r, row in enumerate(d):
                kth = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                near = np.flatnonzero((row <= kth + 1e-9 * (1 + abs(kth))) & np.isfinite(row)) if np.isfinite(kth) else np.flatnonzero(np.isfinite(row))
                exact = np.sqrt(((x[near] - y[at + r]) ** 2).sum(1))
                first = np.lexsort((ids[near], exact))[:k]
                out.append(pd.DataFrame({"query_id": own[at + r], "vec_id": ids[near][first], "score": exact[first]}))
        return pd.concat(out, ignore_index=True) if out else none

    return run


def _parted(kept: DataFrame, root: Index, n: int, k: int, rows_a_part: int, most_parts: int, sample: int, aim: float) -> dict[int, Index]:
    """The second level: an index for each part of the root that holds more than twice ``rows_a_part``, each fitted in a task on at
    most ``sample`` rows of that part. None where the root's parts are as many as the rows need."""
    if n <= 2 * rows_a_part * root.parts:
        return {}
    sent = kept.sparkSession.sparkContext.broadcast(root)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.part(x), pa.int32()), b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["part", "vec_id", "v"])

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([np.frombuffer(b) for b in rows["v"]])
        parts = first_parts(int(rows["held"].iloc[0]), len(x), rows_a_part, most_parts)
        return pd.DataFrame({"part": [key[0]], "index": [pickle.dumps(Index(x, parts, k, aim).state())]})

    own = kept.where("r = 1").select("vec_id", "v").mapInArrow(place, "part int, vec_id long, v binary")
    held = own.groupBy("part").agg(F.count("*").alias("held")).where(F.col("held") > 2 * rows_a_part)
    # by a threshold of hashes first, half as many again as are needed: no part is sorted whole
    near = own.join(F.broadcast(held), "part").where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 40)) * F.col("held") < F.lit(int(1.5 * sample)) * F.lit(float(1 << 40)))
    some = near.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id"))).where(F.col("i") <= sample)
    fitted = some.select("part", "held", "v").groupBy("part").applyInPandas(fit, "part int, index binary")
    return {r["part"]: Index.of(pickle.loads(bytes(r["index"]))) for r in fitted.collect()}  # a row for each part of the root


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, rows_a_part: int = 2000, most_parts: int = 256, sample: int = 10000, aim: float = 0.98, block: int = 4096) -> DataFrame:
    """vectors and queries: vec_id, embedding. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    valid = taking_part(vectors)
    smallest = Window.partitionBy("v").orderBy("vec_id")
    once = valid.groupBy("vec_id", "v").agg(F.lit(1).alias("one")).drop("one")
    kept = checkpointed(once.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1))
    n = kept.count()
    distinct = kept.where("r = 1").select("vec_id", "v")
    fit = np.array([r[0] for r in distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()])
    root = Index(fit, first_parts(n, len(fit), rows_a_part, most_parts), k, aim)
    index = spark.sparkContext.broadcast(Tree(root, _parted(kept, root, n, k, rows_a_part, most_parts, sample, aim), fit, k, aim))  # as large as its routers
    parts = index.value.parts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(index.value.part(x), pa.int32())], ["vec_id", "v", "part"])

    placed = checkpointed(kept.select("vec_id", "v").mapInArrow(place, "vec_id long, v binary, part int"))
    held = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():  # a row for each part
        held[r[0]] = r[1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                to = index.value.route(x, held, k + 1)
                row = np.repeat(np.arange(len(x)), [len(t) for t in to])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array([x[i].tobytes() for i in row], pa.binary()), pa.array(np.concatenate(to).astype(np.int32))], ["query_id", "v", "part"]
                )

    asked = taking_part(queries).where(F.size("v") == (fit.shape[1] if len(fit) else 0)).groupBy("vec_id", "v").agg(F.lit(1).alias("one"))
    routed = checkpointed(asked.select("vec_id", "v").mapInArrow(send, "query_id long, v binary, part int"))
    wanted = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        wanted[r[0]] = r[1]
    blocks = F.array(*(F.lit(int(max(1, -(-x // block)))) for x in held))
    slices = F.array(*(F.lit(int(max(1, -(-x // block)))) for x in wanted))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.get(n, F.col("part"))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.get(n, F.col("part")) - 1))
    c = placed.select("vec_id", "v", "part", spread("vec_id", blocks).alias("block"), each(slices).alias("slice"))
    q = routed.select("query_id", "v", "part", spread("query_id", slices).alias("slice"), each(blocks).alias("block"))
    by = ("part", "block", "slice")
    found = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(_search(k), RESULT)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
