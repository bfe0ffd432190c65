"""Near-duplicate documents by SimHash, with pivot distance tables.

Fingerprints link at ``bits`` or fewer differing bits. Equal fingerprints are first taken together,
under the smallest doc_id. Candidate pairs then share a bucket: where two fingerprints differ in at
most four bits, one of five blocks of bits is equal in both (for large corpora four blocks of eight
hold, and so on, so that buckets stay small). In a bucket, a table holds each fingerprint's Hamming
distances to reference fingerprints. By the triangle inequality two fingerprints at distance d differ
by at most d in every coordinate of the table, so a pair is discarded as soon as one coordinate differs
by more than ``bits``; what survives all of them is verified exactly. A bucket with more than
``limit`` fingerprints is not compared in one task: its members go one level further, with the bits
that are still open in five blocks, until the buckets are small. No pair is lost at any level. A bucket
returns a spanning forest of its links, never all its pairs.

Cases: a null text is an empty one; a text without words has fingerprint zero and links like any other;
a text of fewer than ``width`` words has one shingle, the whole sequence. Rows with one doc_id that
repeat keep a row each; if their texts differ they are one document with several fingerprints, which links all of them. A null doc_id has a fingerprint, but no links and a null component. Other columns of the input
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import checkpointed, components, looked_up, mapped, partitions, smallest_labels, sorted_groups, text_bytes, union_all

SEED = 42
SHORT = 30  # shingles of a set whose candidates are found exactly
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 4) -> bytes:
    """64 bits, most significant first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
        count, chunks = 1, [hashes]
    else:
        starts = [0, *ends]
        count = len(words) - width + 1
        chunks = (
            [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(at + _CHUNK, count)], ends[at + width - 1 : min(at + _CHUNK, count) + width - 1], strict=True)]
            for at in range(0, count, _CHUNK)
        )
    ones = np.zeros(64, np.int64)
    for hashes in chunks:
        ones += np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp: a long with the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b"".join(fingerprint(t, width) for t in text_bytes(b.column(1)))
            fp = np.frombuffer(bits, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def references(count: int) -> np.ndarray:
    """Reference fingerprints: a SplitMix64 sequence from a fixed start."""
    z = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def open_blocks(fixed: int, count: int) -> list[int]:
    """The bits that ``fixed`` leaves open, in ``count`` blocks of nearly equal size, as masks."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cut = [round(k * len(free) / count) for k in range(count + 1)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def first_masks(nodes: int, bits: int, aim: int = 256) -> list[int]:
    """Masks of which at least one is equal in any two fingerprints at ``bits`` or fewer differing bits;
    they fix enough bits for buckets of about ``aim`` even fingerprints."""
    blocks = bits + 1
    while blocks < bits + 5 and nodes / aim > 2 ** (64 * (blocks - bits) / blocks):
        blocks += 1
    parts = open_blocks(0, blocks)
    return [sum(c) for c in combinations(parts, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_pairs(starts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each group, about ``most`` at a time."""
    size = np.diff(starts)
    row_group = np.repeat(np.arange(len(size)), size)
    after = starts[1:][row_group] - np.arange(starts[-1]) - 1  # rows of the group behind each row
    total = np.cumsum(after)
    at = 0
    while at < len(after):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = after[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        at = to


def pivot_links(fp: np.ndarray, starts: np.ndarray, bits: int, pivots: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the groups at ``bits`` or fewer differing bits."""
    fp = fp.view(np.uint64)
    distances = [np.bitwise_count(fp ^ p).astype(np.int8) for p in pivots]
    found_i, found_j = [], []
    for i, j in bucket_pairs(starts, most):
        for d in distances:
            near = np.abs(d[i] - d[j]) <= bits
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        found_i.append(i[near])
        found_j.append(j[near])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def _compare(bits: int, n_pivots: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = references(n_pivots)
        for t, starts, whole in sorted_groups(batches, ["mask", "key"], limit):
            fp, rep, mask = (t.column(c).to_numpy() for c in ("fp", "rep", "mask"))
            if whole:
                i, j = pivot_links(fp, starts, bits, pivots)
                used = np.unique(np.concatenate([i, j]))
                label = smallest_labels(len(used), np.searchsorted(used, i), np.searchsorted(used, j))
                u, v = rep[used], rep[used[label]]
                u, v = u[label != np.arange(len(used))], v[label != np.arange(len(used))]
                yield pa.RecordBatch.from_pydict({"mask": np.zeros(len(u), np.int64), "u": u, "v": v})
            else:  # too many for one task: next level
                yield pa.RecordBatch.from_pydict({"mask": mask, "u": fp, "v": rep})

    return run


def linked(nodes: DataFrame, bits: int = 4, n_pivots: int = 24, limit: int = 4096) -> DataFrame:
    """nodes: fp (distinct), rep. Links u, v between reps that connect whatever is connected at ``bits``."""
    spark = nodes.sparkSession
    n = nodes.count()
    masks = F.array(*(F.lit(_signed(m)) for m in first_masks(n, bits)))
    level = nodes.select("fp", "rep", F.explode(masks).alias("mask"))
    edges = []
    while True:
        keyed = level.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        dealt = keyed.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key")
        done = checkpointed(dealt.mapInArrow(_compare(bits, n_pivots, limit), "mask long, u long, v long"))
        edges.append(done.where("mask = 0").select("u", "v"))
        hot = [r[0] for r in done.where("mask <> 0").select("mask").distinct().collect()]
        if not hot:
            return union_all(edges)
        deeper = F.map_from_arrays(
            F.array(*(F.lit(m) for m in hot)),
            F.array(*(F.array(*(F.lit(_signed((m & (1 << 64) - 1) | b)) for b in open_blocks(m & (1 << 64) - 1, bits + 1) if b)) for m in hot)),
        )
        level = done.where("mask <> 0").select(F.col("u").alias("fp"), F.col("v").alias("rep"), F.explode(deeper[F.col("mask")]).alias("mask"))


def simhash_components(docs: DataFrame, width: int = 4, bits: int = 4, n_pivots: int = 24, limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id that can be reached)."""
    fps = checkpointed(with_fingerprints(docs, width))
    nodes = checkpointed(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = linked(nodes, bits, n_pivots, limit)
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    if not several.isEmpty():  # fingerprints of one document belong together
        own = fps.join(several, "doc_id", "left_semi").join(nodes, "fp").select("doc_id", "rep").distinct()
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").select(F.col("rep").alias("u"), "v"))
    moved = components(links).toDF("rep", "component_id")
    by_fp = nodes.join(moved, "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


# --- near duplicates by similarity -------------------------------------------------------------


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's shingles, lower-cased as for fingerprints."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - width + 1)
    last = min(width, len(words))
    return np.unique(np.frombuffer(b"".join([digest(joined[starts[k] : starts[k + last] - 1], SEED) for k in range(n)]), ">u8").astype(np.uint64))


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of shingles in ``words`` words of 64 bits, each from hashes mixed in a way of its own."""
    ones, salts = np.zeros(64 * words, np.int64), references(words)
    for at in range(0, len(shingles), 4096):
        h = shingles[at : at + 4096, None] ^ salts
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).view(np.uint64)


def agreement(common: int, left: int, right: int) -> float:
    """Probability that a bit is the same in the fingerprints of two sets with so many shingles in common and of their own."""
    pmf = lambda n: np.array([comb(n, k) / 2**n for k in range(n + 1)])
    ones = np.arange(common + 1)

    def one(own: int) -> np.ndarray:
        above = np.append(np.cumsum(pmf(own)[::-1])[::-1], 0)
        return above[np.clip((common + own) // 2 + 1 - ones, 0, own + 1)]

    a, b = one(left), one(right)
    return float(pmf(common) @ (a * b + (1 - a) * (1 - b)))


def least_agreement(similarity: float, above: int = SHORT) -> float:
    """The smallest agreement of bits of two sets at ``similarity`` or more, one of them of more than ``above`` shingles.

    Bits of small sets agree less often than the angle says, of large ones at least as often as it.
    """
    least = 1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi
    for union in range(above + 1, 4 * above + 1):
        common = int(np.ceil(similarity * union - 1e-9))
        for left in range((union - common) // 2 + 1):
            if union - left > above:
                least = min(least, agreement(common, left, union - common - left))
    return least


def _tables(nodes: int, agree: float, miss: float, words: int) -> np.ndarray:
    """Bits of each table: enough bits for small buckets, enough tables to miss a pair whose bits agree with ``agree`` with probability ``miss``."""
    bits = int(np.clip(np.ceil(np.log2(max(nodes, 1) / 64)), 12, 26))
    count = int(np.ceil(np.log(miss) / np.log(1 - agree**bits)))
    rng, drawn = np.random.default_rng(11), []
    while sum(map(len, drawn)) < count * bits:
        drawn.append(rng.permutation(64 * words))
    return np.concatenate(drawn)[: count * bits].reshape(count, bits)


def _loose(bits: int, n_pivots: int, limit: int):
    """Links between sets whose first two words differ in ``bits`` or fewer bits, bucket by bucket, as spanning forests.

    In a bucket of more than ``limit`` all are linked: what they have in common is checked exactly later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, heads = references(2 * n_pivots).reshape(2, -1), {}
        for t, starts, whole in sorted_groups(batches, ["bucket"], limit):
            a, b, rep = (t.column(c).to_numpy() for c in ("f0", "f1", "rep"))
            if not whole:
                head = heads.setdefault(int(t.column("bucket")[0].as_py()), int(rep[0]))
                own = rep != head
                yield pa.RecordBatch.from_pydict({"u": rep[own], "v": np.full(own.sum(), head), "table": t.column("bucket").to_numpy()[own] >> 32})
                continue
            a, b, found = a.view(np.uint64), b.view(np.uint64), []
            distances = [(np.bitwise_count(a ^ p) + np.bitwise_count(b ^ q)).astype(np.int16) for p, q in pivots.T]
            for i, j in bucket_pairs(starts, 1 << 20):
                for d in distances:
                    near = np.abs(d[i] - d[j]) <= bits
                    if not near.all():
                        i, j = i[near], j[near]
                near = np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j]) <= bits
                found.append((i[near], j[near]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            used = np.unique(np.concatenate([i, j]))
            label = smallest_labels(len(used), np.searchsorted(used, i), np.searchsorted(used, j))
            moved = label != np.arange(len(used))
            yield pa.RecordBatch.from_pydict({"u": rep[used][moved], "v": rep[used[label]][moved], "table": t.column("bucket").to_numpy()[used][moved] >> 32})

    return run


def _overlaps(sets: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Elements that sets i and j have in common; ``sets`` has a row for each, filled up with the largest number."""
    both = np.sort(np.concatenate([sets[i], sets[j]], axis=1), axis=1)
    fill = 2 * sets.shape[1] - size[i] - size[j]
    return (both[:, 1:] == both[:, :-1]).sum(axis=1) - np.maximum(fill - 1, 0)


def _short_links(similarity: float, limit: int):
    """Links between short sets in a bucket at ``similarity`` or more, as spanning forests; a bucket of more than ``limit`` is linked as in ``_loose``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {}
        for t, starts, whole in sorted_groups(batches, ["bucket"], limit):
            rep = t.column("rep").to_numpy()
            if not whole:
                head = heads.setdefault(t.column("bucket")[0].as_py(), int(rep[0]))
                u, v = rep[rep != head], np.full((rep != head).sum(), head)
            else:
                made = [np.frombuffer(x, np.uint64) for x in t.column("small").to_pylist()]
                size, sets = np.array([len(x) for x in made]), np.full((len(made), SHORT), np.iinfo(np.uint64).max)
                for k, x in enumerate(made):
                    sets[k, : len(x)] = x
                found = [np.zeros((2, 0), int)]
                for i, j in bucket_pairs(starts, 1 << 15):
                    near = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
                    i, j = i[near], j[near]
                    near = (1 + similarity) * _overlaps(sets, size, i, j) >= similarity * (size[i] + size[j]) - 1e-6
                    found.append(np.stack([i[near], j[near]]))
                i, j = np.concatenate(found, axis=1)
                used = np.unique(np.concatenate([i, j]))
                label = smallest_labels(len(used), np.searchsorted(used, i), np.searchsorted(used, j))
                moved = label != np.arange(len(used))
                u, v = rep[used][moved], rep[used[label]][moved]
            yield pa.RecordBatch.from_pydict({"u": u, "v": v, "table": np.zeros(len(u), np.int64)})

    return run


def short_candidates(nodes: DataFrame, similarity: float, limit: int, most: int = 1 << 16) -> DataFrame:
    """u, v, table: links between sets of at most ``SHORT`` shingles (columns rep, small), none of them missed.

    In one order of all shingles, two similar sets share one of the first few of each (prefix filter). The
    ``most`` frequent shingles come last in that order, rarer first, so that buckets stay small.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], ["shingle"])

    short = nodes.where("small is not null and length(small) > 0").select("rep", "small")
    counts = mapped(short.select("small"), single, "shingle long").groupBy("shingle").count().where("count > 64")
    last = {r["shingle"]: r["count"] for r in counts.orderBy(F.desc("count"), "shingle").limit(most).collect()}

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, row = [], []
            for k, small in enumerate(b.column(1).to_pylist()):
                own = np.frombuffer(small, np.int64).tolist()
                first = len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1
                bucket += sorted(own, key=lambda x: (last.get(x, 0), x))[:first]
                row += [k] * first
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), b.column(0).take(at), b.column(1).take(at)], ["bucket", "rep", "small"])

    dealt = mapped(short, prefixes, "bucket long, rep long, small binary").repartition(partitions(nodes.sparkSession), "bucket").sortWithinPartitions("bucket", "rep")
    return mapped(dealt, _short_links(similarity, limit), "u long, v long, table long")


def _families(loose: DataFrame, first: int = 6) -> DataFrame:
    """Components of the links of all tables. Those of the first few tables are found first: links of the
    other tables mostly fall inside them, so that a large family does not bring its links once for each table."""
    early = checkpointed(components(loose.where(F.col("table") < first).select("u", "v")))
    late = loose.where(F.col("table") >= first).select("u", "v").distinct()
    late = late.join(early.toDF("u", "to_u"), "u", "left").select(F.coalesce("to_u", "u").alias("u"), "v")
    late = late.join(early.toDF("v", "to_v"), "v", "left").select("u", F.coalesce("to_v", "v").alias("v"))
    return components(late.where("u <> v").distinct().unionByName(early))


def similar_pairs(sets: list[np.ndarray], similarity: float, near: np.ndarray | None = None, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets with a Jaccard similarity of ``similarity`` or more; with ``near`` (n by n), only those that it marks."""
    if near is not None:
        used = np.flatnonzero((near | near.T).any(axis=1))
        i, j = similar_pairs([sets[k] for k in used], similarity) if len(used) else (np.zeros(0, int),) * 2
        i, j = used[i], used[j]
        marked = near[i, j]
        return i[marked], j[marked]
    size = np.array([len(s) for s in sets], float)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size.astype(int))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, z = np.searchsorted(column, [first, first + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[row[a:z], column[a:z] - first] = 1
        common += held @ held.T
    found = [np.zeros((2, 0), int)]
    for at in range(0, len(sets), 256):
        i, j = np.nonzero(common[at : at + 256])
        i, n = i + at, common[at : at + 256][i, j].astype(float)
        fine = (i < j) & ((1 + similarity) * n >= similarity * (size[i] + size[j]) - 1e-6)
        found.append(np.stack([i[fine], j[fine]]))
    return tuple(np.concatenate(found, axis=1))


def _exact(similarity: float):
    """Links within a group (rows of one block), or between the two blocks of a group, as spanning forests.

    Pairs whose distances to a pivot differ by more than the distance allowed are discarded before they are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and held[-1][:3] != row[:3]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        for rows in groups():
            (_, x, y), rows = rows[0][:3], sorted({(r[3] != r[1], r[4], tuple(r[5] or ()), r[6]) for r in rows})
            sets, rep = [np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[1] for r in rows])
            near, far = None, np.array([r[2] for r in rows])
            if far.size or x != y:
                near = np.ones((len(rows), len(rows)), bool)
                for d in far.T:
                    near &= np.abs(d[:, None] - d[None, :]) <= 1 - similarity + 1e-6
                if x != y:
                    right = np.array([r[0] for r in rows])
                    near &= right[:, None] != right[None, :]
            i, j = similar_pairs(sets, similarity, near)
            label = smallest_labels(len(rows), i, j)
            moved = label != np.arange(len(rows))
            yield pa.RecordBatch.from_pydict({"u": rep[moved], "v": rep[label[moved]]})

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard distances of each set to the pivots of its family."""
    for big in batches:
        for at in range(0, big.num_rows, 256):
            b = big.slice(at, 256)
            out = []
            for own, pivots in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                mine, row = np.frombuffer(own, np.uint64), []
                for p in pivots:
                    other = np.frombuffer(p, np.uint64)
                    common = len(np.intersect1d(mine, other, assume_unique=True))
                    row.append(1 - common / (len(mine) + len(other) - common) if len(mine) + len(other) else 0.0)
                out.append(row)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(out, pa.list_(pa.float64()))], ["key", "family", "shingles", "names", "far"])


def _laid_out(units: list, block: int, elements: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """units: (cell, band, part, n, total) in order. The first block of each unit with their number, and which blocks each block meets.

    Small units next to each other share a block. Blocks meet unless all their cells or bands are two or more
    apart, or both hold nothing but one part, whose sets are linked already.
    """
    place, blocks = [], []  # a block: lowest and highest band and cells, parts, n, total
    for cell, band, part, n, total in units:
        at, many = np.array([band, *cell]), max(1, -(-n // block), -(-total // elements))
        last = blocks[-1] if blocks else None
        if many == 1 and last and last[3] + n <= block and last[4] + total <= elements:
            blocks[-1] = (np.minimum(last[0], at), np.maximum(last[1], at), last[2] | {part}, last[3] + n, last[4] + total)
            place.append((len(blocks) - 1, 1))
        else:
            place.append((len(blocks), many))
            blocks += [(at, at, {part}, n if many == 1 else block, total)] * many
    low, high = (np.array([b[k] for b in blocks]) for k in (0, 1))
    meets = []
    for b in blocks:
        near = ((low <= b[1] + 1) & (high >= b[0] - 1)).all(axis=1)
        settled = len(b[2]) == 1 and -1 not in b[2]
        meets.append([int(o) for o in np.flatnonzero(near) if not (settled and blocks[o][2] == b[2])])
    return place, meets


def family_links(held: DataFrame, similarity: float, n_pivots: int = 4, block: int = 1024, elements: int = 1 << 19) -> DataFrame:
    """held: key, family, n (rows of the family), total (elements of its sets), shingles. Links u, v of sets at ``similarity``
    or more that connect whatever is connected within a family.

    A family of at most ``block`` sets and ``elements`` elements is compared in one group. In a larger one, a
    pivot distance table comes first: the exact Jaccard distances of all its sets to a few of them. Sets near
    a pivot are linked to it, so they need no comparison with each other. By the triangle inequality other
    pairs are discarded as soon as one coordinate differs by more than 1 - ``similarity``: first by cells of
    that width, which with bands of sizes (similar sets have similar sizes) say which blocks of sets meet at
    all, then pair by pair. So a large family of near copies costs one pass, not all its pairs.
    """
    spark, least = held.sparkSession, 1 - similarity
    n = partitions(spark)
    small = (F.col("n") <= block) & (F.col("total") <= elements)
    none, alone = F.array().cast("array<double>").alias("far"), F.lit(0)
    groups = held.where(small).select("family", alone.alias("x"), alone.alias("y"), alone.alias("b"), "key", none, "shingles")
    large = held.where(~small)
    picked = large.groupBy("family").agg(F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("key", F.lit(k)), "key"))["key"] for k in range(n_pivots)))).alias("picked"))
    picked = checkpointed(picked)
    if picked.isEmpty():
        return mapped(groups.repartition(n, "family", "x", "y").sortWithinPartitions("family", "x", "y"), _exact(similarity), "u long, v long")
    wanted = picked.select("family", F.explode("picked").alias("key"))
    pivots = large.join(wanted, ["family", "key"]).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("key", "shingles"))).alias("p"))
    pivots = checkpointed(pivots.select("family", F.col("p.shingles").alias("pivots"), F.col("p.key").alias("names")))
    near = mapped(large.join(pivots, "family").select("key", "family", "shingles", "pivots", "names"), _distances, "key long, family long, shingles binary, names array<long>, far array<double>")
    # which pivots a set is near to, as bits
    bits = F.aggregate(F.transform("far", lambda d, k: F.when(d <= least + 1e-9, F.pow(F.lit(2.0), k)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x).cast("long")
    size = F.length("shingles") / 8
    band = F.when(size == 0, -1000).otherwise(F.floor(F.log(size) / F.lit(-np.log(similarity) + 1e-9))).cast("int")
    near = checkpointed(near.select("key", "family", "names", "far", bits.alias("bits"), F.transform("far", lambda d: F.floor(d / F.lit(least + 1e-6)).cast("int")).alias("cell"), band.alias("band"), size.cast("long").alias("size")))
    linked_to = near.select(F.col("key").alias("u"), F.explode(F.filter("names", lambda _, k: F.get("far", k) <= least + 1e-9)).alias("v")).where("u <> v")

    def plan(units: list) -> dict:
        """Units of a family, (cell, band, bits, n, total): the part of each, its blocks, and the blocks that each block meets."""
        parts: list[int] = []  # pivots that sets near several of them tie together
        for m in {u["bits"] for u in units} - {0}:
            for o in [o for o in parts if o & m]:
                parts.remove(o)
                m |= o
            parts.append(m)
        parts.sort()
        part = [next((k for k, m in enumerate(parts) if m & u["bits"]), -1) for u in units]
        order = sorted(range(len(units)), key=lambda k: (part[k], units[k]["cell"], units[k]["band"], units[k]["bits"]))
        place, meets = _laid_out([(units[k]["cell"], units[k]["band"], part[k], units[k]["n"], units[k]["total"]) for k in order], block, elements)
        return {"units": [{"cell": units[k]["cell"], "band": units[k]["band"], "bits": units[k]["bits"], "first": f, "many": m} for k, (f, m) in zip(order, place, strict=True)], "meets": meets}

    unit = ("family", "cell", "band", "bits")
    counted = near.groupBy(*unit).agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    laid = counted.groupBy("family").agg(F.collect_list(F.struct("cell", "band", "bits", "n", "total")).alias("units"))
    schema = "struct<units:array<struct<cell:array<int>,band:int,bits:bigint,first:int,many:int>>,meets:array<array<int>>>"
    laid = checkpointed(laid.select("family", F.udf(plan, schema)("units").alias("p")))
    places = laid.select("family", F.explode("p.units").alias("u"), "p.meets").select("family", "u.*", "meets")
    at = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("many"))).cast("int")
    blocks = near.join(places, list(unit)).withColumn("b", at).select("key", "far", "b", F.get("meets", F.col("b")).alias("others")).where("size(others) > 0")
    cut = large.select("key", "family", "shingles").join(blocks, "key").select("family", "key", "far", "shingles", "b", F.explode("others").alias("o"))
    groups = groups.unionByName(cut.select("family", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "key", "far", "shingles"))
    exact = mapped(groups.repartition(n, "family", "x", "y").sortWithinPartitions("family", "x", "y"), _exact(similarity), "u long, v long")
    return exact.unionByName(linked_to)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, **settings) -> DataFrame:
    """doc_id, component_id: the groups of near duplicates (``near_duplicate_sets``), for each row with a doc_id."""
    sketches, by_set = near_duplicate_sets(docs, width, similarity, **settings)
    return looked_up(sketches.select("doc_id", "same"), by_set, "same", "doc_id").select("doc_id", "component_id")


def near_duplicate_sets(docs: DataFrame, width: int = 5, similarity: float = 0.8, miss: float = 1e-3, words: int = 16, n_pivots: int = 8, limit: int = 4096, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Sketches (doc_id and same, the set of its shingles) and, for each set, same and component_id: documents whose sets of shingles have a Jaccard similarity of ``similarity`` or more are linked.

    Equal sets are one (by a 128-bit hash of them). Candidates of sets of at most ``SHORT`` shingles are found
    exactly, by a prefix filter. All candidates else share all bits of one of several tables, drawn from a wide
    fingerprint; the distance of 128 bits thins them out, and what is left falls into loose families. Only
    texts in families are looked at again: within one, pivot distance tables discard pairs and similarities of
    the others are computed exactly (``family_links``). No pair of two short sets is missed; another is missed
    by the tables with a probability of at most ``miss`` (by the exact agreement of bits, not only the angle),
    a closer one far less often; no pair below ``similarity`` is ever linked.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                sets = [shingle_set(t, width) for t in text_bytes(b.column(1))]
                fps = [wide_fingerprint(s, words).tobytes() for s in sets]
                same = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                small = pa.array([s.tobytes() if len(s) <= SHORT else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), small], ["doc_id", "same", "size", "fp", "small"])

    sketches = checkpointed(mapped(texts, sketch, "doc_id long, same binary, size long, fp binary, small binary"))
    nodes = sketches.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("small").alias("small"))
    # a number for each distinct set: no hash, so that no two share one
    nodes = checkpointed(nodes.withColumn("key", F.monotonically_increasing_id()))
    agree = least_agreement(similarity)
    tables = _tables(nodes.count(), agree, miss, words)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.left_shift(np.int64(1), np.arange(tables.shape[1], dtype=np.int64))
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                bits = np.unpackbits(raw, axis=1)
                head = raw[:, :16].copy().view(np.int64)
                for k, own in enumerate(tables):
                    bucket = (bits[:, own].astype(np.int64) @ weight) + (np.int64(k) << np.int64(32))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0), pa.array(head[:, 0].copy()), pa.array(head[:, 1].copy())], ["bucket", "rep", "f0", "f1"])

    n = partitions(spark)
    radius = int(np.ceil(128 * (1 - agree) + 5 * np.sqrt(128 * agree * (1 - agree))))
    dealt = mapped(nodes.select(F.col("key").alias("rep"), "fp"), buckets, "bucket long, rep long, f0 long, f1 long")
    # in the order of rep, so that buckets of one family mostly link to the same few
    loose = mapped(dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "rep"), _loose(radius, n_pivots, limit), "u long, v long, table long")
    loose = checkpointed(loose.unionByName(short_candidates(nodes.select(F.col("key").alias("rep"), "small"), similarity, limit)))
    moved = _families(loose).toDF("key", "family")
    families = moved.unionByName(moved.select(F.col("family").alias("key"), "family").distinct())
    members = checkpointed(nodes.select("key", "rep", "size", "same").join(families, "key"))
    sized = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("total"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                made = [shingle_set(t, width) for t in text_bytes(b.column(0))]
                own = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == same for s, same in zip(made, b.column(1).to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), b.column(5), pa.array([s.tobytes() for s in made], pa.binary())], ["key", "family", "n", "total", "shingles"])
                yield out.filter(own)  # a doc_id may have other texts

    held = texts.join(members.join(sized, "family"), texts["doc_id"] == F.col("rep")).select("text", "same", "key", "family", "n", "total")
    held = checkpointed(mapped(held, sets, "key long, family long, n long, total long, shingles binary"))
    joined = components(family_links(held, similarity, block=block)).toDF("key", "into")
    groups = nodes.select("key", "same", "rep").join(joined, "key", "left").select("same", "rep", F.coalesce("into", "key").alias("into"))
    first = groups.groupBy("into").agg(F.min("rep").alias("component_id"))
    return sketches, looked_up(groups, first, "into", "same").select("same", "component_id")


def near_duplicates_removed(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near duplicates; rows without doc_id stay.

    Of rows that repeat one doc_id all stay: they are one document. Columns as in ``docs``.
    """
    keep = near_duplicate_sets(docs, width, similarity)[1].select(F.col("component_id").alias("doc_id")).distinct()
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
