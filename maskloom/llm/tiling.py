"""Benchmark decontamination by greedy string tiling.

Tokens are the runs of letters, digits and underscores of the lower-cased text. A document is a
candidate for a test item when they share a seed, ``least`` consecutive tokens. Tiles are then laid
greedily: the longest common runs of tokens that touch no marked token, found by running Karp-Rabin
at falling lengths, are marked in both, down to ``least`` tokens. The part of the item under tiles is
its coverage; as tiles may lie in any order, reordered passages count in full. Pairs whose coverage is
at least ``threshold`` are returned. A pair whose seeds together cover less of the item is not tiled,
since tiles consist of seeds.

The seed join runs where the documents are: the items are held by every task in blocks of at most
``block_bytes`` of text, and a larger benchmark takes one pass over the documents for each block, so
that neither side is shuffled and no hot token run gathers in one task.

Cases: a null text is an empty one; items of fewer than ``least`` tokens can't be told from chance and
match nothing; equal items each report their pairs; rows that repeat are each reported; among tiles of
one length the first in the item goes first, then the first in the document; null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import mapped, sliced, union_all

_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, item_id long, item_tokens int, tiles int, covered int, longest int, coverage double"


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``length`` ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, part, unit = np.zeros(n, np.uint64), 0, _BASE, ids.astype(np.uint64) + np.uint64(1), 1
    part = part * (part ^ np.uint64(0xBF58476D1CE4E5B9))
    while unit <= length:  # windows of 1, 2, 4... ids, put together as the bits of length say
        if length & unit:
            out = out * np.uint64(power) + part[done : done + n]
            done += unit
        part = part[:-unit] * np.uint64(power) + part[unit:] if len(part) > unit else part[:0]
        power, unit = power * power & 0xFFFFFFFFFFFFFFFF, unit * 2
    return out


def _unmarked(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of ``length`` tokens without a mark."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[length:] == total[:-length]) if len(marked) >= length else np.zeros(0, int)


def tile(item: np.ndarray, doc: np.ndarray, least: int, first: int = 20) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) of two arrays of ids; negative ids match nothing."""
    in_item, in_doc = item < 0, doc < 0
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(first, len(item)))
    while True:
        starts = defaultdict(list)
        hashes = window_hashes(item, length)
        for p in _unmarked(in_item, length):
            starts[int(hashes[p])].append(int(p))
        hashes = window_hashes(doc, length)
        open_ = _unmarked(in_doc, length)
        open_ = open_[np.isin(hashes[open_], np.array(list(starts), np.uint64))] if starts else open_[:0]
        found: list[tuple[int, int, int]] = []
        for d in map(int, open_):
            for p in starts[int(hashes[d])]:
                if p and d and item[p - 1] == doc[d - 1] and not in_item[p - 1] and not in_doc[d - 1]:
                    continue  # part of a longer match that starts before
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and not in_item[p + n] and not in_doc[d + n]:
                    n += 1
                if n >= length:
                    found.append((-n, p, d))
        longest = -min(found)[0] if found else 0
        if longest > 2 * length:
            length = longest
            continue
        heapq.heapify(found)  # longest first
        while found:
            n, p, d = heapq.heappop(found)
            free = ~(in_item[p : p - n] | in_doc[d : d - n])
            if free.all():
                in_item[p : p - n] = in_doc[d : d - n] = True
                tiles.append((p, d, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
            for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if z - a >= length:  # what longer tiles leave of it
                    heapq.heappush(found, (a - z, p + a, d + a))
        if length == least:
            return tiles
        length = max(least, length // 2)


class Items:
    """Test items, their vocabulary and their seeds."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least, self.ids, self.items, self.word = least, [], [], {}
        for item_id, text in rows:
            if len(words := tokens(text)) >= least:
                self.ids.append(item_id)
                self.items.append(np.array([self.word.setdefault(w, len(self.word)) for w in words], np.int64))
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        hashes = [window_hashes(item, least) for item in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(every, kind="stable")
        #: the items and places of each seed one after the other, ``ends`` where those of a seed end
        self.item_of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place_of = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)]).astype(np.int64)[order]
        self.seeds, first = np.unique(every[order], return_index=True)
        self.ends = np.append(first, len(every))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, text: str | None, threshold: float) -> list[tuple]:
        """(item_id, item_tokens, tiles, covered, longest, coverage) of the items that the text holds."""
        if not self.ids:
            return []
        get = self.word.get
        ids = np.array([get(w, -1) for w in tokens(text)], np.int64)
        hashes = window_hashes(ids, self.least)
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return []
        slot = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        hit = self.seeds[slot] == hashes[at]
        at, slot = at[hit], slot[hit]
        # each seed of the text once, however often it stands there; tokens of an item that its seeds cover are counted by their places
        own = np.unique(slot)
        count = self.ends[own + 1] - self.ends[own]
        row = np.repeat(self.ends[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        order = np.lexsort((self.place_of[row], self.item_of[row]))
        row, seed = row[order], np.repeat(own, count)[order]
        item, place = self.item_of[row], self.place_of[row]
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))[: len(item)]
        steps = np.minimum(np.append(place[1:] - place[:-1], 0), self.least)
        until = np.append(first[1:], len(item))
        steps[until - 1] = self.least
        cover = np.add.reduceat(steps, first) if len(first) else steps
        out = []
        for g in np.flatnonzero(cover >= threshold * self.lengths[item[first]]).tolist():
            k = int(item[first[g]])
            item_ids = self.items[k]
            inside = np.zeros(len(ids), bool)  # only tokens in seeds can be in tiles
            here = at[np.isin(slot, seed[first[g] : until[g]])]
            for s in range(self.least):
                inside[here + s] = True
            inside = np.flatnonzero(inside)
            gaps = np.flatnonzero(np.diff(inside) > 1) + 1
            doc = np.insert(ids[inside], gaps, -1)
            laid = tile(item_ids, doc, self.least)
            covered = sum(n for _, _, n in laid)
            if covered >= threshold * len(item_ids):
                out.append((self.ids[k], len(item_ids), len(laid), covered, max(n for _, _, n in laid), covered / len(item_ids)))
        return out


def _blocks(benchmark: DataFrame, least: int, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = -(-int(held) // block_bytes)
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == k) if count > 1 else rows
        yield Items(sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1])), least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 32 << 20) -> DataFrame:
    """A row for each document row and item whose coverage is at least ``threshold``."""
    sc, rows = docs.sparkSession.sparkContext, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def block(items: Items) -> DataFrame:
        sent = sc.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for b in batches:
                found = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in held.matches(t, threshold)]
                columns = list(zip(*found, strict=True)) or [()] * 7
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        return rows.mapInArrow(run, SCHEMA)

    found = [block(items) for items in _blocks(benchmark, least, block_bytes)]
    return union_all(found) if found else rows.sparkSession.createDataFrame([], SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item to ``threshold``; columns as in ``docs``, no shuffle."""
    sc = docs.sparkSession.sparkContext
    for items in _blocks(benchmark, least, block_bytes):
        sent, at = sc.broadcast(items), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for b in sliced(batches):
                yield b.filter(pa.array([not held.matches(t, threshold) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = mapped(docs, run, docs.schema)
    return docs
