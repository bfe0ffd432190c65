"""Removal of word passages that an earlier document holds, by super-k-mers.

A window is ``width`` consecutive words of one document. Every word is removed that lies in a window whose
words also start in a document with a smaller doc_id; windows are judged on the input.

The minimiser of a window is the smallest hash of its runs of ``GRAM`` words. Consecutive windows with one
minimiser are a super-k-mer: they travel as one packed string of words, to the bucket that the minimiser
names, where equal windows must meet. Steps:

1. Documents with the same words as one with a smaller doc_id are removed whole; the others go on.
2. Minimisers are counted over all of those. One that a single document holds can't be that of a repeated
   window, so its super-k-mers stay at home: only text that may repeat is shuffled.
3. Super-k-mers of shared minimisers are packed. Of equal strings in a block of texts only those of the smallest
   doc_id travel, since the others are known to repeat. In a bucket, windows are sorted exactly: runs of 1, 2, 4...
   words get numbers by sorting the pairs of numbers of their halves, until windows have them; windows of
   one number behind the smallest doc_id are marked.
   A minimiser that more than ``HOT`` super-k-mers share (a passage in very many contexts) has no bucket: its windows
   are dealt one by one, by 128 bits of all their words, so no task gets an unbounded group.
4. Marked words are united by document and what is left is hashed.

A bucket's rows arrive sorted from Spark and are read as a stream, so memory is that of a few thousand strings.

Cases: a null text has no words, and the SHA-256 of no bytes; a null doc_id is larger than all others (as large as
the largest long); rows with one doc_id never count against each other, whether their texts are equal or not, and
each has its own row; other columns are ignored; an empty table gives no rows. A passage that repeats within one
document only stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import checkpointed, mapped, partitions, sliced, sorted_groups, text_bytes
from maskloom.llm.suffix import _folded, _mixed, smallest_in_runs

WIDTH, GRAM = 50, 8
HOT = 1000
BLOCK = 1 << 22
LAST = np.iinfo(np.int64).max
_U = np.uint64
_R = (0xD1342543DE82EF95, 0x9E3779B97F4A7C15)

#: kind 0: marked words, from ``start`` to ``stop``, dealt by document; 1: a super-k-mer; 2: a window on its own, by two hashes;
#: if it stands at several places of the document, ``stop`` is -1 and ``packed`` has all of them.
_TRAVEL = "kind int, bucket long, second long, doc long, variant long, start int, stop int, packed binary"


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # splits at 0x20 and 0x09 to 0x0D


class Block:
    """The words of some texts, one text after the other, and their windows."""

    def __init__(self, texts: list[list[bytes]], width: int, gram: int):
        self.words = [w for t in texts for w in t]
        self.width, self.gram = width, min(gram, width)
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        number: dict[bytes, int] = {}
        self.ids = np.array([number.setdefault(w, len(number)) for w in self.words], np.int64)
        self.distinct = list(number)

    def hashes(self, seed: int) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w, seed) for w in self.distinct], _U)[self.ids] if len(self.ids) else np.zeros(0, _U)

    def rolled(self, seed: int, length: int) -> np.ndarray:
        """A hash of each run of ``length`` words."""
        h, r = self.hashes(seed), _R[seed % 2]
        power = {1 << k: _U(pow(r, 1 << k, 1 << 64)) for k in range(12)}
        n = len(h) - length + 1
        return _mixed(_folded(h, length, lambda a, b, unit: a * power[unit] + b[: len(a)])[:n]) if n > 0 else np.zeros(0, _U)

    def super_kmers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, minimiser, first window and number of windows of each super-k-mer; windows by place in the block."""
        grams = self.rolled(0, self.gram)
        runs = self.width - self.gram + 1
        none = np.zeros(0, np.int64)
        if len(grams) < runs:
            return none, none, none, none
        low = smallest_in_runs(grams, runs).view(np.int64)
        inside = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(inside, self.starts, 1)
        np.add.at(inside, np.maximum(self.starts, self.ends - self.width + 1), -1)
        at = np.flatnonzero(np.cumsum(inside)[: len(low)] > 0)
        if not len(at):
            return none, none, none, none
        first = np.flatnonzero(np.concatenate([[True], (at[1:] - at[:-1] != 1) | (low[at[1:]] != low[at[:-1]])]))
        start = at[first]
        return np.searchsorted(self.ends, start, "right"), low[start], start, np.diff(np.append(first, len(at)))


def blocks(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[tuple[pa.Table, list[list[bytes]]]]:
    """Rows in groups of about ``size`` bytes of column ``text``, with the words of each."""
    held, texts, total = [], [], 0
    for b in sliced(batches, 64):
        own = text_bytes(b.column(text))
        held.append(b)
        texts += [words_of(t) for t in own]
        total += sum(map(len, own))
        if total >= size:
            yield pa.Table.from_batches(held), texts
            held, texts, total = [], [], 0
    if held:
        yield pa.Table.from_batches(held), texts


def _profiles(width: int, gram: int):
    """doc, variant, n_words, a digest of the words and the minimisers of the super-k-mers of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, 2, BLOCK):
            block = Block(texts, width, gram)
            text, low, _, _ = block.super_kmers()
            ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            digests = [hashlib.sha256(b" ".join(t)).digest() for t in texts]
            columns = [rows.column(k).combine_chunks() for k in (0, 1)] + [pa.array(list(map(len, texts)), pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(low))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "variant", "n_words", "digest", "minimisers"])

    return run


def _travelling(kind: int, bucket, second, doc, variant, start, stop, packed=None) -> pa.RecordBatch:
    n = len(doc)
    columns = [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(c, np.int64)) for c in (bucket, second, doc, variant))]
    columns += [pa.array(np.asarray(c, np.int32)) for c in (start, stop)] + [pa.array(packed if packed is not None else [None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _TRAVEL.split(", ")])


def _first_of(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """The smallest ``doc`` among the rows with the same keys, for each row."""
    order = np.lexsort((doc, *keys))
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]) if len(doc) else np.zeros(0, bool)
    out = np.empty_like(doc)
    out[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    return out


def _windows(one: np.ndarray, two: np.ndarray, text: np.ndarray, doc: np.ndarray, variant: np.ndarray, begin: np.ndarray, width: int) -> pa.RecordBatch:
    """A row for each window and text, however often it stands there."""
    order = np.lexsort((begin, text, two, one))
    one, two, text, begin = (x[order] for x in (one, two, text, begin))
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (text[1:] != text[:-1])]))[: len(one)]
    until = np.append(first[1:], len(one))[: len(first)]
    packed: list[bytes | None] = [None] * len(first)
    several = until - first > 1
    for k in np.flatnonzero(several).tolist():
        packed[k] = begin[first[k] : until[k]].astype(np.int32).tobytes()
    own = text[first]
    return _travelling(2, one[first], two[first], doc[own], variant[own], begin[first], np.where(several, -1, begin[first] + width), packed)


def _packed_kmers(width: int, gram: int):
    """Super-k-mers of shared minimisers, windows of hot ones, and what is known to repeat from the block alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, 2, BLOCK):
            wanted = rows.column("wanted").combine_chunks().flatten()
            shared, where = np.unique(wanted.field("minimiser").to_numpy(), return_index=True)
            is_hot = wanted.field("hot").to_numpy(zero_copy_only=False)[where]
            doc, variant = (rows.column(k).to_numpy() for k in (0, 1))
            block = Block(texts, width, gram)
            text, low, start, count = block.super_kmers()
            place = np.minimum(np.searchsorted(shared, low), len(shared) - 1)
            meets = shared[place] == low
            hot = meets & is_hot[place]
            offset = block.starts[text] if len(text) else start
            # strings: of equal ones only those of the smallest doc_id travel
            held: dict[bytes, list[int]] = {}
            known = []
            for k in np.flatnonzero(meets & ~hot).tolist():
                packed = b" ".join(block.words[start[k] : start[k] + count[k] + width - 1])
                own = held.setdefault(packed, [k])
                if own[0] == k:
                    continue
                if doc[text[k]] == doc[text[own[0]]]:
                    own.append(k)
                elif doc[text[k]] > doc[text[own[0]]]:
                    known.append(k)
                else:
                    known += own
                    held[packed] = [k]
            sent = np.array([k for own in held.values() for k in own], np.int64)
            strings = [p for p, own in held.items() for _ in own]
            for kind, k in ((1, sent), (0, np.array(known, np.int64))):
                begin = start[k] - offset[k]
                yield _travelling(kind, low[k] if kind else variant[text[k]], text[k], doc[text[k]], variant[text[k]], begin, begin + count[k] + width - 1, strings if kind else None)
            if hot.any():
                k = np.repeat(np.flatnonzero(hot), count[hot])
                at = start[k] + np.arange(len(k)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                one, two = (block.rolled(seed, width).view(np.int64)[at] for seed in (2, 3))
                again = doc[text[k]] > _first_of([two, one], doc[text[k]])
                for kind, own in ((2, ~again), (0, again)):
                    j, begin = k[own], at[own] - offset[k[own]]
                    if not kind:  # neighbours are one piece
                        new = np.concatenate([[True], (begin[1:] - begin[:-1] != 1) | (text[j][1:] != text[j][:-1])])[: len(j)]
                        begin, stop, j = begin[new], begin[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)] + width if len(j) else begin, j[new]
                        yield _travelling(0, variant[text[j]], j, doc[text[j]], variant[text[j]], begin, stop)
                    else:
                        yield _windows(one[own], two[own], text[j], doc, variant, begin, width)

    return run


def window_names(ids: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all runs of ``width`` ids, the same for equal runs only: pairs of numbers of halves are sorted."""

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a[: len(b)] * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    names, unit = ids, 1
    while unit * 2 <= width:
        names, unit = paired(names, names[unit:]), unit * 2
    return paired(names, names[width - unit :]) if unit < width else names


def _repeated(doc: np.ndarray, counts: np.ndarray, packed: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """string, from and to (in words of the string) of all stretches of windows that a smaller doc holds too."""
    words = b" ".join(packed).split(b" ")
    number: dict[bytes, int] = {}
    names = window_names(np.array([number.setdefault(w, len(number)) for w in words], np.int64), width)
    offset = np.concatenate([[0], np.cumsum(counts + width - 1)[:-1]])
    string = np.repeat(np.arange(len(doc)), counts)
    at = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    again = np.flatnonzero(doc[string] > _first_of([names[offset[string] + at]], doc[string]))
    new = np.concatenate([[True], again[1:] - again[:-1] != 1])[: len(again)] | np.concatenate([[True], string[again][1:] != string[again][:-1]])[: len(again)]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(again) - 1)[: len(first)]
    return string[again[first]], at[again[first]], at[again[last]] + width


def _marks(width: int, rows: int):
    """doc, variant, start, stop of all words to be removed, from rows sorted by bucket and doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[tuple[int, int], int] = {}  # of the group that comes in pieces
        for t, _, whole in sorted_groups(batches, ["bucket"], rows):
            kind, bucket, second, doc, variant, start, stop = (t.column(k).to_numpy() for k in range(7))
            out = [tuple(x[kind == 0] for x in (doc, variant, start, stop))]
            own = np.flatnonzero(kind == 1)
            if len(own):
                packed = t.column(7).take(pa.array(own)).to_pylist()
                string, begin, end = _repeated(doc[own], (stop - start)[own] - width + 1, packed, width)
                k = own[string]
                out.append((doc[k], variant[k], start[k] + begin, start[k] + end))
            own = np.flatnonzero(kind == 2)
            first = _first_of([second[own], bucket[own]], doc[own])
            if whole:
                lowest = {}
            else:
                lowest = {k: v for k, v in lowest.items() if k[0] == bucket[0]}
                for j, s in enumerate(second[own].tolist()):
                    first[j] = lowest.setdefault((int(bucket[0]), s), int(first[j]))
            k = own[doc[own] > first]
            once, often = k[stop[k] >= 0], k[stop[k] < 0]
            out.append((doc[once], variant[once], start[once], stop[once]))
            places = [np.frombuffer(p, np.int32) for p in t.column(7).take(pa.array(often)).to_pylist()]
            at, k = np.concatenate([np.zeros(0, np.int32), *places]), np.repeat(often, [len(p) for p in places])
            out.append((doc[k], variant[k], at, at + width))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(d)) for c, d in zip(columns, (np.int64, np.int64, np.int32, np.int32), strict=True)], ["doc", "variant", "start", "stop"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        ids, texts, marks = b.column("doc_id"), text_bytes(b.column("text")), b.column("marks").to_pylist()
        n, removed, digest = [], [], []
        for t, m in zip(texts, marks, strict=True):
            words, kept, at = words_of(t), [], 0
            for x in sorted((x["start"], x["stop"]) for x in m or []):
                kept += words[at : x[0]]
                at = max(at, x[1])
            kept += words[at:]
            n.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _shared(reps: DataFrame, hot: int, share: int) -> DataFrame:
    """doc, variant, wanted: the minimisers of a document that others hold too, and which of them are hot.

    Fewer than ``share`` minimisers can have more than a ``share``-th of all super-k-mers each; documents meet those by
    a broadcast, so that one which very many documents hold lands in no task of its own.
    """
    each = reps.select("doc", "variant", F.explode("minimisers").alias("minimiser"))
    counted = each.groupBy("minimiser").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    total = reps.agg(F.coalesce(F.sum(F.size("minimisers")), F.lit(0))).first()[0]
    shared = checkpointed(counted.where("low < high").select("minimiser", "n", (F.col("n") > hot).alias("hot")))
    many = shared.where(F.col("n") * share > total).drop("n")
    few = shared.where(F.col("n") * share <= total).drop("n")
    each = each.join(F.broadcast(many), "minimiser", "left")
    met = each.where("hot is not null").unionByName(each.where("hot is null").drop("hot").join(few, "minimiser"))
    return met.groupBy("doc", "variant").agg(F.collect_set(F.struct("minimiser", "hot")).alias("wanted"))


def passages_removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, share: int = 1000, rows: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: see the top of this module. ``rows`` (more than ``hot``): rows of buckets that are sorted together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("variant"), text.alias("text"), doc_id.alias("doc_id"))
    profiles = checkpointed(mapped(base.drop("doc_id"), _profiles(width, gram), "doc long, variant long, n_words long, digest binary, minimisers array<long>")).where(F.col("n_words") >= width)
    first = profiles.groupBy("digest").agg(F.min("doc").alias("doc"))
    reps, copies = profiles.join(first, ["digest", "doc"], "left_semi"), profiles.join(first, ["digest", "doc"], "left_anti")
    wanted = _shared(reps.select("doc", "variant", "minimisers"), hot, share)
    travelling = mapped(base.join(wanted, ["doc", "variant"]).select("doc", "variant", "text", "doc_id", "wanted"), _packed_kmers(width, gram), _TRAVEL)
    dealt = travelling.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "doc")
    marks = mapped(dealt, _marks(width, rows), "doc long, variant long, start int, stop int")
    marks = marks.unionByName(copies.select("doc", "variant", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop")))
    marks = marks.groupBy("doc", "variant").agg(F.collect_set(F.struct("start", "stop")).alias("marks"))
    return mapped(base.join(marks, ["doc", "variant"], "left").select("doc_id", "text", "marks"), _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same in DuckDB, with all windows written out.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, i, array_to_string(words[i:i + 49], ' ') as win from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from d)),
m as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by win) as first from w) where doc_id > first),
c as (select distinct doc_id, unnest(range(i, i + 50)) as i from m),
k as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from (select doc_id, words[i] as word, i from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from d) anti join c using (doc_id, i)) group by doc_id)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""
