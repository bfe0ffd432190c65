"""Removal of repeated byte strings with suffix arrays sorted in two stages.

Every byte is removed that lies in a string of ``width`` bytes which also starts earlier in the corpus:
in a document with a smaller doc_id, or further ahead in the same document. Strings are judged on the
input, and never span documents.

The suffixes of the corpus are dealt so that equal strings of ``width`` bytes meet: a string belongs to
the smallest hash among its substrings of ``GRAM`` bytes. Strings that start next to each other mostly
belong to the same one and form a stretch of text. Stretches go through three steps:

1. Hashes only: of stretches with one smallest hash, those with equal text (by a second 64-bit hash of
   all of it) are one; the first stands for them, the others are removed as they are. This sums up copies
   before any text moves. A smallest hash with one distinct stretch is done, unless it stands at several
   places in that stretch.
2. The text of distinct stretches that share a smallest hash is collected, and sorted. A suffix array is
   built in two stages: only suffixes smaller than their successors are sorted directly, the larger ones
   are induced by scans over the buckets of first bytes. Adjacent common prefixes are computed to ``width``
   bytes; suffixes that share as many are equal strings; all but the first of the corpus are marked.
   Where more than ``HOT`` distinct stretches share a smallest hash, their strings are dealt one by one
   by a hash of all their bytes, so no task gets an unbounded group.
3. Marked bytes are united by document, and what is left is hashed.

Hashes and positions travel as compressed columns, one binary for each pair of tasks, since single rows
would cost more than what is in them. Documents are read twice and shuffled, compressed, twice.

Cases: a null text is an empty one, with nothing removed and the SHA-256 of no bytes; rows with one
doc_id and one text are one document with a row each; rows with one doc_id and different texts are
different documents, ordered by a hash of the text; documents with a null doc_id come after all others.
Other columns are ignored. Very long texts are cut into overlapping pieces for hashing only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import checkpointed, partitions, text_bytes

GRAM = 40
HOT = 20_000
LAST = np.iinfo(np.int64).max
_PIECE = 1 << 20
_U = np.uint64
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- two-stage suffix sorting ------------------------------------------------------------------


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, in the order of bytes; zeros behind the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(_U)
    two = (padded[:-1] << _U(8)) | padded[1:]
    four = (two[:-2] << _U(16)) | two[2:]
    return ((four[:-4] << _U(32)) | four[4:])[: len(t)]


def _sorted_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the text from there on, to ``depth`` bytes at least."""
    words = np.concatenate([words, np.zeros(depth + 8, _U)])
    order = at[np.argsort(words[at], kind="stable")]
    k = words[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    for skip in range(8, depth, 8):
        single = new & np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        group, own = np.cumsum(new)[open_], order[open_]
        k = words[own + skip]
        by = np.lexsort((k, group))
        order[open_], k = own[by], k[by]
        new[open_[1:]] |= (k[1:] != k[:-1]) & (group[1:] == group[:-1])
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (uint8) in order, exact to ``depth`` bytes at least."""
    n = len(t)
    if not n:
        return np.zeros(0, int)
    # A suffix is smaller than its successor if the first byte that differs from the next one is smaller.
    differs = np.flatnonzero(t[1:] != t[:-1])
    where = np.searchsorted(differs, np.arange(n))
    change = differs[np.minimum(where, len(differs) - 1)] if len(differs) else np.zeros(n, int)
    smaller = (where < len(differs)) & (t[change] < t[np.minimum(change + 1, n - 1)]) if len(differs) else np.zeros(n, bool)
    direct = _sorted_directly(np.flatnonzero(smaller), words_at(t), depth)
    cut = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1]))  # the end of the text is the smallest suffix
    out = []
    for c in map(int, np.unique(t)):
        layer = np.concatenate(induced[c]) if induced[c] else np.zeros(0, int)
        bucket = []
        while len(layer):
            bucket.append(layer)
            before = layer[layer > 0] - 1
            layer = before[t[before] == c]  # larger ones of the same byte are induced within the bucket
        bucket.append(direct[cut[c] : cut[c + 1]])
        found = np.concatenate(bucket)
        out.append(found)
        before = found[found > 0] - 1
        before = before[t[before] > c]
        before = before[np.argsort(t[before], kind="stable")]
        bytes_ = t[before]
        edges = np.flatnonzero(np.concatenate([[True], bytes_[1:] != bytes_[:-1]])) if len(before) else []
        for a, b in zip(edges, [*edges[1:], len(before)], strict=False):
            induced[bytes_[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """For each suffix but the first: how many bytes it shares with the one before, counted to ``most``."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    open_ = np.arange(len(out))
    for skip in range(0, most, 8):
        a, b = order[open_ + 1] + skip, order[open_] + skip
        inside = np.maximum(a, b) < len(words)
        open_, differ = open_[inside], words[a[inside]] ^ words[b[inside]]
        ended = differ != 0
        last = differ[ended]
        out[open_[ended]] += sum((last < _U(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
        open_ = open_[~ended]
        out[open_] += 8
    return np.minimum(out, np.minimum(most, len(words) - np.maximum(order[1:], order[:-1])))  # words hold zeros behind the end


# --- stretches ---------------------------------------------------------------------------------

_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    return np.cumprod(out, dtype=_U)


_POW, _INV = _powers(_R, _PIECE + 4096), _powers(pow(_R, -1, 1 << 64), _PIECE + 4096)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _folded(x: np.ndarray, length: int, join) -> np.ndarray:
    """``join`` over all runs of ``length`` values, from runs of 1, 2, 4..."""
    unit, out, done = 1, None, 0
    while True:
        if length & unit:
            out = x if out is None else join(out[: len(x) - done], x[done:], unit)
            done += unit
        if unit * 2 > length:
            return out[: len(out)]
        x = join(x[:-unit], x[unit:], unit)
        unit *= 2


def gram_hashes(t: np.ndarray, gram: int = GRAM) -> np.ndarray:
    power = {1 << k: _U(pow(_R, 1 << k, 1 << 64)) for k in range(10)}
    n = len(t) - gram + 1
    return _mixed(_folded(_TABLE[t], gram, lambda a, b, unit: a * power[unit] + b[: len(a)])[:n])


def smallest_in_runs(h: np.ndarray, length: int) -> np.ndarray:
    unit = 1
    x = h
    while unit * 2 <= length:
        x = np.minimum(x[:-unit], x[unit:])
        unit *= 2
    n = len(h) - length + 1
    return np.minimum(x[:n], x[length - unit : length - unit + n])


def stretches(t: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """t: texts end to end, ``ends`` where they end. Returns (smallest hash, hash of the text, start, strings, inner) of all
    stretches; ``inner``: the smallest hash stands at several places in it, so it may repeat strings itself."""
    none = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if len(t) < width:
        return none
    h = gram_hashes(t)
    low = smallest_in_runs(h, width - GRAM + 1)
    starts = np.concatenate([[0], ends[:-1]])
    turn = np.zeros(len(t) + 1, np.int32)
    np.add.at(turn, starts, 1)
    np.add.at(turn, np.maximum(starts, ends - width + 1), -1)
    at = np.flatnonzero(np.cumsum(turn[: len(low)]) > 0)
    if not len(at):
        return none
    first = np.flatnonzero(np.concatenate([[True], (at[1:] - at[:-1] != 1) | (low[at[1:]] != low[at[:-1]])]))
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    total = np.concatenate([[_U(0)], np.cumsum(h * _POW[: len(h)], dtype=_U)])
    whole = (total[start + count + width - GRAM] - total[start]) * _INV[start]
    places = np.add.reduceat(h[at] == low[at], first, dtype=np.int64)
    for k in range(width - GRAM):  # places behind the last start
        places += h[start + count + k] == low[start]
    return low[start], _mixed(whole), start, count, (places > 1).astype(np.uint8)


# --- columns in binaries -----------------------------------------------------------------------


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of one length; sorted ones compress well as differences."""
    raw = len(columns[0]).to_bytes(4, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes, types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for kind in types.split():
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def _joined(blobs: list[bytes], types: str) -> list[np.ndarray]:
    parts = [_unpacked(b, types) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in types.split()]


def _dealt(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(edges, [*edges[1:], len(part)], strict=False):
        yield int(part[a]), _packed([c[order[a:b]] for c in columns])


def _batch(kind: list[int], part: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["kind", "part", "blob"])


BLOBS = "kind int, part int, blob binary"
_STRETCH = "u8 u8 i8 u4 i8 i4 u1"  # smallest hash, text hash, doc, variant, start, strings, inner
_MARK = "i8 u4 i8 i8"  # doc, variant, from, to
_NEED = "i8 u4 i8 i4 u8 u1"  # doc, variant, start, strings, smallest hash, hot


def _home(doc: np.ndarray, n: int) -> np.ndarray:
    return ((_mixed(doc.view(_U) if doc.dtype == np.int64 else doc.astype(_U)) >> _U(20)) % _U(n)).astype(np.int64)


def _documents(b: pa.RecordBatch, variants: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    texts = text_bytes(b.column(1))
    doc = b.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    return doc, np.array([xxhash.xxh32_intdigest(t, 5) if variants else 0 for t in texts], np.uint32), texts


def _hashed(width: int, n: int, variants: bool):
    """Stretches of all documents, by smallest hash."""

    def flush(held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        t = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        ends = np.cumsum([len(x[3]) for x in held])
        low, whole, start, count, inner = stretches(t, ends, width)
        if len(low):
            row = np.searchsorted(ends, start, "right")
            doc, variant, offset = (np.array([x[k] for x in held], d) for k, d in ((0, np.int64), (1, np.uint32), (2, np.int64)))
            begin = start - np.concatenate([[0], ends[:-1]])[row] + offset[row]
            blobs = list(_dealt((low % _U(n)).astype(np.int64), [low, whole, doc[row], variant[row], begin, count.astype(np.int32), inner]))
            yield _batch([0] * len(blobs), [p for p, _ in blobs], [x for _, x in blobs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for d, v, t in zip(*_documents(b, variants), strict=True):
                if len(t) < width:
                    continue
                # pieces overlap by a string less a byte, so that each string is in exactly one
                for at in range(0, max(1, len(t) - width + 1), _PIECE - width + 1):
                    piece = t[at : at + _PIECE]
                    if size + len(piece) > _PIECE and held:
                        yield from flush(held)
                        held, size = [], 0
                    held.append((d, v, at, piece))
                    size += len(piece)
        if held:
            yield from flush(held)

    return run


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    part, held = None, []
    for b in batches:
        for kind, p, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((kind, blob))
    if held:
        yield part, held


def _summed(width: int, n: int):
    """Marks of stretches that equal an earlier one (kind 0) and distinct stretches to be sorted (kind 1), by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            columns = _joined([x for _, x in blobs], _STRETCH)
            order = np.argsort(columns[0], kind="stable")
            same = columns[0][order[1:]] == columns[0][order[:-1]]
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (columns[6][order] > 0)]
            low, whole, doc, variant, start, *_ = columns = [c[order] for c in columns]
            order = np.lexsort((start, variant, doc, whole, low))
            columns = [c[order] for c in columns]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:5]], axis=0)])[: len(order)]
            low, whole, doc, variant, start, count, inner = (c[new] for c in columns)  # rows that repeat
            new_low = np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]
            new_text = new_low | np.concatenate([[True], (whole[1:] != whole[:-1]) | (count[1:] != count[:-1])])[: len(low)]
            group = np.cumsum(new_low) - 1
            distinct = np.bincount(group[new_text], minlength=group[-1] + 1) if len(group) else np.zeros(0, int)
            again = ~new_text
            marks = [doc[again], variant[again], start[again], start[again] + count[again] + width - 1]
            need = new_text & ((distinct[group] > 1) | (inner > 0)) if len(group) else new_text
            hot = (distinct[group[need]] > HOT).astype(np.uint8) if len(group) else np.zeros(0, np.uint8)
            out = [(0, p, x) for p, x in _dealt(_home(marks[0], n), marks)]
            out += [(1, p, x) for p, x in _dealt(_home(doc[need], n), [doc[need], variant[need], start[need], count[need], low[need], hot])]
            if out:
                yield _batch(*(list(c) for c in zip(*out, strict=True)))

    return run


def _united(df: DataFrame, docs: DataFrame, n: int, variants: bool) -> DataFrame:
    """Blobs and, behind those of their part, the documents (kind 9), compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            doc, variant, texts = _documents(b, variants)
            head = [np.array([d]).tobytes() + np.array([v]).tobytes() + bytes([isnull]) for d, v, isnull in zip(doc, variant, b.column(0).is_null().to_pylist(), strict=True)]
            yield _batch([9] * len(doc), _home(doc, n).tolist(), [h + press.compress(t) for h, t in zip(head, texts, strict=True)])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOBS)
    return dealt(df.unionByName(rows), n).sortWithinPartitions("part", "kind")


def dealt(df: DataFrame, n: int) -> DataFrame:
    """Blobs to the task that their part names: a hash of it would leave a third of the tasks empty."""
    return df.repartitionById(n, F.col("part"))


def _opened(blob: bytes) -> tuple[int, int, bool, bytes]:
    return int(np.frombuffer(blob, "i8", 1)[0]), int(np.frombuffer(blob, "u4", 1, 8)[0]), bool(blob[12]), zstandard.ZstdDecompressor().decompress(blob[13:])


def _with_documents(batches: Iterator[pa.RecordBatch], types: str, wanted: tuple[int, ...]) -> Iterator[tuple]:
    """(doc, variant, null, text, columns) for each document, the columns being the rows of its own blobs."""
    part, blobs, columns = None, [], None
    for b in batches:
        for kind, p, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part:
                part, blobs, columns = p, [], None
            if kind in wanted:
                blobs.append(blob)
            elif kind == 9:
                if columns is None:
                    columns = _joined(blobs, types)
                    order = np.lexsort((columns[2], columns[1], columns[0]))
                    columns, blobs = [c[order] for c in columns], []
                doc, variant, null, text = _opened(blob)
                a, z = np.searchsorted(columns[0], doc, "left"), np.searchsorted(columns[0], doc, "right")
                a, z = a + np.searchsorted(columns[1][a:z], variant, "left"), a + np.searchsorted(columns[1][a:z], variant, "right")
                yield doc, variant, null, text, [c[a:z] for c in columns]


def _texts(width: int, n: int):
    """Text of the stretches to be sorted, by smallest hash; of hot ones each string by its own hash."""
    types = "u8 i8 u4 i8 i4"

    def flush(rows: list[tuple], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [np.array(c, d) for c, d in zip(zip(*rows, strict=True), types.split(), strict=True)]
        part = (columns[0] % _U(n)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
        press = zstandard.ZstdCompressor(level=1)
        out = []
        for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
            head = _packed([c[order[a:z]] for c in columns])
            out.append((0, int(part[order[a]]), len(head).to_bytes(4, "little") + head + press.compress(b"".join(texts[k] for k in order[a:z]))))
        yield _batch(*(list(c) for c in zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, size = [], [], 0
        for doc, variant, _, text, (_, _, start, count, low, hot) in _with_documents(batches, _NEED, (1,)):
            for s, c, m, h in zip(start.tolist(), count.tolist(), low.tolist(), hot.tolist(), strict=True):
                for at, strings in [(s + k, 1) for k in range(c)] if h else [(s, c)]:
                    own = text[at : at + strings + width - 1]
                    rows.append((xxhash.xxh64_intdigest(own, 9) if h else m, doc, variant, at, strings))
                    texts.append(own)
                    size += len(own)
            if size > 16 * _PIECE:
                yield from flush(rows, texts)
                rows, texts, size = [], [], 0
        if rows:
            yield from flush(rows, texts)

    return run


def repeated_strings(texts: list[bytes], count: np.ndarray, rank: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """texts: stretches; count: strings that start in each; rank: the order of documents; start: in the document.

    Returns (stretch, offset) of each string that is not the first of its kind.
    """
    # UTF-8 has no bytes above 0xF7, so one more than each byte leaves zero to part the stretches.
    t = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    lengths = np.array([len(x) + 1 for x in texts])
    begin = np.cumsum(lengths) - lengths
    order = suffix_array(t, width)
    owner = np.repeat(np.arange(len(texts)), lengths)
    offset = np.arange(len(t)) - begin[owner]
    order = order[offset[order] < count[owner[order]]]
    same = common_prefixes(order, words_at(t), width) == width
    group = np.cumsum(np.concatenate([[0], ~same]))
    own, off = owner[order], offset[order]
    by = np.lexsort((start[own] + off, rank[own], group))
    own, off, group = own[by], off[by], group[by]
    again = np.concatenate([[False], group[1:] == group[:-1]])
    return own[again], off[again]


def _sorted(width: int, n: int, most: int = 4 << 20):
    """Marks of the strings that are not the first of their kind, by document."""
    types = "u8 i8 u4 i8 i4"

    def piece(columns: list[np.ndarray], texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        _, doc, variant, start, count = columns
        _, rank = np.unique(np.stack([doc, variant.astype(np.int64)]), axis=1, return_inverse=True)
        own, off = repeated_strings(texts, count, rank.ravel(), start, width)
        if len(own):
            begin = start[own] + off
            order = np.lexsort((begin, variant[own], doc[own]))
            d, v, begin = doc[own][order], variant[own][order], begin[order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (begin[1:] > begin[:-1] + width)]))
            last = np.append(new[1:], len(d)) - 1
            for p, x in _dealt(_home(d[new], n), [d[new], v[new], begin[new], begin[last] + width]):
                yield 0, p, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_part(batches):
            heads, texts = [], []
            for _, blob in blobs:
                cut = 4 + int.from_bytes(blob[:4], "little")
                columns = _unpacked(blob[4:cut], types)
                raw, at = zstandard.ZstdDecompressor().decompress(blob[cut:]), 0
                for c in columns[4].tolist():
                    texts.append(raw[at : at + c + width - 1])
                    at += c + width - 1
                heads.append(columns)
            columns = [np.concatenate(c) for c in zip(*heads, strict=True)]
            low, doc, variant, start, _ = columns
            order = np.lexsort((start, variant, doc, low))
            new = np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in (low, doc, variant, start)], axis=0)])
            order = order[new]  # rows that repeat have sent theirs twice
            columns = [c[order] for c in columns]
            low, size = columns[0], np.cumsum([len(texts[k]) for k in order])
            edges = [*np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])).tolist(), len(low)]
            at, out = 0, []
            for a, z in zip(edges, edges[1:], strict=False):  # whole groups, about ``most`` bytes at a time
                if z == len(low) or size[z - 1] - (size[at - 1] if at else 0) >= most:
                    out += piece([c[at:z] for c in columns], [texts[order[k]] for k in range(at, z)])
                    at = z
            if out:
                yield _batch(*(list(c) for c in zip(*out, strict=True)))

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []

    def batch() -> pa.RecordBatch:
        names = [x.split()[0] for x in _RESULT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for doc, _, null, text, (_, _, start, stop) in _with_documents(batches, _MARK, (0,)):
        kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
        if len(start):
            reach = np.maximum.accumulate(stop)
            new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            for a, z in zip(start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist(), strict=True):
                kept.update(text[at:a])
                at, removed, spans = z, removed + z - a, spans + 1
        kept.update(text[at:])
        rows.append((None if null else doc, len(text), removed, spans, kept.hexdigest()))
        if len(rows) == 4096:
            yield batch()
            rows = []
    if rows:
        yield batch()


def repeats_removed(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # only where doc_ids repeat do documents need the hash of their text to be told apart
    variants = not texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    hashed = dealt(texts.mapInArrow(_hashed(width, n, variants), BLOBS), n).sortWithinPartitions("part")
    summed = checkpointed(hashed.mapInArrow(_summed(width, n), BLOBS))
    needed = _united(summed.where("kind = 1"), texts, n, variants).mapInArrow(_texts(width, n), BLOBS)
    marked = dealt(needed, n).sortWithinPartitions("part").mapInArrow(_sorted(width, n), BLOBS)
    return _united(summed.where("kind = 0").unionByName(marked), texts, n, variants).mapInArrow(_removed, _RESULT)
