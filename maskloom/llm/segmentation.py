"""N-best SentencePiece segmentation and decoding.

The pieces of a vocabulary with their scores span a lattice over a text. A forward Viterbi pass gives
every position the best score of any way to reach it. Those scores are an exact heuristic for an A*
search that runs backward from the end: the agenda is ordered by the score of what is already laid plus
the forward score of what remains, so complete segmentations leave it from the best down.

Where no piece of the vocabulary holds two characters side by side, no path crosses between them, so a
text's lattice is a chain of small ones, its units. A batch of texts is cut at all such places at once,
each distinct unit of the batch is solved once, and all of them together: matches of pieces by a trie in
arrays, Viterbi position by position over all units. Nothing is kept from one batch to the next but the
alternatives of a bounded number of units. The n best of a text are sums of the units' alternatives:
only the n - 1 units whose second best costs least can change in them, and A* lists the alternatives of
those alone. Whole texts are segmented, whatever their length: a long one goes through in stretches that
end between units.

Characters that no piece covers fall back to their UTF-8 bytes, at a score 10 below the lowest, so that
decoding gives back every text exactly. As in SentencePiece a space is put before the text (and is
removed by decoding).

Cases: a null or empty text has no pieces, the score zero and one segmentation; rows that repeat have a
row each; a null doc_id is kept; among equal scores the segmentation found first, by fixed rules, goes
first. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import mapped

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters that are cut into units and solved together.
CHARS = 1 << 20
#: Longer units are solved one by one.
_LONG = 64
#: Characters of distinct units whose matches are held at a time.
_SLAB = 1 << 17
#: Units whose alternatives a task remembers, none of them longer than ``_LONG``.
_KEPT = 20_000
_LOW = float("-inf")
_PAIRS = 20
SCHEMA = "doc_id long, n_pieces int, ids array<int>, score double, nbest_scores array<double>, nbest array<struct<at:int,remove:int,ids:array<int>,rank:int>>"


@dataclass
class Vocabulary:
    """Pieces with a space where the model has its mark; ``score`` and ``id`` by piece.

    The trie is a double array: the child of state s by a character of class c is state ``base[s] + c`` if
    ``check`` of that is s. ``ends`` has the number of the piece that ends in a state (0: none); ``value`` and
    ``ids`` are by that number, the last being a character in bytes. Characters outside all pieces have class 0.
    """

    piece: dict[str, tuple[float, int]]
    byte: list[int]
    text: list[bytes]
    unknown: float
    longest: int = field(init=False)
    classes: np.ndarray = field(init=False)
    spanned: np.ndarray = field(init=False)
    base: np.ndarray = field(init=False)
    check: np.ndarray = field(init=False)
    ends: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.piece), default=1)
        count: dict[str, int] = {}
        for p in self.piece:
            for ch in p:
                count[ch] = count.get(ch, 0) + 1
        number = {ch: k for k, ch in enumerate(sorted(count, key=lambda ch: (-count[ch], ch)), 1)}
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(ch) for ch in number]] = list(number.values())
        self.spanned = np.zeros(1 << _PAIRS, bool)
        inner = {(number[a], number[b]) for p in self.piece for a, b in zip(p, p[1:], strict=False)}
        if inner:
            self.spanned[self.pairs(*(np.array(x, np.uint32) for x in zip(*inner, strict=True)))] = True
        self.value = np.array([_LOW, *(s for s, _ in self.piece.values()), self.unknown])
        self.ids = np.array([-2, *(k for _, k in self.piece.values()), -1], np.int32)
        self._build([[number[ch] for ch in p] for p in self.piece], len(number))

    @staticmethod
    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of neighbouring classes in ``spanned``. Two that share a slot only make units longer."""
        return ((a << np.uint32(16) | b) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _PAIRS)

    def _build(self, words: list[list[int]], classes: int) -> None:
        children: list[dict[int, int]] = [{}]
        last = [0]
        for k, word in enumerate(words, 1):
            node = 0
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    last.append(0)
                node = children[node][c]
            last[node] = k
        used = np.zeros(len(children) + 3 * classes + 1024, bool)
        used[0] = True
        first, place = 1, {}  # the first free slot; base of each node
        for node in sorted((n for n in range(len(children)) if children[n]), key=lambda n: (-len(children[n]), n)):
            own = np.array(sorted(children[node]))
            while used[first]:
                first += 1
            at = max(first, int(own[0]))
            while True:
                if at + classes + 512 >= len(used):
                    used = np.concatenate([used, np.zeros(len(used) + classes, bool)])
                free = at + np.flatnonzero(~used[at : at + 256]) - own[0]
                fits = free[~used[free[:, None] + own[None, :]].any(axis=1)]
                if len(fits):
                    break
                at += 256
            place[node] = int(fits[0])
            used[place[node] + own] = True
        size = int(np.flatnonzero(used)[-1]) + classes + 2  # so that no class leads beyond the end
        self.base, self.check, self.ends = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        state = {0: 0}
        for node in range(len(children)):  # parents come before their children
            for c, child in children[node].items():
                state[child] = slot = place[node] + c
                self.check[slot], self.ends[slot] = state[node], last[child]
        for node, b in place.items():
            self.base[state[node]] = b

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text, piece, byte = [b""] * n, {}, [0] * 256
        for k in range(n):
            if sp.is_byte(k):
                b = int(sp.id_to_piece(k)[3:-1], 16)
                byte[b], text[k] = k, bytes([b])
            elif not (sp.is_unknown(k) or sp.is_control(k) or sp.is_unused(k)):
                p = sp.id_to_piece(k).replace("▁", " ")
                text[k], piece[p] = p.encode(), (sp.get_score(k), k)
        lowest = min((s for s, _ in piece.values() if s > -1e8), default=0.0)
        return cls(piece, byte, text, lowest - 10)

    def cuts(self, text: str) -> np.ndarray:
        """Whether each character begins a unit."""
        own = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint32)
        return np.concatenate([[True], ~self.spanned[self.pairs(own[:-1], own[1:])]])[: len(own)]

    def encoded(self, unit: str, path: list[tuple[int, int]]) -> list[int]:
        """Ids of (start, id) pairs; id -1 is a character in bytes."""
        out = []
        for start, piece in path:
            out += [piece] if piece >= 0 else [self.byte[b] for b in unit[start].encode("utf-8", "replace")]
        return out


# --- backward A* -------------------------------------------------------------------------------


def edges_into(v: Vocabulary, unit: str, end: int) -> list[tuple[int, float, int]]:
    """Edges (start, score, id) of the lattice that end there."""
    out = []
    for i in range(max(0, end - v.longest), end):
        if (p := v.piece.get(unit[i:end])) is not None:
            out.append((i, *p))
    if end and unit[end - 1] not in v.piece:
        out.append((end - 1, v.unknown, -1))
    return out


def forward(v: Vocabulary, unit: str) -> tuple[array, array]:
    """The best score up to each position, and how long its last edge is; among equals the longest."""
    n, get, longest = len(unit), v.piece.get, v.longest
    best, length = array("d", [_LOW]) * (n + 1), array("i", [0]) * (n + 1)
    best[0] = 0.0
    for i in range(n):
        at = best[i]
        for j in range(i + 1, min(n, i + longest) + 1):
            p = get(unit[i:j])
            score = p[0] if p is not None else v.unknown if j == i + 1 else None
            if score is not None and at + score > best[j]:
                best[j], length[j] = at + score, j - i
    return best, length


def n_best(v: Vocabulary, unit: str, best: array, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n best paths as (score, [(start, id)...]), best first: A* from the end, the forward scores its heuristic.

    Among equals the newest goes on, so that ties are followed to the start one by one and not all at once.
    As the heuristic is exact, whatever is behind the n best of the agenda can't be among the n best paths.
    """
    made, out = 0, []
    agenda: list[tuple] = [(-best[-1], 0, len(best) - 1, 0.0, None)]
    while agenda and len(out) < n:
        _, _, at, laid, behind = heapq.heappop(agenda)
        if at == 0:
            path = []
            while behind is not None:
                path.append(behind[0])
                behind = behind[1]
            out.append((laid, path))
            continue
        for start, score, piece in edges_into(v, unit, at):
            made += 1
            heapq.heappush(agenda, (-(laid + score + best[start]), -made, start, laid + score, ((start, piece), behind)))
        if len(agenda) > 64 + 8 * n:
            agenda = heapq.nsmallest(n - len(out), agenda)
    return out


# --- units -------------------------------------------------------------------------------------


def solved_alone(v: Vocabulary, unit: str) -> tuple[np.ndarray, float, float]:
    """Best ids of one unit, their score, and what the second best costs (infinite if there is none).

    A second path leaves the best one; the best path over any edge off the best path has that edge's
    score with the forward score before it and the backward score behind it.
    """
    n, get, longest = len(unit), v.piece.get, v.longest
    best, length = forward(v, unit)
    path, on, j = [], array("i", [0]) * (n + 1), n
    while j:
        i = j - length[j]
        path.append((i, (get(unit[i:j]) or (0.0, -1))[1]))
        on[i], j = j, i
    rest, second = array("d", [_LOW]) * n + array("d", [0.0]), _LOW
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, min(n, i + longest) + 1):
            p = get(unit[i:j])
            score = p[0] if p is not None else v.unknown if j == i + 1 else None
            if score is not None:
                behind = score + rest[j]
                rest[i] = max(rest[i], behind)
                if on[i] != j and best[i] + behind > second:
                    second = best[i] + behind
    return np.array(v.encoded(unit, path[::-1]), np.int32), best[n], best[n] - second


def _matched(v: Vocabulary, own: np.ndarray) -> list[np.ndarray]:
    """Numbers of the pieces of 1, 2, 3... characters that begin at each place (0: none). Class 0 ends every match."""
    alive, node = np.flatnonzero(own >= 0), np.zeros(len(own), np.int32)
    own = np.append(np.maximum(own, 0), np.zeros(v.longest, own.dtype))
    node, out = node[alive], []
    for d in range(v.longest):
        to = v.base[node] + own[alive + d]
        fits = v.check[to] == node
        alive, node = alive[fits], to[fits]
        if not len(alive):
            break
        out.append(np.zeros(len(own), np.int32))
        out[-1][alive] = v.ends[node]
    return out or [np.zeros(len(own), np.int32)]


def solved_together(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``solved_alone`` gives for units of falling length: ids end to end, their number, scores, costs of the second best."""
    size = np.array([len(u) for u in units])
    code = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)  # each with a place behind it
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    own = v.classes[code].astype(np.int32)
    own[start + size] = -1
    match = _matched(v, own)
    bare = (own >= 0) & (match[0][: len(own)] == 0)
    match[0][np.flatnonzero(bare)] = len(v.value) - 1
    value, deepest, most = v.value, len(match), int(size[0])
    active = np.searchsorted(-size, -np.arange(most + 1), "right")  # units of that length or more
    best, length = np.full(len(code) + v.longest, _LOW), np.zeros(len(code), np.int32)
    best[start] = 0.0
    for p in range(1, most + 1):
        at = start[: active[p]] + p
        top, way = np.full(len(at), _LOW), np.zeros(len(at), np.int32)
        for d in range(min(p, deepest), 0, -1):
            score = best[at - d] + value[match[d - 1][at - d]]
            more = score > top
            top[more], way[more] = score[more], d
        best[at], length[at] = top, way
    laid, on, at = np.zeros(len(code), np.int32), np.zeros(len(code), np.int32), start + size
    moving = np.arange(len(units))
    while len(moving):
        d = length[at[moving]]
        at[moving] -= d
        on[at[moving]] = d
        moving = moving[at[moving] > start[moving]]
    for d in range(1, deepest + 1):
        here = np.flatnonzero(on == d)
        laid[here] = match[d - 1][here]
    rest, second = np.full(len(code) + v.longest, _LOW), np.full(len(units), _LOW)
    rest[start + size] = 0.0
    for p in range(most - 1, -1, -1):
        at = start[: active[p + 1]] + p
        top, other = np.full(len(at), _LOW), np.full(len(at), _LOW)
        for d in range(1, min(deepest, most - p) + 1):
            k = active[p + d]  # units that go on for so long
            behind = value[match[d - 1][at[:k]]] + rest[at[:k] + d]
            top[:k] = np.maximum(top[:k], behind)
            other[:k] = np.maximum(other[:k], np.where(on[at[:k]] == d, _LOW, behind))
        rest[at] = top
        second[: active[p + 1]] = np.maximum(second[: active[p + 1]], best[at] + other)
    here = np.flatnonzero(laid)
    ids = v.ids[laid[here]]
    unit = np.searchsorted(start, here, "right") - 1
    if len(raw := np.flatnonzero(ids < 0)):
        bytes_ = [[v.byte[b] for b in chr(c).encode("utf-8", "replace")] for c in code[here[raw]].tolist()]
        many = np.ones(len(ids), int)
        many[raw] = [len(x) for x in bytes_]
        was, ids, unit = ids, np.repeat(ids, many), np.repeat(unit, many)
        ids[np.repeat(was < 0, many)] = [b for x in bytes_ for b in x]
    total = best[start + size]
    return ids, np.bincount(unit, minlength=len(units)), total, total - second


def solved(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best ids of distinct units end to end; first, number, score and cost of the second best for each unit."""
    size = np.array([len(u) for u in units])
    order = np.argsort(-size, kind="stable")
    parts, at = [], int((size > _LONG).sum())
    for k in order[:at]:
        ids, score, cost = solved_alone(v, units[k])
        parts.append((ids, np.array([len(ids)]), np.array([score]), np.array([cost])))
    held = np.cumsum(size[order] + 1)
    while at < len(order):
        z = int(np.searchsorted(held, (held[at - 1] if at else 0) + _SLAB, "right"))
        parts.append(solved_together(v, [units[k] for k in order[at:z].tolist()]))
        at = z
    ids, number, score, cost = (np.concatenate(x) for x in zip(*parts, strict=True))
    back = np.empty(len(order), int)
    back[order] = np.arange(len(order))
    return ids.astype(np.int32), (np.cumsum(number) - number)[back], number[back], score[back], cost[back]


@dataclass
class _Stretch:
    """The units of a stretch of text, solved; ``open``: (cost, place of its ids, number of ids, unit) of the units that may change."""

    ids: np.ndarray
    score: float
    open: list[tuple[float, int, int, str]]


class Segmenter:
    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n = v, n
        self.others: dict[str, list[tuple[float, list[int]]]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, float, list[float], list[tuple[int, int, list[int], int]]]:
        """Best ids, score, the n best scores, and how the others differ: (at, remove, ids, rank), ranks from 1."""
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, float, list[float], list[tuple[int, int, list[int], int]]]]:
        found: list[list[_Stretch]] = [[] for _ in texts]
        held, owners, size = [], [], 0
        for k, text in enumerate(texts):
            for part in self._stretches(" " + text) if text else ():
                if held and size + len(part) > CHARS:
                    for o, s in zip(owners, self._solved(held), strict=True):
                        found[o].append(s)
                    held, owners, size = [], [], 0
                held.append(part)
                owners.append(k)
                size += len(part)
        if held:
            for o, s in zip(owners, self._solved(held), strict=True):
                found[o].append(s)
        return [self._put_together(x) for x in found]

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in stretches of about ``CHARS`` that end between units."""
        at = 0
        while len(text) - at > CHARS:
            z = at + CHARS
            while z < len(text) and not self.v.cuts(text[z - 1 : z + 4096])[1:].any():
                z += 4096
            z = min(len(text), z + int(np.argmax(self.v.cuts(text[z - 1 : z + 4096])[1:]))) if z < len(text) else len(text)
            yield text[at:z]
            at = z
        if at < len(text):
            yield text[at:]

    def _solved(self, parts: list[str]) -> list[_Stretch]:
        whole, v = "".join(parts), self.v
        size = np.array([len(p) for p in parts])
        begins = v.cuts(whole)
        begins[np.cumsum(size) - size] = True
        bounds = np.append(np.flatnonzero(begins), len(whole))
        raw = whole.encode("utf-8", "replace")
        letters = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # where each character begins
        offsets = np.append(letters[bounds[:-1]], len(raw)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        which = coded.indices.to_numpy()
        ids, first, number, score, cost = solved(v, coded.dictionary.to_pylist())
        number, score, cost = number[which], score[which], cost[which]
        end = np.cumsum(number)
        flat = ids[np.repeat(first[which] - (end - number), number) + np.arange(end[-1])]
        edges = np.searchsorted(bounds, np.concatenate([[0], np.cumsum(size)])).tolist()
        out = []
        for a, z in zip(edges, edges[1:], strict=False):
            before = int(end[a] - number[a])
            out.append(_Stretch(flat[before : end[z - 1]], float(score[a:z].sum()), [(float(cost[k]), int(end[k] - number[k]) - before, int(number[k]), whole[bounds[k] : bounds[k + 1]]) for k in (a + self._least(cost[a:z])).tolist()]))
        return out

    def _least(self, costs: np.ndarray) -> np.ndarray:
        """Places of the n - 1 smallest finite costs, the first among equals."""
        if self.n < 2:
            return np.zeros(0, int)
        near = np.arange(len(costs))
        if len(costs) > self.n:
            near = np.flatnonzero(costs <= np.partition(costs, self.n - 2)[self.n - 2])
        near = near[np.isfinite(costs[near])]
        return near[np.argsort(costs[near], kind="stable")][: self.n - 1]

    def _put_together(self, stretches: list[_Stretch]) -> tuple[np.ndarray, float, list[float], list[tuple[int, int, list[int], int]]]:
        if not stretches:
            return np.zeros(0, np.int32), 0.0, [0.0], []
        ids = stretches[0].ids if len(stretches) == 1 else np.concatenate([s.ids for s in stretches])
        score, offset, every = sum(s.score for s in stretches), 0, []
        for s in stretches:
            every += [(cost, at + offset, many, unit) for cost, at, many, unit in s.open]
            offset += len(s.ids)
        chosen = sorted(heapq.nsmallest(self.n - 1, every), key=lambda x: x[1])
        combos: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        paths = []
        for _, at, many, unit in chosen:
            found = self._alternatives(unit, ids[at : at + many].tolist())
            paths.append(found)
            combos = heapq.nsmallest(self.n, ((c + (found[0][0] - s), key + (r,)) for c, key in combos for r, (s, _) in enumerate(found)))
        edits = [(at, many, found[r][1], rank) for rank, (_, key) in enumerate(combos) for (_, at, many, _), found, r in zip(chosen, paths, key, strict=True) if r]
        return ids, score, [score - c for c, _ in combos], edits

    def _alternatives(self, unit: str, first: list[int]) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a unit, beginning with the one that Viterbi took."""
        if (found := self.others.get(unit)) is None:
            found = [(s, self.v.encoded(unit, p)) for s, p in n_best(self.v, unit, forward(self.v, unit)[0], self.n)]
            same = [r for r, (_, ids) in enumerate(found) if ids == first]
            found.insert(0, found.pop(same[0] if same else -1))
            if len(unit) <= _LONG:
                if len(self.others) >= _KEPT:
                    self.others.clear()
                self.others[unit] = found
        return found


def decoded(v: Vocabulary, ids) -> str:
    """The text of a sequence of ids."""
    text = b"".join([v.text[k] for k in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def applied(ids: list[int], edits: list[tuple[int, int, list[int], int]], rank: int) -> list[int]:
    """The ids of the segmentation of that rank (0 is the best)."""
    out, at = [], 0
    for start, remove, new, r in edits:
        if r == rank:
            out += [*ids[at:start], *new]
            at = start + remove
    return out + list(ids[at:])


def segmented(docs: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, score, nbest_scores, nbest (edits of ids by rank)."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # as large as the vocabulary
    edit = pa.list_(pa.struct([("at", pa.int32()), ("remove", pa.int32()), ("ids", pa.list_(pa.int32())), ("rank", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segmenter(sent.value, n)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                found = segment.batch(b.column(1).to_pylist())
                lengths = np.array([len(f[0]) for f in found], np.int32)
                flat = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                edits = pa.array([[{"at": a, "remove": c, "ids": i, "rank": r} for a, c, i, r in f[3]] for f in found], edit)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(lengths), ids, pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.float64())), edits],
                    ["doc_id", "n_pieces", "ids", "score", "nbest_scores", "nbest"],
                )

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def texts_of(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, text."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoded(sent.value, i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
