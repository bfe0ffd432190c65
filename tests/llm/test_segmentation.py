import itertools
import random

import pytest

from maskloom.llm import segmentation as G


@pytest.fixture(scope="module")
def vocabulary():
    return G.Vocabulary.load()


def paths(v, text, at=0):
    """All segmentations as (score, ids)."""
    if at == len(text):
        yield 0.0, ()
        return
    single = False
    for z in range(at + 1, len(text) + 1):
        if p := v.piece.get(text[at:z]):
            single |= z == at + 1
            for score, ids in paths(v, text, z):
                yield p[0] + score, (p[1], *ids)
    if not single:
        for score, ids in paths(v, text, at + 1):
            yield v.unknown + score, (*(v.byte[b] for b in text[at].encode()), *ids)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_equals_all_paths(vocabulary, n):
    rng = random.Random(n)
    segment = G.Segmenter(vocabulary, n)
    texts = ["the cat", "a  b", "é😀 x\ny", "▁ a", "under it", "ab, cd.", "  ", "x²."] + ["".join(rng.choice("ab e,.t\n") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for text in texts:
        every = sorted(paths(vocabulary, " " + text), reverse=True)
        ids, score, scores, edits = segment(text)
        assert scores == [p[0] for p in every[:n]] and score == scores[0]
        found = [tuple(G.applied(ids.tolist(), edits, k)) for k in range(len(scores))]
        assert len(set(found)) == len(found)
        score_of = {p[1]: p[0] for p in every}
        assert [score_of[f] for f in found] == scores
        assert all(G.decoded(vocabulary, f) == text for f in found)


def test_units_together_equal_units_alone(vocabulary):
    rng = random.Random(9)
    units = {"".join(rng.choice("abehrt 1é😀x=") for _ in range(rng.randint(1, 40))) for _ in range(500)}
    units = sorted(units, key=lambda u: (-len(u), u))
    ids, number, score, cost = G.solved_together(vocabulary, units)
    at = 0
    for k, u in enumerate(units):
        own, own_score, own_cost = G.solved_alone(vocabulary, u)
        assert ids[at : at + number[k]].tolist() == own.tolist() and score[k] == own_score and cost[k] == own_cost
        at += number[k]


def test_stretches_and_batches_change_nothing(vocabulary, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcehrt,.é") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 300))) for _ in range(20)] + [None, "", "a" * 9000, "= " * 3000]
    want = [G.Segmenter(vocabulary, 3)(t) for t in texts]
    monkeypatch.setattr(G, "CHARS", 500)
    for w, g in zip(want, G.Segmenter(vocabulary, 3).batch(texts), strict=True):
        assert w[0].tolist() == g[0].tolist() and w[1:] == g[1:]


def test_small_vocabulary_with_pieces_that_span_words():
    pieces = {"a": -1.0, "b": -1.5, " ": -0.5, "a b": -1.2, " a": -2.0, "ab": -3.0, "b ": -0.7}
    v = G.Vocabulary({p: (s, k + 256) for k, (p, s) in enumerate(pieces.items())}, list(range(256)), [bytes([b]) for b in range(256)] + [p.encode() for p in pieces], -10.0)
    for text in map("".join, itertools.product("ab c", repeat=4)):
        every = sorted(paths(v, " " + text), reverse=True)
        ids, _, scores, edits = G.Segmenter(v, 3)(text)
        assert scores == pytest.approx([p[0] for p in every[:3]]) and all(G.decoded(v, G.applied(ids.tolist(), edits, k)) == text for k in range(len(scores)))


def test_tables_round_trip(awkward, empty, vocabulary):
    rows = G.segmented(awkward, 3).collect()
    assert len(rows) == awkward.count() and all(len(r.ids) == r.n_pieces for r in rows)
    back = sorted((r.doc_id or 0, r.text) for r in G.texts_of(G.segmented(awkward, 1)).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in awkward.select("doc_id", "text").collect())
    assert G.segmented(empty).count() == 0
