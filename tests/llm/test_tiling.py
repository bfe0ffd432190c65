import random

import numpy as np

from maskloom.llm import tiling as T


def slow_tiles(item, doc, least):
    """Greedy string tiling as it is defined, by trying all pairs of places."""
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0,)
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] >= 0 and not a[p + n] and not b[d + n]:
                    n += 1
                best = max(best, (n, -p, -d))
        n = best[0]
        if n < least:
            return tiles
        p, d = -best[1], -best[2]
        for k in range(n):
            a[p + k] = b[d + k] = True
        tiles.append((p, d, n))


def test_tiles_equal_the_slow_way():
    rng = random.Random(1)
    for _ in range(200):
        item = np.array([rng.randint(0, 4) for _ in range(rng.randint(3, 30))])
        doc = np.array([rng.randint(-1, 4) for _ in range(rng.randint(3, 60))])
        if rng.random() < 0.5:
            at = rng.randint(0, len(doc) - 1)
            doc = np.concatenate([doc[:at], item[len(item) // 2 :], doc[at:], item[: len(item) // 2]])
        got, want = T.tile(item, doc, 3, first=rng.choice([3, 6, 20])), slow_tiles(item.tolist(), doc.tolist(), 3)
        for tiles in (got, want):  # apart, and of equal runs
            assert all((item[p : p + n] == doc[d : d + n]).all() for p, d, n in tiles)
            assert len({p + k for p, _, n in tiles for k in range(n)}) == sum(n for *_, n in tiles) == len({d + k for _, d, n in tiles for k in range(n)})
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)


def test_window_hashes():
    rng = np.random.default_rng(2)
    ids = rng.integers(-1, 50, 200)
    for length in (1, 3, 5, 20):
        h = T.window_hashes(ids, length)
        windows = [tuple(ids[k : k + length]) for k in range(len(ids) - length + 1)]
        assert len(set(zip(h.tolist(), windows, strict=True))) == len(set(h.tolist())) == len(set(windows))


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew an odd green potion tonight"
OTHER = "completely different question about the height of mountains in an unnamed far away land"


def test_planted_items(frame, spark):
    w = ITEM.split()
    rows = [
        (1, "Well. " + ITEM.upper() + "! and more"), (2, " ".join(w[9:]) + " filler words here " + " ".join(w[:9])), (3, " ".join(w[:6]) + " nothing else"),
        (4, "clean text without any of it"), (5, None), (6, ""), (None, ITEM), (7, ITEM), (7, ITEM), (8, "x " * 30_000 + ITEM.replace("wizards", "witches")),
    ]
    bench = spark.createDataFrame([(10, ITEM), (11, OTHER), (12, None), (13, "too short"), (14, ""), (10, ITEM)], "item_id long, text string")
    for block in (32 << 20, 64):
        got = T.contaminated(frame(rows), bench.distinct(), block_bytes=block).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.item_id) for r in got) == sorted([((False, k), 10) for k in (1, 2, 7, 7, 8)] + [((True, 0), 10)])
        by = {r.doc_id: r for r in got}
        assert by[2].tiles == 2 and by[2].coverage == 1.0 and by[8].coverage == 17 / 18 and by[1].longest == 18
        kept = T.decontaminated(frame(rows), bench, block_bytes=block)
        assert kept.columns == frame(rows).columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_awkward_rows(awkward, empty, spark):
    bench = spark.createDataFrame([(1, "same text of some words here"), (2, "word word word word word")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in T.contaminated(awkward, bench).collect())
    assert got == [(4, 2), (5, 1), (5, 1), (6, 1)]
    assert T.contaminated(empty, bench).count() == 0 and T.contaminated(awkward, bench.where("false")).count() == 0
    assert T.decontaminated(awkward, bench.where("false")).count() == awkward.count()


def test_ties_go_to_the_first_place_in_the_item_then_in_the_document():
    assert T.tile(np.array([1, 2, 3, 9, 1, 2, 3]), np.array([5, 1, 2, 3, 6, 1, 2, 3]), 3) == [(0, 1, 3), (4, 5, 3)]
    rng = random.Random(7)
    for _ in range(150):
        item = np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 24))])
        doc = np.array([rng.randint(-1, 3) for _ in range(rng.randint(3, 40))])
        assert sorted(T.tile(item, doc, 3, first=24)) == sorted(slow_tiles(item.tolist(), doc.tolist(), 3))


def test_one_beginning_in_very_many_items():
    import time

    start = [f"s{k}" for k in range(60)]
    items = T.Items([(k, " ".join(start + [f"i{k}x{j}" for j in range(70)])) for k in range(3000)], 5)
    text = " ".join(start + [f"i77x{j}" for j in range(70)] + start * 14)
    items.matches("s1 s2 s3 s4 s5", 0.5)
    began = time.time()
    found = items.matches(text, 0.5)
    assert time.time() - began < 1 and [(m[0], m[3]) for m in found] == [(77, 130)]
    assert len(items.matches(text, 0.46)) == 3000
