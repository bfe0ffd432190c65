"""Near duplicates among texts of 5 to 20 words, where bits of fingerprints agree least."""

import random
from math import log

import numpy as np

from maskloom.llm import simhash as H
from tests.llm.test_pipeline import brute


def families(rng, n):
    """Texts of 5 to 20 words with copies that have a word more at the end, or two or three."""
    rows = []
    for _ in range(n):
        words = [f"w{rng.randrange(100_000)}" for _ in range(rng.randint(5, 20))]
        rows += [words + [f"x{rng.randrange(100_000)}" for _ in range(k)] for k in range(4)]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_no_pair_of_short_texts_is_missed(spark, frame):
    rows = families(random.Random(6), 150)
    # pairs of eight and nine words: 4 shingles of 5, so 0.8 exactly
    rows += [(10_000 + 2 * k + j, " ".join(f"v{k}.{i}" for i in range(8 + j))) for k in range(400) for j in range(2)]
    want = brute(rows)
    for limit in (4096, 16):  # also with buckets that are cut
        assert {r.doc_id: r.component_id for r in H.near_duplicates(frame(rows), limit=limit).collect()} == want


def test_candidates_of_common_shingles(spark):
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    sets = [np.unique(np.append(common, rng.integers(0, 1 << 63, k % 5, dtype=np.uint64))) for k in range(150)]
    nodes = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "rep long, small binary")
    i, j = H.similar_pairs(sets, 0.8)
    want = H.smallest_labels(len(sets), i, j)
    links = H.short_candidates(nodes, 0.8, 4096).collect()
    got = H.smallest_labels(len(sets), np.array([r.u for r in links], int), np.array([r.v for r in links], int))
    assert got.tolist() == want.tolist() and len(set(want.tolist())) == 1 + sum(len(s) > 15 for s in sets)


def test_tables_miss_no_more_than_stated():
    assert abs(H.agreement(4, 0, 1) - 0.8125) < 1e-9
    agree = H.least_agreement(0.8)
    for nodes in (1000, 10**7, 10**10):
        count, bits = H._tables(nodes, agree, 1e-3, 16).shape
        for common, left, right in ((28, 2, 5), (28, 0, 7), (32, 4, 4), (36, 4, 5), (44, 4, 7), (100, 12, 13), (400, 0, 100)):
            assert count * log(1 - H.agreement(common, left, right) ** bits) <= log(1e-3)


def test_pairs_at_exactly_the_similarity_are_kept():
    for common, left, right in ((12, 0, 3), (4, 0, 1), (24, 3, 3), (400, 50, 50)):
        sets = [np.arange(common + left, dtype=np.uint64), np.append(np.arange(common), 10_000 + np.arange(right)).astype(np.uint64)]
        assert [x.tolist() for x in H.similar_pairs(sets, 0.8)] == [[0], [1]]
