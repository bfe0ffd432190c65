import random

import numpy as np
import xxhash

from maskloom.llm import simhash as H
from maskloom.llm.common import components, smallest_labels


def slow_fingerprint(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, bits):
    """fps: (doc_id, fingerprint). The smallest doc_id that each can reach."""
    ids = sorted({i for i, _ in fps})
    place = {i: k for k, i in enumerate(ids)}
    links = [(place[a], place[b]) for x, (a, f) in enumerate(fps) for b, g in fps[:x] if (f ^ g).bit_count() <= bits]
    label = smallest_labels(len(ids), np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
    return {i: ids[label[k]] for k, i in enumerate(ids)}


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["Ab", "c", " ", "\n", "é", "\x0b", " ", "Ü"]) for _ in range(rng.randint(0, 80)))
        assert int.from_bytes(H.fingerprint(text.encode()), "big") == slow_fingerprint(text)
    assert H.fingerprint(b" \n") == bytes(8)


def test_masks_lose_no_pair():
    rng = random.Random(2)
    for nodes in (10, 10**6, 10**9, 10**11):
        masks = H.first_masks(nodes, 4)
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            assert any(not differ & m for m in masks)


def cluster(rng, n):
    centre = rng.getrandbits(64)
    return {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(n)}


def test_links_at_every_depth_equal_brute_force(spark):
    rng = random.Random(3)
    fps = sorted(set().union(*(cluster(rng, 60) for _ in range(4)), {rng.getrandbits(64) for _ in range(200)}))
    rows = [(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "fp long, rep long").repartition(3)
    want = brute([(k, f) for k, f in enumerate(fps)], 4)
    for limit in (8, 10_000):  # with and without going deeper
        moved = {r.u: r.v for r in components(H.linked(nodes, 4, limit=limit)).collect()}
        assert {k: moved.get(k, k) for k in want} == want


def test_pivots_discard_only_pairs_that_are_too_far():
    rng = np.random.default_rng(4)
    fp = np.concatenate([rng.integers(0, 1 << 63, 50, dtype=np.int64), np.array([1, 3, 7, 15, 31, 63], np.int64)])
    i, j = H.pivot_links(fp, np.array([0, len(fp)]), 4, H.references(24))
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 4}


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    out = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_components_around_a_hub_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    edges = [(500, k) for k in range(501, 900)] + [(int(a), int(b)) for a, b in rng.integers(0, 2000, (700, 2)) if 500 != a != b != 500]
    edges += [(k, 3000) for k in range(2500, 2700)]  # the largest node is one that many share
    label = smallest_labels(3001, *np.array(edges).T)
    for few in ({}, {"rows_a_task": 300, "salts": 3}):
        out = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long"), **few).collect()}
        assert out == {k: int(x) for k, x in enumerate(label) if x != k}


def test_awkward_rows(awkward, empty, spark):
    from pyspark.sql import functions as F

    rows = H.simhash_components(awkward).collect()
    assert len(rows) == awkward.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    texts = awkward.select("doc_id", "text").collect()
    assert all((t.doc_id, f"{slow_fingerprint(t.text):016x}") in by for t in texts)
    want = brute([(t.doc_id, slow_fingerprint(t.text)) for t in texts if t.doc_id is not None], 4)
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in rows)
    assert H.simhash_components(empty).count() == 0
    assert H.simhash_components(awkward.select(F.lit(None).cast("long").alias("doc_id"), "text")).where("component_id is null").count() == len(rows)


def test_documents_with_several_texts_link_them(frame):
    x, y = "alpha beta gamma delta epsilon", "one two three four five six seven"
    got = {(r.doc_id, r.fingerprint): r.component_id for r in H.simhash_components(frame([(1, x), (5, x), (2, y), (5, y), (9, "other words that stand here alone")])).collect()}
    assert {k[0]: v for k, v in got.items()} == {1: 1, 2: 1, 5: 1, 9: 9} and len(got) == 5
