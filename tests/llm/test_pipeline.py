import os
import random

import pytest

import corpus_pipeline
from maskloom.llm import simhash as H

DIR = "/root/testdata/sf0.001"


def brute(rows, similarity=0.8):
    """rows: (doc_id, text). The smallest doc_id of each group."""
    sets = [(i, set(H.shingle_set((t or "").encode(), 5).tolist())) for i, t in rows if i is not None]
    group = {i: i for i, _ in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x == y or len(x & y) >= similarity * len(x | y) - 1e-9 and x | y:
                p, q = sorted((root(i), root(j)))
                group[q] = p
    return {i: root(i) for i in group}


def test_near_duplicates_equal_brute_force(frame):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, k = [], 0
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 9)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(k + j, " ".join(rng.choice(vocabulary) for _ in range(50))) for j in range(40)] + [(900, "a b"), (901, "A  b"), (902, "a b c"), (903, None), (904, "")]
    want = brute(rows)
    for settings in ({}, {"limit": 8, "block": 3}):  # also with buckets and families that are cut
        assert {r.doc_id: r.component_id for r in H.near_duplicates(frame(rows), **settings).collect()} == want
    kept = H.near_duplicates_removed(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_awkward_rows(awkward, empty):
    out = H.near_duplicates_removed(awkward)
    assert out.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4, 5, 5, 7, 7, 8, 9]
    assert H.near_duplicates_removed(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_stages_over_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, DIR).cache()
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after
        assert k == 4 or docs.columns == columns
        if k == 1:
            texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect() if r.doc_id in before]
            assert after == set(brute(texts).values())
        if k > 2:
            assert after == before
    assert corpus_pipeline.run(spark, DIR).count() == len(after) and corpus_pipeline.ORACLE_SQL is None
