"""Chains and alignments against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from maskloom.operators import anchors


def rising(v, idx):
    return all(v[a] < v[b] for a, b in itertools.pairwise(idx))


def test_longest_chains(spark):
    rng = random.Random(4)
    lists = [[], [5], [3, 2, 1], list(range(30))] + [rng.sample(range(50), rng.randint(1, 11)) for _ in range(120)]
    got = spark.createDataFrame(list(enumerate(lists)), "k int, v array<int>").select("k", anchors.longest_chain(F.col("v")).alias("c")).collect()
    for r in got:
        v = lists[r.k]
        best = len(v) if rising(v, range(len(v))) else max((n for n in range(len(v) + 1) if any(rising(v, c) for c in itertools.combinations(range(len(v)), n))), default=0)
        assert len(r.c) == best and rising(v, r.c) and list(r.c) == sorted(set(r.c))


def test_every_line_has_one_operation(spark):
    rng = random.Random(5)
    bases, answers = [], []
    for doc in range(30):
        lines = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 14))]
        other = [x for x in lines if rng.random() < 0.8] + [rng.choice("xyz") for _ in range(2)]
        if rng.random() < 0.5:
            cut = rng.randint(0, len(other))
            other = other[cut:] + other[:cut]
        bases += [(doc, k, x) for k, x in enumerate(lines)]
        answers += [(doc, k, x) for k, x in enumerate(other)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, k int, norm string")
    rows = anchors.aligned(make(bases), make(answers)).collect()
    text, new = {(d, k): x for d, k, x in bases}, {(d, k): x for d, k, x in answers}
    assert sorted((r.doc_id, r.base) for r in rows if r.base is not None) == sorted(text) and sorted((r.doc_id, r.answer) for r in rows if r.answer is not None) == sorted(new)
    for r in rows:
        assert (r.op == "deleted") == (r.answer is None) and (r.op == "inserted") == (r.base is None)
        if r.op in ("equal", "moved"):
            assert text[r.doc_id, r.base] == new[r.doc_id, r.answer]
    for doc in range(30):
        chain = sorted((r.base, r.answer) for r in rows if r.doc_id == doc and r.op == "equal")
        assert all(a[1] < b[1] for a, b in itertools.pairwise(chain))
    same = anchors.aligned(make(bases), make(bases))
    assert {r.op for r in same.select("op").distinct().collect()} == {"equal"}
