"""Removal of repeated passages against a search of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from maskloom.llm import super_kmers as K
from maskloom.llm.queries import ORACLES, op13_passages

DIR = "/root/testdata/sf0.001"


def brute(rows, width):
    """rows: (doc_id, text). Sorted rows of the result."""
    docs = [(K.LAST if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for d, _, w in docs:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, i, w in docs:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < d:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "#x", "Ω"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(6)]
    out = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        out.append((k, "  ".join(words) if k % 7 else "\n".join(words)))
    out += [(300 + k, out[k % 40][1]) for k in range(60)]  # copies
    out += [(10, out[11][1]), (10, out[11][1]), (None, out[12][1]), (None, "a b c d e f g h i j k l"), (500, "x y " * 200), (501, "y x " * 150), (502, None)]
    return out


@pytest.mark.parametrize("settings", [{}, {"hot": 2, "rows": 5}, {"hot": 0, "share": 2, "rows": 3}, {"gram": 1}])
def test_equals_all_windows(frame, rows, settings):
    got = result(K.passages_removed(frame(rows, 6), **({"width": 10, "gram": 4} | settings)))
    assert got == brute(rows, 10)
    assert sum(r[2] > 0 for r in got) > 60


def test_blocks_of_few_texts(frame, rows, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 1)
    for hot in (0, 1000):
        assert result(K.passages_removed(frame(rows, 2), width=12, gram=5, hot=hot, rows=1001)) == brute(rows, 12)


def test_awkward_and_empty(awkward, empty):
    got = result(K.passages_removed(awkward))
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()], 50)
    assert K.passages_removed(empty).count() == 0


def test_a_passage_in_many_contexts(frame):
    rng = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, " ".join(str(rng.random()) for _ in range(30)) + " " + passage + " " + " ".join(str(rng.random()) for _ in range(30))) for k in range(200)]
    got = result(K.passages_removed(frame(rows, 8), hot=50))
    assert [r[2] for r in got] == [0 if r[0] == 0 else 70 for r in got]


def test_names_are_exact():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 3, 2000)
    for width in (1, 2, 7, 50):
        names = K.window_names(ids, width)
        seen = {}
        for k in range(len(ids) - width + 1):
            assert seen.setdefault(tuple(ids[k : k + width]), names[k]) == names[k]
        assert len(set(seen.values())) == len(seen)


def test_op13_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
    cur = con.execute(ORACLES["op13_passages"])
    columns = [c[0] for c in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in op13_passages(spark, DIR).select(*columns).collect())
