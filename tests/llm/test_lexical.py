"""Ranked lexical search against scores computed document by document."""

import math
import random
import re

import numpy as np
import pytest

from maskloom.llm import lexical as R
from maskloom.llm.queries import ORACLES, op12_search

DIR = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    """docs, items: (id, text). Rows (item_id, rank, doc_id, score), for one text an item."""
    own = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    count, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, t in own:
            m = 75 + 25 * len(t) * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 12 * m)) for x in q if x in df)
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(scores[:top])]
    return out


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = [f"W{k}" for k in range(60)] + ["the"] * 30 + ["é", "ß", "Ünder", "a-b", "x_y", "İ", "naïve"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    docs += [(200 + k, "the same W1 w2 text") for k in range(40)]  # equal scores
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(12)] + [(3, "w1 w1 the"), (3, "w1 w1 the"), (None, "w2 É é"), (50, None), (51, "..."), (52, "absent"), (53, "w1 w2 same")]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"most_terms": 5}, {"most_entries": 7}, {"top": 3}])
def test_equals_brute_force(spark, frame, tables, settings, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(R, "SLICE", 50)
    got = result(R.ranked(frame(docs, 5), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), **settings))
    assert got == ordered(brute(docs, items, settings.get("top", 20)))


def test_awkward_and_empty(spark, awkward, empty):
    items = spark.createDataFrame([(1, "same words here"), (2, "word"), (3, "😀 text"), (4, None)], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    got = result(R.ranked(awkward, items))
    want = ordered(brute(docs, [(r.item_id, r.text) for r in items.collect()]))
    assert got == want and any(r[2] == 5 for r in got)
    assert R.ranked(empty, items).count() == 0 and R.ranked(awkward, items.where("false")).count() == 0


def test_sums_by_radix():
    rng = np.random.default_rng(1)
    item, doc, impact = rng.integers(0, 1 << 20, 5000), rng.integers(0, 300, 5000), rng.integers(0, 1 << 40, 5000)
    item[:2500] %= 7
    want = {}
    for i, d, x in zip(item.tolist(), doc.tolist(), impact.tolist(), strict=True):
        want[i, d] = want.get((i, d), 0) + x
    i, d, s = R.summed(item, doc, impact, 300)
    assert list(zip(i.tolist(), d.tolist(), s.tolist(), strict=True)) == [(*k, v) for k, v in sorted(want.items())]
    assert len(R.summed(item[:0], doc[:0], impact[:0], 300)[0]) == 0


def test_op12_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    cur = con.execute(ORACLES["op12_search"])
    columns = [c[0] for c in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in op12_search(spark, DIR).select(*columns).collect())
