"""The filter audit against the filters run one by one in every order."""

import re
from itertools import permutations

import pytest

from maskloom.llm import filter_audit as A
from maskloom.llm.queries import ORACLES, op11_filters

DIR = "/root/testdata/sf0.001"


def fails(text, doc_id, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    order = lambda i: (i is None, i or 0)
    return {f for f, c in {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None, "E": any((t or "") == text and order(i) < order(doc_id) for i, t, *_ in rows),
    }.items() if c}


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic). {(part, order, step): counts}."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = [(lang or "", i, fails(t or "", i, rows)) for i, t, lang in rows]
    out, removed = {}, {}
    for p in permutations("ABCDE"):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            gone = []
            for k, f in enumerate(p):
                here = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                redundant = sum(f in d[2] for d in gone)
                gone += here
                unique = sum(d[2] == {f} for d in docs if d[0] == part)
                out[part, "".join(p), k + 1] = [len(left), len(here), redundant, unique, sum(d[1] in good for d in here), sum(d[1] in toxic for d in here)]
                removed[part, f] = removed.get((part, f), 0) + len(here)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


LABELS = "doc_id long, quality int, toxic int"


def test_equals_filters_one_by_one(spark, frame):
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate([
        (long, "en"), (long, "de"), (long, "en"), (long + " $", "en"), ("word " * 130, "en"), (long.upper(), None), ("SHORT # text", ""), (long + " #", "de"), ("a\x0bb\x85c", "fr"), (None, "en"), ("", None),
    ])] + [(2, long, "en", "s"), (None, long, "en", "s"), (None, None, "de", "s")]
    labels = [(0, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (4, None, 1), (None, 1, 1), (77, 1, 1), (6, 2, 3)]
    want = brute([r[:3] for r in rows], labels)
    assert result(A.filter_interactions(frame(rows), spark.createDataFrame(labels, LABELS))) == want
    assert len(want) == 4 * 600  # en, de, fr and no language


def test_awkward_and_empty(spark, awkward, empty):
    none = spark.createDataFrame([], LABELS)
    want = brute([(r.doc_id, r.text, r.lang) for r in awkward.collect()], [])
    assert result(A.filter_interactions(awkward, none)) == want
    assert A.filter_interactions(empty, none).count() == 0


def test_a_text_that_many_share(spark, frame):
    rows = [(k, "same # text", "en" if k % 3 else "de", "s") for k in range(500)]
    got = result(A.filter_interactions(frame(rows, 8), spark.createDataFrame([(k, 1, k % 2) for k in range(0, 500, 5)], LABELS)))
    assert got["de", "EABCD", 1][:3] == (1, 166, 0) and got["en", "EABCD", 1][:3] == (0, 333, 0) and got["en", "ABCDE", 5][:3] == (0, 0, 333)
    assert got["de", "EABCD", 1][4] == 33 and got["en", "EABCD", 1][4] == 66


def test_paths_cross_every_edge():
    assert len(A.paths()) == 600 and len({p[2:] for p in A.paths()}) == 80


def test_op11_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    cur = con.execute(ORACLES["op11_filters"])
    columns = [c[0] for c in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in op11_filters(spark, DIR).select(*columns).collect())
