"""Every registered query of the engine against its SQL in DuckDB, on the smallest table."""

import os

import duckdb
import pytest

from maskloom.queries import ORACLES, QUERIES

DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def views(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return views(DIR)


@pytest.fixture(scope="module")
def larger():
    return views(LARGER)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_find_something(larger, name):
    assert larger.execute(f"select count(*) from ({ORACLES[name]})").fetchone()[0] > 0


WITHOUT_SQL = {
    "anonymize_full": ("documents", "doc_id"), "align_merge": ("documents", "doc_id"), "alignment_operations": ("documents", "doc_id"),
    "anonymize_conversations": ("conversations", "conv_id"), "html_visible_text": ("pages", "page_id"),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    table, key = WITHOUT_SQL[name]
    got = QUERIES[name](spark, DIR).cache()
    assert {r[0] for r in got.select(key).distinct().collect()} == {r[0] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).distinct().collect()}


def test_full_masking_equals_its_parts(spark):
    """The masked text is the original with the spans of ``masking.found`` replaced, label by label."""
    from maskloom.operators import masking

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    spans = {}
    for r in masking.found(docs.select("doc_id", "text")).collect():
        spans.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["anonymize_full"](spark, DIR).collect():
        text, at, out, numbers = texts[r.doc_id], 0, [], {}
        for s in sorted(spans.get(r.doc_id, []), key=lambda s: s.start):
            assert text[s.start : s.stop] == s.value and s.start >= at
            own = numbers.setdefault(s.category, {})
            out += [text[at : s.start], f"[{s.category}_{own.setdefault(s.value, len(own) + 1)}]"]
            at = s.stop
        assert r.n_spans == len(spans.get(r.doc_id, [])) and r.text == (None if text is None else "".join(out) + text[at:])


def test_entry(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
