"""Scans over large groups, counters of lists and notes, against plain loops."""

import random

from maskloom.operators import scans


def test_running_sums_and_gaps_of_one_huge_group(spark):
    rng = random.Random(3)
    rows = [("big", k, rng.random() < 0.6) for k in range(3000)] + [("small", k, False) for k in range(5)] + [(None, k, k != 2) for k in range(4)]
    df = spark.createDataFrame(rows, "key string, at long, has boolean").repartition(5)
    got = {r.key: (r.total, r.matched, r.longest) for r in scans.longest_gaps(df, "key", "at", "has", 7).collect()}
    for key in ("big", "small", None):
        own, run, longest = [h for k, _, h in rows if k == key], 0, 0
        for h in own:
            run = 0 if h else run + 1
            longest = max(longest, run)
        assert got[key] == (len(own), sum(own), longest)
    summed = scans.with_running_sum(df.selectExpr("key", "at", "cast(has as int) as v"), "key", "at", "v", "s", 7)
    total = 0
    for r in summed.where("key = 'big'").orderBy("at").collect():
        total += r.v
        assert r.s == total
    assert scans.longest_gaps(df.where("false"), "key", "at", "has").count() == 0


def test_lists(spark):
    levels = [1, 2, 2, 3, 1, 3, 2, 1, 1]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(levels)], "doc_id long, k long, level int")
    assert [r.number for r in scans.list_numbers(df, 3).orderBy("k").collect()] == ["1", "1.1", "1.2", "1.2.1", "2", "2.1.1", "2.1", "3", "4"]


def test_long_lists_do_not_end_at_some_number(spark):
    df = spark.createDataFrame([(1, k, 1) for k in range(1000)], "doc_id long, k long, level int")
    assert [r.number for r in scans.list_numbers(df, 2).orderBy("k").collect()] == [str(k + 1) for k in range(1000)]


def test_notes(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, note long, text string")
    base = make([(1, 1, "a"), (1, 2, "mail x@y"), (1, 3, "c"), (1, 4, "d"), (2, None, None)])
    masked = make([(1, 1, "a"), (1, 2, "mail [E]"), (1, 3, "c"), (1, 4, "d"), (2, None, None)])
    answer = make([(1, 1, "a"), (1, 2, "mail [E]!"), (1, 3, "C"), (1, 9, "new"), (2, None, None)])
    got = sorted(((r.doc_id, r.note, r.fate, r.text) for r in scans.notes_reconciled(base, masked, answer).collect()), key=str)
    assert got == sorted([(1, 1, "kept", "a"), (1, 2, "both", "mail [E]!"), (1, 3, "changed", "C"), (1, 4, "lost", "d"), (1, 9, "added", "new"), (2, None, "kept", None)], key=str)


def test_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 2)], "doc_id long, cell long, place long")
    texts = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc_id long, place long, text string")
    assert sorted((r.cell, r.text) for r in scans.refilled(cells, texts).collect()) == [(0, "a\nb"), (1, "")]
