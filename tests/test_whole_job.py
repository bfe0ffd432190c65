"""Queries do the whole job: every document, every term, every repeat."""

import os

import pytest

from maskloom.functions import alignment as A
from maskloom.functions import nesting
from maskloom.operators import entities, labels, masking, merging
from maskloom.queries import QUERIES

DIR = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@data
@pytest.mark.parametrize("name", ["align_merge", "alignment_operations"])
def test_every_document_is_aligned(spark, name):
    want = {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, DIR).select("doc_id").collect()} == want


def test_documents_without_labels_and_null_texts_are_aligned(spark, tmp_path):
    folder = documents(spark, tmp_path, [(1, "nothing to mask\nhere"), (2, None), (3, "mail a@b.ru")])
    assert {r.doc_id for r in QUERIES["align_merge"](spark, folder).collect()} == {1, 2, 3}
    ops = {(r.doc_id, r.op): r.n for r in QUERIES["alignment_operations"](spark, folder).collect()}
    assert ops[1, "equal"] == 1 and ops[1, "deleted"] == 1 and ops[3, "inserted"] == 1


def test_documents_too_large_have_a_row(spark):
    bases = spark.createDataFrame([(1, "\n\n".join(f"line {k}" for k in range(A.MAX_BLOCKS + 1))), (2, "x")], "doc_id long, text string")
    rows = merging.alignment_ops(bases, bases).collect()
    assert [(r.doc_id, r.op, r.base, r.answer) for r in sorted(rows, key=lambda r: r.doc_id)] == [(1, "refused", [], []), (2, "equal", [0], [0])]
    report = {r.doc_id: r.reason for r in merging.merge_answers(bases, bases).collect()}
    assert report[1] == "too many blocks" and report[2] is None


def test_invented_values_of_neighbours(spark, tmp_path):
    folder = documents(spark, tmp_path, [(k, f"mail u{k // 2}@b.ru") for k in range(6)])
    assert sorted((r.doc_id, r.value) for r in QUERIES["hallucination_scan"](spark, folder).collect()) == [(-1, "u0@b.ru"), (1, "u1@b.ru"), (3, "u2@b.ru")]


def test_terms_of_all_segments(spark):
    segments = spark.createDataFrame([(1, 0, "Sidorov met Petrova."), (1, 1, "SIDOROVS, Petrova; agency"), (1, 2, "Agency"), (2, 0, None)], "doc_id long, seg_no long, text string")
    seeds = spark.createDataFrame([(1, t, "ФИО") for t in ("Sidorov", "Petrova", "Agency")] + [(2, "Nobody", "ФИО")], "doc_id long, term string, category string")
    got = sorted((r.seg_no, r.term, r.start, r.stop) for r in entities.terms_spread(segments, seeds).collect())
    assert got == [(0, "Petrova", 12, 19), (0, "Sidorov", 0, 7), (1, "Petrova", 10, 17), (1, "Sidorov", 0, 8)]


def test_repeated_lines_move_each(spark, tmp_path):
    folder = documents(spark, tmp_path, [(1, "a\nb\na\na\nc"), (2, "x\nx"), (3, None)])
    # in reverse: c a a b a, so a stands at 0, 2, 3 and at 1, 2, 4
    assert sorted((r.doc_id, r.base, r.answer) for r in QUERIES["line_equal_moves"](spark, folder).collect()) == [(1, 0, 1), (1, 1, 3), (1, 3, 4), (1, 4, 0)]


def chain(doc, n, end):
    return [(doc, "EMAIL", k, f"<[EMAIL_{k + 1}]>" if k < n else end) for k in range(1, n + 1)]


TABLE = "doc_id long, category string, n int, value string"


def test_values_nested_to_any_depth_are_restored(spark):
    table = spark.createDataFrame(chain(1, 12, "end") + [(2, "EMAIL", 1, "x")] + chain(3, 200, "[EMAIL_7] 1") + chain(4, 37, "[EMAIL_77]") + [(5, "A", 1, "[A_2] [a-2]"), (5, "A", 2, "b"), (6, "A", 1, "[A_1]"), (6, "A", 2, "[A_1] [A_3]"), (6, "A", 3, "z")], TABLE)
    answers = spark.createDataFrame([(1, "[EMAIL_1] [EMAIL_9] [EMAIL_99]"), (2, "[email 1]"), (3, "[EMAIL_1] [EMAIL_8]"), (4, "[EMAIL_1]"), (5, "[A_1]"), (5, "[A_1]"), (6, "[A_2][A_1]"), (7, "[A_1]"), (8, None), (None, "[A_1]")], "doc_id long, text string")
    got = sorted((tuple(r)[:5] for r in labels.restored(answers, table).collect()), key=str)
    assert got == sorted([
        (1, "<" * 11 + "end" + ">" * 11 + " " + "<" * 3 + "end" + ">" * 3 + " [EMAIL_99]", 2, 1, 0), (2, "x", 1, 0, 0),
        (3, "<" * 6 + "[EMAIL_7]" + ">" * 6 + " [EMAIL_8]", 1, 1, 2), (4, "<" * 36 + "[EMAIL_77]" + ">" * 36, 1, 0, 0), (5, "b b", 1, 0, 0), (5, "b b", 1, 0, 0),
        (6, "[A_1] z[A_1]", 1, 1, 2), (7, "[A_1]", 0, 1, 0), (8, None, 0, 0, 0), (None, "[A_1]", 0, 0, 0),
    ], key=str)


def test_circular_labels(spark):
    table = spark.createDataFrame(chain(1, 12, "end") + chain(3, 40, "[EMAIL_7]") + [(6, "A", 1, "[A_1]"), (6, "A", 2, "[A_1]")], TABLE)
    assert {(r.doc_id, r.label) for r in labels.circular_labels(table).collect()} == {(3, f"[EMAIL_{k}]") for k in range(7, 41)} | {(6, "[A_1]")}
    assert labels.circular_labels(table.where("false")).count() == 0


def test_values_that_would_grow_without_bounds_stop_the_restoring(spark):
    table = spark.createDataFrame([(1, "A", k, f"[A_{k + 1}][A_{k + 1}]" if k < 60 else "end") for k in range(1, 61)], TABLE)
    with pytest.raises(Exception, match="longest"):
        labels.restored(spark.createDataFrame([(1, "[A_1]")], "doc_id long, text string"), table).collect()


def test_latin_runs_that_hang_on_a_letter_are_no_organisations(spark, tmp_path):
    folder = documents(spark, tmp_path, [(1, "CIÓNRR ASESRR ÑOS, Globex Trade. aBC Initech"), (2, None)])
    assert sorted((r.start, r.value) for r in QUERIES["detect_latin_org"](spark, folder).collect()) == [(19, "Globex Trade")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_without_names_are_searched_without_a_join(spark):
    docs = spark.createDataFrame([(1, "ИНН 7712345678"), (2, "\uFDD0 ИНН 7712345678 \uFDD0")], "doc_id long, text string")
    got = masking.found(docs)
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    assert sorted((r.doc_id, r.start, r.value) for r in got.collect()) == [(1, 4, "7712345678"), (2, 6, "7712345678")]


def test_keys_in_one_file_are_dealt_out(spark):
    if os.path.isdir(DIR):
        assert "REPARTITION_BY_NUM" in plan(QUERIES["rules_money"](spark, DIR))


def test_words_are_dealt_out_once(spark):
    segments = spark.createDataFrame([(1, 0, "Ivan Ivana Ivanov ivanovx")], "doc_id long, seg_no long, text string")
    seeds = spark.createDataFrame([(1, "Ivan", "ФИО"), (1, "Ivanov", "ФИО")], "doc_id long, term string, category string")
    spread = entities.terms_spread(segments, seeds)
    assert spread._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
    assert sorted((r.term, r.start) for r in spread.collect()) == [("Ivan", 0), ("Ivan", 5), ("Ivan", 11), ("Ivan", 18), ("Ivanov", 11), ("Ivanov", 18)]


def test_masked_documents_and_their_answers_are_aligned_without_a_shuffle(spark, tmp_path):
    folder = documents(spark, tmp_path, [(1, "mail a@b.ru\nhere\nend"), (2, None), (None, "x")])
    for name in ("align_merge", "alignment_operations"):
        text = plan(QUERIES[name](spark, folder))
        assert "CoGroup" not in text and "Join" not in text
    assert "Exchange" not in plan(QUERIES["align_merge"](spark, folder))
    got = {r.doc_id: (r.text, r.equal, r.deleted, r.inserted) for r in QUERIES["align_merge"](spark, folder).collect()}
    assert got[1] == ("A new first paragraph.\n\nmail [EMAIL_1]\n\nhere\n\nend", 2, 1, 1) and got[None] == ("A new first paragraph.\n\nx", 1, 0, 1)
    assert set(got) == {1, 2, None}


def test_a_document_on_one_side_only_is_merged(spark):
    bases = spark.createDataFrame([(1, "a\n\nb"), (2, "only base"), (None, "none")], "doc_id long, text string")
    answers = spark.createDataFrame([(1, "a"), (3, "only answer"), (None, "none")], "doc_id long, text string")
    agreed = spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, block int")
    got = {r.doc_id: (r.text, r.equal, r.deleted, r.inserted) for r in merging.merge_answers(bases, answers, agreed).collect()}
    assert got == {1: ("a", 1, 1, 0), 2: ("only base", 0, 1, 0), 3: ("only answer", 0, 0, 1), None: ("none", 1, 0, 0)}


def test_restoring_nested_values_keeps_no_rounds_on_disk(spark):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    size = lambda: at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    before = size()
    table = spark.createDataFrame(chain(1, 60, "end") + [(2, "A", 1, "x[a 2]y[A_2]"), (2, "A", 2, "[A_3]"), (2, "A", 3, "[A_2][B_9]"), (2, "A", 4, "[A_1]?[A_1]"), (2, "C", 1, None), (2, "A", 5, "[C_1]")], TABLE)
    answers = spark.createDataFrame([(1, "[EMAIL_1]"), (2, "[A_4] [A_3] [A_5]")], "doc_id long, text string")
    got = sorted(tuple(r)[:5] for r in labels.restored(answers, table).collect())
    assert got == [(1, "<" * 59 + "end" + ">" * 59, 1, 0, 0), (2, "x[a 2]y[A_2]?x[a 2]y[A_2] [A_3] [C_1]", 2, 1, 5)]
    assert size() == before


def test_labels_of_a_document_are_opened_in_linear_space():
    n = 20_000
    table = {str(k): (("a" * 50, ""), (f"[{k + 1}]",), (str(k + 1),)) for k in range(n)} | {str(n): (("end",), (), ())}
    ((label, value, closed),) = nesting.opened(table, ["0"], 10**7)
    assert (label, len(value), value[-4:], closed) == ("0", 50 * n + 3, "aend", 0)
    empty = {str(k): (("", "", ""), ("[x]", "[x]"), (str(k + 1), str(k + 1))) for k in range(100)} | {"100": (("",), (), ())}
    assert nesting.opened(empty, ["0"], 10) == [("0", "", 0)]


def test_names_and_words_are_not_broadcast(spark):
    docs = spark.range(4).selectExpr("id as doc_id", "if(id % 2 = 0, 'пришёл Сидоров Антон.\\r\\nСИДОРОВА ждали, Сидоров Антон', 'ИНН 7712345678') as text")
    got = masking.found(docs)
    assert "Broadcast" not in plan(got)
    people = sorted((r.doc_id, r.start, r.value) for r in got.collect() if r.category == "ФИО")
    assert people == sorted((k, at, name) for k in (0, 2) for at, name in ((7, "Сидоров Антон"), (23, "СИДОРОВА"), (39, "Сидоров Антон")))


def test_long_runs_of_one_kind_do_not_overflow_the_stack(spark):
    n = 20_000
    runs = {"latin_org": "Globex " * n, "email": "a@b" + ".c" * n + ".ru", "money_words": "(" + "сто " * n + "рублей)"}
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(runs.values())] + [(3, "THE " * n), (4, "СУД " * n)], "doc_id long, text string")
    got = {(r.doc_id, r.rule): r.stop - r.start for r in masking.rules_found(texts, only=tuple(runs)).collect()}
    assert got == {(0, "latin_org"): 7 * n - 1, (1, "email"): 3 + 2 * n + 3, (2, "money_words"): 4 * n + 6}


def test_long_brackets_are_no_labels(spark):
    answers = spark.createDataFrame([(1, "[" + "see fox " * 20_000 + "] [A_1]")], "doc_id long, text string")
    (row,) = labels.restored(answers, spark.createDataFrame([(1, "A", 1, "x")], TABLE)).collect()
    assert row.text.endswith("] x") and (row.restored, row.unresolved) == (1, 0)


@pytest.mark.parametrize("name", ["alignment_operations", "rules_documents", "anonymize_full"])
def test_a_line_of_capitalised_words_is_searched(spark, tmp_path, name):
    folder = documents(spark, tmp_path, [(1, "Globex " * 20_000), (2, "mail a@b.ru")])
    assert {r.doc_id for r in QUERIES[name](spark, folder).collect()} == {1, 2}
