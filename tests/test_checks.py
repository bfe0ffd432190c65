"""Checks and sinks that stand beside the queries."""

import pytest
from pyspark.sql import functions as F

from maskloom.operators import gates, verify
from maskloom.sources import pdf_lines, sinks


def test_notices_in_their_order(spark):
    stats = spark.createDataFrame([(1, 0, 0, 0, 1.0, False, 0, 0), (2, 3, 1, 2, 0.5, True, 1, 4)], "doc_id long, unknown int, invented int, residual int, coverage double, truncated boolean, frozen_touched int, notes_missing int")
    got = {r.doc_id: r.notices for r in verify.notices(stats).collect()}
    assert got[1] == [] and len(got[2]) == 6 and got[2][0].startswith("the answer") and got[2][1].startswith("3 labels")


def test_what_detection_finds_in_an_output(spark):
    out = spark.createDataFrame([(1, "[ФИО_1] ИНН 7812345678 и [EMAIL_1]"), (2, "[СУММА_1] чисто"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.value) for r in verify.detector_residuals(out).collect()] == [(1, "7812345678")]


def test_scans_without_text_are_refused(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, " "), (1, 1, 12.0, "x"), (2, 1, 0.0, ""), (3, 1, 0.0, None)], "doc_id long, page int, top double, text string")
    assert {r.doc_id: bool(r.readable) for r in pdf_lines.has_text(lines).collect()} == {1: True, 2: False, 3: False}


def test_label_tables_are_written_by_their_own_name_only(spark, tmp_path):
    table = spark.createDataFrame([(1, "[A_1]", "v")], "doc_id long, label string, value string")
    with pytest.raises(PermissionError):
        sinks.write_parquet(table, str(tmp_path / "x"))
    sinks.write_labels(table, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_labels(table, str(tmp_path / "x"))


def test_whole_texts_and_names_and_cells(spark):
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "[ANON] x [RESTORED] y")], "doc_id long, seg_no long, text string")
    assert {r.doc_id: r.text for r in sinks.whole_text(rows, "-").collect()}[1] == "a-b"
    assert rows.where("doc_id = 2").select(sinks.marked_name(F.col("text"), sinks.ANSWER, ".md")).first()[0] == "[ОТВЕТ] x y.md"
    cells = spark.createDataFrame([("12", True), ("12", False), ("+7 (812) 555-12-34", False)], "cell string, is_text boolean")
    assert [r[0] for r in cells.select(gates.cell_looked_at(F.col("cell"), F.col("is_text"))).collect()] == [True, False, True]
