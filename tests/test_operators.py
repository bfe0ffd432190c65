import random

from maskloom.functions import categories as C
from maskloom.operators import entities, labels, masking, merging, verify
from maskloom.operators import spans as S
from maskloom.sources import pdf_lines

TEXT = "Пишите: a@b.ru или (812) 555-12-34.\nСчёт 40702810900000000001, снова a@b.ru 😀 z@y.com"


def united(raw):
    out = []
    for start, stop, category in sorted(raw, key=lambda s: (s[0], -s[1])):
        if out and start < out[-1][1]:
            a, z, had = out[-1]
            out[-1] = (a, max(z, stop), category if C.PRIORITY[category] > C.PRIORITY[had] else had)
        else:
            out.append((start, stop, category))
    return out


def test_unions_agree(spark):
    rng = random.Random(5)
    rows = [(d, 0, a, a + rng.randint(1, 9), c, C.PRIORITY[c], k) for d in range(30) for k, (a, c) in enumerate((rng.randint(0, 30), rng.choice(["ФИО", "EMAIL", "СУММА", "ИНДЕКС"])) for _ in range(8))]
    got = {}
    df = spark.createDataFrame(rows, "doc_id long, seg_no long, start int, stop int, category string, priority int, ord int")
    for r in S.united(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop, r.category))
    for d in range(30):
        assert sorted(got[d]) == united([(r[2], r[3], r[4]) for r in rows if r[0] == d])


def test_rows_and_relations_agree(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "no values"), (5, "a@b.ru")], "doc_id long, text string")
    rows = {r.doc_id: r for r in labels.anonymized_rows(docs).collect()}
    assert rows[1].masked == "Пишите: [EMAIL_1] или [ТЕЛЕФОН_1].\nСчёт [СЧЁТ_1], снова [EMAIL_1] 😀 [EMAIL_2]" and rows[2].masked == ""
    segments, table = labels.anonymized(S.as_segments(docs))
    assert {r.doc_id: r.text for r in segments.collect()} == {k: r.masked for k, r in rows.items()}
    back = labels.restored(segments.select("doc_id", "text"), table)
    assert {r.doc_id: r.text for r in back.collect()} == {1: TEXT, 2: "", 3: "", 4: "no values", 5: "a@b.ru"}


def test_tolerant_restore_in_columns(spark):
    answers = spark.createDataFrame([(1, "[email-1] [ EMAIL 1 ] [EMAIL_9] [ДАТА ВЫДАЧИ 1]")], "doc_id long, text string")
    table = spark.createDataFrame([(1, "EMAIL", 1, "x@y.z"), (1, "ДАТА_ВЫДАЧИ", 1, "01.02.2003")], "doc_id long, category string, n int, value string")
    r = labels.restored(answers, table).first()
    assert (r.text, r.restored, r.unresolved) == ("x@y.z x@y.z [EMAIL_9] 01.02.2003", 3, 1)


def test_numbers_run_through_segments(spark):
    segments = spark.createDataFrame([(1, 1, "b@b.ru a@a.ru"), (1, 0, "a@a.ru"), (2, 0, "b@b.ru")], "doc_id long, seg_no long, text string")
    out, _ = labels.anonymized(segments)
    assert {(r.doc_id, r.seg_no): r.text for r in out.collect()} == {(1, 0): "[EMAIL_1]", (1, 1): "[EMAIL_2] [EMAIL_1]", (2, 0): "[EMAIL_1]"}


def test_lines_keep_their_breaks(spark):
    text = "a\r\nb\rc\nd\x85e f\x0bg"
    df = S.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r.text for r in df.orderBy("seg_no").collect()] == text.splitlines(keepends=True)


def test_runs(spark):
    runs = spark.createDataFrame([(1, 0, 0, 0, 5, "Hello"), (1, 0, 1, 5, 11, " world"), (1, 0, 2, 11, 12, "!")], "doc_id long, seg_no long, run_no int, start int, stop int, text string")
    put = spark.createDataFrame([(1, 0, 3, 8, "[X_1]")], "doc_id long, seg_no long, start int, stop int, put string")
    assert [r.text for r in S.spliced_runs(runs, put).orderBy("run_no").collect()] == ["Hel[X_1]", "rld", "!"]


def test_switch(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "Предмет договора"), (1, 2, "b"), (1, 3, "Подписи сторон")], "doc_id long, seg_no long, text string")
    assert [r.masking for r in S.switched(df).orderBy("seg_no").collect()] == [True, False, False, True]


def test_masking_tables(spark):
    docs = spark.createDataFrame([(1, "Директор Сидоров Антон, ИНН 7812345678\nСидорова ждут"), (2, None)], "doc_id long, text string")
    out = masking.anonymize(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text.startswith("Директор [ФИО_1], ИНН [ИНН_ЮЛ_1]") and "Сидоров" not in rows[1].text and rows[2].text is None
    back = masking.restore(out.select("doc_id", "text"), out.select("doc_id", "labels")).collect()
    assert {r.doc_id: r.text for r in back}[1] == docs.first().text


def test_entities_from_a_table_and_their_absence(spark):
    import pytest

    segments = spark.createDataFrame([(1, 0, "Кирилл пришёл"), (1, 1, "ушёл")], "doc_id long, seg_no long, text string")
    found = spark.createDataFrame([(1, 0, 0, 6, "PER")], "doc_id long, seg_no long, start int, stop int, type string")
    out, _ = masking.anonymize_segments(entities.with_table_entities(segments, found, segments))
    assert [r.text for r in out.orderBy("seg_no").collect()] == ["[ФИО_1] пришёл", "ушёл"]
    with pytest.raises(Exception, match="no entities"):
        masking.anonymize_segments(entities.with_table_entities(segments, found, segments.where("seg_no = 0")))[0].collect()


def test_other_documents_do_not_change_labels(spark):
    one = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    two = one.unionByName(spark.createDataFrame([(2, "c@d.ru")], "doc_id long, text string"))
    assert labels.anonymized_rows(one).first().masked == labels.anonymized_rows(two).where("doc_id = 1").first().masked


def test_paragraphs(spark):
    rows = [(1, 1, 12.0 * k + (30.0 if k > 2 else 0), t) for k, t in enumerate(["A broken hy-", "phen and", "end.", "Next"])]
    df = spark.createDataFrame(rows, "doc_id long, page int, top double, text string")
    assert [r.text for r in pdf_lines.paragraphs(df).orderBy("para_no").collect()] == ["A broken hyphen and end.", "Next"]


def test_merge_over_tables(spark):
    base = "First [ФИО_1] paragraph of it.\n\nSecond one."
    bases = spark.createDataFrame([(1, base), (2, "x")], "doc_id long, text string")
    answers = spark.createDataFrame([(1, base.replace("paragraph of it", "paragraph of that"))], "doc_id long, text string")
    rows = {r.doc_id: r for r in merging.merge_answers(bases, answers).collect()}
    assert "of that" in rows[1].text and rows[1].modified == 1 and rows[2].text == "x"


def test_checks(spark):
    import pytest

    table = spark.createDataFrame([(1, "EMAIL", "[EMAIL_1]", "a@b.ru"), (1, "ИНН_ЮЛ", "[ИНН_ЮЛ_1]", "7812345678")], "doc_id long, category string, label string, value string")
    answer = spark.createDataFrame([(1, "[EMAIL_1] [EMAIL_2] [ИНН_ФЛ_1] x@y.com [Name 1] a@b.ru")], "doc_id long, text string")
    assert [r.label for r in verify.unknown_labels(answer, table).collect()] == ["[EMAIL_2]"]
    assert [r.value for r in verify.invented_values(answer, table).collect()] == ["x@y.com"]
    assert {r.kind for r in verify.residual_labels(answer).collect()} == {"label", "lookalike"}
    leaks = verify.residual_values(answer, table)
    assert [r.value for r in leaks.collect()] == ["a@b.ru"]
    with pytest.raises(verify.Leak):
        verify.refuse_leaks(leaks)
    verify.refuse_leaks(leaks.where("false"))


def test_stream(spark, tmp_path):
    from maskloom.streaming.documents import masked_stream

    spark.createDataFrame([(1, "a@b.ru"), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = masked_stream(source, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "[EMAIL_1]", 2: "x"}
