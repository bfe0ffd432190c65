"""Files from end to end: formats kept, values gone, answers restored."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from maskloom.functions.tagging import Options
from maskloom.operators import files, gates
from maskloom.sources import ooxml, text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in members.items():
            z.writestr(n, x)
    return out.getvalue()


def docx(body):
    core = '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Сидоров</dc:creator></p>'
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "docProps/core.xml": core})


BODY = (
    "<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs></w:pPr><w:r><w:t>Директор</w:t></w:r><w:r><w:tab/><w:t>Сидоров </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>А.Б.</w:t><w:br/><w:t>подписал</w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>почта user@example.com</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
)
SHEET = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7812345678</v></c><c r="C1"><v>5</v></c><c r="D1" t="b"><v>1</v></c></row></sheetData><headerFooter><oddHeader>Сидоров А.Б.</oddHeader></headerFooter></worksheet>'
BOOK = archive({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Сидоров" sheetId="1"/></sheets><definedNames><definedName name="x">Сидоров!A1</definedName></definedNames></workbook>',
    "xl/worksheets/sheet1.xml": SHEET, "xl/sharedStrings.xml": f'<sst {S} count="1"><si><t>Сидоров Антон Борисович</t></si></sst>',
    "xl/comments1.xml": f'<comments {S}><authors><author>Сидоров</author></authors><commentList><comment ref="A1"><text><t>звонить (812) 555-12-34</t></text></comment></commentList></comments>',
})


def members(raw):
    z = zipfile.ZipFile(io.BytesIO(raw))
    return {n: z.read(n).decode() for n in z.namelist()}


def test_paragraphs_keep_tabs_breaks_and_formats():
    new = ooxml.docx_changed(docx(BODY), lambda t: [t[0].replace("Сидоров А.Б.", "[ФИО_1]"), t[1]])
    xml = members(new)["word/document.xml"]
    assert list(ooxml.docx_texts(new)) == ["Директор\t[ФИО_1]\nподписал", "почта user@example.com"]
    assert xml.count("tab") == members(docx(BODY))["word/document.xml"].count("tab") and len(re.findall(r"<\w+:br ?/>", xml)) == 1 and len(re.findall(r"<\w+:b ?/>", xml)) == 1
    assert "Сидоров" not in "".join(members(new).values())
    gone = ooxml.docx_changed(docx(BODY), lambda t: ["Директор подписал", t[1]])  # the tab and the break are inside the change
    assert next(ooxml.docx_texts(gone)) == "Директор подписал"


def test_workbooks():
    texts = [c[2] for c in ooxml.xlsx_cells(BOOK)]
    assert texts == ["Сидоров Антон Борисович", "7812345678", "Сидоров А.Б.", "Сидоров", "звонить (812) 555-12-34"]
    new = ooxml.xlsx_changed(BOOK, lambda t: [f"[X_{k}]" for k in range(len(t))])
    every = members(new)
    assert not any("Сидоров" in x or "7812345678" in x or "555" in x for x in every.values())
    assert [c[2] for c in ooxml.xlsx_cells(new)] == ["[X_0]", "[X_1]", "[X_2]", "[X_4]"] and "Sheet1" in every["xl/workbook.xml"] and ">5<" in every["xl/worksheets/sheet1.xml"]
    same = ooxml.xlsx_changed(BOOK, lambda t: t)
    assert [c[2] for c in ooxml.xlsx_cells(same)][:2] == texts[:2] and members(same)["xl/sharedStrings.xml"].count("<") == members(new)["xl/sharedStrings.xml"].count("<")


def test_files_masked_and_restored(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    out.mkdir()
    contents = {"a.docx": docx(BODY), "b.xlsx": BOOK, "c.txt": "Сидоров Антон Борисович, ИНН 7812345678\n".encode("cp1251"), "d.csv": "имя;почта\nx;user@example.com\n".encode(), "e.html": "<p>тел. (812) 555-12-34</p>".encode(), "f.pdf": b"%PDF", "g.docx": b"broken"}
    for n, c in contents.items():
        (source / n).write_bytes(c)
    taken = text.intake(spark, str(source))
    got = {r.doc_id.rpartition("/")[2]: r for r in files.mask_files(taken).collect()}
    assert {n for n, r in got.items() if r.reason} == {"f.pdf", "g.docx"} and all(r.content is None for r in got.values() if r.reason)
    assert got["c.txt"].output_name == "[ANON] c.txt" and bytes(got["c.txt"].content).decode() == "[ФИО_1], ИНН [ИНН_ЮЛ_1]\n"
    assert bytes(got["d.csv"].content).decode() == "имя\tпочта\nx\t[EMAIL_1]\n" and got["e.html"].output_name.endswith(".txt")
    results = files.mask_files(taken)
    files.published(results, str(out))
    assert len(list(out.iterdir())) == 5
    files.published(results, str(out))
    assert len(list(out.iterdir())) == 10 and (out / "[ANON] c (2).txt").read_bytes() == bytes(got["c.txt"].content)

    named = taken.select(F.element_at(F.split("doc_id", "/"), -1).alias("original_name"), "ext", "content")
    manifest = gates.manifests(named.select("original_name", "content", F.lit("o").alias("output_name")), Options())
    answers = [(f"[ОТВЕТ] {n}", n.rpartition(".")[2] if n != "d.csv" else "txt", bytearray(got[n].content), n) for n in ("a.docx", "b.xlsx", "c.txt", "d.csv")]
    answers += [("x.pdf", "pdf", bytearray(b""), "a.docx"), ("y.txt", "txt", bytearray(b"[EMAIL_1] [EMAIL_7]"), "d.csv"), ("z.txt", "txt", bytearray(b""), "none")]
    asked = spark.createDataFrame(answers, "answer string, ext string, content binary, original_name string")
    back = {r.answer: r for r in files.restore_files(asked, named, manifest).collect()}
    assert list(ooxml.docx_texts(bytes(back["[ОТВЕТ] a.docx"].content))) == list(ooxml.docx_texts(contents["a.docx"]))
    assert [c[2] for c in ooxml.xlsx_cells(bytes(back["[ОТВЕТ] b.xlsx"].content))][:3] == [c[2] for c in ooxml.xlsx_cells(BOOK)][:3]
    assert bytes(back["[ОТВЕТ] c.txt"].content).decode() == "Сидоров Антон Борисович, ИНН 7812345678\n" and back["[ОТВЕТ] c.txt"].output_name == "[RESTORED] c.txt"
    assert bytes(back["y.txt"].content) == b"user@example.com [EMAIL_7]" and (back["y.txt"].restored, back["y.txt"].unresolved) == (1, 1)
    assert back["x.pdf"].reason and back["z.txt"].reason == "no original"
    other = manifest.withColumn("rules_version", F.lit("0"))
    assert {r.reason for r in files.restore_files(asked.where("ext = 'docx'"), named, other).collect()} == {"other rules"}


def test_nothing_is_published_if_anything_leaks_or_fails(spark, tmp_path):
    good = spark.createDataFrame([(f"f{k}.txt", bytearray(b"x"), 0) for k in range(20)], "output_name string, content binary, n_leaks long").repartition(4)
    leak = good.withColumn("n_leaks", F.when(F.col("output_name") == "f7.txt", 1).otherwise(0))
    with pytest.raises(Exception, match="nothing was published"):
        files.published(leak, str(tmp_path))
    assert not list(tmp_path.iterdir())
    failing = good.withColumn("output_name", F.when(F.col("output_name") == "f7.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("output_name")))
    with pytest.raises(Exception, match="broken"):
        files.published(failing, str(tmp_path))
    assert not list(tmp_path.iterdir())
    files.published(good, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 20


def test_intake_leaves_no_file_out(spark, tmp_path):
    for k in range(1500):
        (tmp_path / f"f{k:04d}.{'TXT' if k % 2 else 'txt'}").write_bytes(b"a" * (k % 7 + 1))
    (tmp_path / "other.bin").write_bytes(b"x")
    rows = text.intake(spark, str(tmp_path), most=1000, largest=6).collect()
    reasons = {}
    for r in rows:
        reasons[r.reason] = reasons.get(r.reason, 0) + 1
        assert (r.content is None) == (r.reason is not None)
    assert len(rows) == 1500 and reasons["behind the first 1000 files"] == 500 and reasons["too large"] == sum(k % 7 == 6 for k in range(1000))
    assert text.intake(spark, str(tmp_path)).where("reason is null").count() == 1500
    plan = text.intake(spark, str(tmp_path), largest=5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,5)" in plan
