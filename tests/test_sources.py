import io
import zipfile

import pytest

from maskloom.functions.tagging import Options
from maskloom.operators import gates
from maskloom.sources import ooxml, sinks, text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def docx(body, **more):
    return archive(word__document_dot_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>", **more)


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_text_encodings():
    assert text.decoded("﻿текст".encode()) == "текст" and text.decoded("текст".encode("cp1251")) == "текст"


def test_csv_rows():
    assert text.csv_rows('a;b\n"x;1";"y\nz"\n'.encode()) == ["a\tb\n", "x;1\ty z\n"]
    with pytest.raises(ValueError):
        text.csv_rows(b"a,b\nc,d\n", max_cells=3)


def test_html_hides_attributes_and_scripts():
    page = '<title>T</title><script>var s="<p>x</p>"</script><p>A&amp;B <a href="mailto:x@y.z">link</a></p><div>c</div>'
    assert text.visible_text(page).split("\n") == ["T", "A&B link", "c"]


def test_docx_order_and_rewriting():
    table = f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>"
    raw = docx(p("one ", "two") + table + p("three"), word__footnotes_dot_xml=f"<w:footnotes {W}><w:footnote>{p('note')}</w:footnote></w:footnotes>", docProps__core_dot_xml="<c><creator>Ann</creator></c>")
    assert list(ooxml.docx_texts(raw)) == ["one two", "three", "cell", "note"]
    new = ooxml.docx_rewritten(raw, lambda t: t.replace("two", "[X_1]"))
    assert list(ooxml.docx_texts(new)) == ["one [X_1]", "three", "cell", "note"]
    assert b"Ann" not in zipfile.ZipFile(io.BytesIO(new)).read("docProps/core.xml")


def test_xlsx_cells():
    sheet = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7812345678</v></c><c r="C1"><v>12</v></c><c r="D1" t="b"><v>1</v></c></row></sheetData></worksheet>'
    raw = archive(xl__worksheets__sheet1_dot_xml=sheet, xl__sharedStrings_dot_xml=f"<sst {S}><si><t>name</t></si></sst>")
    assert [c[2] for c in ooxml.xlsx_cells(raw)] == ["name", "7812345678"]


@pytest.mark.parametrize(
    "raw,why",
    [
        (archive(xl__worksheets__s_dot_xml=f'<worksheet {S}><sheetData><row><c r="A1"><f>1+1</f></c></row></sheetData></worksheet>'), "formula"),
        (docx(p("x"), word__media__i_dot_png="x"), "not supported"),
        (docx(p("x"), word___rels__d_dot_rels='<r><Relationship TargetMode="External" Type="http://x/image" Target="http://e"/></r>'), "external"),
        (docx(f"<w:ins>{p('x')}</w:ins>"), "tracked"),
        (archive(word__document_dot_xml="<!DOCTYPE x><x/>"), "not readable"),
        (b"no archive", "not readable"),
        (archive(**{"..__evil": "x"}), "outside"),
    ],
)
def test_archives_that_are_refused(raw, why):
    assert why in (ooxml.refused(raw) or "")


def test_scans_gates_and_intake(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("один\nдва".encode())
    (tmp_path / "sub" / "b.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "c.docx").write_bytes(docx(p("x"), word__media__i_dot_png="x"))
    (tmp_path / "d.exe").write_bytes(b"x")
    files = text.intake(spark, str(tmp_path))
    assert sorted(r.ext for r in files.select("ext").collect()) == ["csv", "docx", "txt"]
    lines = text.text_lines(files.where("ext = 'txt'")).orderBy("seg_no").collect()
    assert [r.text for r in lines] == ["один\n", "два"]
    assert [r.text for r in text.csv_lines(files.where("ext = 'csv'")).orderBy("seg_no").collect()] == ["x\ty\n", "1\t2\n"]
    assert {r.doc_id[-6:]: r.ok for r in gates.gated(files).collect()} == {"/a.txt": True, "/b.csv": True, "c.docx": False}


def test_names_and_publishing(tmp_path, spark):
    assert sinks.stripped_name("[ANON] Contract [deanon]") == "Contract"
    path = sinks.free_path(str(tmp_path), "x", ".txt")
    with sinks.published(path) as f:
        f.write(b"1")
    assert sinks.free_path(str(tmp_path), "x", ".txt").endswith("x (2).txt")
    with pytest.raises(RuntimeError), sinks.published(str(tmp_path / "y")) as f:
        raise RuntimeError
    assert sorted(q.name for q in tmp_path.iterdir()) == ["x.txt"]
    labels = spark.createDataFrame([("[A_1]", "v")], "label string, value string")
    with pytest.raises(PermissionError):
        sinks.write_parquet(labels, str(tmp_path / "labels"))


def test_manifests(spark):
    docs = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "original_name string, content binary")
    from pyspark.sql import functions as F

    written = gates.manifests(docs.withColumn("output_name", F.lit("o")), Options())
    assert "value" not in written.columns and written.first().options["hide_names"] is True
    changed = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"3"))], "original_name string, content binary")
    assert {r.original_name: r.reason for r in gates.matched_manifests(changed, written).collect()} == {"a": None, "b": "no manifest"}
    other = written.withColumn("rules_version", F.lit("0"))
    assert {r.reason for r in gates.matched_manifests(docs, other).collect()} == {"other rules"}
    both = written.unionByName(gates.manifests(docs.withColumn("output_name", F.lit("o")), Options(hide_dates=True)))
    assert {r.reason for r in gates.matched_manifests(docs, both).collect()} == {"conflicting options"}


def test_pairs(spark):
    a = spark.createDataFrame([("p1", "[ОТВЕТ] Договор"), ("p2", "x")], "path string, stem string")
    o = spark.createDataFrame([("o1", "Договор"), ("o2", "[ANON] Договор")], "path string, stem string")
    assert {r.answer: r.original for r in gates.pairs(a, o).collect()} == {"p1": "o1", "p2": None}


def test_no_network_modules():
    import pathlib

    for f in (pathlib.Path(text.__file__).parent.parent).rglob("*.py"):
        body = f.read_text()
        assert not any(f"import {m}" in body for m in ("socket", "requests", "urllib", "http.client")), f
