"""Workbooks as spreadsheet programs write them, through the data source and the plain reader."""

import datetime as dt
import io
import zipfile

import pytest

from snapweave.sources import workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheet, shared=(), formats=(), custom="", about=""):
    """A workbook from sheet XML, shared texts (XML) and the number formats of its styles."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{about}<sheets><sheet name="x" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        if formats:
            cells = "".join(f'<xf numFmtId="{n}"/>' for n in formats)
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts>{custom}</numFmts><cellXfs>{cells}</cellXfs></styleSheet>')
    return out.getvalue()


FIRST = book(
    '<row r="1"><c r="A1"/></row>'
    '<row r="3"><c r="C3" t="s"><v>0</v></c><c r="D3" t="s"><v>1</v></c><c r="F3" t="inlineStr"><is><t>when</t></is></c><c r="G3" t="str"><v>ok</v></c></row>'
    '<row r="4"><c r="C4" t="s"><v>2</v></c><c r="D4"><v>3.0</v></c><c r="F4" s="1"><v>45292.5</v></c><c r="G4" t="b"><v>1</v></c></row>'
    '<row r="5"/>'
    '<row r="6"><c r="D6"><v>4</v></c><c r="F6" s="2"><v>45293</v></c><c r="G6" t="e"><v>#N/A</v></c></row>'
    '<row r="7"><c r="C7" t="str"><v>computed</v></c><c r="D7" s="3"><v>5</v></c><c r="F7" t="inlineStr"><is><t>never</t></is></c><c r="G7" t="b"><v>0</v></c></row>',
    shared=["<t>user</t>", "<t>number</t>", "<r><t>ri</t></r><r><t>ch &amp; ü</t></r>"],
    formats=[0, 22, 164, 165],
    custom='<numFmt numFmtId="164" formatCode="dd\\/mm\\/yyyy"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/>',
)
SECOND = book('<row><c t="inlineStr"><is><t>number</t></is></c><c t="inlineStr"><is><t>user</t></is></c></row><row><c><v>9</v></c><c t="inlineStr"><is><t>z</t></is></c></row>')
OLD = book('<row><c t="inlineStr"><is><t>when</t></is></c></row><row><c s="1"><v>0.25</v></c></row>', formats=[0, 14], about='<workbookPr date1904="1"/>')


def test_rows_of_a_sheet():
    assert list(workbooks.sheet_rows(FIRST)) == [
        {"user": "rich & ü", "number": "3.0", "when": "2024-01-01 12:00:00", "ok": "true"},
        {"user": None, "number": "4", "when": "2024-01-02 00:00:00", "ok": None},
        {"user": "computed", "number": "5", "when": "never", "ok": "false"},
    ]
    assert list(workbooks.sheet_rows(OLD)) == [{"when": "1904-01-01 06:00:00"}]


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(workbooks.WorkbookSource)
    for name, content in (("a.xlsx", FIRST), ("b.xlsx", SECOND)):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "notes.txt").write_text("no workbook")
    return str(tmp_path)


def test_source_with_a_schema(spark, folder):
    read = spark.read.format("workbooks").schema("number int, user string, when timestamp, ok boolean, absent double").load(folder)
    got = {tuple(r) for r in read.collect()}
    day = dt.datetime(2024, 1, 1)
    assert got == {
        (3, "rich & ü", day + dt.timedelta(hours=12), True, None),
        (4, None, day + dt.timedelta(days=1), None, None),
        (5, "computed", None, False, None),
        (9, "z", None, None, None),
    }


def test_source_takes_its_schema_from_the_header(spark, folder):
    read = spark.read.format("workbooks").load(folder)
    assert read.columns == ["user", "number", "when", "ok"] and {t for _, t in read.dtypes} == {"string"}
    assert read.filter("user = 'z'").select("number").first()[0] == "9"


def test_both_readers_agree(spark, folder):
    schema = "user string, number int, when timestamp"
    plain = workbooks.read_workbooks(spark, folder + "/*.xlsx", schema)
    source = spark.read.format("workbooks").schema(schema).load(folder)
    assert sorted(map(str, plain.collect())) == sorted(map(str, source.collect()))


def test_empty_folder(spark, tmp_path):
    spark.dataSource.register(workbooks.WorkbookSource)
    assert spark.read.format("workbooks").schema("a int").load(str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="give a schema"):
        spark.read.format("workbooks").load(str(tmp_path))
