"""Files: marks of byte order, workbooks as other programs write them, broken and foreign ones."""

import io
import zipfile

from triplicate.sources import tabular

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def read(spark, *files):
    rows = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in files], "path string, content binary")
    return [(r.path, r.sheet, r.row, r.cells and [(c.name, c.value) for c in r.cells], r.error) for r in tabular.records(rows).collect()]


def foreign_workbook() -> bytes:
    """Shared texts with runs, a date, a gap in a row, a formula's value, a truth value, and the second sheet in view."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>SKU</t></si><si><r><t>Ba</t></r><r><t>se</t></r><rPh><t>x</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="[Red]yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"""<worksheet {MAIN}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>Name</t></is></c><c r="D2" t="str"><v>When</v></c></row>
            <row r="3"><c r="A3"/></row><row r="5"><c r="A5"><v>36</v></c><c r="C5" t="s"><v>1</v></c><c r="D5" s="1"><v>45292.5</v></c><c r="E5"><v>9</v></c></row>
            <row r="6"><c r="A6"><f>1+1</f><v>3.50</v></c><c r="C6" t="b"><v>1</v></c><c r="D6" s="2"><v>45292</v></c></row></sheetData></worksheet>""")
    return out.getvalue()


def test_csv_with_and_without_a_mark(spark):
    text = 'Code,Description\r\n"B,1","two\nlines"\r\n\r\nB2\r\nB3,x,beyond\r\n'
    for raw in (text.encode("utf-8-sig"), text.encode()):
        assert [r[2:4] for r in read(spark, ("A.CSV", raw))] == [
            (2, [("Code", "B,1"), ("Description", "two\nlines")]), (4, [("Code", "B2"), ("Description", None)]), (5, [("Code", "B3"), ("Description", "x")]),
        ]
    assert read(spark, ("a.csv", b""), ("b.csv", b"Code\n")) == []


def test_a_foreign_workbook(spark):
    assert read(spark, ("x.xlsx", foreign_workbook())) == [
        ("x.xlsx", "Two", 5, [("SKU", "36"), (None, None), ("Name", "Base"), ("When", "2024-01-01 12:00:00")], None),
        ("x.xlsx", "Two", 6, [("SKU", "3.5"), (None, None), ("Name", "True"), ("When", "2024-01-01 00:00:00")], None),
    ]
    rows = spark.createDataFrame([("x.xlsx", bytearray(foreign_workbook()))], "path string, content binary")
    (text,) = [r.text for r in tabular.sheet_texts(rows).collect()]
    assert text == "--- SHEET: One ---\n7\n\n--- SHEET: Two ---\nSKU | Name | When\n36 | Base | 2024-01-01 12:00:00 | 9\n3.5 | True | 2024-01-01 00:00:00"


def test_bad_files_do_not_stop_others(spark):
    good = tabular.workbook({"S": [["Part#", "x"], ["A1", 2]]})
    found = read(spark, ("a.xlsx", b"no zip"), ("b.txt", b"Code\nX"), ("c.csv", b"Code\n\xff\xfe"), ("d.csv", None), ("e.xlsx", good[:-30]), ("f.xlsx", good))
    assert [(r[0], r[4] is None) for r in found] == [("a.xlsx", False), ("b.txt", False), ("c.csv", False), ("d.csv", False), ("e.xlsx", False), ("f.xlsx", True)]
    assert {r[4] for r in found if r[0] in "b.txt d.csv"} == {"Unsupported file type — use .csv or .xlsx", "File too large"}


def test_catalogues_by_their_headers(spark):
    files = [
        ("one.csv", b"\xef\xbb\xbfItem Code,Product Description,Product Type\nBT36B-2,Base w/ 2 Roll-Out Trays,Cabinet\n  ,blank,\nFREIGHTSURCHARGE,Freight Surcharge,Commercial Charge\n"),
        ("two.xlsx", tabular.workbook({"S": [["SKU", "Description", "Category"], ["WST3057B", "Stacked Wall Cabinet", "Cabinet"], [None, None, None], [36, None, None]]})),
        ("none.csv", b"Foo,Bar\n1,2\n3,4\n"),
    ]
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    found = {(r.path, r.code): (r.description, r.category, r.confidence, r.error) for r in tabular.catalogues(tabular.records(rows)).collect()}
    assert found == {
        ("one.csv", "BT36B-2"): ("Base w/ 2 Roll-Out Trays", "CABINET", 1.0, None), ("one.csv", "FREIGHTSURCHARGE"): ("Freight Surcharge", "COMMERCIAL_CHARGE", 1.0, None),
        ("two.xlsx", "WST3057B"): ("Stacked Wall Cabinet", "CABINET", 1.0, None), ("two.xlsx", "36"): (None, "UNKNOWN", 1.0, None),
        ("none.csv", None): (None, None, None, "Could not find a code/SKU column in this file"),
    }


def test_files_by_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_bytes(b"\xef\xbb\xbfCode\nA1\n")
    (tmp_path / "b.csv").write_bytes(b"Code\n" + b"B1\n" * 1000)
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.content) for r in tabular.files(spark, str(tmp_path), largest=100).collect()}
    assert found["a.csv"][1] is not None and found["b.csv"] == (3005, None)
