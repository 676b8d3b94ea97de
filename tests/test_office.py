import io
import zipfile

from lodestone.operators import queryplan
from lodestone.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _zip(**files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x"), text)
    return bytearray(data.getvalue())


DOCX = _zip(word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p></w:body></w:document>')
PPTX = _zip(ppt__slides__slide1_xml=f'<p:sld {A}><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><a:p><a:t>Head</a:t></a:p></p:sp><p:sp><a:p><a:t>One</a:t></a:p></p:sp></p:sld>')
XLSX = _zip(
    xl__workbook_xml=f'<workbook {S}><sheets><sheet name="S1"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {S}><si><t>name</t></si></sst>",
    xl__worksheets__sheet1_xml=f'<worksheet {S}><row><c t="s"><v>0</v></c><c><v>5.0</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c></row></worksheet>',
)


def test_office_files(spark):
    rows = [("a.docx", DOCX), ("b.pptx", PPTX), ("c.xlsx", XLSX), ("d.docx", bytearray(b"broken")), ("e.txt", bytearray(b"x")), ("f.docx", None)]
    got = office.read_office(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "block_no").collect()
    assert [(r.path, r.kind, r.content, r.level) for r in got if r.kind != "table"] == [
        ("a.docx", "heading", "Title", 1), ("a.docx", "text", "Text", 0), ("b.pptx", "heading", "Head", 2), ("b.pptx", "text", "One", 0), ("c.xlsx", "heading", "S1", 2),
    ]
    assert [r.table_rows for r in got if r.kind == "table"] == [[["a"]], [["name", "5", "TRUE", "#ERR:#N/A"]]]


def test_query_plan(spark):
    groups = spark.createDataFrame([("g", "медный кек", ["copper cake", None])], "canonical_id string, canonical_name string, aliases array<string>")
    q = spark.createDataFrame([(1, " Copper cake , yield ?"), (2, "что-то"), (3, None)], "id int, q string")
    got = {r.query_id: r for r in queryplan.planned(q, "id", "q", groups).collect()}
    assert got[1].is_english and got[1].matched_terms == ["copper cake"] and "медный кек" in got[1].dense_query and got[1].cleaned == "Copper cake, yield?"
    assert not got[2].is_english and got[2].dense_query == "что-то" and got[3].matched_terms == []
