import io
import struct
import zipfile

from pyspark.sql import functions as F

from strata.operators import parsing
from strata.plans import document

W = 'xmlns:w="http://x/w"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


DOCX = zipped(word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>')
XLSX = zipped(xl__sharedStrings_xml="<sst><si><t>hi</t></si></sst>", xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
PPTX = zipped(ppt__slides__slide1_xml='<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:sld>')


def test_formats():
    assert parsing.docx(DOCX) == [("heading", "Top", 0.95), ("paragraph", "One two", 0.95), ("row", "a | ", 0.95)]
    assert parsing.xlsx(XLSX) == [("row", "hi |  | 5", 0.95)]
    assert parsing.pptx(PPTX) == [("paragraph", "Slide", 0.9)]
    assert parsing.odt(zipped(content_xml='<o xmlns:t="t"><t:h>H</t:h><t:p>x <t:s>y</t:s></t:p></o>')) == [("heading", "H", 0.95), ("paragraph", "x y", 0.95)]
    assert parsing.rtf(rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Bold\b0  caf\'e9\par next}")[0][1] == "Bold café"
    assert parsing.image(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9)) == [("image", "7x9", 1.0)]
    assert parsing.fallback(b"\x00\x01\x02hello world\x03\xff\xfe\xfd\xfc\xfb")[0] == ("paragraph", "hello world", 0.3)
    assert parsing.fallback(b"plain text")[0][2] == 0.6
    assert parsing.cell_place("AB12") == (11, 27)


def test_containers():
    inner = zipped(a_txt="x")
    outer = zipped(inner_zip=inner, b_txt="y")
    assert [n for n, _ in parsing.children(outer, "o")] == ["o/inner_zip", "o/inner_zip/a_txt", "o/b_txt"]
    assert [n for n, _ in parsing.children(outer, "o", depth=1)] == ["o/inner_zip", "o/inner_zip/#gap: deeper than the levels asked for", "o/b_txt"]
    assert parsing.children(outer, "o", most=1)[-1] == ("o/#gap: 1 of 2 left out", b"")
    assert parsing.children(b"no zip", "n") == []
    assert parsing.structure_findings(b"%PDF-1.4 xref", "application/pdf") == ["no_eof"]
    assert parsing.structure_findings(None, "application/pdf") == ["empty"]
    assert parsing.structure_findings(DOCX, "application/vnd.openxmlformats-officedocument.wordprocessingml.document") == ["missing_[Content_Types].xml"]


def test_artifacts(spark):
    files = [(1, "a.docx", DOCX), (2, "b.html", b"<h1>A</h1><p>B</p>"), (3, "c.bin", b""), (4, "d.docx", b"broken"), (5, "e.txt", None), (6, "f.txt", b"One\n\n# Two")]
    df = spark.createDataFrame(files, "k int, name string, data binary")
    got = {r.k: r for r in document.artifacts(df, "k", "name", "data").collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "ok", 3: "capability_gap", 4: "failed", 5: "capability_gap", 6: "ok"}
    assert got[2].text == "A\nB" and got[1].n_headings == 1 and got[1].n_rows == 1 and got[2].provenance_coverage == 1.0
    assert document.artifacts(df.limit(0), "k", "name", "data").count() == 0


def test_front_matter(spark):
    df = spark.createDataFrame([("---\nname: x y\nlist:\n  - a\n---\nbody",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(parsing.front_matter(F.col("t"))).collect()] == [{"name": "x y", "list": ""}, {}, {}]


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and {f"p{n}_found" for n in (3, 4)} <= set(known) and len(known) > 80
