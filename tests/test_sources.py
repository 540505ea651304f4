import io
import zipfile

import pytest

from corpusq.sources import files, parsers
from corpusq.sources.parsers import Context


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def named(members):
    return zipped(**members)


DOCX = named({"word/document.xml": "<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = named({
    "xl/workbook.xml": "<workbook><sheets><sheet name='One'/><sheet name='Two'/></sheets></workbook>", "xl/sharedStrings.xml": "<sst><si><t>text</t></si></sst>",
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c t='s'><v>0</v></c><c/><c><v>7</v></c></row><row><c/></row></sheetData></worksheet>", "xl/worksheets/sheet2.xml": "<worksheet><sheetData><row><c t='inlineStr'><is><t>in</t></is></c></row></sheetData></worksheet>"})
PPTX = named({"ppt/slides/slide2.xml": "<s><p><t>second</t></p></s>", "ppt/slides/slide1.xml": "<s><p><t>first</t></p><tbl><tr><tc><p><t>x</t></p></tc><tc><p><t>y</t></p></tc></tr></tbl></s>"})
VSDX = named({"visio/pages/page1.xml": "<P><Shape><Text>Start</Text></Shape><Shape><Text> </Text></Shape></P>"})
DXF = "0\nSECTION\n2\nENTITIES\n0\nTEXT\n1\nWall\n0\nLINE\n1\nno\n0\nMTEXT\n3\nLong \n1\nnote\n0\nENDSEC\n0\nEOF\n".encode()


def test_office_formats():
    assert parsers.parse("a.docx", DOCX).content == "Hello there\na | b" and parsers.parse("a.docx", DOCX).pages == ["Hello there"]
    got = parsers.parse("a.xlsx", XLSX)
    assert got.pages == ["=== Sheet: One ===\ntext\t7", "=== Sheet: Two ===\nin"] and got.content == "\n\n".join(got.pages)
    assert parsers.parse("a.pptx", PPTX).pages == ["--- Slide 1 ---\nfirst\nx | y", "--- Slide 2 ---\nsecond"]
    assert parsers.parse("a.vsdx", VSDX).content == "Start" and parsers.parse("a.vsdx", b"junk").metadata == {"error": "unreadable"}
    assert parsers.parse("a.dxf", DXF).content == "Wall\nLong\nnote"


def test_sniffing():
    assert [parsers.word_format(x) for x in (DOCX, parsers.OLE2 + b"x", b"text")] == ["docx", "doc", None]
    assert [parsers.table_format(x) for x in (XLSX, parsers.OLE2, b"a;b\r\n1", b"\x00\x01", b"")] == ["xlsx", "xls", "csv", None, None]
    assert parsers.parse("t.csv", "a;;c\n;;\n1;2;3\n".encode()).content == "a\tc\n1\t2\t3"
    assert parsers.parse("t.xls", "x,y\n1,2\n".encode()).content == "x\ty\n1\t2" and parsers.parse("t.xls", XLSX).pages[1].endswith("in")
    old = parsers.OLE2 + b"\0" * 10 + "Readable line".encode("utf-16-le") + b"\x01\x00" + "ab".encode("utf-16-le")
    assert "Readable line" in parsers.parse("old.doc", old).content
    assert parsers.parse("bad.doc", b"nothing").metadata["error"]


def test_archive_pdf_image():
    z = named({"in/a.docx": DOCX, "~$a.docx": b"temp", "b.zip": b"nested", "c.csv": "p,q\n", "d.unknown": b"?"})
    got = parsers.parse("x.zip", z)
    assert got.content == "[From archive: x.zip/a.docx]\nHello there\na | b\n\n[From archive: x.zip/c.csv]\np\tq" and got.pages == [got.content]
    ctx = Context(pdf_pages=lambda b: ["one", "", "three"], ocr=lambda b, m: f"ocr {m}")
    assert parsers.parse("a.pdf", b"%PDF", ctx).content == "--- Page 1 ---\none\n\n--- Page 3 ---\nthree"
    blank = Context(pdf_pages=lambda b: ["", " "], ocr=ctx.ocr)
    assert parsers.parse("a.pdf", b"%PDF", blank).content == "ocr application/pdf"
    assert parsers.parse("a.png", b"x", ctx).content == "ocr image/png" and parsers.parse("a.png", b"x").content == "[Image: a.png]"
    assert parsers.needs_ocr("a.png", b"", None) and not parsers.needs_ocr("a.docx", b"", None) and parsers.needs_ocr("a.pdf", b"", blank.pdf_pages) and not parsers.needs_ocr("a.pdf", b"", ctx.pdf_pages)
    assert [parsers.ocr_batches(n) for n in (50, 51, 201)] == [(50, 100), (20, 100), (10, 72)]
    with pytest.raises(ValueError):
        parsers.parse("a.exe", b"")


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.DOCX": DOCX, "sub/b.csv": b"x,y\n", "~$a.docx": DOCX, ".~c.csv": b"", "d.txt": b"plain", "broken.docx": b"PKnot really"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan_directory(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["a.DOCX", "b.csv", "broken.docx"]
    got = {r.file_name: r for r in files.parse_files(found).collect()}
    assert got["a.DOCX"].content == "Hello there\na | b" and got["a.DOCX"].file_type == "word" and got["broken.docx"].content is None and "BadZipFile" in got["broken.docx"].error
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in files.read_plain(spark, str(tmp_path)).collect() if r.path.endswith("d.txt")] == [("d.txt", "plain")]
    fast, slow = files.routed(found, Context())
    assert fast.count() == 3 and slow.count() == 0
    assert files.test_file(spark, str(tmp_path / "sub/b.csv")).first().chars == 3
    page = spark.createDataFrame([(1, "<html><script>x<p></script><p>A &amp; b<br>c</p><!-- no --></html>")], "page_id long, html string")
    assert files.page_text(page).first().text == "A & b\nc"
