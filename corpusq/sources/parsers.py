"""Parsers: bytes of a file to text, pages and metadata.

Each parser takes (name, data, context) and returns a ``Parsed``.  Formats
that need a library or service (PDF text, OCR, RAR, old XLS) take it from the
context as a function; without it the document says that it could not be read.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field

from corpusq.settings import CHUNK_CHARS, EXTENSIONS, FILE_TYPES, PLAIN_EXTENSIONS


@dataclass
class Parsed:
    content: str
    pages: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass
class Context:
    """Functions that stand for libraries and services; all optional."""

    pdf_pages: Callable[[bytes], list[str]] | None = None
    ocr: Callable[[bytes, str], str] | None = None
    rar_members: Callable[[bytes], list[tuple[str, bytes]]] | None = None
    xls_sheets: Callable[[bytes], list[tuple[str, list[list[str]]]]] | None = None
    skip_ocr: bool = False
    ocr_pages: Callable[[bytes, int, int, int], str | None] | None = None  # (PDF, first page, page after the last, dots per inch) to text


OLE2 = bytes.fromhex("D0CF11E0")


def extension(name: str) -> str:
    base = re.split(r"[/\\]", name)[-1]
    return base.rsplit(".", 1)[1].lower() if "." in base.strip(".") else ""


def word_format(data: bytes) -> str | None:
    return "docx" if data[:2] == b"PK" else "doc" if data[:4] == OLE2 else None


def table_format(data: bytes) -> str | None:
    if data[:2] == b"PK":
        return "xlsx"
    if data[:4] == OLE2:
        return "xls"
    head = data[:8]
    return "csv" if head and all(32 <= b < 127 or b in b"\r\n\t" for b in head) else None


def ole2_text(data: bytes) -> str:
    """Readable lines of an OLE2 file, scanned as UTF-16LE: two characters or more, half of them CJK or ASCII."""
    text = data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
    lines = "".join(c if " " <= c <= "￼" else "\n" for c in text).split("\n")
    usual = lambda line: sum(c <= "~" or "一" <= c <= "鿿" for c in line) >= 0.5 * len(line)
    return "\n".join(x for x in map(str.strip, lines) if len(x) >= 2 and usual(x))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ET.Element, name: str) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def _members(z: zipfile.ZipFile, pattern: str) -> list[str]:
    """Names that match, by their number."""
    number = lambda n: int((re.findall(r"\d+", n) or ["0"])[-1])
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=number)


def _packed(parts: list[str], chars: int = CHUNK_CHARS) -> list[str]:
    pages: list[list[str]] = [[]]
    held = 0
    for p in parts:
        pages[-1].append(p)
        held += len(p)
        if held > chars:
            pages.append([])
            held = 0
    return ["\n".join(p) for p in pages if p]


def docx(name: str, data: bytes, ctx: Context) -> Parsed:
    if word_format(data) == "doc":
        return Parsed(ole2_text(data), [], {"format": "ole2"})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
    inside = {id(p) for t in body.iter() if _local(t.tag) == "tbl" for p in t.iter() if _local(p.tag) == "p"}
    paragraphs = [x for x in (_texts(p, "t").strip() for p in body.iter() if _local(p.tag) == "p" and id(p) not in inside) if x]
    rows = [" | ".join(_texts(c, "t").strip() for c in r if _local(c.tag) == "tc") for t in body.iter() if _local(t.tag) == "tbl" for r in t if _local(r.tag) == "tr"]
    return Parsed("\n".join(paragraphs + [r for r in rows if r.strip(" |")]), _packed(paragraphs))


def _sheet_text(name: str, rows: list[list[str]]) -> str:
    filled = ("\t".join(c for c in row if c != "") for row in rows)
    return "\n".join([f"=== Sheet: {name} ===", *[r for r in filled if r]])


def xlsx(name: str, data: bytes, ctx: Context) -> Parsed:
    if data[:2] != b"PK":
        return xls(name, data, ctx)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = [_texts(s, "t") for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name", "") for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"] if "xl/workbook.xml" in names else []
        pages = []
        for i, member in enumerate(_members(z, r"xl/worksheets/sheet\d+\.xml")):
            rows = []
            for row in ET.fromstring(z.read(member)).iter():
                if _local(row.tag) == "row":
                    cells = []
                    for c in row:
                        value = next((v.text or "" for v in c if _local(v.tag) == "v"), None)
                        cells.append(strings[int(value)] if c.get("t") == "s" and value else _texts(c, "t") if c.get("t") == "inlineStr" else value or "")
                    rows.append([x.strip() for x in cells])
            pages.append(_sheet_text(titles[i] if i < len(titles) else f"Sheet{i + 1}", rows))
    return Parsed("\n\n".join(pages), pages)


def csv_text(data: bytes) -> str:
    """Rows with their filled cells only, joined by tabs; the delimiter is the likeliest of comma, tab, semicolon and bar."""
    text = data.decode("utf-8", "replace").removeprefix("﻿")
    try:
        dialect = csv.Sniffer().sniff(text[:8192], ",\t;|")
        rows = list(csv.reader(io.StringIO(text), dialect))
    except csv.Error:
        rows = list(csv.reader(io.StringIO(text)))
    joined = ("\t".join(c.strip() for c in row if c.strip()) for row in rows)
    return "\n".join(r for r in joined if r)


def xls(name: str, data: bytes, ctx: Context) -> Parsed:
    kind = table_format(data)
    if kind == "xlsx":
        return xlsx(name, data, ctx)
    if kind == "xls":
        if ctx.xls_sheets is None:
            return Parsed(ole2_text(data), [], {"format": "ole2"})
        pages = [_sheet_text(n, rows) for n, rows in ctx.xls_sheets(data)]
        return Parsed("\n\n".join(pages), pages)
    text = csv_text(data)
    return Parsed(text, [text])


def vsdx(name: str, data: bytes, ctx: Context) -> Parsed:
    pages = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for member in _members(z, r"visio/pages/page\d+\.xml"):
                found = [x for x in ("".join(t.itertext()).strip() for t in ET.fromstring(z.read(member)).iter() if _local(t.tag) == "Text") if x]
                pages.append("\n".join(found))
    except (zipfile.BadZipFile, ET.ParseError, KeyError):
        return Parsed("", [], {"error": "unreadable"})
    return Parsed("\n\n".join(p for p in pages if p), [p for p in pages if p])


def pdf(name: str, data: bytes, ctx: Context) -> Parsed:
    if ctx.pdf_pages is None and ctx.ocr is None:
        raise ValueError("no reader for PDF text")
    try:
        texts = ctx.pdf_pages(data) if ctx.pdf_pages else []
    except Exception as e:  # a damaged file must not end the job
        return Parsed(f"[PDF: {name}]", [], {"error": str(e)[:500]})
    shown = [f"--- Page {i} ---\n{t.strip()}" for i, t in enumerate(texts, 1) if t and t.strip()]
    if not shown and ctx.ocr and not ctx.skip_ocr:
        text = ctx.ocr(data, "application/pdf")
        return Parsed(text, [text], {"ocr": "true"})
    return Parsed("\n\n".join(shown) or f"[PDF: {name}]", [t for t in texts if t and t.strip()])


def image(name: str, data: bytes, ctx: Context) -> Parsed:
    text = ctx.ocr(data, f"image/{extension(name)}") if ctx.ocr and not ctx.skip_ocr else None
    return Parsed(text or f"[Image: {name}]", [text] if text else [], {"ocr": "true"} if text else {})


def archive(name: str, data: bytes, ctx: Context) -> Parsed:
    """Members parsed and joined into one document; folders, temporary files and nested archives are left out."""
    if extension(name) == "rar":
        if ctx.rar_members is None:
            return Parsed(f"[Archive: {name}]", [], {"error": "no reader for rar"})
        members = ctx.rar_members(data)
    else:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            members = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    parts = []
    for path, content in members:
        base = re.split(r"[/\\]", path)[-1]
        if is_source(base) and FILE_TYPES.get(extension(base)) != "archive":
            got = parse(base, content, ctx)
            parts.append(f"[From archive: {name}/{base}]\n{got.content}")
    text = "\n\n".join(parts)
    return Parsed(text, [text])


def doc(name: str, data: bytes, ctx: Context) -> Parsed:
    try:
        return docx(name, data, ctx)
    except Exception as e:  # any damaged file gets a placeholder
        return Parsed(f"[DOC: {name}]", [], {"error": str(e)[:500]})


def pptx(name: str, data: bytes, ctx: Context) -> Parsed:
    pages = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, member in enumerate(_members(z, r"ppt/slides/slide\d+\.xml"), 1):
            root = ET.fromstring(z.read(member))
            inside = {id(p) for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter() if _local(p.tag) == "p"}
            lines = [x for x in (_texts(p, "t").strip() for p in root.iter() if _local(p.tag) == "p" and id(p) not in inside) if x]
            lines += [" | ".join(_texts(c, "t").strip() for c in r if _local(c.tag) == "tc") for r in root.iter() if _local(r.tag) == "tr"]
            pages.append("\n".join([f"--- Slide {i} ---", *lines]))
    return Parsed("\n\n".join(pages), pages)


def ppt(name: str, data: bytes, ctx: Context) -> Parsed:
    try:
        return pptx(name, data, ctx)
    except Exception as e:  # the old binary format has no reader here
        return Parsed(f"[PPT: {name}]", [], {"error": str(e)[:500]})


def dxf(name: str, data: bytes, ctx: Context) -> Parsed:
    """Texts of TEXT and MTEXT entities: a DXF file is lines of group code and value in turn."""
    lines = data.decode("utf-8", "replace").splitlines()
    section = entity = ""
    found: list[str] = []
    for code, value in zip(map(str.strip, lines[::2]), map(str.strip, lines[1::2])):
        if code == "2" and entity == "SECTION":
            section = value
        if code == "0":
            entity = value
        elif section == "ENTITIES" and entity in ("TEXT", "MTEXT"):
            if code == "1":
                found.append(value)
            elif code == "3" and entity == "MTEXT":
                found.append(value)
    text = "\n".join(x for x in found if x)
    return Parsed(text, [text] if text else [])


def plain(name: str, data: bytes, ctx: Context) -> Parsed:
    text = data.decode("utf-8", "replace")
    return Parsed(text, [text])


def html(name: str, data: bytes, ctx: Context) -> Parsed:
    """Text of a web page without its scripts, styles and marks."""
    import html as entities

    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", data.decode("utf-8", "replace"))
    text = re.sub(r"(?i)<(/?(p|div|h\d|li|tr|article|nav|section)\b[^>]*|br\s*/?)>", "\n", text)
    lines = (re.sub(r"\s+", " ", x).strip() for x in entities.unescape(re.sub(r"<[^>]*>", "", text)).split("\n"))
    out = "\n".join(x for x in lines if x)
    return Parsed(out, [out])


PARSERS: dict[str, Callable[[str, bytes, Context], Parsed]] = {
    "docx": docx, "xlsx": xlsx, "vsdx": vsdx, "pdf": pdf, "zip": archive, "rar": archive, "dxf": dxf, "csv": xls, "doc": doc, "xls": xls, "ppt": ppt, "pptx": pptx,
} | {e: image for e in EXTENSIONS if FILE_TYPES[e] == "image"}
UPLOADS = PARSERS | {e: plain for e in PLAIN_EXTENSIONS}


def is_source(base: str, extensions: tuple[str, ...] = EXTENSIONS) -> bool:
    """Whether a file is read: a known extension and no name of a temporary file."""
    return not base.startswith((".~", "~$")) and extension(base) in extensions


def parse(name: str, data: bytes, ctx: Context | None = None, parsers: dict | None = None) -> Parsed:
    kind = extension(name)
    known = parsers or PARSERS
    if kind not in known:
        raise ValueError(f"no parser for .{kind}")
    return known[kind](name, data, ctx or Context())


def needs_ocr(name: str, data: bytes, pdf_pages: Callable[[bytes], list[str]] | None) -> bool:
    """Images do; a PDF does if fewer than 0.3 of its first 20 pages have text; others and unreadable ones do not."""
    kind = extension(name)
    if FILE_TYPES.get(kind) == "image":
        return True
    if kind != "pdf" or pdf_pages is None:
        return False
    try:
        pages = pdf_pages(data)[:20]
    except Exception:  # unreadable: let the parser report it
        return False
    return sum(bool(p and p.strip()) for p in pages) < 0.3 * len(pages)


def ocr_batches(n_pages: int) -> tuple[int, int]:
    """Pages of a batch and resolution for a document of that many pages."""
    return (50, 100) if n_pages <= 50 else (20, 100) if n_pages <= 200 else (10, 72)
