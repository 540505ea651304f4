"""Chunking of parsed documents, and pages of chunks.

The fold over paragraphs is sequential, so it runs document by document in
Python workers over Arrow batches; everything around it is columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from corpusq.settings import CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_SIZE

#: Documents and chunks that a Python worker holds at once; a batch is closed by bytes too.
BATCH_ROWS = 200
BATCH_BYTES = 16 << 20
SCHEMA = "chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long, metadata string, page int"


def estimate(text: str) -> int:
    """As ``functions.text.chunk_tokens``."""
    letters = re.findall("[a-zA-Z]+", text)
    cjk = len(re.findall("[一-鿿]", text))
    return int(2.5 * cjk + 2.0 * len(letters) + (len(text) - cjk - sum(map(len, letters))))


def split_long(paragraph: str, chars: int = CHUNK_CHARS) -> list[str]:
    """Pieces of a paragraph that is too long: ten sentences each, or lines packed up to ``chars``.

    Sentences end at 。！？!? only; line ends do not count towards ``chars`` and a line is never cut.
    """
    sentences = [s for s in (p.strip() for p in re.split("(?<=[。！？!?])", paragraph)) if s]
    if len(sentences) > 1:
        return ["".join(sentences[i: i + 10]) for i in range(0, len(sentences), 10)]
    packed: list[list[str]] = []
    room = 0
    for line in filter(None, map(str.strip, paragraph.split("\n"))):
        if not packed or len(line) > room and packed[-1]:
            packed.append([])
            room = chars
        packed[-1].append(line)
        room -= len(line)
    return ["\n".join(lines) for lines in packed]


def fold(content: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Paragraphs packed into chunks of about ``size`` tokens; each chunk starts with the last paragraphs of the one before, up to ``overlap``."""
    chunks: list[str] = []
    held: list[tuple[str, int]] = []

    def flush() -> None:
        chunks.append("\n\n".join(p for p, _ in held))
        keep, total = len(held), 0
        while keep and total + held[keep - 1][1] <= overlap:
            keep -= 1
            total += held[keep][1]
        del held[:keep]

    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", content))):
        for piece in split_long(paragraph) if estimate(paragraph) > size else [paragraph]:
            n = estimate(piece)
            if held and sum(t for _, t in held) + n > size:
                flush()
            held.append((piece, n))
    if held:
        chunks.append("\n\n".join(p for p, _ in held))
    return chunks


def cap(chunk: str, chars: int = CHUNK_CHARS, lossless: bool = False) -> list[str]:
    """A chunk cut to ``chars`` at its last line end; the rest is dropped, or follows as further chunks."""
    out = []
    while len(chunk) > chars:
        at = chunk.rfind("\n", 0, chars)
        at = at if at > 0 else chars
        out.append(chunk[:at])
        if not lossless:
            return out
        chunk = chunk[at:].lstrip("\n")
    return [*out, chunk] if chunk else out


def page_of(text: str, pages: list[str]) -> int | None:
    """Number of the page with most of the 3-character pieces of the first 200 characters, more than 0.3 of them."""
    if len(pages) < 2:
        return None
    grams = lambda t: {t[i: i + 3] for i in range(len(t) - 2)}
    start = grams(text[:200])
    if not start:
        return None
    shares = [len(start & grams(p or "")) / len(start) for p in pages]
    best = max(range(len(pages)), key=lambda i: (shares[i], -i))
    return best + 1 if shares[best] > 0.3 else None


def chunk_one(content: str | None, pages: list[str] | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, lossless: bool = False) -> list[tuple[str, int | None]]:
    """(text, page) of every chunk; none for a blank text."""
    if not (content or "").strip():
        return []
    parts = [t for c in fold(content, size, overlap) for t in cap(c, lossless=lossless)]
    return [(t.strip(), page_of(t, list(pages) if pages is not None else [])) for t in parts or [content[:CHUNK_CHARS]]]


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, lossless: bool = False) -> DataFrame:
    """Chunks of documents (file_path, file_type, content, pages, metadata map).

    ``chunk_id`` is a digest of path, index and text, so a rerun gives the same ids.
    """

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page": "Int32"})
        for pdf in batches:
            out = []
            for path, kind, content, pages, meta in zip(pdf["file_path"], pdf["file_type"], pdf["content"], pdf["pages"], pdf["metadata"]):
                parts = chunk_one(content, pages, size, overlap, lossless)
                known = dict(meta) if meta is not None else {}
                for i, (text, page) in enumerate(parts):
                    digest = hashlib.sha256(f"{path}\0{i}\0{text}".encode()).hexdigest()
                    data = ({"page": page} if page else {}) | known
                    out.append((digest, text, path, kind, i, len(parts), json.dumps(data, ensure_ascii=False, sort_keys=True), page))
                    if len(out) == BATCH_ROWS:
                        yield frame(out)
                        out = []
            yield frame(out)

    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return docs.select("file_path", "file_type", "content", "pages", "metadata").mapInPandas(run, SCHEMA)
