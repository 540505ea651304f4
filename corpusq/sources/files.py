"""Files as DataFrames: scan a folder, parse its files, read plain uploads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import basename, extension, file_type, format_size
from corpusq.settings import EXTENSIONS, OCR_SECONDS, PARSE_SECONDS, PLAIN_EXTENSIONS
from corpusq.sources import parsers
from corpusq.sources.limits import CallFailed, Limited, OutOfTime

PARSED = "file_path string, file_name string, file_type string, content string, pages array<string>, metadata map<string,string>, hash string, error string"


def scan_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, name, ext, size, size_str, modified, content of the files below ``path`` that have a parser.

    The bytes are read only where ``content`` is used.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = basename(F.col("path"))
    return (
        raw.withColumn("name", name).withColumn("ext", extension(F.col("path")))
        .filter(F.col("ext").isin(*extensions) & ~F.col("name").startswith(".~") & ~F.col("name").startswith("~$"))
        .select("path", "name", "ext", F.col("length").alias("size"), format_size(F.col("length")).alias("size_str"), F.col("modificationTime").alias("modified"), "content")
    )


def parse_files(files: DataFrame, context: parsers.Context | None = None, known: dict | None = None, seconds: tuple[float, float] | None = (PARSE_SECONDS, OCR_SECONDS)) -> DataFrame:
    """Parsed documents of (path, content); a file that cannot be parsed has an ``error`` and no content.

    A file is given ``seconds``, the second figure if it is a picture or a PDF, in a child process of the
    worker; one that hangs or ends its process is an error and costs no other file.  With None there is no limit and no child.
    """
    ctx, table = context or parsers.Context(), known or parsers.PARSERS

    def one(name: str, content: bytes) -> tuple:
        got = parsers.parse(name, content, ctx, table)
        return got and (got.content, got.pages, got.metadata)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limited = Limited(one)
        try:
            for pdf in batches:
                out = []
                for path, content, digest, kind in zip(pdf["path"], pdf["content"], pdf["hash"], pdf["kind"]):
                    name = path.replace("\\", "/").rsplit("/", 1)[-1]
                    try:
                        if seconds is None:
                            got, error = one(name, content), None
                        else:
                            got, error = limited(seconds[kind in ("image", "pdf")], name, content), None
                    except OutOfTime as e:
                        got, error = None, f"timeout: {e}"
                    except Exception as e:  # one bad file must not end the job
                        got, error = None, (str(e) if isinstance(e, CallFailed) else f"{type(e).__name__}: {e}")[:500]
                    out.append((path, name, kind, *(got or (None, None, None)), digest, error))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])
        finally:
            limited.close()

    rows = files.select("path", "content", F.md5("content").alias("hash"), file_type(F.col("path")).alias("kind"))
    return rows.mapInPandas(run, PARSED)


def needs_ocr(files: DataFrame, context: parsers.Context) -> DataFrame:
    """``files`` with ``ocr``: whether text has to be read from pictures."""
    pdf_pages = context.pdf_pages

    def each(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([parsers.needs_ocr(n, c, pdf_pages) for n, c in zip(names, contents)], dtype=bool)

    return files.withColumn("ocr", F.pandas_udf(each, "boolean")(basename(F.col("path")), F.col("content")))


def routed(files: DataFrame, context: parsers.Context) -> tuple[DataFrame, DataFrame]:
    """Files to parse at once, and files that go through OCR."""
    marked = needs_ocr(files, context)
    return marked.filter("not ocr").drop("ocr"), marked.filter("ocr").drop("ocr")


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """path, text of plain-text files, each as one row."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.filter(extension(F.col("path")).isin(*PLAIN_EXTENSIONS))


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``: what their HTML shows."""

    def each(col: pd.Series) -> pd.Series:
        return col.map(lambda h: parsers.html("page.html", (h or "").encode(), parsers.Context()).content)

    return pages.withColumn("text", F.pandas_udf(each, "string")(F.col(html)))


def test_file(spark: SparkSession, path: str, context: parsers.Context | None = None, lossless: bool = True) -> DataFrame:
    """file_name, chars, chunks, preview of one file, parsed and chunked."""
    from corpusq.operators.chunk import chunk_documents

    parsed = parse_files(spark.read.format("binaryFile").load(path), context)
    n = chunk_documents(parsed, lossless=lossless).groupBy("source_file").agg(F.count("*").alias("chunks"))
    return parsed.join(n, F.col("file_path") == F.col("source_file"), "left").select("file_name", F.length("content").alias("chars"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.substring("content", 1, 500).alias("preview"), "error")
