"""Ingest: scan, drop duplicates, parse, chunk, embed, store; batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import basename, extension, file_type, tagged_text
from corpusq.operators import status
from corpusq.operators.chunk import chunk_documents
from corpusq.operators.status import FailedFiles
from corpusq.operators.store import ChunkStore
from corpusq.session import cut
from corpusq.settings import EMBED_ATTEMPTS, EMBED_BATCH, EMBED_CHARS, OCR_SECONDS
from corpusq.sources.files import PARSED, parse_files, routed, scan_directory
from corpusq.sources.limits import CallFailed, Limited
from corpusq.sources.parsers import Context, ocr_batches

MANIFEST = "path string, hash string, indexed_at double"
#: Codes of an embedding service for texts too long, and for one that is worth asking again.
TOO_LONG = 413
BUSY = (429, 500, 502, 503)


def _patient(embed: Callable[[list[str]], list], texts: list[str], attempts: int, sleep: Callable[[float], None]) -> list:
    """The vectors of ``texts``.  Raises what ``embed`` raises in the end.

    Texts that are too long (413) are sent once more, each cut to half.  After a
    busy or failing service (429, 500, 502, 503) or any failure without a code the same texts are sent again, 1, 2, ...
    seconds later, ``attempts`` times in all; any other code is final.
    """
    for attempt in range(attempts):
        try:
            return embed(texts)
        except Exception as e:  # the service's own errors
            code = getattr(e, "code", None)
            if code == TOO_LONG:
                return embed([t[: len(t) // 2] for t in texts])
            if attempt == attempts - 1 or isinstance(code, int) and code not in BUSY:
                raise
            sleep(2.0**attempt)
    return []


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], attempts: int = EMBED_ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Add ``vector``: texts cut to 3000 characters go to ``embed`` 20 at a time, as ``_patient`` says; null where it fails in the end."""

    def each(texts: pd.Series) -> pd.Series:
        out: list = []
        values = [t[:EMBED_CHARS] for t in texts.fillna("")]
        for i in range(0, len(values), EMBED_BATCH):
            part = values[i: i + EMBED_BATCH]
            try:
                got = list(_patient(embed, part, attempts, sleep))
            except Exception:  # the service's own errors: these chunks have no vector
                got = []
            out += got if len(got) == len(part) else [None] * len(part)
        return pd.Series(out, dtype=object)

    return chunks.withColumn("vector", F.pandas_udf(each, "array<float>")(F.col("text")))


def ingest(
    spark: SparkSession, source: str | DataFrame, store: ChunkStore, embed: Callable[[list[str]], list], manifest: DataFrame | None = None, context: Context | None = None, indexed_at: float = 0.0,
    lossless: bool = True, replaced: DataFrame | None = None, cancelled: DataFrame | None = None, failed: FailedFiles | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Index what is new or changed below a folder; the manifest afterwards, and the status of every file.

    Files already indexed under their path are passed over by hash, so a run
    that was broken off continues where it stopped.  Long chunks go on in
    further chunks; with ``lossless=False`` their rest is dropped.  Chunks of changed files, and of the
    files ``replaced``, go in the version that brings the new ones, and stay if a file cannot be read now.
    Files of ``cancelled`` (path) that would be indexed are left alone and have that status.
    What did not end well takes the place of what ``failed`` holds, or, for files ``replaced``, what ended well leaves it.
    """
    files = scan_directory(spark, source) if isinstance(source, str) else source
    listed = files.select("path", F.md5("content").alias("hash"))
    numbered = listed.withColumn("pos", F.col("path"))
    judged = cut(status.dedup(numbered, manifest).select("path", "hash", "verdict"))
    wanted = judged.filter(F.col("verdict").isin("new", "changed"))
    if cancelled is not None:
        kept = status.remove_paths(wanted, cancelled)
        judged = cut(judged.join(wanted.join(kept.select("path"), "path", "left_anti").select("path", F.lit("cancelled").alias("_off")), "path", "left").select("path", "hash", F.coalesce("_off", "verdict").alias("verdict")))
        wanted = judged.filter(F.col("verdict").isin("new", "changed"))
    parsed = cut(parsed_or_read(files.join(wanted.select("path"), "path", "left_semi"), context))
    chunks = cut(embed_chunks(chunk_documents(parsed.filter("error is null"), lossless=lossless).drop("page"), embed))
    changed = judged.filter("verdict = 'changed'").select("path")
    changed = changed if replaced is None else changed.unionByName(replaced.select(F.col(replaced.columns[0]).alias("path")))
    changed = cut(changed.join(parsed.filter("error is null").select(F.col("file_path").alias("path")), "path", "left_semi").distinct())
    if not chunks.isEmpty() or not changed.isEmpty():
        store.upsert(chunks, changed)
    per = chunks.groupBy("source_file").agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"))
    state = (
        judged.join(parsed.select(F.col("file_path").alias("path"), "error"), "path", "left").join(per, F.col("path") == F.col("source_file"), "left")
        .select(
            "path", "hash",
            F.when(F.col("verdict").startswith("duplicate"), "duplicate").when(F.col("verdict") == "unchanged", "embedded").when(F.col("verdict") == "cancelled", "cancelled").when(F.col("error").isNotNull(), "error")
            .when(F.col("chunks").isNull(), "parsed").when(F.col("vectors") < F.col("chunks"), "error").otherwise("embedded").alias("status"),
            F.coalesce("error", F.when(F.col("vectors") < F.col("chunks"), status.EMBED_FAILED)).alias("error"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
        )
    )
    if failed is not None and replaced is None:
        failed.save(status.failed_of(state))
    elif failed is not None:
        failed.add(status.failed_of(state))
        failed.remove(state.filter("status = 'embedded'"))
    done = state.filter("status = 'embedded'").withColumn("indexed_at", F.lit(indexed_at))
    known = manifest if manifest is not None else spark.createDataFrame([], MANIFEST)
    return status.merge_manifest(known, done), state


def retry_file(spark: SparkSession, path: str, store: ChunkStore, embed: Callable[[list[str]], list], manifest: DataFrame, context: Context | None = None, lossless: bool = True, failed: FailedFiles | None = None) -> tuple[DataFrame, DataFrame]:
    """Index a file again in place of its chunks; manifest and status.  With success it leaves ``failed``."""
    one = spark.createDataFrame([(path,)], "path string")
    return ingest(spark, scan_directory(spark, path), store, embed, status.remove_paths(manifest, one), context, lossless=lossless, replaced=one, failed=failed)


def ocr_documents(files: DataFrame, context: Context, seconds: float = OCR_SECONDS) -> DataFrame:
    """Documents as of ``parse_files`` of scanned PDFs, read by batches of pages of ``seconds`` each; one that fails makes the file an error, so that no text is lost unseen."""
    pages = context.pdf_pages

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Limited(context.ocr_pages)
        try:
            yield from map(partial(batches_of, read), pdfs)
        finally:
            read.close()

    def batches_of(read: Limited, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            n = len(pages(content))
            step, dpi = ocr_batches(n)
            for first in range(0, n, step):
                try:
                    rows.append((path, first, read(seconds, content, first, min(first + step, n), dpi), None))
                except Exception as e:  # whatever the service raises; one file must not end the job
                    rows.append((path, first, None, f"OCR from page {first + 1}: {e if isinstance(e, CallFailed) else f'{type(e).__name__}: {e}'}"[:500]))
        return pd.DataFrame(rows, columns=["path", "first_page", "text", "error"])

    batches = cut(files.select("path", "content").mapInPandas(run, "path string, first_page int, text string, error string").withColumn("text", tagged_text(F.col("text"))))  # the service is not asked again
    texts = merged_ocr(batches.filter("text <> ''")).join(batches.groupBy("path").agg(F.min("error").alias("_failed")), "path", "full")
    known = files.select("path", F.md5("content").alias("hash")).join(texts, "path", "left")
    error = F.coalesce("_failed", F.when(F.col("content").isNull(), "OCR found no text"))
    path = F.col("path")
    return known.select(
        path.alias("file_path"), basename(path).alias("file_name"), file_type(path).alias("file_type"), F.when(error.isNull(), F.col("content")).alias("content"), F.when(error.isNull(), F.array("content")).alias("pages"),
        F.create_map(F.lit("ocr"), F.lit("true")).alias("metadata"), "hash", error.alias("error"))


def parsed_or_read(files: DataFrame, context: Context | None = None) -> DataFrame:
    """``parse_files``, with scanned PDFs read by batches of pages where ``context`` has functions for it."""
    if context is None or context.skip_ocr or context.ocr_pages is None or context.pdf_pages is None:
        return parse_files(files, context)
    fast, slow = routed(files, context)
    is_pdf = extension(F.col("path")) == "pdf"
    names = [c.split()[0] for c in PARSED.split(", ")]
    return parse_files(fast.unionByName(slow.filter(~is_pdf)), context).unionByName(ocr_documents(slow.filter(is_pdf), context).select(*names))


def merged_ocr(batches: DataFrame) -> DataFrame:
    """path, content: OCR results (path, first_page, text) of page batches joined in order of pages."""
    return batches.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_page", "text"))), lambda x: x["text"]), "\n\n").alias("content"))

