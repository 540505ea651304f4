"""Ingest status: duplicates, states of files, failures, manifest, profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.functions.text import basename
from corpusq.session import read_or_empty

STATES = ("pending", "parsing", "parsed", "embedding", "embedded", "duplicate", "error", "cancelling", "cancelled")
UNFINISHED = ("pending", "parsing", "parsed", "embedding")


def dedup(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """``files`` (pos, path, hash) with ``verdict``: new, changed, duplicate_of_indexed or duplicate_in_batch.

    A hash in the manifest under the same path is the file itself, ``unchanged``; a path of the
    manifest with another hash is ``changed`` and indexed again.  A null hash (unreadable) is new.
    """
    first = Window.partitionBy("hash").orderBy("pos")
    out = files.withColumn("_n", F.row_number().over(first))
    if manifest is None:
        known = F.lit(False)
        out = out.withColumn("_old", F.lit(None).cast("string")).withColumn("_same", F.lit(False))
    else:
        out = out.join(manifest.groupBy(F.col("path").alias("_p")).agg(F.max("hash").alias("_old")), F.col("path") == F.col("_p"), "left")
        out = out.join(manifest.select(F.col("hash").alias("_h")).distinct(), F.col("hash") == F.col("_h"), "left").withColumn("_same", F.col("_h").isNotNull())
        known = F.col("_same")
    verdict = (
        F.when(F.col("hash").isNull(), "new").when(F.col("_old") == F.col("hash"), "unchanged").when(known, "duplicate_of_indexed")
        .when(F.col("_n") > 1, "duplicate_in_batch").when(F.col("_old").isNotNull(), "changed").otherwise("new")
    )
    return out.withColumn("verdict", verdict).select(*files.columns, "verdict")


def current_status(events: DataFrame) -> DataFrame:
    """path, status, error: the last event (seq, path, status, error) of every file."""
    return events.groupBy("path").agg(F.max_by("status", "seq").alias("status"), F.max_by("error", "seq").alias("error"))


def dedupe_errors(errors: DataFrame) -> DataFrame:
    """First of errors with one (type, path, file, first 100 characters of message), in order of pos."""
    key = Window.partitionBy("type", "path", "file", F.substring("message", 1, 100)).orderBy("pos")
    return errors.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n").orderBy("pos")


def failed_groups(status: DataFrame, errors: DataFrame) -> DataFrame:
    """``status`` rows that did not end well, with ``group``: parse_error, embed_error, duplicate or cancelled.

    An error goes by the type of the path's first error; unfinished files are parse errors,
    reported incomplete.
    """
    first = errors.groupBy("path").agg(F.min_by("type", "pos").alias("first_type"))
    s = F.col("status")
    group = (
        F.when(s == "error", F.when(F.col("first_type") == "embed_error", "embed_error").otherwise("parse_error")).when(s == "duplicate", "duplicate")
        .when(s.isin("cancelled", "cancelling"), "cancelled").when(s.isin(*UNFINISHED), "parse_error")
    )
    joined = status.join(first, "path", "left").withColumn("group", group).filter(F.col("group").isNotNull())
    return joined.withColumn("error", F.when(s.isin(*UNFINISHED), "incomplete").otherwise(F.col("error"))).select("group", *status.columns)


def merge_manifest(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest with the embedded files of ``done`` (path, hash, status, indexed_at) added or replaced."""
    new = done.filter("status = 'embedded'").select("path", "hash", "indexed_at")
    return manifest.join(new.select("path"), "path", "left_anti").select("path", "hash", "indexed_at").unionByName(new)


def normal_path(name: str = "path"):
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"\\", "/"), r"/+(\./)*", "/"))


def remove_paths(table: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``table`` whose path, normalised, is not among ``paths``."""
    gone = paths.select(normal_path("path").alias("_p")).distinct()
    return table.join(gone, normal_path(key) == gone["_p"], "left_anti")


def paths_of(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """source_file: the files that the paths of ``wanted`` name, both kinds of slashes being one.

    If none of the paths is that of a file, they go by basename; of files with one basename the last path counts.
    """
    slashed = lambda c: F.regexp_replace(c, r"\\", "/")
    known = files.select("source_file").distinct()
    exact = known.join(wanted.select(slashed("path").alias("_p")).distinct(), slashed("source_file") == F.col("_p"), "left_semi")
    if not exact.isEmpty():
        return exact
    last = known.groupBy(basename(F.col("source_file")).alias("_n")).agg(F.max("source_file").alias("source_file"))
    return last.join(wanted.select(basename(F.col("path")).alias("_n")).distinct(), "_n", "left_semi").select("source_file")


#: What ``ingest`` says of a file of which a chunk has no vector.
EMBED_FAILED = "embedding failed"
FAILED = "group string, name string, path string, status string, error string"


@dataclass
class FailedFiles:
    """Failed files as a table that is only appended to: those of the last run saved, those added since, less what was retried with success."""

    spark: SparkSession
    base: str

    def _rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.base, f"seq int, kind string, {FAILED}", recursiveFileLookup=True)

    def _append(self, rows: DataFrame, kind: str) -> None:
        seq = (self._rows().agg(F.max("seq")).first()[0] or 0) + 1
        names = [c.split()[0] for c in FAILED.split(", ")]
        given = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names]
        # a save without rows has to be known too
        none = self.spark.createDataFrame([(seq, "none")], "seq int, kind string")
        rows.select(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), *given).unionByName(none.withColumn("kind", F.lit(f"{kind} ends")), True).write.mode("append").parquet(self.base)

    def save(self, failed: DataFrame) -> None:
        """``failed`` (rows of ``failed_groups``, with name) takes the place of what was saved before."""
        self._append(failed, "save")

    def add(self, failed: DataFrame) -> None:
        """``failed`` joins what was saved; of a path that is there already the new row counts."""
        self._append(failed, "add")

    def remove(self, paths: DataFrame) -> None:
        self._append(paths.select("path"), "gone")

    def load(self) -> DataFrame:
        rows = self._rows()
        start = rows.filter("kind = 'save ends'").agg(F.max("seq")).first()[0] or 0
        since = rows.filter((F.col("seq") >= start) & F.col("kind").isin("save", "add", "gone")).withColumn("_p", normal_path("path"))
        last = since.groupBy("_p").agg(F.max("seq").alias("_last"))
        held = since.join(last, "_p").filter((F.col("seq") == F.col("_last")) & (F.col("kind") != "gone"))
        return held.drop("_p", "_last", "seq", "kind")


def failed_of(state: DataFrame) -> DataFrame:
    """Rows of ``failed_groups`` of a run's ``state`` (path, status, error)."""
    kind = F.when(F.col("error") == EMBED_FAILED, "embed_error").otherwise("parse_error")
    errors = state.filter("status = 'error'").select(F.lit(0).alias("pos"), "path", kind.alias("type"))
    return failed_groups(state.select("path", basename(F.col("path")).alias("name"), "status", "error"), errors)


def profile(timings: DataFrame, slowest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Totals of (path, chunks, ms), and the slowest files."""
    total = timings.agg(F.sum("ms").alias("total_ms"), F.sum("chunks").alias("chunks"), F.try_divide(F.sum("ms"), F.sum("chunks")).alias("ms_per_chunk"))
    return total, timings.orderBy(F.desc("ms"), "path").limit(slowest)


def ok_summary(results: DataFrame) -> DataFrame:
    """ok, total of rows with a boolean ``ok``."""
    return results.agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"))
