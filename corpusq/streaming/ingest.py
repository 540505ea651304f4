"""Files as a stream: every micro-batch is one ingest into the store.

The stream's checkpoint remembers which files were seen; the store's
manifest, to which every batch adds its files, makes a repeated batch harmless.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpusq.functions.text import basename, extension, format_size
from corpusq.operators import status
from corpusq.operators.ingest import MANIFEST, ingest
from corpusq.operators.status import FailedFiles
from corpusq.operators.store import ChunkStore
from corpusq.settings import EXTENSIONS
from corpusq.sources.parsers import Context

#: The name of what is observed of the files of a batch.
OBSERVED = "files"
FILES = "path string, modificationTime timestamp, length long, content binary"


def read_manifest(store: ChunkStore) -> DataFrame:
    rows = store._read("manifest", MANIFEST)
    return rows.groupBy("path").agg(F.max_by(F.struct("hash", "indexed_at"), "seq").alias("m")).select("path", "m.hash", "m.indexed_at")


def write_manifest(store: ChunkStore, new: DataFrame) -> None:
    """Add or replace entries; a batch writes its own only."""
    store.commit(manifest=new.select("path", "hash", "indexed_at"))


def file_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(path)
    name = basename(F.col("path"))
    return (
        raw.withColumn("name", name).withColumn("ext", extension(F.col("path")))
        .filter(F.col("ext").isin(*EXTENSIONS) & ~F.col("name").startswith(".~") & ~F.col("name").startswith("~$"))
        .select("path", "name", "ext", F.col("length").alias("size"), format_size(F.col("length")).alias("size_str"), F.col("modificationTime").alias("modified"), "content")
        .observe(OBSERVED, F.count("*").alias("files"), F.sum("size").alias("bytes"))
    )


def ingest_stream(spark: SparkSession, path: str, store: ChunkStore, embed: Callable[[list[str]], list], checkpoint: str, context: Context | None = None, per_batch: int = 1000, available_now: bool = True, lossless: bool = True, cancelled: Callable[[], DataFrame | None] = lambda: None, failed: FailedFiles | None = None) -> StreamingQuery:
    """Start ingesting; ``lastProgress`` of the query is the progress, ``stop`` ends it between batches.

    ``cancelled`` is asked before every batch for the files (path) that are to be left alone.  Files that
    did not end well join ``failed``.
    """

    def batch(files: DataFrame, number: int) -> None:
        once = files.persist(StorageLevel.DISK_ONLY)  # read, and observed, once
        _, state = ingest(files.sparkSession, once, store, embed, read_manifest(store), context, float(number), lossless, cancelled=cancelled())
        if failed is not None:
            failed.add(status.failed_of(state))
        write_manifest(store, state.filter("status = 'embedded'").withColumn("indexed_at", F.lit(float(number))))
        once.unpersist()

    writer = file_stream(spark, path, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"ingest-{uuid.uuid4().hex[:8]}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


PROGRESS = "query string, run string, batch long, at timestamp, files long, bytes long, rows_per_second double, milliseconds long"


class ProgressTable(StreamingQueryListener):
    """Writes a row of ``PROGRESS`` below ``path`` for each batch of the queries whose name starts with ``prefix``.

    Files and bytes are what ``file_stream`` observes of a batch.  Rows are appended as JSON, one small file a batch.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: str = "ingest-"):
        self.spark, self.path, self.prefix = spark, path, prefix

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(OBSERVED)
        if p.name and p.name.startswith(self.prefix) and seen is not None and seen["files"]:
            row = (p.name, str(p.runId), p.batchId, p.timestamp, seen["files"], seen["bytes"] or 0, p.processedRowsPerSecond, p.batchDuration)
            rows = self.spark.createDataFrame([row], PROGRESS.replace("timestamp", "string"))
            rows.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def load(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(self.path)


def status_stream(events: DataFrame) -> DataFrame:
    """Running status of each file from a stream of events (seq, path, status)."""
    return events.groupBy("path").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("events"))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time, late ones up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
