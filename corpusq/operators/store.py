"""Chunk store: Parquet segments and deletes, and one commit record a version.

A change writes its data under names of its own and then one small record, created only
if no record of that version exists, that lists every segment and delete that holds from then
on.  Readers follow the newest complete record, so they see all of a change or none of it;
what a writer left that broke off before its record is never read, and of two writers of one
version the second is refused.  A change costs what it brings; ``compact``
rewrites, ``vacuum`` removes what no record needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.vectors import l2_normalize

COLUMNS = "rowid long, chunk_id string, text string, source_file string, file_type string, chunk_index long, total_chunks long, metadata string, vector array<float>"
DELETES = "kind string, key string"
RECORDS = "versions"
END = "\n#end\n"


@dataclass
class ChunkStore:
    spark: SparkSession
    base: str

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        """Versions that have a record, complete or not."""
        fs, p, _ = self._fs(f"{self.base}/{RECORDS}")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def _record(self, version: int | None = None) -> tuple[int, dict]:
        """The newest complete record up to ``version`` and its number; 0 and nothing without any."""
        for n in reversed(self._numbers()):
            if version is None or n <= version:
                fs, p, _ = self._fs(f"{self.base}/{RECORDS}/{n:012d}.json")
                stream = fs.open(p)
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                if text.endswith(END):
                    return n, json.loads(text.removesuffix(END))
        return 0, {}

    def version(self) -> int:
        return self._record()[0]

    def _put(self, df: DataFrame, part: str, seq: int) -> list:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.base}/{part}/seq={seq}/part={name}")
        return [seq, name]

    def _publish(self, seq: int, record: dict) -> int:
        fs, p, _ = self._fs(f"{self.base}/{RECORDS}/{seq:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:  # Hadoop says that the file exists
            raise OSError(f"version {seq} exists: another writer was first") from e
        out.write(bytearray((json.dumps(record) + END).encode()))
        out.close()
        return seq

    def commit(self, replace: bool = False, **parts: DataFrame) -> int:
        """Add rows to the named parts, in one version; ``replace`` leaves out what those parts held before."""
        at, record = self._record()
        seq = max([at, *self._numbers()]) + 1
        new = {part: [*([] if replace else record.get(part, [])), *([self._put(df, part, seq)] if df is not None else [])] for part, df in parts.items()}
        if self._record()[0] != at:
            raise OSError(f"version {seq} exists: another writer was first")
        return self._publish(seq, record | new)

    def _read(self, part: str, schema: str, version: int | None = None) -> DataFrame:
        listed = self._record(version)[1].get(part, [])
        if not listed:
            return self.spark.createDataFrame([], f"{schema}, seq long")
        paths = [f"{self.base}/{part}/seq={seq}/part={name}" for seq, name in listed]
        return self.spark.read.schema(f"{schema}, seq long, part string").option("basePath", f"{self.base}/{part}").parquet(*paths).drop("part")

    def load(self, version: int | None = None) -> DataFrame:
        """Chunks as of a version; the newest by default."""
        rows = self._read("segments", COLUMNS, version)
        gone = self._read("deletes", DELETES, version).groupBy("kind", "key").agg(F.max("seq").alias("dseq"))
        for kind, column in (("source", "source_file"), ("chunk", "chunk_id")):
            d = gone.filter(F.col("kind") == kind)
            rows = rows.join(d, (rows[column] == d["key"]) & (d["dseq"] > rows["seq"]), "left_anti")
        return rows.drop("seq")

    def upsert(self, chunks: DataFrame, replaced: DataFrame | None = None) -> int:
        """Add chunks (all columns but rowid), replacing equal chunk_ids and all chunks of the files ``replaced``, in one version.

        Vectors are scaled to length 1; all vectors of the store have one length.  Returns the version.
        """
        seq = max([0, *self._numbers()]) + 1
        dims = [r[0] for r in chunks.filter("vector is not null").select(F.size("vector")).distinct().limit(2).collect()]
        known = [r[0] for r in self._read("segments", COLUMNS).filter("vector is not null").select(F.size("vector")).limit(1).collect()]
        if len(set(dims + known)) > 1:
            raise ValueError(f"vectors of several lengths: {sorted(set(dims + known))}")
        # versions come one after the other, so the version and a number within it order rows by insertion
        rowid = F.lit(seq << 50) + F.monotonically_increasing_id()
        new = chunks.dropDuplicates(["chunk_id"]).orderBy("source_file", "chunk_index").withColumn("rowid", rowid).withColumn("vector", l2_normalize(F.col("vector")).cast("array<float>"))
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        gone = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"))
        if replaced is not None:
            gone = gone.unionByName(replaced.select(F.lit("source").alias("kind"), F.col(replaced.columns[0]).alias("key")))
        # deletes count for older segments only
        return self.commit(deletes=gone.distinct(), segments=new.select(*names))

    def delete_sources(self, paths: list[str] | DataFrame) -> int:
        """Remove the chunks of files; the version."""
        df = paths.select(F.col(paths.columns[0]).alias("key")) if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "key string")
        return self.commit(deletes=df.select(F.lit("source").alias("kind"), "key").distinct())

    def compact(self) -> int:
        """Write what is live as one segment; older versions stay readable until ``vacuum``."""
        return self.commit(replace=True, segments=self.load(), deletes=None)

    def vacuum(self) -> None:
        """Remove older records, and data that the newest one does not list."""
        at, record = self._record()
        fs, _, path = self._fs(self.base)
        for n in self._numbers():
            if n < at:
                fs.delete(path(f"{self.base}/{RECORDS}/{n:012d}.json"), False)
        for part in ("segments", "deletes", "manifest"):
            kept = {f"seq={seq}/part={name}" for seq, name in record.get(part, [])}
            for found in fs.globStatus(path(f"{self.base}/{part}/seq=*/part=*")) or []:
                if "/".join(found.getPath().toString().split("/")[-2:]) not in kept:
                    fs.delete(found.getPath(), True)

    def clear(self) -> None:
        fs, p, _ = self._fs(self.base)
        fs.delete(p, True)

    def status(self) -> dict:
        rows = self.load()
        got = rows.agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"), F.countDistinct("source_file").alias("files")).first()
        return got.asDict() | {"version": self.version()}


@dataclass
class Libraries:
    """Named stores below one folder; names differ in more than case."""

    spark: SparkSession
    root: str

    def _marker(self, name: str) -> ChunkStore:
        return ChunkStore(self.spark, f"{self.root}/{name}")

    def names(self) -> list[str]:
        fs, p, _ = self._marker("")._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def find(self, name: str) -> str | None:
        return next((n for n in self.names() if n.lower() == name.strip().lower()), None)

    def create(self, name: str) -> ChunkStore:
        name = name.strip()
        if not name or name in (".", "..") or "/" in name or "\\" in name:
            raise ValueError("not a name for a library")
        if self.find(name):
            raise ValueError("a library of that name exists")
        store = self._marker(name)
        fs, p, _ = store._fs(store.base)
        fs.mkdirs(p)
        return store

    def delete(self, name: str) -> None:
        found = self.find(name)
        if found is None:
            raise KeyError(name)
        if len(self.names()) < 2:
            raise ValueError("the last library stays")
        self._marker(found).clear()

    def open(self, name: str | None = None) -> ChunkStore:
        """The library of that name, the first one without a name."""
        found = self.find(name) if name else next(iter(self.names()), None)
        if found is None:
            raise KeyError(name)
        return self._marker(found)
