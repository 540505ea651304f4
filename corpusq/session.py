"""What operators need of the session: the shared folder, and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only a local session that
    sets none (tests) gets a temporary folder, made once per session.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="corpusq-")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage by a reliable checkpoint.

    Spark deletes shuffle files when their handles on the driver are collected
    as garbage, which a large idle heap puts off; so it is asked to collect now.
    """
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    df.sparkSession._jvm.System.gc()
    return done


def kept(df: DataFrame) -> DataFrame:
    """As ``cut``, in Parquet below the shared folder: for long tables of short rows a small part of a checkpoint's bytes."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written at ``path`` yet."""
    try:
        spark.read.schema("_ int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_or_empty(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """The Parquet table at ``path``, without rows if nothing has been written there yet."""
    return spark.read.options(**options).schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
