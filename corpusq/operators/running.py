"""Work that can be stopped while it runs: every Spark job it starts bears a tag, by which it is interrupted."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


#: Whether Spark interrupts the threads of tasks that are cancelled.
INTERRUPT = "spark.sql.execution.interruptOnCancel"


class Stopped(RuntimeError):
    """The work was stopped before it ended."""


class Running:
    """``work`` begun in a thread of its own, such as ``Running(spark, lambda: ingest(...))``.

    ``stop`` interrupts the jobs that run and lets no further one begin; what the
    work had not committed by then, such as the version of a store that an ingest was going to write, does not come to be.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], Any]):
        self.spark, self.tag = spark, f"running-{uuid.uuid4().hex}"
        self.stopped = threading.Event()
        self._result: Any = None
        self._error: BaseException | None = None

        def run() -> None:
            spark.sparkContext.addJobTag(self.tag)
            # a task that is interrupted leaves a closed channel to its Python worker behind; one that is only told to stop has its worker killed
            before = spark.conf.get(INTERRUPT, None)
            spark.conf.set(INTERRUPT, "false")
            try:
                self._result = work()
            except BaseException as e:  # told to whoever asks for the result
                self._error = e
            finally:
                spark.conf.unset(INTERRUPT) if before is None else spark.conf.set(INTERRUPT, before)
                spark.sparkContext.removeJobTag(self.tag)

        self.thread = threading.Thread(target=inheritable_thread_target(spark)(run), name=self.tag, daemon=True)
        self.thread.start()

    def stop(self) -> None:
        """Interrupt until the thread has ended: a job may just be between two others."""
        self.stopped.set()
        while self.thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self.thread.join(0.2)

    def result(self, seconds: float | None = None) -> Any:
        """What the work returned; raises what it raised, ``Stopped`` if that was for ``stop``, TimeoutError if it still runs."""
        self.thread.join(seconds)
        if self.thread.is_alive():
            raise TimeoutError(f"still running after {seconds} s")
        if self._error is not None and self.stopped.is_set():
            raise Stopped("stopped") from self._error
        if self._error is not None:
            raise self._error
        return self._result
