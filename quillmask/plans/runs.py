"""Runs that can be stopped and taken up again: documents are worked on in portions, and a ledger says which are finished.

A portion is one Spark job under a tag of the run. Its results are written to a folder of their own first; one row of the ledger
then makes them count, so what a stopped or failed portion has written is never read. A run that is taken up again leaves out all
documents that the ledger names and does the rest; results are the same as those of a run that was not stopped, as documents are
independent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "portion string, n_documents long, finished_at timestamp"


@dataclass
class Progress:
    """What one call of work() did: documents that it finished, those that were finished before, all, and whether it was stopped."""

    finished: int
    before: int
    total: int
    cancelled: bool


class Run:
    """A run in a folder that all executors share; the folder's name is the run's."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tag = f"quillmask-{uuid.uuid5(uuid.NAMESPACE_URL, self.folder).hex[:12]}"
        self.stopped = False

    def _path(self, what: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _finished_portions(self) -> list[str]:
        p, fs = self._path("ledger")
        if not fs.exists(p):
            return []
        return sorted(r.portion for r in self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger").select("portion").distinct().collect())

    def results(self, schema: str) -> DataFrame:
        """Rows of all finished portions; none before the first."""
        paths = [f"{self.folder}/results/{p}" for p in self._finished_portions()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def finished(self) -> DataFrame:
        """(doc_id) of documents that need not be done again."""
        paths = [f"{self.folder}/documents/{p}" for p in self._finished_portions()]
        return self.spark.read.schema("doc_id string").parquet(*paths) if paths else self.spark.createDataFrame([], "doc_id string")

    def stop(self) -> None:
        """Ends the portion that is being worked on, from any thread, and the run with it. The run can be taken up again."""
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def work(self, documents: DataFrame, process: Callable[[DataFrame], DataFrame], portion: int = 100_000, should_stop: Callable[[], bool] = lambda: False) -> Progress:
        """Does process (documents, a row each and told apart by doc_id, to results) to what is left of documents, about so many at a time.
        should_stop is asked between portions; stop() also ends one that is under way, which then leaves nothing.

        Null ids are an error. An empty table is finished at once. A portion that fails raises its error, and the
        portions before it stay finished."""
        if not documents.where("doc_id is null").isEmpty():
            raise ValueError("documents need an id")
        left = documents.join(self.finished(), "doc_id", "left_anti")
        total, rest = documents.count(), left.count()
        n = -(-rest // portion)
        dealt = left.withColumn("_portion", F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))))
        done = 0
        self.stopped = False
        for i in range(n):
            if self.stopped or should_stop():
                return Progress(done, total - rest, total, True)
            name = uuid.uuid4().hex
            some = dealt.where(F.col("_portion") == i).drop("_portion")
            self.spark.sparkContext.addJobTag(self.tag)
            try:
                process(some).write.parquet(f"{self.folder}/results/{name}")
                some.select(F.col("doc_id").cast("string").alias("doc_id")).write.parquet(f"{self.folder}/documents/{name}")
                n_done = self.spark.read.parquet(f"{self.folder}/documents/{name}").count()
            except Exception:
                self._drop(name)
                if self.stopped:
                    return Progress(done, total - rest, total, True)
                raise
            finally:
                self.spark.sparkContext.removeJobTag(self.tag)
            # from here on the portion counts
            self.spark.createDataFrame([(name, n_done)], "portion string, n_documents long").withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
            done += n_done
        return Progress(done, total - rest, total, False)

    def _drop(self, name: str) -> None:
        for what in ("results", "documents"):
            p, fs = self._path(f"{what}/{name}")
            fs.delete(p, True)

    def sweep(self) -> int:
        """Deletes what portions that never finished have written (after a lost driver), and says how many there were."""
        kept, gone = set(self._finished_portions()), set()
        for what in ("results", "documents"):
            p, fs = self._path(what)
            if fs.exists(p):
                gone |= {s.getPath().getName() for s in fs.listStatus(p)} - kept
        for name in gone:
            self._drop(name)
        return len(gone)
