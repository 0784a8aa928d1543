"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stream import few, small_batches

#: Seconds of a write after which shuffle files are freed.
SOON = 1.0
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where the setting is absent, a new temporary one of a local session. On a
    cluster executors would not share such a folder, so there the setting is needed."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillmask-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Named Parquet tables of one operator run: save() cuts the lineage, drop() frees a table no later step reads.

    What is left is deleted when the driver ends, because a result may still be read lazily until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names = spark, set()
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/quillmask-{name}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads a table. Spark deletes shuffle files when the driver collects its garbage, which may be long
        after their last use; after a write of any size it is asked to."""
        path, began = f"{self.root}/{name}", time.monotonic()
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        if time.monotonic() - began > SOON:
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in self.names & set(names):
            _delete(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Saves a result that stands on its own and drops all other tables of this run."""
        df = self.save(df, name)
        self.drop(*(self.names - {name}))
        return df


def numbered(docs: DataFrame, scratch: Scratch, name: str = "_row") -> DataFrame:
    """docs with a number of each row, unique even where ids are null or repeated: that of its file and its place in it, so it
    is the same in every read and in a task that runs again. A table that was not read from Parquet files is written first."""
    if name in docs.columns:
        raise ValueError(f"column {name!r} would be overwritten")
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = scratch.save(docs, "numbered")
    at = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_nth"))
    files = docs.select(F.col("_metadata.file_path").alias("_path")).distinct().withColumn("_file", F.row_number().over(Window.orderBy("_path")) - 1)
    files = scratch.save(files, "files")  # one row a file
    return at.join(few(files), "_path").withColumn(name, F.shiftleft(F.col("_file").cast("long"), 40) + F.col("_nth")).select(*docs.columns, name)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, root in _made:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return
