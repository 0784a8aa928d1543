"""Session settings for this engine's plans."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the setting is absent, a local session gets a folder of its own; on a
    cluster executors would not share it, so there the setting is needed."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillmask-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows a task where few bytes of a file make much work or memory.
A_TASK = 250_000


def tasks_of(rows: int, a_task: int = A_TASK) -> int:
    """How many tasks rows are dealt to, so that what a task holds does not grow with the table; two a core at least."""
    return max(2 * SparkSession.active().sparkContext.defaultParallelism, -(-rows // a_task))


class Kept:
    """Tables of one run that are computed once and kept in the shared folder, so that what is built on them several times neither
    plans nor computes them again. They hold real names: close() deletes them, and so does the end of a with block, or else
    of the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.root = f"{shared_folder(spark)}/quillmask-run-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        """df written and read again. Names that repeat from case to case take a hundredth of their memory in a file, and Spark
        estimates a table by its files, so joins of kept tables sort and never broadcast them."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).hint("merge")

    def close(self) -> None:
        """Deletes the run's tables; nothing that was built on them can be read after that."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if self in _open:
            _open.remove(self)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


_open: list[Kept] = []


@atexit.register
def close_all() -> None:
    """Deletes what runs that were not closed have kept."""
    for kept in list(_open):
        try:
            kept.close()
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def session(name: str = "quillmask", cores: str = "*", **settings: str) -> SparkSession:
    """A local session; on a cluster the session comes from the submitter and only its settings matter.

    Adaptive execution sizes partitions and splits skewed ones; shuffle.partitions is a starting point that it merges."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.shuffle.partitions": "64", "spark.sql.session.timeZone": "UTC", "spark.sql.parquet.filterPushdown": "true", "spark.ui.enabled": "false"}
    for k, v in (base | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
