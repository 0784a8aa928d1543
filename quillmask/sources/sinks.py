"""Sinks: finished texts, quarantined ones, the audit log and the key, each in its place; names of files and folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of files that a run makes.
MADE = ["_redacted.pdf", "_deidentified.txt", ".UNVERIFIED.pdf", ".UNVERIFIED.txt"]
RULE = "=" * 70


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def output_folder(spark: SparkSession, parent: str, name: str = "deidentified", action: str = "reuse", custom: str | None = None) -> str:
    """The folder to write to: the custom one; else name under parent, emptied (overwrite), the first free of name_2, name_3 ...
    if it exists (new), or as it is."""
    path = custom or f"{parent.rstrip('/')}/{name}"
    p, fs = _fs(spark, path)
    if not custom and action == "overwrite" and fs.exists(p):
        fs.delete(p, True)
    if not custom and action == "new":
        n = 2
        while fs.exists(p):
            p, fs = _fs(spark, f"{path}_{n}")
            n += 1
    fs.mkdirs(p)
    return p.toString()


def same_place(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths name one file or folder."""
    (p, f), (q, g) = _fs(spark, a), _fs(spark, b)
    return f.makeQualified(p).equals(g.makeQualified(q))


def unique_names(stems: DataFrame, suffix: str, order: str = "doc_id") -> DataFrame:
    """stems (folder, stem) with name: the second and later files of one stem in a folder get _2, _3 ... before the suffix."""
    nth = F.row_number().over(Window.partitionBy("folder", "stem").orderBy(order))
    return stems.withColumn("name", F.concat("stem", F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.lit(suffix)))


def safe_name(name: Column, suffix: str) -> Column:
    """A file name that a person typed, without folders, with the suffix (.txt takes the place of another ending, .pdf comes
    after it); null if nothing is left."""
    base = F.btrim(F.regexp_extract(name, r"([^/\\]*)$", 1))
    low = F.lower(base)
    ends = F.endswith(low, F.lit(suffix))
    changed = F.concat(F.regexp_replace(base, r"(?<=.)\.[^.]*$", "") if suffix == ".txt" else base, F.lit(suffix))
    return F.when(base.isin("", ".", ".."), None).when(ends, base).otherwise(changed)


def finished_text(body: Column, n_replaced: Column) -> Column:
    """A text with its head, which says so if nothing was replaced."""
    # The heads of finished texts.
    done = "De-identified copy — names and personal details have been replaced with labels such as [Student] and [Teacher 1].\n"
    none = "WARNING — NOTHING WAS REPLACED IN THIS FILE.\nNo personal information was detected, so this is the document's text exactly as it was.\nRead it before sharing it or pasting it anywhere.\n"
    return F.concat(F.when(n_replaced > 0, F.lit(done)).otherwise(F.lit(none)), F.lit(f"{RULE}\n\n"), body)


def write_results(results: DataFrame, folder: str) -> None:
    """results (doc_id, name, body, n_replaced, status) as Parquet, parted by status so that what was not verified lies apart."""
    rows = results.withColumn("text", finished_text(F.col("body"), F.col("n_replaced"))).select("doc_id", "name", "text", "n_replaced", "status")
    rows.write.mode("append").partitionBy("status").parquet(folder)


def output_name(stem: Column, status: Column, kind: str = "txt") -> Column:
    """The file name of a result: what could not be verified says so in its name, so that it is taken for nothing else."""
    done = "_deidentified.txt" if kind == "txt" else "_redacted.pdf"
    return F.concat(stem, F.when(status == "written", F.lit(done)).otherwise(F.lit(f".UNVERIFIED.{kind}")))


def _write_files(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Each file under a name of its own first, then moved in place: a task that runs again leaves one whole file."""
    import uuid

    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name, data in zip(batch["name"], batch["data"], strict=True):
            part = f"{root}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(data)
            files.move(part, f"{root}/{name}")
        yield pd.DataFrame({"name": batch["name"], "n_bytes": batch["data"].map(len)})


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """One file in folder for each of rows (name, data), written by the executors; (name, n_bytes) of what was written. folder is
    a path or address of a file system that pyarrow knows; names must be distinct and hold no folder (unique_names)."""
    folder = folder.rstrip("/") if "://" in folder else folder.removeprefix("file:").rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _write_files(batches, folder)

    made = rows.select("name", F.col("data").cast("binary").alias("data")).mapInPandas(run, "name string, n_bytes long")
    path = f"{folder}/.written"
    made.write.mode("overwrite").parquet(path)  # writes the files, and the list of them
    return made.sparkSession.read.schema(made.schema).parquet(path)


def write_texts(results: DataFrame, folder: str) -> DataFrame:
    """One text file per document of results (stem, body, n_replaced, status), <stem>_deidentified.txt, or <stem>.UNVERIFIED.txt for
    one whose check found something left. read_outputs and cleanup find them again."""
    return write_files(results.select(output_name(F.col("stem"), F.col("status")).alias("name"), finished_text(F.col("body"), F.col("n_replaced")).alias("data")), folder)


_MADE = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
#: What an adapter is told of each step: where it acts (a page, an image by its xref, a box), on what, and how.
PLAN = "stage int, page_num int, kind string, xref long, value string, action string, x0 double, y0 double, x1 double, y1 double"


def redact_files(files: DataFrame, plan: DataFrame, redact: Callable[[bytes, list[dict]], bytes]) -> DataFrame:
    """(path, content, error) of files (path, content) rewritten by an adapter that gets a file and the rows of plan (doc_id and those of
    PLAN; a column that is missing is null) that name it, in the order of stages, pages, kinds, images and boxes. A file that fails, or
    whose plan has a row with the action fail, has no content, so nothing half done is written."""
    fields = [(f.split()[0], f.split()[1]) for f in PLAN.split(", ")]
    row = F.struct(*[(F.col(c) if c in plan.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])
    in_order = F.array_sort(F.collect_list(row))
    by = plan.groupBy(F.col("doc_id").alias("path")).agg(in_order.alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path, content, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                steps = steps or []
                unread = [s["page_num"] for s in steps if s["action"] == "fail"]
                try:
                    if unread:
                        raise ValueError(f"pages {unread} could not be read")
                    made.append({"path": path, "content": redact(content, steps), "error": None})
                except Exception as e:  # noqa: BLE001  the reason belongs in the table, and other files go on
                    made.append({"path": path, "content": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(made, schema=_MADE)

    return files.select("path", "content").join(by, "path", "left").mapInArrow(run, "path string, content binary, error string")


def key_lines(owners: DataFrame, notes: DataFrame, names: DataFrame, beside_outputs: bool = False) -> DataFrame:
    """Lines (case_id, section, place, line) of the private key: labels and real names, remarks on shared names, which file came
    from which (names: case_id, original, produced)."""
    head = ["DO NOT UPLOAD THIS FILE", RULE, "It turns the labels back into real names: keep it private, away from the de-identified copies."]
    if beside_outputs:
        head.append("!! This folder also holds the originals and this key: send single files, never the folder.")
    cases = owners.select("case_id").distinct()
    top = cases.select("case_id", F.lit(0).alias("section"), F.posexplode(F.array(*map(F.lit, head))).alias("place", "line"))
    labels = owners.select("case_id", F.lit(1).alias("section"), F.col("seq").alias("place"), F.concat("label", F.lit("  ->  "), "full_name").alias("line"))
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("form"))
    shared = notes.select("case_id", F.lit(2).alias("section"), nth.alias("place"), F.concat(F.lit("- "), "note").alias("line"))
    files = names.select("case_id", F.lit(3).alias("section"), F.row_number().over(Window.partitionBy("case_id").orderBy("original")).alias("place"), F.concat("original", F.lit("  ->  "), F.coalesce("produced", F.lit("(not produced)"))).alias("line"))
    return top.unionByName(labels).unionByName(shared).unionByName(files)


def write_key(lines: DataFrame, originals: str, outputs: str, spark: SparkSession) -> str:
    """Writes the key beside the originals; refuses a folder that is the outputs' unless its lines say so."""
    if same_place(spark, originals, outputs) and lines.where("line like '!!%'").isEmpty():
        raise ValueError("the key must not lie among the outputs without a warning")
    path = f"{originals.rstrip('/')}/key"
    lines.write.mode("overwrite").partitionBy("case_id").parquet(path)
    return path


def cleanup(spark: SparkSession, folder: str, paths: list[str] | None = None) -> list[str]:
    """Without paths, the files in folder that runs made, sorted; with paths, deletes those of them that lie in it and have such
    an ending (one that is gone counts as deleted) and gives them back."""
    p, fs = _fs(spark, folder)
    if paths is None:
        found = [s.getPath().toString() for s in fs.listStatus(p) if s.isFile()]
        return sorted(f for f in found if any(f.endswith(m) for m in MADE))
    root = fs.makeQualified(p).toString().rstrip("/") + "/"
    gone = []
    for path in paths:
        q, g = _fs(spark, path)
        full = g.makeQualified(q).toString()
        if full.startswith(root) and ".." not in full and any(full.endswith(m) for m in MADE):
            g.delete(q, False)
            gone.append(full)
    return gone
