"""Folders as sources and sets of files, and reports that merge."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmask.operators import reports
from quillmask.sources import folder
from quillmask.sources.folder import FileSet, PageFiles


def pages_with_calls(path, content):
    """Notes each call in a file beside the folder."""
    with open(os.path.dirname(path) + ".calls", "a") as f:
        f.write(os.path.basename(path) + "\n")
    if content == b"bad":
        raise ValueError("cannot be read")
    yield from folder.text_pages(path, content)


def test_files_are_dealt_by_their_bytes():
    found = [(f"f{i}", size) for i, size in enumerate([100, 1, 1, 1, 50, 50, 0])]
    tasks = folder.planned(found, 100)
    assert sorted(p for t in tasks for p in t.paths) == sorted(p for p, _ in found) and len(tasks) == 3
    assert folder.planned([], 10) == [] and len(folder.planned(found, 10**9)) == 1


def test_pages_of_a_folder_are_read_once_a_file(spark, tmp_path):
    spark.dataSource.register(PageFiles)
    root = tmp_path / "in"
    root.mkdir()
    for name, content in (("a.txt", b"one\ftwo"), ("b.txt", b""), ("c.txt", b"bad"), (".hidden", b"x")):
        (root / name).write_bytes(content)
    (root / "sub").mkdir()
    load = lambda **o: spark.read.format("page_files").options(path=str(root), reader="tests.test_folder:pages_with_calls", bytes="4", **o).load()
    got = {(os.path.basename(r.doc_id), r.page_num): (r.text, r.method) for r in load().collect()}
    assert got == {("a.txt", 1): ("one", "native"), ("a.txt", 2): ("two", "native"), ("b.txt", 1): ("", "native"), ("c.txt", 0): (None, "failed: cannot be read")}
    assert sorted((tmp_path / "in.calls").read_text().split()) == ["a.txt", "b.txt", "c.txt"]
    assert load(columns="doc_id,text").columns == ["doc_id", "text"] and load(columns="doc_id,text").count() == 4
    assert spark.read.format("page_files").option("path", str(tmp_path / "none")).load().count() == 0


def test_a_watched_folder_gives_each_file_once(spark, tmp_path):
    spark.dataSource.register(PageFiles)
    root = tmp_path / "in"
    root.mkdir()
    for i, names in enumerate((["a", "b"], ["c"], [])):  # the query starts again from its checkpoint each time
        for n in names:
            (root / n).write_text(f"page of {n}")
            os.utime(root / n, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.format("page_files").options(path=str(root), reader="tests.test_folder:pages_with_calls").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["page of a", "page of b", "page of c"]
    assert sorted((tmp_path / "in.calls").read_text().split()) == ["a", "b", "c"]


def test_a_set_of_files_appears_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(FileSet)
    rows = spark.createDataFrame([(f"t{i}.txt", bytearray(f"text {i}".encode())) for i in range(20)] + [("key", bytearray(b"k")), ("log", bytearray(b""))], "name string, data binary").repartition(4)
    save = lambda df, mode="append": df.write.format("file_set").mode(mode).options(path=str(tmp_path), name="run").save()
    for broken in (rows.withColumn("data", F.when(F.col("name") == "t7.txt", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data"))), rows.unionByName(rows.limit(1)), rows.withColumn("name", F.concat(F.lit("../"), "name"))):
        with pytest.raises(Exception):
            save(broken)
        assert os.listdir(tmp_path) == []
    save(rows)
    assert os.listdir(tmp_path) == ["run"] and len(os.listdir(tmp_path / "run")) == 22 and (tmp_path / "run" / "t7.txt").read_text() == "text 7"
    with pytest.raises(Exception):
        save(rows)
    assert len(os.listdir(tmp_path / "run")) == 22
    save(rows.limit(3), "overwrite")
    assert os.listdir(tmp_path) == ["run"] and len(os.listdir(tmp_path / "run")) == 3


def test_reports_merge_in_any_order_and_stay_within_their_errors(spark):
    rng = random.Random(6)
    rows = [(f"d{rng.randint(0, 4000)}", f"Text{rng.randint(0, 30000)}" if rng.random() < 0.99 else None, rng.choice(("A", "B", None)), rng.random()) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id string, text string, category string, confidence double").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(5))).cache()
    parts = [reports.report(df.where(F.col("part") == i)) for i in range(5)]
    whole = {r.category: r for r in reports.read(reports.report(df)).collect()}
    for order in ([0, 1, 2, 3, 4], [3, 1, 4, 0, 2]):
        every = parts[order[0]]
        for i in order[1:]:
            every = every.unionByName(parts[i])
        merged = {r.category: r for r in reports.read(reports.merge(every)).collect()}
        for c in ("A", "B", None):
            own = [r for r in rows if r[2] == c]
            texts, docs, ranks = {r[1].lower() for r in own if r[1]}, {r[0] for r in own}, sorted(r[3] for r in own)
            for got in (merged[c], whole[c]):
                assert got.n == len(own)
                assert abs(got.n_texts - len(texts)) <= reports.DISTINCT_ERROR * len(texts) and abs(got.n_documents - len(docs)) <= reports.DISTINCT_ERROR * len(docs)
                for q in (10, 50, 90):
                    assert abs(sum(v < got[f"q{q}"] for v in ranks) / len(ranks) - q / 100) <= 2 * reports.RANK_ERROR
    a, b = reports.report(df.where("part < 4 and (category = 'A' or category is null)")), reports.report(df.where("part > 0 and category = 'A'"))
    got = {r.category: r for r in reports.compare(a, b).collect()}
    of = lambda keep: {r.text.lower() for r in df.where(f"category = 'A' and text is not null and {keep}").collect()}
    assert abs(got["A"].lost - len(of("part = 0"))) <= 0.1 * len(of("part = 0")) and abs(got["A"].won - len(of("part = 4"))) <= 0.1 * len(of("part = 4"))
    assert got[None].n_after == 0 and got[None].won == 0 and got[None].lost > 0
    assert reports.read(reports.report(df.limit(0))).count() == 0
