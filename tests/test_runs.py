"""Runs that are stopped between portions, within one, or fail, and go on."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillmask.plans.runs import Run

SCHEMA = "doc_id string, n int"


def shout(docs):
    return docs.select("doc_id", F.length("text").alias("n"))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(f"d{i}", "x" * i) for i in range(40)], "doc_id string, text string")


def want(docs):
    return sorted(tuple(r) for r in shout(docs).collect())


def rows(run):
    return sorted(tuple(r) for r in run.results(SCHEMA).collect())


def test_a_run_that_is_stopped_between_portions_goes_on(spark, docs, tmp_path):
    run, asked = Run(spark, str(tmp_path)), []
    first = run.work(docs, shout, portion=10, should_stop=lambda: asked.append(1) or len(asked) > 2)
    assert first.cancelled and first.total == 40 and 0 < first.finished < 40 and first.before == 0
    assert len(rows(run)) == first.finished == run.finished().count()
    seen = []
    rest = Run(spark, str(tmp_path)).work(docs, lambda d: seen.append(d.count()) or shout(d), portion=10)
    assert not rest.cancelled and rest.before == first.finished and rest.finished == 40 - first.finished == sum(seen)
    assert rows(run) == want(docs)
    again = run.work(docs, shout)
    assert (again.finished, again.before, again.cancelled) == (0, 40, False)


def test_a_portion_that_is_interrupted_leaves_nothing(spark, docs, tmp_path):
    run = Run(spark, str(tmp_path))

    @F.udf("int")
    def slow(text):
        time.sleep(0.5)
        return len(text)

    calls = []

    def process(d):
        calls.append(1)
        if len(calls) == 1:
            return shout(d)
        threading.Timer(1.0, run.stop).start()
        return d.select("doc_id", slow("text").alias("n"))

    got = run.work(docs, process, portion=20)
    assert got.cancelled and got.finished == len(rows(run)) and 0 < got.finished < 40
    assert len(os.listdir(tmp_path / "results")) == 1 and run.sweep() == 0
    assert run.work(docs, shout, portion=20).finished == 40 - got.finished and rows(run) == want(docs)


def test_a_portion_that_fails_says_so_and_is_done_later(spark, docs, tmp_path):
    run = Run(spark, str(tmp_path))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        run.work(docs, lambda d: d.select("doc_id", F.expr("1 div (length(text) - 7)").cast("int").alias("n")), portion=100)
    assert rows(run) == [] and not run.work(docs, shout).cancelled and rows(run) == want(docs)
    (tmp_path / "results" / "lost").mkdir()
    assert run.sweep() == 1 and rows(run) == want(docs)


def test_nothing_to_do_and_documents_without_ids(spark, docs, tmp_path):
    run = Run(spark, str(tmp_path))
    got = run.work(docs.limit(0), shout)
    assert (got.finished, got.total, got.cancelled) == (0, 0, False) and rows(run) == []
    with pytest.raises(ValueError):
        run.work(docs.withColumn("doc_id", F.lit(None).cast("string")), shout)
