"""Streams of matches and events: any split into batches, late rows, and starting again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmask.operators import people as who
from quillmask.plans.registry import CASE
from quillmask.streaming import people, windows

CHOSEN = "case_id string, doc_order string, match_idx int, text string, category string"
NAMES = ["Sidonie Harcastle", "S. Harcastle", "Ms Sidonie Harcastle", "Rufaro Plimmer", "Rufaro P.", "Ilsabet Vardane", "Mother Vardane", "Phone:", "Torvin Vardane", "harcastle", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_mentions_ends_in_the_rosters_of_the_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    cases = spark.createDataFrame([(c, "Torvin Vardane", ["Ilsabet Vardane"] if c != "b" else None, [], ["Telmora Primary School"]) for c in ("a", "b", "silent")], CASE)
    rows = [(rng.choice(("a", "b", "other")), f"d{rng.randint(0, 5)}", i, rng.choice(NAMES), rng.choice(("Person name (NER)", "Phone number"))) for i in range(60)]
    rows += rows[:5]
    chosen = spark.createDataFrame(rows, CHOSEN)
    want = who.owner_labels(who.build_rosters(cases, chosen)).select("case_id", "seq", "full_name", "role", "label")
    size = len(rows) // 3
    for i, at in enumerate((0, size, 2 * size)):  # the query ends and starts again between them
        part = rows[at : at + size if i < 2 else None]
        spark.createDataFrame(part, CHOSEN).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(chosen.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        people.write_people(stream, cases, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = who.owner_labels(people.current_rosters(spark, str(tmp_path / "out"), cases)).select("case_id", "seq", "full_name", "role", "label")
    assert sorted(got.collect()) == sorted(want.collect())
    changes = people.label_changes(spark, str(tmp_path / "out"))
    last = {}
    for r in changes.orderBy("version").collect():
        last[r.case_id, r.full_name] = r.after
    assert {(c, n): label for (c, n), label in last.items() if label} == {(r.case_id, r.full_name): r.label for r in want.where("case_id <> 'silent'").collect()}


def test_a_batch_keeps_names_and_leaves_the_folding_to_readers(spark, tmp_path):
    cases = spark.createDataFrame([("a", "Torvin Vardane", [], [], []), ("b", "Feyra Oskeld", [], [], [])], CASE)
    batches = [[("a", "d2", 0, "Rufaro Plimmer"), ("a", "d2", 1, "rufaro plimmer"), ("other", "d1", 0, "Rufaro Plimmer")], [("a", "d3", 0, "Rufaro Plimmer"), ("b", "d1", 0, "Ansgar Woldt")], [("a", "d1", 0, "RUFARO Plimmer")]]
    for rows in batches:
        spark.createDataFrame([(*r, "Person name (NER)") for r in rows], CHOSEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CHOSEN).parquet(str(tmp_path / "in"))
        query = people.write_people(stream, cases, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]  # no Python and no state a case
    kept = spark.read.parquet(str(tmp_path / "out" / "names")).select("batch", "case_id", "folded", "f.doc_order").collect()
    assert sorted(map(tuple, kept)) == [(0, "a", "rufaro plimmer", "d2"), (1, "b", "ansgar woldt", "d1"), (2, "a", "rufaro plimmer", "d1")]
    assert {(r.case_id, r.version) for r in people.label_changes(spark, str(tmp_path / "out")).collect()} >= {("a", 1), ("a", 2), ("b", 1)}


EVENTS = "user string, at timestamp, value int"


def test_windows_of_a_stream_are_those_of_the_table_but_for_late_rows(spark, tmp_path):
    rng, zero = random.Random(3), datetime(2026, 1, 1)
    made = [(rng.choice(("u", "v", None)), zero + timedelta(minutes=rng.randint(0, 60) + 120 * batch), rng.randint(0, 9)) for batch in range(3) for _ in range(25)]
    parts = [made[:25], made[25:50], [*made[50:], ("u", zero, 1000), ("u", None, 5)], [("u", zero + timedelta(days=9), 0)]]
    for kind, of in (("sessions", lambda rows: windows.sessions(rows, ["user"], "at", "10 minutes", "30 minutes", value=F.sum("value"))), ("sliding", lambda rows: windows.sliding(rows, ["user"], "at", "1 hour", "20 minutes", "30 minutes", value=F.sum("value")))):
        dropped = 0
        for i, part in enumerate(parts):  # a batch at a time; the query starts again from its checkpoint
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / kind / "in"))
            query = windows.append(of(spark.readStream.schema(EVENTS).parquet(str(tmp_path / kind / "in"))), str(tmp_path / kind / "out"), str(tmp_path / kind / "cp"))
            query.awaitTermination()
            dropped += windows.late_rows(query)
        table = of(spark.createDataFrame(made, EVENTS))
        got = spark.read.parquet(str(tmp_path / kind / "out"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, table.collect())) and dropped > 0
