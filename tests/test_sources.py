"""Sources, sinks, streams and the session."""

import os

from pyspark.sql import functions as F

from quillmask.plans.registry import CASE, PAGE
from quillmask.sources import documents as D
from quillmask.sources import sinks as K
from quillmask.streaming.detect import counts_by_window, write_matches


def test_folder_scan_does_not_go_below(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "b.docx", "c.xyz", "sub/d.pdf"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.name: (r.status, r.reason) for r in D.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.docx": ("to convert", None), "c.xyz": ("failed", "Unsupported file type: .xyz")}


def test_files_that_cannot_be_opened_count_as_protected(spark, tmp_path):
    for name, content in (("a.pdf", b"ok"), ("b.pdf", b"locked"), ("c.pdf", b"broken")):
        (tmp_path / name).write_bytes(content)

    def probe(content):
        if content == b"broken":
            raise ValueError
        return content == b"locked"

    files = D.encrypted(D.scan_files(spark, str(tmp_path), content=True), probe)
    assert {r.name: r.status for r in files.collect()} == {"a.pdf": "pdf", "b.pdf": "protected", "c.pdf": "protected"}


def test_pages_come_through_an_adapter(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    pages = D.extract_pages(D.scan_files(spark, str(tmp_path), content=True), lambda path, c: ({"page_num": i + 1, "text": t, "method": "native", "confidence": 1.0, "widget_values": None} for i, t in enumerate(c.decode().split("|"))))
    assert [(r.page_num, r.text) for r in pages.orderBy("page_num").collect()] == [(1, "one"), (2, "two")]


def test_output_folders(spark, tmp_path):
    first = K.output_folder(spark, str(tmp_path))
    assert K.output_folder(spark, str(tmp_path)) == first
    assert K.output_folder(spark, str(tmp_path), action="new").endswith("deidentified_2")
    open(os.path.join(tmp_path, "deidentified", "x_deidentified.txt"), "w").close()
    K.output_folder(spark, str(tmp_path), action="overwrite")
    assert os.listdir(tmp_path / "deidentified") == []


def test_results_lie_apart_by_status_and_cleanup_only_takes_its_own(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "a.txt", "body", 1, "written"), ("d2", "b.txt", "body", 0, "quarantined")], "doc_id string, name string, body string, n_replaced int, status string")
    K.write_results(rows, str(tmp_path / "out"))
    assert {d for d in os.listdir(tmp_path / "out") if d.startswith("status")} == {"status=written", "status=quarantined"}
    keep, made = tmp_path / "keep.txt", tmp_path / "x_deidentified.txt"
    keep.write_text("k")
    made.write_text("m")
    assert [os.path.basename(p) for p in K.cleanup(spark, str(tmp_path))] == ["x_deidentified.txt"]
    K.cleanup(spark, str(tmp_path), [str(made), str(keep), str(tmp_path / "gone_deidentified.txt")])
    assert keep.exists() and not made.exists()


def test_texts_are_files_of_their_own_and_are_found_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one", 1, "written"), ("b", "two", 0, "quarantined"), ("c", "three", 2, "written")], "stem string, body string, n_replaced int, status string")
    wrote = {r["name"]: r.n_bytes for r in K.write_texts(rows, str(tmp_path)).collect()}
    assert set(wrote) == {"a_deidentified.txt", "b.UNVERIFIED.txt", "c_deidentified.txt"}
    for name, size in wrote.items():
        assert (tmp_path / name).is_file() and (tmp_path / name).stat().st_size == size
    assert {(os.path.basename(r.path), r.text.rpartition("\n")[2]) for r in D.read_outputs(spark, str(tmp_path)).collect()} == {("a_deidentified.txt", "one"), ("c_deidentified.txt", "three")}
    listed = K.cleanup(spark, str(tmp_path))
    assert [os.path.basename(p) for p in listed] == ["a_deidentified.txt", "b.UNVERIFIED.txt", "c_deidentified.txt"]
    K.cleanup(spark, str(tmp_path), listed)
    assert K.cleanup(spark, str(tmp_path)) == [] and D.read_outputs(spark, str(tmp_path)).count() == 0


def test_redaction_from_plan_to_quarantine(spark):
    """Files that are text: one is redacted, one keeps a name, one cannot be read again, one cannot be rewritten."""
    from quillmask.plans.flows import redact

    files = spark.createDataFrame([(p, p, bytearray(c)) for p, c in (("good", b"Fern met Bo"), ("kept", b"Fern met fern"), ("dark", b"Fern hid"), ("broken", b"x"))], "path string, stem string, content binary")
    plan = spark.createDataFrame([(p, "text", 1, "Fern", "erase") for p in ("good", "kept", "dark", "broken")], "doc_id string, kind string, page_num int, value string, action string")
    items = spark.createDataFrame([(p, "Fern") for p in ("good", "kept", "dark", "broken")], "doc_id string, text string")

    def rewrite(content, rows):
        if content == b"x":
            raise ValueError("no file")
        for r in rows:
            content = content.replace(r["value"].encode(), b"####")
        return content

    def read(path, content):
        yield {"page_num": 1, "text": content.decode()}

    def scan(path, content):
        if b"hid" in content:
            raise ValueError("too dark")
        yield {"page_num": 1, "text": content.decode()}

    got = {r.path: (r["name"], r.content and bytes(r.content), r.status, r.failures) for r in redact(files, plan, items, rewrite, read, scan).collect()}
    assert got["good"] == ("good_redacted.pdf", b"#### met Bo", "written", [])
    assert got["kept"] == ("kept.UNVERIFIED.pdf", b"#### met fern", "quarantined", ["Page 1: 'Fern' still visible after redaction"])
    assert got["dark"][0] == "dark.UNVERIFIED.pdf" and got["dark"][2:] == ("quarantined", ["OCR verification error: too dark"])
    assert got["broken"][:3] == (None, None, "failed") and "no file" in got["broken"][3][0]


#: Keys of pages.
GRID = "doc_id string, page_num int"


def test_an_adapter_that_only_sees_boxes_blanks_the_right_cells(spark):
    """Pages are grids of letters, a cell 10 points wide and high; the adapter is told nothing but the plan. Page 1 is text, page 2 an image that was
    read, page 3 holds an embedded image (xref 7) that page 1 shows too."""
    import json

    from quillmask.plans.flows import plan_redaction

    page = lambda *rows: [list(r) for r in rows]
    source = json.dumps({"1": page("Fern met Bo", "..Fern...Fernia"), "2": page("by Fern now"), "images": {"7": page("Fern")}})
    files = spark.createDataFrame([("d", bytearray(source.encode())), ("u", bytearray(source.encode()))], "path string, content binary")
    docs = spark.createDataFrame([("d",), ("u",)], "doc_id string")
    items = spark.createDataFrame([("d", 1, "Fern"), ("d", 2, "Fern"), ("u", 2, "Fern")], GRID + ", text string")
    pages = spark.createDataFrame([(d, 1, 300, 100, 5, 1) for d in "du"] + [(d, 2, 300, 100, 0, 1) for d in "du"], GRID + ", width int, height int, n_words int, n_images int")
    box = ", x0 double, y0 double, x1 double, y1 double"
    words = spark.createDataFrame([("d", 1, "Fern", 0.0, 0.0, 40.0, 10.0), ("d", 1, "Fern", 20.0, 10.0, 60.0, 20.0), ("d", 1, "Fernia", 90.0, 10.0, 150.0, 20.0)], GRID + ", word string" + box)
    hits = spark.createDataFrame([("d", 1, "Fern", 0.0, 0.0, 40.0, 10.0), ("d", 1, "Fern", 20.0, 10.0, 60.0, 20.0), ("d", 1, "Fern", 90.0, 10.0, 130.0, 20.0), ("d", 1, "met", 50.0, 0.0, 80.0, 10.0)], GRID + ", text string" + box)
    scanned = spark.createDataFrame([("d", 2, 0, "by", 0.0, 0.0, 20.0, 10.0), ("d", 2, 1, "Fern", 30.0, 0.0, 70.0, 10.0)], GRID + ", pos int, word string" + box)
    images = spark.createDataFrame([("d", 1, 7, 900, 900, 500.0, 0.5)], GRID + ", xref int, px_w int, px_h int, rect_w double, ink_ratio double")
    image_words = spark.createDataFrame([("d", 7, 0, "Fern", 0.0, 0.0, 40.0, 10.0)], "doc_id string, xref int, pos int, word string" + box)
    marks = spark.createDataFrame([], "doc_id string, kind string, page_num int, value string")
    plan = plan_redaction(docs, items, pages, words, hits, scanned, images, image_words, marks, zones=False)
    stages = []

    def paint(content, steps):
        made = json.loads(content)
        for s in steps:
            stages.append(s["stage"])
            if s["x0"] is None:
                continue
            grid = made["images"][str(s["xref"])] if s["kind"] == "image" else made[str(s["page_num"])]
            for y, row in enumerate(grid):
                for x in range(len(row)):
                    if s["x0"] < 10 * x + 5 < s["x1"] and s["y0"] < 10 * y + 5 < s["y1"]:
                        row[x] = "#"
        assert [s["stage"] for s in steps] == sorted(s["stage"] for s in steps)
        return json.dumps(made).encode()

    got = {r.path: (r.content and json.loads(bytes(r.content)), r.error) for r in K.redact_files(files, plan, paint).collect()}
    assert got["d"] == ({"1": page("#### met Bo", "..####...Fernia"), "2": page("by #### now"), "images": {"7": page("####")}}, None)
    assert got["u"] == (None, "pages [2] could not be read")


def test_categories_come_in_either_order(spark):
    from quillmask.operators.review import selected_categories

    rows = spark.createDataFrame([("B",), ("A",), ("C",), ("C",), (None,)], "category string")
    assert [(r.category, r.n) for r in selected_categories(rows).collect()] == [("A", 1), ("B", 1), ("C", 2), ("Unknown", 1)]
    assert [r.category for r in selected_categories(rows, "n").collect()] == ["C", "A", "B", "Unknown"]


def test_key_is_refused_among_the_outputs(spark, tmp_path):
    owners = spark.createDataFrame([("c", 0, "Torvin Vardane", "[Student]")], "case_id string, seq int, full_name string, label string")
    notes = spark.createDataFrame([], "case_id string, form string, note string")
    names = spark.createDataFrame([("c", "Torvin.pdf", None)], "case_id string, original string, produced string")
    lines = K.key_lines(owners, notes, names)
    assert lines.where(F.col("line") == "[Student]  ->  Torvin Vardane").count() == 1
    try:
        K.write_key(lines, str(tmp_path), str(tmp_path), spark)
    except ValueError:
        pass
    else:
        raise AssertionError("a key among the outputs must be refused")
    K.write_key(K.key_lines(owners, notes, names, beside_outputs=True), str(tmp_path), str(tmp_path), spark)


def test_stream_of_pages_gives_the_matches_of_the_table(spark, tmp_path):
    rows = [("c", f"d{i}", 1, f"mail a{i}@b.org and a{i}@b.org") for i in range(5)]
    spark.createDataFrame(rows, PAGE).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_matches(stream.select("doc_id", "page_num", "text"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_windowed_counts(spark):
    pages = spark.createDataFrame([("d", 1, "a@b.org", "2026-01-01 00:01:00"), ("e", 1, "c@d.org", "2026-01-01 00:12:00")], "doc_id string, page_num int, text string, at string").withColumn("at", F.to_timestamp("at"))
    assert {(r.category, r.n) for r in counts_by_window(pages, "at").collect()} == {("Email address", 1)}


def test_word_files_are_converted_or_say_why_not(spark, tmp_path):
    for name, content in (("a.docx", b"fine"), ("b.docx", b"bad"), ("c.pdf", b"pdf")):
        (tmp_path / name).write_bytes(content)

    def convert(content):
        if content == b"bad":
            raise ValueError("cannot be read")
        return b"pdf of " + content

    got = {r.name: (r.status, r.reason, bytes(r.content)) for r in D.convert_word(D.scan_files(spark, str(tmp_path), content=True), convert).collect()}
    assert got == {"a.docx": ("converted", None, b"pdf of fine"), "b.docx": ("failed", "cannot be read", b"bad"), "c.pdf": ("pdf", None, b"pdf")}


def test_redaction_goes_through_an_adapter(spark):
    files = spark.createDataFrame([("a", bytearray(b"Fern met Bo")), ("b", bytearray(b"x"))], "path string, content binary")
    plan = spark.createDataFrame([("a", "text", 1, "Fern", "delete")], "doc_id string, kind string, page_num int, value string, action string")

    def redact(content, rows):
        if content == b"x":
            raise ValueError("broken")
        for r in rows:
            content = content.replace(r["value"].encode(), b"###")
        return content

    assert {r.path: (r.content and bytes(r.content), r.error) for r in K.redact_files(files, plan, redact).collect()} == {"a": (b"### met Bo", None), "b": (None, "broken")}


def test_what_a_redacted_document_still_shows(spark):
    from quillmask.operators.rewrite import verify_redaction
    from quillmask.operators.scans import image_counts

    out = spark.createDataFrame([("d", 1, "Fernside plan"), ("d", 2, "by oswick-vale")], "doc_id string, page_num int, text string")
    chosen = spark.createDataFrame([("d", "Fern"), ("d", "Oswick Vale"), ("d", "by")], "doc_id string, text string")
    assert [(r.doc_id, r.text) for r in verify_redaction(out, chosen).collect()] == [("d", "Oswick Vale")]
    pages = spark.createDataFrame([("d", 2, "native"), ("d", 1, "native"), ("e", 3, "ocr"), ("f", 0, "native")], "doc_id string, n_images int, method string")
    assert [(r.doc_id, r.n_images) for r in image_counts(pages).collect()] == [("d", 3)]


def test_pages_of_a_file_are_read_once_and_may_leave_out_what_they_lack(spark, tmp_path):
    from quillmask.plans.flows import detect

    (tmp_path / "a.pdf").write_bytes(b"x")
    calls = spark.sparkContext.accumulator(0)

    def reader(path, content):
        calls.add(1)
        yield {"page_num": 1, "text": "mail a@b.org ﬁne"}
        yield {"page_num": 2, "text": None, "method": "ocr", "confidence": 0.5, "other": 1}

    pages = D.extract_pages(D.scan_files(spark, str(tmp_path), content=True), reader)
    assert [(r.page_num, r.method, r.widget_values) for r in pages.collect()] == [(1, None, None), (2, "ocr", None)]
    before = calls.value
    assert [r.text for r in detect(pages.select("doc_id", "page_num", "text")).collect()] == ["a@b.org"] and calls.value == before + 1


def test_a_run_leaves_no_names_behind(spark, tmp_path):
    from quillmask.plans.flows import deidentify, detect
    from quillmask.plans.session import Kept, close_all, shared_folder

    root = shared_folder(spark).removeprefix("file://")
    close_all()
    others = set(os.listdir(root))  # the folder may be shared with other sessions
    held = lambda: [n for n in os.listdir(root) if n.startswith("quillmask-run-") and n not in others]
    pages = spark.createDataFrame([("c", "d", 1, "Torvin Vardane left")], PAGE)
    cases = spark.createDataFrame([("c", "Torvin Vardane", [], [], [])], CASE)
    with Kept(spark) as kept:
        run = deidentify(pages, cases, detect(pages, cases), kept=kept)
        assert run["results"].first().status == "written" and len(held()) == 1
    assert held() == []
    assert deidentify(pages, cases, detect(pages, cases))["results"].count() == 1 and len(held()) == 1
    close_all()
    assert held() == []
