"""Detectors, names and people on small cases."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmask.functions import names as N
from quillmask.functions import text as X
from quillmask.operators import people as who
from quillmask.operators import review as R
from quillmask.operators import rewrite as W
from quillmask.operators.detect import REGISTRY, detect_lines
from quillmask.plans import registry
from quillmask.plans.flows import deidentify, detect
from quillmask.plans.oracles import ORACLES
from quillmask.plans.registry import CASE, PAGE
from tests import oracle

NO_ADDRESS = ["Level 4 Term Two Reading", "3 Helpers Dr Munrose", "11 Point Rise in spelling", "6 On The Way Up", "She won 14 Points", "Grade 5 pupils"]


def found(spark, text, student="Oswick Munrose", **lists):
    pages = spark.createDataFrame([("c", "d", 1, text)], PAGE)
    cases = spark.createDataFrame([("c", student, lists.get("parents", []), lists.get("family", []), lists.get("orgs", []))], CASE)
    return {(r.text, r.category, r.line_num) for r in detect_lines(pages, cases).collect()}


@pytest.mark.parametrize("text", NO_ADDRESS)
def test_report_language_is_no_address(spark, text):
    assert not [x for x in found(spark, text) if x[1] == "Address"]


def test_full_address_hides_the_street_within_it(spark):
    assert [x[0] for x in found(spark, "Home is 7 Corvane Road, Telmora VIC 3456") if x[1] == "Address"] == ["7 Corvane Road, Telmora VIC 3456"]


def test_same_line_number_keeps_the_next_line_out(spark):
    assert found(spark, "Medicare 2345 67890 1\n9876 54321 0") == {("2345 67890 1", "Medicare number", 1)}


def test_lists_of_names_and_telling_words(spark):
    got = found(spark, "Ilsabet Vardane of Fern Ridge Primary School met Yorvel Lee", parents=["Ilsabet Vardane"], family=["Yorvel Lee"], orgs=["Fern Ridge Primary School"])
    assert ("Ilsabet Vardane", "Parent/Guardian (user-provided)", 1) in got and ("Yorvel Lee", "Family member (user-provided)", 1) in got
    assert {x[0] for x in got if x[1] == "Organisation name"} == {"Fern Ridge Primary School", "Fern", "Ridge"}


@pytest.mark.parametrize("text", [None, "", "\n\n", " "])
def test_blank_pages_have_no_matches(spark, text):
    assert found(spark, text) == set()


def test_empty_table_of_pages(spark):
    assert detect_lines(spark.createDataFrame([], PAGE), spark.createDataFrame([], CASE)).collect() == []


def test_offsets_are_code_points(spark):
    row = spark.createDataFrame([("🙂 a@b.co, é c@d.org",)], "t string").select(X.spans(F.col("t"), r"[a-z]@[a-z]\.[a-z]+").alias("s")).first().s
    assert [(x.start, x.end, x.text) for x in row] == [(2, 8, "a@b.co"), (12, 19, "c@d.org")]


def test_detection_stays_in_the_jvm_and_needs_no_shuffle(spark):
    pages = spark.createDataFrame([("d", 1, "x")], "doc_id string, page_num int, text string")
    plan = detect_lines(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # the only Python node is given texts that hold an unsettled character, and nulls; the table is read once
    assert plan.count("EvalPython") == 1 and re.search(r"ArrowEvalPython \[_nfkc\(CASE WHEN ", plan) and plan.count("Scan") == 1


def test_settled_text_never_reaches_python(spark, monkeypatch):
    def broken(text):
        if text.notna().any():
            raise AssertionError("a text reached Python")
        return text

    monkeypatch.setattr(X, "_nfkc", F.pandas_udf(lambda text: broken(text), "string"))
    plain = spark.createDataFrame([("d", 1, "called 0412 345 678"), ("e", 1, "é ß ü ñ 日本 Ω ж"), ("f", 1, None), ("g", 1, "")], "doc_id string, page_num int, text string")
    assert [r.text for r in detect_lines(plain).collect()] == ["0412 345 678"]


@pytest.mark.parametrize("text", ["ﬁle", "e\u0301", "Ａ", "\u00a0", "½", "\u1100\u1161", "한글", "é", "ẛ̣", "〱", "𝐀", "ｶﾞ"])
def test_what_nfkc_changes_is_not_settled(spark, text):
    import unicodedata

    made = X.normalise(spark.createDataFrame([(text,)], "text string")).first().text
    assert made == unicodedata.normalize("NFKC", text)


def test_registry_can_be_extended(spark):
    from dataclasses import replace

    mine = replace(REGISTRY[0], category="Badge", patterns=(r"B-\d+",), gate="B-")
    pages = spark.createDataFrame([("d", 1, "my B-12")], "doc_id string, page_num int, text string")
    assert [(r.text, r.category) for r in detect_lines(pages, registry=[mine]).collect()] == [("B-12", "Badge")]


def test_short_names_stay_only_if_whole(spark):
    rows = spark.createDataFrame([("Jo Li",), ("Li",), ("",), (None,)], "n string").select("n", N.variations(F.col("n")).alias("v")).collect()
    assert [r.v for r in rows] == [["Jo Li", "J. Li", "Jo L.", "J.L."], ["Li"], [], []]


def roster(spark, student, *mentions, parents=()):
    cases = spark.createDataFrame([("c", student, list(parents), [], [])], CASE)
    chosen = spark.createDataFrame([("c", "d", i, t, "Person name (NER)") for i, t in enumerate(mentions)] or [], "case_id string, doc_order string, match_idx int, text string, category string")
    made = who.build_rosters(cases, chosen)
    owners = who.owner_labels(made)
    return owners, who.form_labels(made, owners)


def test_first_name_shared_with_a_classmate(spark):
    _, forms = roster(spark, "Torvin Vardane", "Torvin Quill")
    got = {r.form: r.label for r in forms.collect()}
    assert got["torvin"] == "[Student]" and got["quill"] == "[Other person]"


@pytest.mark.parametrize("order", [("Sidonie Harcastle", "S. Harcastle"), ("S. Harcastle", "Sidonie Harcastle"), ("Ms Sidonie Harcastle", "Sidonie H.", "S. Harcastle")])
def test_written_forms_of_one_person_share_a_label(spark, order):
    owners, _ = roster(spark, "Torvin Vardane", *order)
    assert [(r.full_name, r.label) for r in owners.where("seq > 0").collect()] == [("Sidonie Harcastle", "[Other person]")]


def test_shared_surname_is_the_familys(spark):
    _, forms = roster(spark, "Torvin Vardane", "Sidonie Harcastle", "Rufaro Harcastle")
    got = {r.form: r.label for r in forms.collect()}
    assert got["harcastle"] == "[Family name]" and got["sidonie"] == "[Other person 1]" and got["rufaro"] == "[Other person 2]"
    assert who.ambiguity_notes(forms).count() == 1


def test_dedup_keeps_first_of_equals_and_last_only_if_better(spark):
    schema = "doc_id string, page_num int, line_num int, text string, category string, confidence double, context string, source string, ord array<int>"
    rows = [("d", 1, 1, "Quenna", c, p, "", "regex", [i]) for i, (c, p) in enumerate((("A", 0.5), ("B", 0.5), ("C", 0.9), ("D", 0.9)))]
    got = R.rank_matches(R.dedup_matches(spark.createDataFrame(rows, schema))).collect()
    assert [(r.category, r.match_idx, r.first_ord) for r in got] == [("C", 0, [0])]


def test_matches_of_documents_without_an_id_or_with_a_shared_one(spark, tmp_path):
    docs = [(None, "n1@b.com n2@b.com", "en"), (None, "\nn3@b.com", "en"), (7, "s1@b.com 0412345678", "en"), (7, "s1@b.com", "fr"), (7, "\ns2@b.com", "fr"), (8, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("a")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for query in (registry.w01_match_dedup, registry.j04_selected, registry.u03_deselected, registry.a02_by_category, registry.d_documents):
        oracle.check(query(spark, str(tmp_path)), ORACLES[query.__name__], con)


def test_labels_are_not_searched_again(spark):
    pages = spark.createDataFrame([("c", "d", 1, "Person met Sidonie Harcastle.")], PAGE)
    cases = spark.createDataFrame([("c", "Person Tibbance", [], [], [])], CASE)
    schema = "case_id string, doc_id string, match_idx int, text string, category string, confidence double, page_num int, line_num int, context string, source string"
    ranked = spark.createDataFrame([("c", "d", 0, "Person", "Student name", 0.95, 1, 1, "", "r"), ("c", "d", 1, "Sidonie Harcastle", "Person name (NER)", 0.9, 1, 1, "", "r")], schema)
    out = deidentify(pages, cases, ranked)["results"].first()
    assert out.body.endswith("[Student] met [Other person].") and out.n_replaced == 2 and out.status == "written"


def test_address_over_two_cells_is_replaced_and_verified(spark):
    pages = spark.createDataFrame([("c", "d", 1, f"81 Fennick Street{W.CELL}Ostmere VIC 3001")], PAGE)
    cases = spark.createDataFrame([("c", "Oswick Munrose", [], [], [])], CASE)
    ranked = spark.createDataFrame([("c", "d", 0, "81 Fennick Street Ostmere VIC 3001", "Address", 0.95, 1, 1, "", "r")], "case_id string, doc_id string, match_idx int, text string, category string, confidence double, page_num int, line_num int, context string, source string")
    out = deidentify(pages, cases, ranked)["results"].first()
    assert "[address]" in out.body and out.status == "written"


def test_scanned_page_with_a_near_miss_is_quarantined(spark):
    pages = spark.createDataFrame([("c", "d", 1, "Sidonie was here", "native"), ("c", "d", 2, "Sidonle left", "ocr")], PAGE + ", method string")
    cases = spark.createDataFrame([("c", "Sidonie Lee", [], [], [])], CASE)
    out = deidentify(pages, cases, detect(pages, cases))["results"].first()
    assert out.status == "quarantined" and out.leftovers == ["Sidonie"]


def test_form_words_stay(spark):
    forms = spark.createDataFrame([("c", "oswick munrose", 0, "[Student]"), ("c", "munrose", 1, "[Family name]"), ("d", "ann", 0, "[Parent]")], "case_id string, form string, at int, label string")
    rows = spark.createDataFrame([("c", "Phone:", "Parent/Guardian"), ("c", "Ann", "Parent/Guardian"), ("c", "Phone", "Phone number"), ("c", "dear Oswick  Munrose's", "Student name"), ("c", "the Munrose house", "Student name"), ("c", "Munrose's", "Address"), ("d", "Ann", None), (None, "Ann", "Student name")], "case_id string, text string, category string")
    got = {(r.case_id, r.text): (r.replaced, r.label) for r in who.resolve(rows, forms).collect()}
    assert got == {("c", "Phone:"): (False, "[name]"), ("c", "Ann"): (True, "[name]"), ("c", "Phone"): (True, "[phone]"), ("c", "dear Oswick  Munrose's"): (True, "[Student]"), ("c", "the Munrose house"): (True, "[Family name]"),
                   ("c", "Munrose's"): (True, "[Family name]"), ("d", "Ann"): (True, "[Parent]"), (None, "Ann"): (True, "[name]")}


def test_listed_names_are_trimmed_and_keep_their_digits(spark):
    got = found(spark, "0 Kim 0 and Lou 1", parents=[" Kim "], family=["Lou 1"], orgs=[])
    assert {x[0] for x in got} >= {"Kim", "Lou 1"}
