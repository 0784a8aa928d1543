"""Plans that hold at size: what may be broadcast, and how rows are dealt to tasks."""

import re

from pyspark.sql import functions as F

from quillmask.functions import patterns as P
from quillmask.functions.lexicons import FAMILY_KEYWORDS
from quillmask.functions.names import clean_person, variations
from quillmask.functions.text import spans
from quillmask.operators import detect, intervals, misread
from quillmask.operators.detect import _any, _mentions
from quillmask.plans import flows, invented, registry
from quillmask.plans.session import Kept, tasks_of
from tests import oracle


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_not_broadcast(spark):
    with Kept(spark) as kept:
        a, b = (kept.cut(spark.range(10).selectExpr("id", "array('one name') AS names")) for _ in range(2))
        assert "Broadcast" not in plan_of(a.join(b, "id"))
        assert "Broadcast" not in plan_of(a.selectExpr("id", "explode(names) AS name").join(b.groupBy("id").count(), "id", "left"))


def test_people_are_dealt_by_rows_and_not_broadcast(spark):
    rows = invented.people(spark, oracle.DATA)
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    plan = plan_of(invented.reports(rows).join(invented.cases(rows), "case_id"))
    assert "Broadcast" not in plan and plan.count("Exchange") <= 2  # dealt by case once, for both sides
    assert "Broadcast" not in plan_of(registry.d_detectors(spark, oracle.DATA))


def test_a_name_is_computed_once(spark):
    text = F.concat(F.lit("  Ms "), F.col("id").cast("string").substr(1, 0), F.lit("Sidonie  Harcastle"))
    rows = spark.range(1).select(variations(clean_person(text)).alias("forms"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Ms ") <= 1 and rows.first().forms[:3] == ["Sidonie Harcastle", "Sidonie", "Harcastle"]


def test_pages_are_searched_for_entities_once(spark):
    plan = registry.n08_entities(spark, oracle.DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and plan.count("Relation [") == 2  # pages, and the names of their cases


def test_spans_in_one_pass_are_those_of_the_pattern(spark):
    texts = ["abn: 11 222 333 444, abn 99888777666 1", "x﷐12﷑ y3", "\U0001f600 ABN 12345678901", "", "none", None]
    abn, digits = r"(?Ui)abn\s*:?\s*(\d{2}\s?\d{3}\s?\d{3}\s?\d{3})\b", r"\d+"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t"), digits).alias("n"), spans(F.col("t"), F.lit(abn), 1).alias("g"))
    assert spans(F.col("t"), digits)._jc.toString().count("regexp_extract_all") == 0
    for r in rows.collect():
        assert [tuple(s) for s in r.n] == [(m.start(), m.end(), m[0]) for m in re.finditer(digits, r.t or "")]
        assert [tuple(s) for s in r.g] == [(*m.span(1), m[1]) for m in re.finditer(abn.replace("(?Ui)", "(?i)"), r.t or "")]


def test_a_lookahead_in_front_changes_no_match(spark):
    long = "Flat 3/12 Corvane Road, Telmora VIC 34561 Fennick Lane, Ostmere NSW 2000\nNo 2013 at 4 Ut Court and 3Unit 5 Elm St, Foo VIC 3001"
    text = F.lit(long)
    for pattern, plain, flags in [(P.full_address(), rf"{P.UNIT}\d+\s+[A-Za-z\s]+(?:{P.STREETS}),?\s+[A-Za-z\s]+,?\s+(?:{P.STATES})\s+\d{{4}}", "(?Ui)"), (P.MEDICARE, r"\b\d{4}\s?\d{5}\s?\d\b", "(?U)"),
                                  (P.STREET_ONLY, rf"\b{P.UNIT}{P.STREET_LEAD}(?:{P.STREETS_FREE})\b|\b{P.UNIT}{P.STREET_LEAD}(?:{P.STREETS_ENDING})(?=[,.]|\s*$)", "(?U)")]:
        a, b = spark.range(1).select(spans(text, flags + pattern), F.regexp_extract_all(text, F.lit(flags + plain), F.lit(0))).first()
        assert [s.text for s in a] == b


def test_family_keywords_are_met_in_any_case_and_script(spark):
    lines = ["x", "the MOTHER", "Next of  kin", "Next of kin", "foster \t PARENT", "ſister K", "step-Mother", "Lives WITH", "gé aunt", "kinship"]
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select(_mentions(F.col("t"), FAMILY_KEYWORDS), F.col("t").rlike(_any(FAMILY_KEYWORDS))).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] and {r[0] for r in rows} == {True, False}


def test_misread_words_meet_within_their_document(spark):
    words = spark.createDataFrame([("a", "harcostle"), ("b", "plimner"), ("b", "harcastle")], "doc_id string, word string")
    items = spark.createDataFrame([("a", "Harcastle"), ("b", "Plimmer")], "doc_id string, text string")
    found = misread.misread_items(words, items)
    plan = plan_of(found)
    assert "_key" not in plan and plan.count("levenshtein") == 1 and plan.count("Join") == 1  # no pairs of all documents' words
    assert {tuple(r) for r in found.collect()} == {("a", "Harcastle", "harcastle", "harcostle"), ("b", "Plimmer", "plimmer", "plimner")}


def test_intervals_within_others_make_no_pairs(spark):
    left = spark.range(-60, 60).selectExpr("if(id % 7 = 0, null, 'k') AS k", "id AS s", "id + pmod(id, 9) AS e", "id AS a")
    right = spark.range(-60, 60, 11).selectExpr("'k' AS k", "id AS s2", "id + 8 AS e2").union(spark.sql("SELECT 'k', -50L, -20L"))
    free = [intervals.not_within(left, right, ["k"], ("s", "e"), ("s2", "e2"), ["a"], stretch) for stretch in (1, 4, 1024)]
    assert all("Join" not in plan_of(f) for f in free)
    spans_ = [(r.s2, r.e2) for r in right.collect()]
    want = [r.a for r in left.collect() if r.k is None or r.e <= r.s or not any(s <= r.s and r.e <= e for s, e in spans_)]
    assert all(sorted(r.a for r in f.collect()) == sorted(want) and f.columns == left.columns for f in free) and 0 < len(want) < 120


def test_distinct_values_are_dealt_by_rows(spark):
    plan = plan_of(registry.a16_sketches(spark, oracle.DATA))
    assert plan.count("REPARTITION_BY_NUM") == 2 and "Expand" not in plan
    assert tasks_of(10**9) == 4000 and tasks_of(1) == 2 * spark.sparkContext.defaultParallelism


def test_owners_and_forms_need_no_texts_rewritten(spark, monkeypatch):
    def never(*_):
        raise AssertionError("items were made")

    rows = invented.people(spark, oracle.DATA).where("k < 20")
    monkeypatch.setattr(registry, "_reports", lambda *_: (invented.reports(rows), invented.cases(rows)))
    whole = registry._run(spark, oracle.DATA)
    monkeypatch.setattr(flows, "replacements", never)
    known = registry._known(spark, oracle.DATA)
    for table in ("owners", "forms"):
        assert sorted(map(repr, known[table].collect())) == sorted(map(repr, whole[table].collect()))
    assert registry.e07_people(spark, oracle.DATA).count() == 2 * rows.count()


def test_lines_are_held_against_names_of_their_page_alone(spark):
    cases = spark.createDataFrame([("c", "Torvin Vardane", [], [], ["Telmora Primary School"])], registry.CASE)
    pages = spark.createDataFrame([("c", "d", 1, "at TELMORA\nby torvin")], registry.PAGE)
    rows = pages.join(detect.with_name_forms(cases), "case_id")
    held = rows.select(*[detect._held(F.col(c), F.col("text")).alias(c) for c in ("student_forms", "organisations")]).first()
    assert [r.v for r in held.student_forms] == ["Torvin"] and [r.v for r in held.organisations] == ["Telmora"]
    assert sorted(r.text for r in detect.detect_lines(pages, cases).collect()) == ["TELMORA", "torvin"]


def test_what_phone_numbers_begin_with_is_in_all_of_them():
    for number in ("+61 412 345 678", "+61 3 1234 5678", "03 1234 5678", "03.1234.5678", "(03) 1234 5678", "0412 345 678", "0412.345.678", "0412345678"):
        assert any(re.search(p, number) for p in P.PHONES) and re.search(P.PHONE_LEAD, number)
    assert not re.search(P.PHONE_LEAD, "Medicare 1234 56789 1, 05 1234 5678")
