"""Joins on names, misread words, intervals and times against brute force on random and odd rows."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmask.operators import asof, intervals, lexicon, misread
from quillmask.operators.detect import detect_lines
from quillmask.operators.review import dedup_matches

LINES = "case_id string, doc_id string, line_num int, line string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_found_as_one_by_one(spark):
    rng = random.Random(1)
    vocabulary = "anna ann lee o'neil mary-jane (x) e. r. straße ÉLODIE élodie a.b zoë van der berg 12 x_1 .".split()
    lines = [("c" if rng.random() < 0.7 else None if rng.random() < 0.2 else "d", f"d{i % 7}", i, rng.choice((" ", "  ", ", ")).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [("c", "d0", 900, None), ("c", "d0", 901, "")]
    names = [(c, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3)))) for c in ("c", "d", "e") for _ in range(60)] + [("c", None), ("c", ""), ("c", "..."), (None, "anna"), ("c", "anna"), ("c", "anna")]
    got = lexicon.lexicon_join(spark.createDataFrame(lines, LINES), spark.createDataFrame(names, "case_id string, name string"), ["case_id"], ["doc_id", "line_num"])
    want = Counter()
    word = r"[\w]"
    for c, d, n, line in lines:
        for case, name in set(names):
            if c is None or case != c or not line or not name or not re.search(r"\w", name):
                continue
            bound = lambda ch, before: (rf"(?<!{word})" if before else rf"(?!{word})") if re.match(word, ch) else (rf"(?<={word})" if before else rf"(?={word})")
            for m in re.finditer(bound(name[0], True) + re.escape(name) + bound(name[-1], False), line, re.I):
                want[c, d, n, name, m.start(), m.end(), m[0]] += 1
    assert Counter(tuple(r[c] for c in ("case_id", "doc_id", "line_num", "name", "start", "end", "text")) for r in got.collect()) == want and len(want) > 200
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_tokens_of_a_line_are_not_made_again_to_see_whether_there_are_any(spark):
    """explode() gets such a filter from the optimiser, which is put below the projection that makes the tokens."""
    lines, names = spark.createDataFrame([("1", "a", 1, "Ann Lee was here")], LINES), spark.createDataFrame([("1", "ann lee")], "case_id string, name string")
    plan = lexicon.lexicon_join(lines, names, ["case_id"], ["doc_id", "line_num"])._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and lexicon.TOKEN in x and "size(" in x and "lower(line" in x]



def test_fused_names_take_the_longest_and_do_not_overlap(spark):
    lines = spark.createDataFrame([("c", "d", 1, "Ann Lee met ann and Lee Ann Lee")], LINES)
    names = spark.createDataFrame([("c", "Ann"), ("c", "Ann Lee"), ("c", "Lee")], "case_id string, name string")
    got = [(r.start, r.text) for r in lexicon.fused_matches(lines, names, ["case_id"], ["doc_id", "line_num"]).orderBy("start").collect()]
    assert got == [(0, "Ann Lee"), (12, "ann"), (20, "Lee"), (24, "Ann Lee")]


def test_listed_names_are_those_of_the_detectors(spark):
    pages = spark.createDataFrame([("c", "d", 1, "Torvin Vardane came\nMaelis Oskeld and MAELIS OSKELD"), ("c", "e", 2, None), ("x", "f", 1, "Maelis Oskeld")], "case_id string, doc_id string, page_num int, text string")
    cases = spark.createDataFrame([("c", "", ["Maelis Oskeld"], [], [])], "case_id string, student_name string, parent_names array<string>, family_names array<string>, organisation_names array<string>")
    names = spark.createDataFrame([("c", "Maelis Oskeld", "Parent/Guardian (user-provided)", 0.95, 15)], "case_id string, name string, category string, confidence double, rank int")
    columns = ["doc_id", "page_num", "line_num", "text", "category", "confidence", "context", "source"]
    want = detect_lines(pages, cases, registry=[]).where("category like 'Parent%'").select(columns).collect()
    got = lexicon.listed_matches(pages, names)
    assert sorted(got.select(columns).collect()) == sorted(want) and len(want) == 2
    assert dedup_matches(got).count() == 1


def test_misread_words_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    base = ["harcastle", "plimmer", "ansgar", "woldt", "éèêëçñ", "o", "four", "x" * 17, "responsibilities" + "abcdefgh", "internationalisation", "straße", "abcde12", "ｈｅｌｌｏ"]

    def changed(w):
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w = rng.choice((w[:i] + rng.choice("aeé9") + w[i:], w[:i] + w[i + 1 :], w[:i] + "e" + w[i + 1 :]))
        return w

    words = {changed(rng.choice(base)) for _ in range(700)} | {"", "a" * 300}
    tokens = {changed(rng.choice(base)) for _ in range(150)} | set(base)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {(w, t) for t in tokens if len(t) >= 5 and t.isalpha() for w in words if abs(len(w) - len(t)) <= 2 and distance(w, t) <= (1 if len(t) <= 7 else 2)}
    w, t = spark.createDataFrame([(x,) for x in words] + [(None,)], "word string"), spark.createDataFrame([(x,) for x in tokens] + [(None,)], "token string")
    got = misread.near_words(w, t)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100 and any(len(x) > misread.LONG for _, x in want)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_misread_items_of_documents(spark):
    words = spark.createDataFrame([("a", "Harcostle,"), ("a", "Plimmer"), ("b", "harcastle"), ("b", None), (None, "harcastle")], "doc_id string, word string")
    items = spark.createDataFrame([("a", "Sidonie Harcastle"), ("b", "Plimmer"), ("b", "Harcastles"), (None, "harcastle"), ("a", None)], "doc_id string, text string")
    assert {tuple(r) for r in misread.misread_items(words, items).collect()} == {("a", "Sidonie Harcastle", "harcastle", "harcostle"), ("b", "Harcastles", "harcastles", "harcastle")}


def intervals_of(rng, n, name):
    rows = []
    for i in range(n):
        start = rng.choice((rng.randint(-50, 200), rng.randint(-(10**12), 10**12)))
        size = rng.choice((0, 1, 1, 2, 3, 4, 7, 8, 9, 64, rng.randint(1, 300), 10**9, -1))
        rows.append((rng.choice(("k", "k", "l", None)), None if rng.random() < 0.05 else start, None if rng.random() < 0.05 else start + size, f"{name}{i}"))
    return rows + rows[:3]


@pytest.mark.parametrize("within", [False, True])
def test_intervals_meet_as_all_pairs_do(spark, within):
    rng = random.Random(3)
    a, b = intervals_of(rng, 150, "a"), intervals_of(rng, 150, "b")
    want = Counter()
    for k, s, e, x in a:
        for k2, s2, e2, y in b:
            if None not in (k, s, e, s2, e2) and k == k2 and e > s and e2 > s2 and ((s >= s2 and e <= e2) if within else (s < e2 and s2 < e)):
                want[x, y] += 1
    left, right = spark.createDataFrame(a, "k string, s long, e long, a string"), spark.createDataFrame(b, "k string, s2 long, e2 long, b string")
    got = intervals.overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), within)
    assert Counter((r.a, r.b) for r in got.collect()) == want and len(want) > 100
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    if within:
        inside = {x for x, _ in want}
        free = intervals.not_within(left, right, ["k"], ("s", "e"), ("s2", "e2"), ["a"])
        assert Counter(r.a for r in free.collect()) == Counter(x for _, _, _, x in a if x not in inside)
    assert intervals.overlap_join(left.limit(0), right, ["k"], ("s", "e"), ("s2", "e2"), within).count() == 0
    with pytest.raises(ValueError):
        intervals.overlap_join(left, left, ["k"], ("s", "e"), ("s", "e"))


def test_overlapping_matches_are_settled(spark):
    rng = random.Random(4)
    rows = [(f"d{i % 5}", s, s + rng.randint(1, 12), rng.choice(("manual", "regex", "ner")), rng.choice((0.65, 0.9, 0.95)), f"t{i}") for i in range(200) for s in [rng.randint(0, 90)]]
    want = set()
    for doc in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (("manual", "regex", "ner").index(r[3]), -r[4], r[1] - r[2], r[1], r[1:])):
            if not any(k[1] < r[2] and r[1] < k[2] for k in kept):
                kept.append(r)
        want |= set(kept)
    df = spark.createDataFrame(rows, "doc_id string, start int, end int, source string, confidence double, text string")
    assert {tuple(r) for r in intervals.settle(df, ["doc_id"]).collect()} == want
    assert intervals.settle(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("before,within", [(False, None), (True, None), (False, 500), (True, 500)])
@pytest.mark.parametrize("stretch", [1, 60, 10**9])
def test_each_row_finds_the_last_one_before_it(spark, before, within, stretch):
    rng = random.Random(5)
    zero = datetime(2024, 3, 31, 0, 30)
    time = lambda: None if rng.random() < 0.05 else zero + timedelta(seconds=rng.randint(0, 3000), microseconds=rng.choice((0, 1, 500_000)))
    key = lambda: rng.choice(("a", "a", "a", "b", None))
    left, right = [(key(), time(), i) for i in range(120)], [(key(), time(), i) for i in range(60)]
    left, right = left + left[:2], right + [(k, t, i + 1000) for k, t, i in right[:5]]
    want = Counter()
    for k, t, i in left:
        fine = [(t2, j) for k2, t2, j in right if k is not None and k2 == k and t is not None and t2 is not None and (t2 < t if before else t2 <= t)]
        best = max(fine, default=None)
        if best and within is not None and (t - best[0]).total_seconds() > within:
            best = None
        want[i, best[1] if best else None] += 1
    a, b = spark.createDataFrame(left, "k string, t timestamp_ntz, i int"), spark.createDataFrame(right, "k string, t2 timestamp_ntz, j int")
    for x, y in ((a, b), (a.withColumn("t", F.col("t").cast("timestamp")), b.withColumn("t2", F.col("t2").cast("timestamp")))):
        got = asof.asof_join(x, y, ["k"], "t", "t2", stretch, within, before)
        assert got.columns == ["k", "t", "i", "t2", "j"] and Counter((r.i, r.j) for r in got.collect()) == want


def test_as_of_joins_of_nothing_and_of_clashes(spark):
    a = spark.createDataFrame([("a", datetime(2024, 1, 1), 1)], "k string, t timestamp, i int")
    b = spark.createDataFrame([], "k string, t2 timestamp, j int")
    assert [(r.i, r.j) for r in asof.asof_join(a, b, ["k"], "t", "t2").collect()] == [(1, None)] and asof.asof_join(a.limit(0), b, ["k"], "t", "t2").count() == 0
    for bad in (b.withColumnRenamed("j", "i"), b.withColumn("t2", F.col("t2").cast("timestamp_ntz"))):
        with pytest.raises(ValueError):
            asof.asof_join(a, bad, ["k"], "t", "t2")


def test_only_keys_that_names_ask_for_leave_a_task(spark):
    schema = "scope string, name string"
    names = spark.createDataFrame([("a", "Sidonie Harcastle"), ("a", "Woldt"), ("b", "Rufaro Plimmer"), (None, "Nobody")], schema)
    lines = spark.createDataFrame([("a", 1, "by sidonie harcastle and rufaro plimmer"), ("b", 2, "rufaro plimmer met woldt"), ("a", 3, None), ("a", 4, "seen by WOLDT")], "scope string, n int, line string")
    rows = lines.where("line is not null").withColumn("_tokens", lexicon.keys_of(F.col("line"), False))
    asked = names.select("scope", F.explode(lexicon.keys_of(F.col("name"), True)).alias("token"))
    left = lexicon._asked_tokens(rows, ["scope", "n"], asked, ["scope"]).collect()
    assert sorted((r.n, r.token.replace("\u0001", " ")) for r in left) == [(1, "sidonie harcastle"), (2, "rufaro plimmer"), (4, "woldt")]
    assert lexicon._asked_tokens(rows, ["scope", "n"], asked.limit(0), ["scope"]).count() == 0
    got = lexicon.lexicon_join(lines, names, ["scope"], ["n"]).collect()
    assert sorted((r.n, r.name, r.text) for r in got) == [(1, "Sidonie Harcastle", "sidonie harcastle"), (2, "Rufaro Plimmer", "rufaro plimmer"), (4, "Woldt", "WOLDT")]
