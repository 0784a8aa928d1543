"""Detectors: pages of text to matches, in one pass over the lines and in the JVM.

Each detector is an expression that yields an array of matches for a line; the arrays of all detectors are joined and
unfolded once, so a page is read, split and searched in a single stage. Cheap conditions stand before costly patterns.
Every match carries ord, its place in the order of detection, which decides ties in later steps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.lexicons import FAMILY_KEYWORDS, NOT_NAMES, PARENT_HINTS
from ..functions.names import nicknames, organisation_forms, tokens, variations
from ..functions.text import bind, context, normalise, quoted, spans

MATCH = "struct<text:string,category:string,confidence:double,line_num:int,context:string,ord:array<int>>"
KEYS = ("case_id", "doc_id", "page_num")
#: Columns of with_name_forms that are looked for line by line.
LISTS = ("student_forms", "nick_forms", "parents", "family", "organisations")


@dataclass(frozen=True)
class Detector:
    """A row of the detector registry: patterns over a line, after an optional condition. With below, the line after one that
    fulfils the condition but holds no match is searched too, at that confidence."""

    rank: int
    category: str
    confidence: float
    patterns: tuple[str, ...]
    gate: str | None = None
    group: int = 0
    below: float | None = None
    flags: str = "(?U)"


def _any(words: list[str]) -> str:
    return "(?Ui)" + "|".join(words)


def _ascii(line: Column) -> Column:
    return F.octet_length(line) == F.length(line)


def _mentions(line: Column, words: list[str]) -> Column:
    """Whether a line holds any of many words (patterns), whatever their case. In an ASCII line, where no other letter counts as one of theirs, a
    case is the only difference, and lower case with alternatives that begin alike put together is many times as fast."""
    by: dict[str, list[str]] = {}
    for w in sorted({w.lower() for w in words}):
        by.setdefault(w[0], []).append(w[1:])
    plain = f"[{''.join(by)}](?:" + "|".join(f"(?<={first})(?:{'|'.join(rest)})" for first, rest in by.items()) + ")"
    return F.when(_ascii(line), F.regexp_like(F.lower(line), F.lit(plain))).otherwise(F.regexp_like(line, F.lit(_any(words))))


#: Detectors that need no case: rank is the order in which they run on a line.
REGISTRY = [
    Detector(3, "Phone number", 0.95, tuple(P.PHONES), gate=P.PHONE_LEAD),
    Detector(4, "Email address", 0.95, (P.EMAIL,), gate="@"),
    Detector(5, "Address", 0.95, (P.full_address(),), gate=r"\d{4}", flags="(?Ui)"),
    Detector(7, "Medicare number", 0.95, (P.MEDICARE,), gate="(?i)medicare", below=0.90),
    Detector(8, "Centrelink CRN", 0.65, (P.CRN,), gate="(?i)crn", below=0.60),
    Detector(10, "Date of birth", 0.95, tuple(P.DATES), gate=_any(P.DOB_LABELS), below=0.90),
    Detector(17, "NDIS number", 0.90, (P.NDIS,), gate=r"\d{9}", group=1, flags="(?Ui)"),
    Detector(18, "ABN", 0.90, (P.ABN,), gate="(?i)abn", group=1, flags="(?Ui)"),
    Detector(19, "Passport number", 0.65, (P.PASSPORT,), gate="(?i)passport", group=1, flags="(?Ui)"),
]


def _none() -> Column:
    return F.array().cast(f"array<{MATCH}>")


def _match(s: Column, category: Column | str, confidence: Column | float, line: Column, line_num: Column, emitted: Column, rank: int, first: Column | int, second: Column | int = 0, shown: Column | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    order = F.array(*[as_col(x).cast("int") for x in (emitted, rank, first, second, s["start"])])
    return F.struct(s["text"].alias("text"), as_col(category).alias("category"), as_col(confidence).cast("double").alias("confidence"), line_num.cast("int").alias("line_num"),
                    (context(line, s["start"], s["end"]) if shown is None else shown).alias("context"), order.alias("ord"))


def _by_patterns(d: Detector, line: Column, below: Column, n: Column) -> Column:
    def over(text: Column, num: Column, confidence: float) -> Column:
        """The spans of each pattern, with its number, made into matches at once."""
        each = F.flatten(F.array(*[F.transform(spans(text, d.flags + p, d.group), lambda s, i=i: F.struct(s.alias("s"), F.lit(i).alias("i"))) for i, p in enumerate(d.patterns)]))
        return F.transform(each, lambda r: _match(r["s"], d.category, confidence, text, num, n, d.rank, r["i"]))

    here = over(line, n, d.confidence)
    if d.below is not None:
        any_here = reduce(Column.__or__, [F.regexp_like(line, F.lit(d.flags + p)) for p in d.patterns])
        here = F.when(any_here, here).otherwise(F.coalesce(over(below, n + 1, d.below), _none()))
    return F.when(F.regexp_like(line, F.lit(d.gate)), here).otherwise(_none()) if d.gate else here


def _street_only(line: Column, n: Column) -> Column:
    """Addresses without state and postcode that lie within no full one."""
    full = spans(line, "(?Ui)" + P.full_address())
    free = F.filter(spans(line, "(?U)" + P.STREET_ONLY), lambda s: ~F.exists(full, lambda f: (s["start"] >= f["start"]) & (s["end"] <= f["end"])))
    return F.when(F.regexp_like(line, F.lit(r"\d\s+[A-Z]")), F.transform(free, lambda s: _match(s, "Address", 0.65, line, n, n, 6, 0))).otherwise(_none())


def _family(line: Column, below: Column, n: Column) -> Column:
    """Names after family keywords: after a colon or space, in brackets, after a comma; else at the start of the next line."""
    word = lambda k: F.concat(F.lit(r"(?U)\b(?i:"), k, F.lit(")"))
    # which keywords a line holds is tested with constant patterns; only those of the ones it holds are put together a line
    low = F.lower(line)
    of_keyword = lambda i, k: F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit("Parent/Guardian" if any(h in k.lower() for h in PARENT_HINTS) else "Family member").alias("c"))
    there = bind(low, lambda low: F.array_compact(F.array(*[F.when((F.contains(low, F.lit(re.split(r"\W", k.lower())[0])) | ~_ascii(line)) & F.regexp_like(line, F.lit(rf"(?U)\b(?i:{k})")), of_keyword(i, k)) for i, k in enumerate(FAMILY_KEYWORDS)])))
    forms = [r"[:\s]+" + P.NAME, r"\s*\(\s*" + P.NAME + r"\s*\)", r",\s+" + P.NAME]

    def of(r: Column) -> Column:
        one = lambda f, j: F.transform(F.filter(spans(line, F.concat(word(r["k"]), F.lit(f)), 1), lambda s: ~F.lower(s["text"]).isin(NOT_NAMES)), lambda s: _match(s, r["c"], 0.65, line, n, n, 14, r["i"], j))
        here = F.concat(*[one(f, j) for j, f in enumerate(forms)])
        next_ = F.btrim(below)
        name = F.regexp_extract(next_, "(?U)^" + P.NAME, 1)
        s = F.struct(F.lit(0).alias("start"), F.length(name).alias("end"), name.alias("text"))
        fallback = F.when((name != "") & ~F.lower(name).isin(NOT_NAMES) & F.regexp_like(line, F.concat(word(r["k"]), F.lit(r"\b"))), F.array(_match(s, r["c"], 0.60, below, n + 1, n, 14, r["i"], 9, F.substring(next_, 1, 80)))).otherwise(_none())
        return bind(here, lambda here: F.when(F.size(here) > 0, here).otherwise(F.coalesce(fallback, _none())))

    found = F.flatten(F.transform(there, of))
    return F.when(_mentions(line, FAMILY_KEYWORDS), found).otherwise(_none())


def _held(names: Column, text: Column) -> Column:
    """Those names of a list, with their lower case and place in it, that a text holds, whatever their case."""
    each = F.transform(names, lambda v, i: F.struct(v.alias("v"), F.lower(v).alias("low"), i.alias("i")))
    return bind(F.lower(text), lambda low: F.filter(each, lambda r: F.contains(low, r["low"])))


def _listed(names: Column, category: str, confidence: float, rank: int, line: Column, n: Column) -> Column:
    """Whole-word occurrences of the names that _held gives for the page, whatever their case."""
    held = bind(F.lower(line), lambda low: F.filter(names, lambda r: F.contains(low, r["low"])))
    pattern = lambda v: F.concat(F.lit(r"(?Ui)\b"), quoted(v), F.lit(r"\b"))
    return F.flatten(F.transform(held, lambda r: F.transform(spans(line, pattern(r["v"])), lambda s: _match(s, category, confidence, line, n, n, rank, r["i"]))))


def with_name_forms(cases: DataFrame) -> DataFrame:
    """cases (case_id, student_name, parent_names, family_names, organisation_names) with the forms that detectors look for."""
    empty = F.array().cast("array<string>")
    trimmed = lambda c: F.filter(F.transform(F.coalesce(F.col(c), empty), lambda x: F.btrim(x)), lambda x: x != "")
    student = F.btrim(F.coalesce(F.col("student_name"), F.lit("")))
    surname = F.coalesce(F.try_element_at(tokens(student), F.lit(-1)), F.lit(""))
    return cases.select("case_id", student.alias("student"), variations(student).alias("student_forms"), nicknames(student).alias("nick_forms"),
                        trimmed("parent_names").alias("parents"), trimmed("family_names").alias("family"),
                        F.flatten(F.transform(trimmed("organisation_names"), organisation_forms)).alias("organisations"),
                        F.upper(F.substring(surname, 1, 3)).alias("id_prefix"))


def detect_lines(pages: DataFrame, cases: DataFrame | None = None, registry: list[Detector] | None = None, normalised: bool = False) -> DataFrame:
    """Matches (pages' keys, text, category, confidence, page_num, line_num, context, ord, source) of pages (case_id if cases
    are given, doc_id, page_num, text). Text is normalised first, unless it is already. Null and empty pages have no matches."""
    registry = REGISTRY if registry is None else registry
    keys = [c for c in KEYS if c in pages.columns]
    rows = pages.select(*keys, "text")
    rows = rows if normalised else normalise(rows)
    forms: list[str] = []
    if cases is not None:  # joined to pages, before they become many lines; a line is only held against names that its page holds
        forms = [*LISTS, "id_prefix"]
        rows = rows.join(with_name_forms(cases), "case_id").select(*keys, "text", *[_held(F.col(c), F.col("text")).alias(c) for c in LISTS], "id_prefix")
    # the next line comes from the same array of lines, so looking at it needs no shuffle
    split = rows.select(*keys, *forms, F.split("text", "\n").alias("_lines"))
    lines = split.select(*keys, *forms, "_lines", F.posexplode("_lines").alias("_at", "line"))
    lines = lines.select(*keys, *forms, (F.col("_at") + 1).alias("line_num"), "line", F.get("_lines", F.col("_at") + 1).alias("below"))
    line, after, n = F.col("line"), F.col("below"), F.col("line_num")
    parts = [_by_patterns(d, line, after, n) for d in registry]
    if registry is REGISTRY:
        parts += [_street_only(line, n), _family(line, after, n)]
    if cases is not None:
        identity = F.transform(spans(line, "(?U)" + P.STUDENT_ID), lambda s: _match(s, "Student ID", F.when(F.substring(s["text"], 1, 3) == F.col("id_prefix"), 0.95).otherwise(0.65), line, n, n, 9, 0))
        parts += [_listed(F.col("student_forms"), "Student name", 0.95, 1, line, n), _listed(F.col("nick_forms"), "Student name (nickname)", 0.75, 2, line, n), identity,
                  _listed(F.col("parents"), "Parent/Guardian (user-provided)", 0.95, 15, line, n), _listed(F.col("family"), "Family member (user-provided)", 0.95, 15, line, n),
                  _listed(F.col("organisations"), "Organisation name", 0.95, 16, line, n)]
    found = lines.where(F.length("line") > 0).select(*keys, F.inline(F.concat(*parts)))
    return found.withColumn("source", F.lit("regex"))
