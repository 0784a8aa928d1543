"""Column expressions over text, built from Spark's own functions; only normalise() leaves the JVM, for the few texts that
it may change."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicons import SHOWN_CATEGORIES
from .patterns import EDGE_AFTER, EDGE_BEFORE, PATHS, SEPARATOR

SPAN = "struct<start:int,end:int,text:string>"
#: Characters that no text is meant to hold (Unicode keeps them for use within a program): where a match begins, where it and its group
#: end, and what stands for either in a text that holds one nevertheless.
_MARKS = "\ufdd0\ufdd1\ufdd2"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _class(points: list[int]) -> str:
    first = [i for i, before in zip(points, [None, *points]) if before != i - 1]
    last = [i for i, after in zip(points, [*points[1:], None]) if after != i + 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last, strict=True)) + "]"


@cache
def unsettled() -> tuple[str, str]:
    """Two classes: all characters that NFKC may change, by themselves or behind another one (those with a form of their own,
    marks, and the second halves of composed ones; letters such as é or ß are none), and the Latin ones that it never changes."""
    every = [i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]
    pairs = (unicodedata.decomposition(chr(i)).split() for i in every)
    second = {int(p[1], 16) for p in pairs if len(p) == 2 and p[0][0] != "<"} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    odd = [i for i in every if i in second or unicodedata.combining(chr(i)) or unicodedata.normalize("NFKC", chr(i)) != chr(i)]
    return _class(odd), _class(sorted(set(range(0x250)) - set(odd)))


def normalise(df: DataFrame, column: str = "text") -> DataFrame:
    """df with column in NFKC and straight quotes. df is read once: Python is given a null for every text that holds no character of
    unsettled(), and those texts stay in the JVM. The class has hundreds of ranges, so it only sees what is not ASCII or settled Latin."""
    text, (may_change, plain) = F.col(column), unsettled()
    odd = (F.octet_length(text) != F.length(text)) & F.regexp_replace(text, plain + "+", "").rlike(may_change)
    rows = df.withColumn("_changed", _nfkc.asNondeterministic()(F.when(odd, text)))
    return rows.withColumn(column, F.translate(F.coalesce("_changed", text), "‘’“”", "''\"\"")).drop("_changed")


def to_lines(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line of each page: line_num from 1, line; a null text has no lines. Other columns stay."""
    split = pages.select(*[c for c in pages.columns if c != text_col], F.posexplode(F.split(text_col, "\n")).alias("_at", "line"))
    return split.withColumn("line_num", F.col("_at") + 1).drop("_at")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: within a lambda an expression is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quoted(text: Column) -> Column:
    """A pattern that matches text as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def parts(text: Column) -> Column:
    """Lower-case words of a chosen text between separators."""
    return F.filter(F.split(F.lower(text), "(?U)" + SEPARATOR + "+"), lambda t: t != "")


def loose_pattern(text: Column) -> Column:
    """A pattern for a text whose words may be parted by any separators or none; empty for a text of separators."""
    return F.array_join(F.transform(parts(text), quoted), SEPARATOR + "*")


def visible(text: Column, haystack: Column) -> Column:
    """Whether a text still stands in haystack as whole words, with a possessive s or without."""
    pattern = F.concat(F.lit("(?Ui)" + EDGE_BEFORE), loose_pattern(text), F.lit("(?:['’]s)?" + EDGE_AFTER))
    return (F.size(parts(text)) > 0) & F.regexp_like(haystack, pattern)


def spans(text: Column, pattern: Column | str, group: int = 0) -> Column:
    """All matches of pattern as array of SPAN: 0-based start, end after the last, and the text of group; none of a null text. One pass
    of the pattern puts marks around the matches, and the text is cut at the marks. Offsets of group 1 assume that its text is the
    last such text in the match."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    begin, end, other = _MARKS
    free = F.when(F.contains(text, F.lit(begin)) | F.contains(text, F.lit(end)), F.translate(text, begin + end, other + other)).otherwise(text)
    marked = F.regexp_replace(free, p, F.lit(f"{begin}$0{end}$1{end}" if group else f"{begin}$0{end}"))
    none = F.array().cast(f"array<{SPAN}>")

    def more(so_far: Column, x: Column) -> Column:
        """x is a match, a mark, the group and a mark if one is asked for, and what lies before the next match."""
        start = so_far["at"]
        if group:
            h, g = F.substring_index(x, end, 1), F.get(F.split(x, end, 3), F.lit(1))
            size, at = F.length(g), start + F.length(h) - F.call_function("instr", F.reverse(h), F.reverse(g)) + 1 - F.length(g)
            after = start + F.length(x) - size - 2
        else:
            size, at = F.call_function("instr", x, F.lit(end)) - 1, start
            after = start + F.length(x) - 1
        one = F.struct(at.alias("start"), (at + size).alias("end"), F.substring(text, at + 1, size).alias("text"))
        return F.struct(after.alias("at"), F.concat(so_far["out"], F.array(one)).alias("out"))

    def cut(parts: Column) -> Column:
        zero = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none.alias("out"))
        return F.aggregate(F.slice(parts, 2, F.size(parts)), zero, more, lambda s: s["out"])

    # a fixed pattern is tried first, as most texts hold no match
    there = F.regexp_like(text, p) if isinstance(pattern, str) else text.isNotNull()
    return F.when(there, bind(F.split(marked, begin, -1), cut)).otherwise(none)


def context(line: Column, start: Column, end: Column, width: int = 50) -> Column:
    """The match between ** with up to width characters on both sides, between dots."""
    low = F.greatest(start - width, F.lit(0))
    parts = F.substring(line, low + 1, start - low), F.substring(line, start + 1, end - start), F.substring(line, end + 1, F.lit(width))
    return F.btrim(F.concat(F.lit("..."), parts[0], F.lit("**"), parts[1], F.lit("**"), parts[2], F.lit("...")))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def split_context(text: Column) -> Column:
    """Segments of a context as array of struct<text, matched>: what stands between ** pairs is matched; none of empty text."""
    pattern = F.lit(r"(?s)\*\*(.+?)\*\*")
    marked, plain = F.regexp_extract_all(text, pattern, F.lit(1)), F.split(text, pattern, -1)
    piece = lambda x, matched: F.struct(x.alias("text"), F.lit(matched).alias("matched"))
    pairs = F.transform(plain, lambda x, i: F.when(i < F.size(marked), F.array(piece(x, False), piece(F.get(marked, i), True))).otherwise(F.array(piece(x, False))))
    return F.filter(F.flatten(pairs), lambda s: s["text"] != "")


def friendly_category(category: Column) -> Column:
    """The name shown for a category; others are shown as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SHOWN_CATEGORIES.items() for x in kv])[category], category)


def scrub_paths(text: Column) -> Column:
    """Windows, network and Unix paths replaced by a remark."""
    for pattern in PATHS:
        text = F.regexp_replace(text, pattern, "[path removed]")
    return F.coalesce(text, F.lit(""))


def name_list(text: Column) -> Column:
    """Names of a list separated by commas, trimmed, without empty ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")
