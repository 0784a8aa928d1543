"""Rewriting text with labels, and checking that nothing chosen is left in it.

Replacement and verification build their patterns from one function, so what the check would find is what was replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.lexicons import CATEGORY_LABELS, SHARED_SURNAME, SOME_NAME, SOME_ORGANISATION, SOMETHING
from ..functions.text import bind, loose_pattern, parts, quoted, visible
from .people import resolve

#: Stands between the cells of a table row while text is rewritten and checked; matches may span it.
CELL = "\u2028"
ITEMS = "array<struct<n:int,at:int,raw:string,label:string,key:string,pattern:string>>"


def _squeezed(text: Column) -> Column:
    return F.array_join(parts(text), "")


def replacements(chosen: DataFrame, forms: DataFrame) -> DataFrame:
    """(case_id, doc_id, items: ITEMS) of chosen matches: distinct texts that are to be replaced, longest first, each with its
    label, its words run together and its pattern. forms (case_id, form, at, label) come from people.form_labels."""
    rows = chosen.withColumn("raw", F.btrim("text")).where(F.length("raw") >= 2)
    rows = rows.groupBy("case_id", "doc_id", F.lower("raw").alias("_low")).agg(F.min_by(F.struct("raw", "category"), "match_idx").alias("m"), F.min("match_idx").alias("at"))
    # the first category seen decides both whether and how a text is replaced
    rows = resolve(rows.select("case_id", "doc_id", "at", F.col("m.raw").alias("text"), F.col("m.category").alias("category")), forms)
    rows = rows.where(F.col("replaced") & (F.size(parts(F.col("text"))) > 0))
    item = F.struct((-F.length("text")).alias("n"), "at", F.col("text").alias("raw"), "label", _squeezed(F.col("text")).alias("key"), loose_pattern(F.col("text")).alias("pattern"))
    return rows.groupBy("case_id", "doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def rewrite(text: Column, items: Column) -> tuple[Column, Column]:
    """(text with every item replaced by its label, number of replacements), in one pass: labels are never searched again, and
    longer items go first. Null items leave the text as it is."""
    alternatives = F.array_join(F.transform(items, lambda i: i["pattern"]), "|")
    pattern = F.concat(F.lit("(?Ui)" + P.EDGE_BEFORE + "(?:"), alternatives, F.lit(")" + P.EDGE_AFTER))
    hits, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    label = lambda key: F.coalesce(F.get(F.filter(items, lambda i: i["key"] == key), F.lit(0))["label"], F.lit(SOMETHING))
    labels = F.transform(hits, lambda h: bind(_squeezed(h), label))
    whole = F.array_join(F.zip_with(between, labels, lambda b, x: F.concat(b, F.coalesce(x, F.lit("")))), "")
    some = F.coalesce(F.size(items), F.lit(0)) > 0
    return F.when(some, whole).otherwise(text), F.when(some, F.size(hits)).otherwise(0)


def deidentify_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """pages (case_id, doc_id, page_num, text) with clean and n_replaced: every item of a document applies to all its pages."""
    rows = pages.join(items, ["case_id", "doc_id"], "left")
    clean, n = rewrite(F.col("text"), F.col("items"))
    return rows.select(*pages.columns, clean.alias("clean"), n.alias("n_replaced"))


def assemble(clean: DataFrame) -> DataFrame:
    """(case_id, doc_id, body, n_replaced): pages in order, each after its mark."""
    block = F.format_string("--- Page %d ---\n\n%s", "page_num", "clean")
    rows = F.array_sort(F.collect_list(F.struct("page_num", block.alias("block"))))
    return clean.groupBy("case_id", "doc_id").agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("body"), F.sum("n_replaced").alias("n_replaced"))


def all_labels(owners: DataFrame) -> DataFrame:
    """(case_id, labels): every label that a case's texts can hold, longest first."""
    fixed = F.array(*[F.lit(x) for x in [*CATEGORY_LABELS.values(), SHARED_SURNAME, SOME_NAME, SOMETHING, SOME_ORGANISATION]])
    labels = F.array_union(F.collect_set("label"), fixed)
    return owners.groupBy("case_id").agg(F.transform(F.array_sort(F.transform(labels, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda r: r["x"]).alias("labels"))


def strip_labels(text: Column, labels: Column) -> Column:
    """Text with its labels (longest first) made a space each, so that a label is never taken for a leftover."""
    pattern = F.array_join(F.transform(labels, quoted), "|")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.regexp_replace(text, pattern, F.lit(" "))).otherwise(text)


def leftovers(body: Column, items: Column, labels: Column) -> Column:
    """Those of items with three characters or more that are still visible as whole words, as texts."""
    seen = lambda i, bare: F.regexp_like(bare, F.concat(F.lit("(?Ui)" + P.EDGE_BEFORE), i["pattern"], F.lit("(?:['’]s)?" + P.EDGE_AFTER)))
    return bind(strip_labels(body, labels), lambda bare: F.transform(F.filter(items, lambda i: (F.length(i["raw"]) >= 3) & (i["key"] != "") & seen(i, bare)), lambda i: i["raw"]))


def close_words(word: Column, token: Column) -> Column:
    """Whether a misread word may stand for a token: letters only, five or more, one change up to seven letters, two beyond."""
    return token.rlike(r"^\p{L}{5,}$") & few_changes(word, token)


def few_changes(word: Column, token: Column) -> Column:
    """Whether a word is one change from a token of up to seven letters, or two from a longer one."""
    allowed = F.when(F.length(token) <= 7, 1).otherwise(2)
    return (F.abs(F.length(word) - F.length(token)) <= 2) & (F.levenshtein(word, token) <= allowed)


def fuzzy_leftovers(body: Column, texts: Column, labels: Column) -> Column:
    """Those of texts with a word that text read from a scan still nearly shows."""
    words = F.array_distinct(F.transform(F.split(strip_labels(body, labels), r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w'’]", ""))))
    near = lambda ws: F.transform(F.filter(texts, lambda t: F.exists(parts(F.btrim(t)), lambda k: F.exists(ws, lambda w: close_words(w, k)))), lambda x: F.btrim(x))
    return bind(F.filter(words, lambda w: w != ""), near)


def verify(bodies: DataFrame, items: DataFrame, labels: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """bodies with leftovers (array) and status: "written", or "quarantined" if anything replaced is still visible. scanned
    (case_id, doc_id, scan) holds the text of scanned pages, which is checked for near misses too. Cell marks become " | "."""
    rows = bodies.join(items, ["case_id", "doc_id"], "left").join(labels, "case_id", "left")
    items = F.coalesce("items", F.array().cast(ITEMS))
    texts = F.transform(items, lambda i: i["raw"])
    found = leftovers(F.col("body"), items, F.col("labels"))
    if scanned is not None:
        rows = rows.join(scanned, ["case_id", "doc_id"], "left")
        found = F.array_union(found, F.when(F.col("scan").isNotNull(), fuzzy_leftovers(F.col("scan"), texts, F.col("labels"))).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("leftovers", found).withColumn("body", F.replace("body", F.lit(CELL), F.lit(" | ")))
    return out.select(*bodies.columns, "leftovers", F.when(F.size("leftovers") > 0, "quarantined").otherwise("written").alias("status"))


def verify_redaction(outputs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text) of chosen texts with three characters or more that the text of a redacted document (doc_id, page_num, text:
    pages, form values, or pages read again by a scanner) still shows as whole words."""
    items = chosen.select("doc_id", F.btrim("text").alias("item")).where(F.length("item") >= 3).groupBy("doc_id").agg(F.collect_set("item").alias("items"))
    found = outputs.join(items, "doc_id").select("doc_id", F.explode(F.filter("items", lambda i: visible(i, F.col("text")))).alias("text"))
    return found.distinct()


def verify_scanned(outputs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, failures, status) of redacted documents whose pages were drawn and read again (doc_id, page_num, text, error): what
    is still visible, page by page, and every page that could not be read. An error counts as a failure, so a document is only
    "written" if all of it was read and nothing was found."""
    items = chosen.select("doc_id", F.btrim("text").alias("item")).where(F.length("item") >= 3).groupBy("doc_id").agg(F.collect_set("item").alias("items"))
    rows = outputs.join(items, "doc_id", "left")
    seen = F.filter("items", lambda i: visible(i, F.lower(F.col("text"))))
    shown = F.transform(F.coalesce(seen, F.array().cast("array<string>")), lambda i: F.concat(F.lit("Page "), F.col("page_num"), F.lit(": '"), i, F.lit("' still visible after redaction")))
    failed = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("OCR verification error: "), "error"))).otherwise(shown)
    by = rows.select("doc_id", failed.alias("f")).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("failures"))
    return by.withColumn("status", F.when(F.size("failures") > 0, "quarantined").otherwise("written"))


def strip_filename(stem: Column, names: Column) -> Column:
    """A file's stem without the given names, longest first, and without what their removal leaves behind."""
    long = F.transform(F.array_sort(F.transform(F.filter(names, lambda n: F.length(n) >= 3), lambda n, i: F.struct((-F.length(n)).alias("l"), i.alias("i"), n.alias("n")))), lambda r: r["n"])
    pattern = F.concat(F.lit(r"(?Ui)\b(?:"), F.array_join(F.transform(long, quoted), "|"), F.lit(r")\b"))
    text = F.replace(stem, F.lit("_"), F.lit(" "))
    text = F.when(F.size(long) > 0, F.regexp_replace(text, pattern, F.lit(""))).otherwise(text)
    for what, by in ((r"'s\b", ""), (" {2,}", " "), (r"\(\s*\)|\[\s*\]", ""), (r"(?:\s*-\s*){2,}", " - "), (r"\s*-\s*(?=[(\[])", " "), (r"^[ \-_,.]+|[ \-_,.]+$", ""), (" {2,}", " ")):
        text = F.regexp_replace(text, what, by)
    text = F.btrim(text)
    return F.when(F.coalesce(F.size(names), F.lit(0)) == 0, stem).when(F.length(text) < 3, F.lit("document")).otherwise(text)


def filename_names(cases: DataFrame) -> DataFrame:
    """(case_id, names): names and their parts of three characters or more, in order and distinct."""
    empty = F.array().cast("array<string>")
    listed = F.concat(F.array(F.coalesce("student_name", F.lit(""))), *[F.coalesce(c, empty) for c in ("parent_names", "family_names", "organisation_names")])
    each = lambda n: F.concat(F.array(F.btrim(n)), F.filter(F.split(F.btrim(n), r"\s+"), lambda p: F.length(p) >= 3))
    return cases.select("case_id", F.array_distinct(F.flatten(F.transform(F.filter(listed, lambda n: F.btrim(n) != ""), each))).alias("names"))
