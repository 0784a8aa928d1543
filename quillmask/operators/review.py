"""Review: merging detector outputs, numbering matches, choosing which ones to act on, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import STAY_CHOSEN
from ..functions.text import confidence_label

RECORD = ("text", "category", "confidence", "page_num", "line_num", "context", "source")


def dedup_matches(matches: DataFrame, keys: tuple[str, ...] = ("case_id", "doc_id")) -> DataFrame:
    """One match per text (any case), page and line: the one of highest confidence, the first detected among equals. first_ord
    is the order of the first of them, where the survivor stands. One shuffle, combined before it."""
    keys = [k for k in keys if k in matches.columns]
    best = F.min_by(F.struct(*RECORD), F.struct(-F.col("confidence"), F.col("ord")))
    by = matches.groupBy(*keys, "page_num", "line_num", F.lower("text").alias("_text")).agg(best.alias("_m"), F.min("ord").alias("first_ord"))
    return by.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in RECORD], "first_ord")


def rank_matches(matches: DataFrame, keys: tuple[str, ...] = ("case_id", "doc_id")) -> DataFrame:
    """dedup_matches' result with match_idx, its place from 0 in a document: by page, falling confidence, line, order; where documents
    share an id, by text what all these leave open, so that numbers are the same each time they are given."""
    keys = [k for k in keys if k in matches.columns]
    order = Window.partitionBy(*keys).orderBy("page_num", F.desc("confidence"), "line_num", "first_ord", "text", "category")
    return matches.withColumn("match_idx", F.row_number().over(order) - 1)


def merge_matches(*parts: DataFrame) -> DataFrame:
    """Outputs of several detectors as one table whose order keeps that of the parts: the line detectors, then name variations,
    then recognisers."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("ord", F.concat(F.array(F.lit(i)), F.col("ord")))
        out = part if out is None else out.unionByName(part)
    return out


def add_manual(ranked: DataFrame, manual: DataFrame, page_counts: DataFrame) -> DataFrame:
    """ranked matches with manual ones (doc_id, text, category, page_num) after those of their document: confidence 1, line 0.
    Texts under three characters and pages that a document (page_counts: doc_id, total_pages) lacks are left out."""
    fine = manual.join(page_counts, "doc_id").where((F.length(F.btrim("text")) >= 3) & F.col("page_num").between(1, F.col("total_pages")))
    text = F.btrim("text")
    made = fine.select("doc_id", text.alias("text"), F.coalesce("category", F.lit("Manual")).alias("category"), F.lit(1.0).alias("confidence"), "page_num", F.lit(0).alias("line_num"), text.alias("context"), F.lit("manual").alias("source"))
    last = ranked.groupBy("doc_id").agg(F.max("match_idx").alias("_last"))
    made = made.join(last, "doc_id", "left").withColumn("match_idx", F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "text"))).drop("_last")
    return ranked.select("doc_id", *RECORD, "match_idx").unionByName(made)


def _named(ranked: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """ranked joined, semi or anti, to the doc_id and match_idx of others; documents without an id are one document, as for match_idx."""
    others = others.select(F.col("doc_id").alias("_doc_id"), F.col("match_idx").alias("_match_idx"))
    return ranked.join(others, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("match_idx") == F.col("_match_idx")), how)


def selected(ranked: DataFrame, selections: DataFrame) -> DataFrame:
    """Matches that selections (doc_id, match_idx, selected) names; one that is not named is not selected."""
    return _named(ranked, selections.where("selected"), "left_semi")


def preselected(category: Column, mode: Column | str) -> Column:
    """Whether a category starts out selected: always for redaction; for de-identification not if only a recogniser found it."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return (mode != "deidentify") | category.isin(STAY_CHOSEN) | ~category.rlike(r"\(NER\)$")


def deselected_texts(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per document the texts (lower case) of matches that were left out and of none that was chosen. Without an id nothing says that two
    texts are of one document, so there a text that was left out stays, whatever else was chosen."""
    low = F.lower(F.btrim("text")).alias("text")
    rest = _named(ranked, chosen, "left_anti")
    return rest.select("doc_id", low).distinct().join(chosen.select("doc_id", low).distinct(), ["doc_id", "text"], "left_anti")


def missing_documents(documents: DataFrame, detected: DataFrame) -> DataFrame:
    """Documents that were never searched."""
    return documents.join(detected.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("Run detection first").alias("error"))


def match_counts(matches: DataFrame) -> DataFrame:
    """Matches of each document, and of all (doc_id null)."""
    return matches.rollup("doc_id").agg(F.count("*").alias("n"))


def category_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(F.count("*").alias("n"))


def corpus_counts(matches: DataFrame) -> DataFrame:
    """Distinct (document, category, text whatever its case), counted by category, and how many texts they are: the report that
    two versions of the detectors are compared by."""
    rows = matches.select("doc_id", "category", F.lower("text").alias("text")).distinct()
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


def log_summary(matches: DataFrame) -> DataFrame:
    """Counts by category, by confidence label and in all, from one pass: (category, label, n) with nulls for "any"."""
    rows = matches.select("category", confidence_label(F.col("confidence")).alias("label"))
    sets = rows.groupingSets([["category"], ["label"], []], "category", "label")
    return sets.agg(F.count("*").alias("n"))


def document_summary(matches: DataFrame) -> DataFrame:
    """Per document and category the count, and whether anything is below high confidence."""
    label = confidence_label(F.col("confidence"))
    return matches.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.bool_or(label.isin("medium", "low")).alias("uncertain"))


def ocr_item_counts(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """Matches on pages read by OCR; documents hold ocr_pages as an array."""
    return matches.join(documents, "doc_id").groupBy("doc_id").agg(F.count_if(F.array_contains("ocr_pages", F.col("page_num"))).alias("n"))


def folder_counts(files: DataFrame) -> DataFrame:
    """All files, those that can be processed, and those that were flagged."""
    return files.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("pdf", "converted")).alias("processable"), F.count_if(F.col("status").isin("failed", "protected")).alias("flagged"))


def run_totals(results: DataFrame) -> DataFrame:
    """Over results (success, items, failures and ocr_warnings arrays): documents, successes, items, failures and warnings."""
    return results.agg(F.count("*").alias("documents"), F.count_if("success").alias("successful"), F.sum("items").alias("items"), F.sum(F.size("failures")).alias("failures"), F.sum(F.size("ocr_warnings")).alias("ocr_warnings"))


#: The words of the audit log.
LOG_RULES = ("=" * 61, "─" * 76, "─" * 25)


def _lines(rows: DataFrame, section: int, keys: list[Column], *lines: Column) -> DataFrame:
    """Lines (section, keys, step, line) of rows; null lines are left out."""
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("step"), x.alias("line")) for i, x in enumerate(lines)]), lambda x: x["line"].isNotNull())
    return rows.select(F.lit(section).alias("section"), *[k.alias(n) for k, n in zip(keys, ("document_name", "output_name", "place"), strict=True)], F.inline(each))


def audit_lines(entries: DataFrame) -> DataFrame:
    """Lines (document_name, output_name, place, line) of the audit log's documents: a head, a rule, then a line for each entry, by page
    and line, and one more for its notes (a column that may be missing). A row a line, so a document with very many entries is
    never gathered."""
    keys = ["document_name", "output_name"]
    label = confidence_label(F.col("confidence"))
    line = F.format_string('Page %d, Line %d: "%s" [%s] [%s confidence]', "page_num", "line_num", "text", "category", label)
    notes = F.col("notes") if "notes" in entries.columns else F.lit(None).cast("string")
    noted = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("    Note: "), notes))
    rows = entries.select(*keys, line.alias("line"), noted.alias("note"), "page_num", "line_num", "match_idx")
    order = Window.partitionBy(*keys).orderBy("page_num", "line_num", "match_idx")
    # notes push what comes after them down by a line
    at = F.row_number().over(order) + F.coalesce(F.count("note").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    rows = rows.select(*keys, at.cast("int").alias("at"), "line", "note")
    both = F.filter(F.array(F.struct(F.col("at").alias("place"), F.col("line").alias("line")), F.struct((F.col("at") + 1).alias("place"), F.col("note").alias("line"))), lambda x: x["line"].isNotNull())
    head = F.array(F.concat(F.lit("DOCUMENT: "), "document_name", F.lit(" → "), "output_name"), F.lit(LOG_RULES[1]))
    return entries.select(*keys).distinct().select(*keys, F.posexplode(head).alias("place", "line")).unionByName(rows.select(*keys, F.inline(both)))


def audit_log(run: DataFrame, entries: DataFrame, flagged: DataFrame) -> DataFrame:
    """The whole log of one run as lines (section, document_name, output_name, place, line), to be read in that order: its head (0), its documents (1, as
    audit_lines gives them, each with an empty line behind it), the files that someone has to look at (2) and the end (3).

    run is one row (operation, verb, folder, subject, processed, total, successful, n_flagged, cancelled); flagged are its n_flagged rows
    (document_name, reason). A run that was cancelled says so, and how far it came."""
    none = F.lit("")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    c = F.col
    head = _lines(run, 0, [none, none, F.lit(0)], text(c("operation"), " LOG"), F.lit(LOG_RULES[0]), text("Folder: ", c("folder")), text("Student: ", c("subject")), text("Processed: ", c("processed")),
                  text("Total documents: ", c("total")), text("Successfully ", c("verb"), ": ", c("successful")), text("Flagged for manual review: ", c("n_flagged")),
                  F.when(c("cancelled"), text("RUN CANCELLED BY USER — ", c("successful"), " of ", c("total"), " documents were processed")), none)
    documents = audit_lines(entries)
    last = entries.groupBy("document_name", "output_name").agg(F.lit((1 << 31) - 1).alias("place"), F.lit("").alias("line"))
    body = documents.unionByName(last).select(F.lit(1).alias("section"), "document_name", "output_name", "place", F.lit(0).alias("step"), "line")
    some = _lines(run.where("n_flagged > 0"), 2, [none, none, F.lit(0)], F.lit("FLAGGED FOR MANUAL REVIEW"), F.lit(LOG_RULES[2]))
    each = _lines(flagged, 2, [c("document_name"), none, F.lit(1)], text("- ", c("document_name"), ": ", F.coalesce("reason", F.lit(""))))
    end = _lines(run, 3, [none, none, F.lit(0)], F.when(c("n_flagged") > 0, none), F.lit("END OF LOG"))
    out = head.unionByName(body).unionByName(some).unionByName(each).unionByName(end)
    nth = F.row_number().over(Window.partitionBy("section", "document_name", "output_name").orderBy("place", "step")) - 1
    return out.select("section", "document_name", "output_name", nth.cast("int").alias("place"), "line")


def selected_categories(chosen: DataFrame, by: str = "category") -> DataFrame:
    """Chosen matches counted by category, in the order of names or, by "n", most first and equal ones by name."""
    counts = category_counts(chosen)
    return counts.orderBy("category") if by == "category" else counts.orderBy(F.desc("n"), "category")


def native_pages(pages: Column | str, scanned: Column | str) -> Column:
    """Pages (an array of numbers) with text of their own: all but the scanned ones."""
    return F.array_except(pages, scanned)


def scanned_pages(produced: Column | str, scanned: Column | str) -> Column:
    """Scanned pages among those of which text was produced, in order."""
    return F.array_sort(F.array_intersect(scanned, produced))
