"""Words read from scanned pages and images: where chosen texts stand, which images look signed, what to blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rewrite import close_words

#: Shares of a page's height that count as header and footer; padding around a found word in pixels.
HEADER, FOOTER, PADDING = 0.12, 0.08, 4
PAGE = ["doc_id", "page_num"]


def lines_of_words(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, text, confidence) of words (pos, word, block, line, conf): runs of words with one block and line make a
    line, blank words and those with negative confidence are left out, confidence is the mean of the positive ones."""
    rows = words.where((F.col("conf") >= 0) & (F.btrim("word") != ""))
    order = Window.partitionBy(*PAGE).orderBy("pos")
    new = F.coalesce((F.col("block") != F.lag("block").over(order)) | (F.col("line") != F.lag("line").over(order)), F.lit(True))
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    texts = rows.groupBy(*PAGE, "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("t"), F.sum(F.when(F.col("conf") > 0, F.col("conf"))).alias("s"), F.count_if(F.col("conf") > 0).alias("n"))
    page = texts.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_run", "t"))), lambda r: r["t"]), "\n").alias("text"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return page.select(*PAGE, "text", F.coalesce(F.col("s") / F.col("n") / 100, F.lit(0.0)).alias("confidence"))


def _one(word: Column, item: Column) -> Column:
    low = F.lower(word)
    clean = F.regexp_replace(low, r"(?U)[^\w'’]", "")
    bare = F.regexp_replace(clean, r"[.,;:!?]+$", "")
    odd = ~item.rlike(r"^\p{L}+$") & F.contains(low, item)
    return (clean == item) | (clean == F.concat(item, F.lit("'s"))) | (clean == F.concat(item, F.lit("’s"))) | (bare == item) | odd | close_words(clean, item)


def _part(word: Column, item: Column) -> Column:
    clean = F.regexp_replace(F.lower(word), r"(?U)[^\w']", "")
    return (clean == item) | (F.regexp_replace(clean, r"[.,;:!?]+$", "") == item) | close_words(clean, item)


def find_items(words: DataFrame, items: DataFrame, padding: int = PADDING) -> DataFrame:
    """Boxes (doc_id, page_num, item, pos, x0, y0, x1, y1) to paint over: runs of words (pos, word, x0..y1) that match an item
    (doc_id, text) of the document, with its padding; items that have a page_num are looked for on that page only. Items under three
    characters are left out. Words of a page are gathered into one row, so that runs are compared within it and pages meet
    items by document, or by page."""
    page = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "x0", "y0", "x1", "y1"))).alias("w"))
    keys = [c for c in PAGE if c in items.columns]
    chosen = items.select(*keys, F.lower(F.btrim("text")).alias("item")).where(F.length("item") >= 3).distinct()
    rows = page.join(chosen.withColumn("p", F.split("item", r"(?U)\s+")), keys)
    n = F.size("p")
    single = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: _one(F.get("w", i)["word"], F.col("item")))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: (i + n <= F.size("w")) & F.forall(F.sequence(F.lit(0), n - 1), lambda k: _part(F.get("w", i + k)["word"], F.get("p", k))))
    rows = rows.withColumn("at", F.explode(F.when(n == 1, single).otherwise(starts)))
    a, b = F.get("w", F.col("at")), F.get("w", F.col("at") + n - 1)
    return rows.select(*PAGE, "item", a["pos"].alias("pos"), (F.least(a["x0"], b["x0"]) - padding).alias("x0"), (F.least(a["y0"], b["y0"]) - padding).alias("y0"), (F.greatest(a["x1"], b["x1"]) + padding).alias("x1"), (F.greatest(a["y1"], b["y1"]) + padding).alias("y1"))


def signatures(images: DataFrame) -> DataFrame:
    """Images (px_w, px_h, rect_w, ink_ratio) that look like a signature: wide, small on the page, thin strokes."""
    fine = (F.col("px_h") > 0) & (F.col("px_w") >= 2 * F.col("px_h")) & (F.col("rect_w") <= 250) & (F.col("px_w") >= 50) & (F.col("px_h") <= 200) & (F.col("ink_ratio") <= 0.30)
    return images.where(fine)


def image_only_pages(pages: DataFrame) -> DataFrame:
    """Pages (n_words, n_images) without words but with an image."""
    return pages.where((F.col("n_words") == 0) & (F.col("n_images") > 0))


def image_counts(pages: DataFrame) -> DataFrame:
    """Images per document on pages (n_images, method) that were not scanned: what a text output can't show."""
    return pages.where("method <> 'ocr'").groupBy("doc_id").agg(F.sum("n_images").alias("n_images")).where("n_images > 0")


def zones(pages: DataFrame) -> DataFrame:
    """Header and footer boxes of pages (width, height)."""
    box = lambda y0, y1: F.struct(F.lit(0.0).alias("x0"), y0.alias("y0"), F.col("width").cast("double").alias("x1"), y1.alias("y1"))
    h = F.col("height").cast("double")
    return pages.select(*PAGE, F.inline(F.array(box(h * 0, h * HEADER), box(h * (1 - FOOTER), h))))


def whole_word_boxes(found: DataFrame, words: DataFrame) -> DataFrame:
    """Of boxes found for texts (text, x0..y1), those to erase: texts over six characters as they are, shorter ones only where
    a word of the page that is the text, possessive or with punctuation after it, covers 70 % of the box. One point more all
    round. Texts under three characters are left out."""
    rows = found.where(F.length("text") >= 3)
    needle, pad = F.lower(F.btrim("text")), lambda df: df.select(*PAGE, "text", *[(F.col(c) + d).alias(c) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    w = words.select(*PAGE, F.lower(F.btrim("word")).alias("w"), *[F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1")])
    short = rows.where(F.length("text") <= 6).join(w, PAGE)
    wide = F.least("x1", "w_x1") - F.greatest("x0", "w_x0")
    high = F.least("y1", "w_y1") - F.greatest("y0", "w_y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    tail = F.substring(F.col("w"), F.length(needle) + 1, F.length("w"))
    fits = F.startswith("w", needle) & tail.rlike(r"^(?:['’]s)?[^a-zA-Z0-9]*$") & (wide > 0) & (high > 0) & (wide * high >= 0.7 * area)
    return pad(rows.where(F.length("text") > 6)).unionByName(pad(short.where(fits)).distinct())


def redaction_plan(marks: DataFrame, items: DataFrame) -> DataFrame:
    """What else of a document is to go: fields (whole word in value), links, annotations and bookmarks (text anywhere). marks
    are (doc_id, kind, page_num, value); the action is delete, or the bookmark's new title."""
    chosen = items.select("doc_id", F.btrim("text").alias("text")).where(F.length("text") >= 3).distinct()
    by = chosen.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    rows = marks.join(by, "doc_id")
    word = F.exists("texts", lambda t: F.regexp_like("value", F.concat(F.lit(r"(?Ui)\b\Q"), t, F.lit(r"\E\b"))))
    part = F.exists("texts", lambda t: F.contains(F.lower("value"), F.lower(t)))
    title = F.regexp_replace(F.col("value"), F.concat(F.lit("(?i)"), F.array_join(F.transform("texts", lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")), F.lit("[REDACTED]"))
    return rows.where(F.when(F.col("kind") == "widget", word).otherwise(part)).select("doc_id", "kind", "page_num", "value", F.when(F.col("kind") == "bookmark", title).otherwise("delete").alias("action"))


def item_boxes(items: DataFrame) -> DataFrame:
    """Boxes of items (doc_id, page_num, text, x0..y1) whose place is known already, a point wider on each side."""
    known = items.where(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull())
    return known.select(*PAGE, "text", *[(F.col(c) + d).alias(c) for c, d in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]).distinct()


def unread_pages(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Pages (doc_id, page_num) without any word that was read there: what they show can't be found, so it can't be removed."""
    return pages.select(*PAGE).distinct().join(words.select(*PAGE), PAGE, "left_anti")


def unique_images(images: DataFrame, scanned_pages: DataFrame) -> DataFrame:
    """(doc_id, xref, n_places): the embedded images (doc_id, page_num, xref) that are to be read, once each however often they are
    placed, pages that were read as a whole (doc_id, page_num) left out."""
    rest = images.join(scanned_pages, ["doc_id", "page_num"], "left_anti")
    return rest.groupBy("doc_id", "xref").agg(F.count("*").alias("n_places"))


def image_boxes(images: DataFrame, scanned_pages: DataFrame, words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, page_num, xref, item, x0, y0, x1, y1): boxes to blacken in every place of an image. words (doc_id, xref, pos, word,
    box) are those of each image, read once; items are all of a document, as images may stand on any page."""
    found = find_items(words.withColumnRenamed("xref", "page_num"), items).withColumnRenamed("page_num", "xref")
    places = images.join(scanned_pages, ["doc_id", "page_num"], "left_anti").select("doc_id", "page_num", "xref").distinct()
    return places.join(found, ["doc_id", "xref"]).select("doc_id", "page_num", "xref", "item", "x0", "y0", "x1", "y1")


# What a file says of itself, and the parts of its structure that may hold text.
METADATA = ["author", "title", "subject", "creator", "producer", "keywords", "creationDate", "modDate"]
STRUCTURE = ["MarkInfo", "StructTreeRoot", "Names"]


def metadata_plan(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, page_num, value, action) for every document: its information is emptied, its second copy of that (XMP) and
    the files it holds are deleted, and so are parts of its structure that repeat its text."""
    rows = [("metadata", v, "empty") for v in METADATA] + [("xmp", "xmp", "delete"), ("embedded", "*", "delete")] + [("structure", v, "delete") for v in STRUCTURE]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(0).alias("page_num"), F.lit(v).alias("value"), F.lit(a).alias("action")) for k, v, a in rows])
    return documents.select("doc_id", F.inline(each))
