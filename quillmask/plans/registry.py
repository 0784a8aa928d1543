"""The registered queries and their SQL oracles.

Queries run over whole tables of the driver, or over reports about people invented from customer; the oracle computes what
must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..operators import intervals as V
from ..operators import people as who
from ..operators import reports as Q
from ..operators import review as R
from ..operators import rewrite as W
from ..operators import scans as S
from ..operators.asof import asof_join
from ..operators.detect import REGISTRY, detect_lines, with_name_forms
from ..operators.layout import formatted_pages, layout_pages
from ..operators.lexicon import lexicon_join, listed_matches
from ..operators.misread import misread_items, near_words
from ..operators.recognise import all_entity_matches, entity_matches, lexicon_recogniser, no_recogniser, page_entities, person_sweep, recogniser_udf
from ..operators.roles import describe_people, effective_roles, suggest_roles
from ..sources.documents import blocks_of_page, choose_text, pages_of_table, spans_of_page
from ..sources.sinks import finished_text, key_lines, safe_name, unique_names
from ..streaming import windows as T
from ..streaming.people import current_rosters, write_people
from . import invented as I
from .flows import deidentify, detect, plan_redaction, preview_labels, rosters_of
from .oracles import ORACLES
from .session import Kept, tasks_of

Query = Callable[[SparkSession, str], DataFrame]
CASE = "case_id string, student_name string, parent_names array<string>, family_names array<string>, organisation_names array<string>"
PAGE = "case_id string, doc_id string, page_num int, text string"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def _phones_and_emails(pages: DataFrame) -> DataFrame:
    return detect_lines(pages, registry=[d for d in REGISTRY if d.category in ("Phone number", "Email address")])


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose case is their language, so that documents of two languages that share an id stay apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("lang").alias("case_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), "text")


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers and emails of all documents, one of each text a line."""
    return R.dedup_matches(_phones_and_emails(_by_language(spark, sf_dir))).drop("case_id")


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.people(spark, sf_dir)


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _people(spark, sf_dir)
    return I.reports(rows), I.cases(rows)


def _seen_by() -> Callable:
    return lexicon_recogniser(I.SEEN_BY.split(","))


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pages, cases = _reports(spark, sf_dir)
    return deidentify(pages, cases, detect(pages, cases, _seen_by()))


def _known(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Owners and forms of _run, without the items of documents and their texts."""
    pages, cases = _reports(spark, sf_dir)
    return rosters_of(cases, detect(pages, cases, _seen_by()), Kept(spark))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct phone numbers and emails of all documents by category and confidence label."""
    found = _deduped(spark, sf_dir)
    return found.groupBy("category", X.confidence_label(F.col("confidence")).alias("label")).agg(F.count("*").alias("n"))


def p02_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.to_lines(_pages(spark, sf_dir).select("doc_id", "text"))
    return lines.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_num").alias("last_line"))


def d03_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect_lines(_pages(spark, sf_dir), registry=[d for d in REGISTRY if d.category == "Phone number"])
    return R.dedup_matches(rows).select(F.col("doc_id").cast("long").alias("doc_id"), "line_num", "text", "confidence")


def d04_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect_lines(_pages(spark, sf_dir), registry=[d for d in REGISTRY if d.category == "Email address"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "line_num", "text", "confidence")


def d10_dob_same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth beside their label, in reports that hold one there and in such that hold one below it."""
    rows = _people(spark, sf_dir)
    dates = [d for d in REGISTRY if d.category == "Date of birth"]
    pages = I.more_reports(rows)[0].unionByName(I.reports(rows))
    found = R.dedup_matches(detect_lines(pages, registry=dates).where("confidence = 0.95"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "line_num", "text")


def d01_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, per source, in which the forms of a student's name occur; each source is a case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.coalesce("source", F.lit("(none)")))
    cases = docs.select(F.col("source").alias("case_id")).distinct().select("case_id", F.lit("Eriner Retion").alias("student_name"), *[F.array().cast("array<string>").alias(c) for c in ("parent_names", "family_names", "organisation_names")])
    pages = docs.select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), "text")
    found = detect_lines(pages, cases, registry=[]).where("category = 'Student name'")
    return found.groupBy(F.col("case_id").alias("source"), F.lower("text").alias("form")).agg(F.count_distinct("doc_id").alias("n_docs"))


def w01_match_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.rank_matches(_deduped(spark, sf_dir))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "match_idx", "line_num", "text", "category")


def w01_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matches: the same text (any case) twice on a line, with equal or better confidence later."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), F.col("o_orderkey").cast("int").alias("line_num"), "o_orderpriority", "o_orderstatus")
    one = lambda text, category, confidence, at: F.struct(text.alias("text"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit("").alias("context"), F.lit("regex").alias("source"), F.array(F.lit(at)).alias("ord"))
    text = F.col("o_orderpriority")
    made = rows.select("doc_id", "page_num", "line_num", F.inline(F.array(one(text, "A", 0.65, 0), one(F.lower(text), "B", 0.65, 1), one(F.upper(text), "C", 0.65, 2), one(F.concat("o_orderstatus", F.lit(" only")), "D", 0.95, 3))))
    return R.rank_matches(R.dedup_matches(made)).select(F.col("doc_id").cast("long").alias("doc_id"), "match_idx", "line_num", "text", "category", "confidence")


def a02_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.category_counts(_deduped(spark, sf_dir))


def a03_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.log_summary(_deduped(spark, sf_dir))


def a05_doc_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.document_summary(_deduped(spark, sf_dir))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "category", "n", "uncertain")


def j04_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the matches of documents, the first of each, which a selection table names."""
    ranked = R.rank_matches(_deduped(spark, sf_dir))
    picks = ranked.select("doc_id", "match_idx", (F.col("match_idx") == 0).alias("selected"))
    return R.selected(ranked, picks).select(F.col("doc_id").cast("long").alias("doc_id"), "match_idx", "text")


def u03_deselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.rank_matches(_deduped(spark, sf_dir))
    rest = R.deselected_texts(ranked, ranked.where("match_idx = 0"))
    return rest.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def v03_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    a, b = F.lower("n_name"), F.lower("r_name")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("n_name", "r_name", F.levenshtein(a, b).alias("distance"), W.close_words(a, b).alias("close"))


def d17_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).select("k", F.concat_ws(" ", "first", "last").alias("name"))
    return rows.select("k", F.explode(N.variations(F.col("name"))).alias("form"))


def d17_nicknames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).select("k", F.concat_ws(" ", "first", "last").alias("name"))
    return rows.select("k", F.explode(N.nicknames(F.col("name"))).alias("form"))


def d_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector over a report of each customer."""
    found = R.dedup_matches(detect_lines(*_reports(spark, sf_dir)))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "line_num", "text", "category", "confidence")


def d14_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family known by context or from the list, numbers on the line below their keyword, and other forms of phone numbers and dates."""
    found = R.dedup_matches(detect_lines(*I.more_reports(_people(spark, sf_dir))))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "line_num", "text", "category", "confidence")


def d_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full set of detectors over all documents, counted by category."""
    found = R.dedup_matches(detect_lines(_by_language(spark, sf_dir)))
    return found.groupBy("category").agg(F.count("*").alias("n"))


def n08_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What page recognisers and a model find in the reports, and the other forms of the names among it."""
    pages, cases = _reports(spark, sf_dir)
    rows = pages.join(with_name_forms(cases).select("case_id", "student_forms"), "case_id")
    text = F.col("text")
    found = all_entity_matches(rows, F.concat(page_entities(text, F.col("student_forms")), _seen_by()(text), no_recogniser(text)))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "category", "confidence", "line_num").distinct()


def o05_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People still found in texts, distinct whatever their case; each second mother was deselected."""
    rows = _people(spark, sf_dir).withColumn("doc_id", F.col("k").cast("string"))
    texts = rows.select("doc_id", F.expr("concat(first, ' met ', mother_first, ', ', upper(first), ' and ', first, '; ', seen_by, ' too')").alias("text"))
    left = rows.where("k % 2 = 0").select("doc_id", F.lower("mother_first").alias("text"))
    names = [*I.FIRST.split(","), *I.FIRST.upper().split(","), *I.MOTHERS.split(","), *I.SEEN_BY.split(",")]
    return person_sweep(texts, lexicon_recogniser(names)(F.col("text")), left).withColumn("doc_id", F.col("doc_id").cast("long"))


def e01_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir)["owners"].select(F.col("case_id").cast("long").alias("k"), "seq", "full_name", "role", "label")


def e10_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that people would get if each third person that was detected is answered to be a teacher, the others a psychologist."""
    rows = _people(spark, sf_dir).withColumn("case_id", F.col("k").cast("string"))
    chosen = rows.select("case_id", F.lit("d").alias("doc_order"), F.lit(0).alias("match_idx"), F.col("seen_by").alias("text"), F.lit("Person name (NER)").alias("category"))
    answers = rows.select("case_id", F.lit(0).alias("place"), F.concat(F.lit("Ms "), "seen_by").alias("name"), F.expr("case when k % 3 = 0 then 'teacher' else 'health' end").alias("role"), F.expr("case when k % 3 = 0 then null else 'psychologist' end").alias("custom"))
    return preview_labels(I.cases(rows), chosen, answers).select(F.col("case_id").cast("long").alias("k"), "full_name", "label")


def w04_shared_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What first names, surnames and the school stand for; a surname that mother and child share is the family's."""
    rows = _people(spark, sf_dir)
    forms = _known(spark, sf_dir)["forms"].select(F.col("case_id").cast("long").alias("k"), "form", "label")
    asked = rows.select("k", F.explode(F.array(*[F.lower(c) for c in ("first", "last", "mother_first", "mother_last", "town", "school")])).alias("form")).distinct()
    return asked.join(forms, ["k", "form"], "left")


def r02_deidentify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports with everything replaced: whole texts, as they are written."""
    return _run(spark, sf_dir)["results"].select(F.col("doc_id").cast("long").alias("k"), "body", F.col("n_replaced").cast("int").alias("n_replaced"), "status")


def r02_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers and emails of all documents replaced by their labels: how many emails, in how many documents. (A phone number
    within a longer run of digits is no whole word and stays.)"""
    pages = _pages(spark, sf_dir).withColumn("case_id", F.lit("all"))
    ranked = R.rank_matches(R.dedup_matches(_phones_and_emails(pages)))
    forms = spark.createDataFrame([], "case_id string, form string, at int, label string")
    clean = W.deidentify_pages(pages, W.replacements(ranked, forms))
    emails = F.size(F.split("clean", r"\[email\]", -1)) - 1
    return clean.groupBy(F.lit("all").alias("scope")).agg(F.count_if(emails > 0).alias("docs_changed"), F.sum(emails).alias("emails"))


def a14_role_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from what is said around a name, one snippet or three a person."""
    rows = _people(spark, sf_dir)
    said = "split_part('the mother|a foster home|our tutor|the chaplain|a physio|an advocate|her classmate|nobody', '|', cast(k % 8 + 1 as int))"
    snippet = lambda what: F.concat(F.expr(what), F.lit(", "), "first", F.lit(", was there"))
    more = F.when(F.col("k") % 5 == 0, F.array(F.struct(F.lit(1).alias("at"), snippet("'the tutor'").alias("snippet")), F.struct(F.lit(2).alias("at"), snippet("'a tutor'").alias("snippet")))).otherwise(F.array().cast("array<struct<at:int,snippet:string>>"))
    contexts = rows.select(F.when(F.col("k") % 8 == 7, F.concat(F.lit("Dr "), "last")).otherwise(F.col("first")).alias("name"), F.col("k").alias("case_id"), F.inline(F.concat(F.array(F.struct(F.lit(0).alias("at"), snippet(said).alias("snippet"))), more)))
    return suggest_roles(contexts).select(F.col("case_id").alias("k"), "role", "confidence", "evidence")


def v01_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names in five surroundings: within a word, possessive, parted by other separators, by none, within a label."""
    rows = _table(spark, sf_dir, "nation").select("n_name", F.explode(F.expr("array(concat(n_name, 'ic tale'), concat(lower(n_name), char(39), 's tale'), concat('by ', replace(n_name, ' ', ' - ')), concat('by ', replace(n_name, ' ', '')), concat('[', n_name, ' 1] here'))")).alias("body"))
    bare = W.strip_labels(F.col("body"), F.array(F.concat(F.lit("["), "n_name", F.lit(" 1]"))))
    return rows.select("n_name", "body", W.visible(F.col("n_name"), bare).alias("visible"))


def v02_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames misread by a scanner: one letter, two letters, or another word."""
    rows = _people(spark, sf_dir).select("k", "last", F.expr("case cast(k % 3 as int) when 0 then replace(lower(last), 'e', 'c') when 1 then concat(last, 'x') else 'nothing' end").alias("read"))
    return rows.select("k", "read", (F.size(W.fuzzy_leftovers(F.concat("read", F.lit(" was here.")), F.array("last"), F.array().cast("array<string>"))) > 0).alias("left_over"))


def r09_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems that hold a name in front, behind, within brackets, with underscores, or nothing else."""
    rows = _people(spark, sf_dir)
    stems = "array(concat(first, ' ', last, ' Plan ', cast(k as string)), concat('Plan - ', first, ' ', last), concat('Plan ', cast(k as string), ' (', first, ')'), concat(last, '_', first, '_Term_Summary'), concat(first, char(39), 's Summary'), concat(first, ' ', last))"
    return rows.select("k", F.posexplode(F.expr(stems)).alias("kind", "stem"), F.array(F.concat_ws(" ", "first", "last"), "first", "last").alias("names")).select("k", "kind", W.strip_filename(F.col("stem"), F.col("names")).alias("safe"))


def f14_preselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which categories are chosen at first, in both modes, and what they are called, over line items that stand for matches."""
    cats = "Student name|Person name (NER)|Person name (NER variation)|Location (NER)|ORGANIZATION (NER)|Date/Time (NER)|Phone number"
    rows = _table(spark, sf_dir, "lineitem").selectExpr(f"split_part('{cats}', '|', cast(l_partkey % 7 + 1 as int)) AS category", "explode(array('redact', 'deidentify')) AS mode")
    return rows.groupBy("category", "mode", R.preselected(F.col("category"), F.col("mode")).alias("chosen"), X.friendly_category(F.col("category")).alias("shown")).agg(F.count("*").alias("n"))


def f07_clean_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).select("k", F.posexplode(F.expr("array(concat('Ms  ', last), concat('Dr. ', first, ' ', last), 'Mr', concat(first, ' ', last, ' Date of Birth'), concat(last, '-O''Hara'), 'Phone:', concat(first, cast(k as string)), concat('Prof Dr ', first))")).alias("kind", "name"))
    return rows.select("k", "kind", N.clean_person(F.col("name")).alias("person"), N.is_form_label(F.col("name")).alias("form_label"))


def p08_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with Windows, network and Unix paths that hold a name."""
    rows = _people(spark, sf_dir)
    texts = [F.concat(F.lit("open C:\\Users\\"), "first", F.lit("\\a.pdf failed")), F.concat(F.lit('at "C:\\My Files\\'), "first", F.lit(' b.pdf" now')), F.concat(F.lit("\\\\srv\\"), "last", F.lit("\\a.txt")), F.concat(F.lit("see /Users/"), "first", F.lit("/b.pdf or /etc/x")), F.concat(F.lit("no path of "), "first")]
    return rows.select("k", F.posexplode(F.array(*texts)).alias("kind", "text")).select("k", "kind", X.scrub_paths(F.col("text")).alias("scrubbed"))


def p06_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).select("k", F.concat(F.lit("...by **"), "first", F.lit("** and **"), "last", F.lit("**...")).alias("context"))
    return rows.select("k", F.posexplode(X.split_context(F.col("context"))).alias("at", "s")).select("k", "at", "s.text", "s.matched")


def k07_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: a folder per status, a stem per priority and day."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("folder"), F.concat("o_orderpriority", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM")).alias("stem"), F.col("o_orderkey").alias("doc_id"))
    return unique_names(rows, "_deidentified.txt").select("doc_id", "name")


def k08_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).select("k", F.posexplode(F.array(F.concat(F.lit("../a/"), "first", F.lit(".docx")), F.concat(F.lit("c:\\x\\"), "last", F.lit(".txt")), F.lit(".."), F.concat("first", F.lit(" "), "last"))).alias("kind", "name"))
    return rows.select("k", "kind", safe_name(F.col("name"), ".txt").alias("as_txt"), safe_name(F.col("name"), ".pdf").alias("as_pdf"))


def k03_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of finished texts over all documents, as if those in English had been changed."""
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("body"), F.when(F.col("lang") == "en", 3).otherwise(0).alias("n"))
    whole = finished_text(F.col("body"), F.col("n"))
    return rows.select("doc_id", F.startswith(whole, F.lit("WARNING")).alias("warns"), F.endswith(whole, F.col("body")).alias("whole"), (F.length(whole) - F.length("body")).alias("head"))


def s05_choose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a text of their own and one read by a scanner, which counts for the short ones."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), F.col("text").alias("native_text"), F.lit("v").alias("widget_values"), F.lit("scan").alias("ocr_text"), F.lit(0.75).alias("ocr_confidence"))
    both = [choose_text(rows, ocr).withColumn("ocr", F.lit(ocr)) for ocr in (True, False)]
    return both[0].unionByName(both[1]).select(F.col("doc_id").cast("long").alias("doc_id"), "ocr", F.length("text").alias("n_chars"), F.endswith("text", F.lit("\nv")).alias("with_values"), "method", "confidence")


def _turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as scanned pages: words in lines of five, every seventh one of no confidence."""
    rows = _table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return rows.select("*", F.lit(1).alias("block"), F.floor(F.col("pos") / 5).cast("int").alias("line"), F.when(F.col("pos") % 7 == 6, -1).otherwise(F.col("pos") % 50 + 50).cast("int").alias("conf"))


def s07_ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.lines_of_words(_turn_words(spark, sf_dir))
    return rows.select(F.col("doc_id").cast("long").alias("conv_id"), "page_num", "text", F.round("confidence", 9).alias("confidence"))


def j10_ocr_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The, possessives and what stands around it, in the turns of conversations; a word is as wide as it is long."""
    words = _turn_words(spark, sf_dir).where("conf >= 0").select("doc_id", "page_num", "pos", "word", (F.col("pos") % 5 * 100).alias("x0"), (F.col("line") * 20).alias("y0"), (F.col("pos") % 5 * 100 + F.length("word") * 8).alias("x1"), (F.col("line") * 20 + 15).alias("y1"))
    items = words.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("The"), F.lit("la"), F.lit("und"))).alias("text"))
    return S.find_items(words, items).select(F.col("doc_id").cast("long").alias("conv_id"), "page_num", "item", "pos", "x0", "y0", "x1", "y1")


def f13_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as images: quantity, part and price as width, height and ink."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_partkey % 500 + 20 as int) AS px_w", "cast(l_suppkey % 240 as int) AS px_h", "cast(l_partkey % 400 as double) AS rect_w", "cast(l_discount * 5 as double) AS ink_ratio")
    return S.signatures(rows).select("l_orderkey", "l_linenumber", "px_w")


def b03_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments and the first letters of these as boxes that a search found: short ones count only where a word fills them."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc_id", "1 AS page_num", "explode(array(c_mktsegment, substr(c_mktsegment, 1, 4), substr(c_mktsegment, 1, 2))) AS text", "c_custkey AS k")
    found = rows.selectExpr("doc_id", "page_num", "text", "10.0D AS x0", "0.0D AS y0", "10.0D + 8 * length(text) AS x1", "10.0D AS y1")
    ending = F.when(F.col("k") % 4 == 0, ",").when(F.col("k") % 4 == 1, "'s").when(F.col("k") % 4 == 2, "ia").otherwise("")
    words = rows.select("doc_id", "page_num", F.concat("text", ending).alias("word"), F.lit(10.0).alias("x0"), F.lit(0.0).alias("y0"), (10.0 + F.when(F.col("k") % 7 == 0, 4).otherwise(8) * F.length("text")).alias("x1"), F.lit(10.0).alias("y1"))
    return S.whole_word_boxes(found, words).select("doc_id", "text", "x0", "y0", "x1", "y1")


def b08_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form values, links and bookmarks of each case that show the name."""
    rows = _people(spark, sf_dir).withColumn("doc_id", F.col("k").cast("string"))
    mark = lambda kind, page, value: F.struct(F.lit(kind).alias("kind"), F.lit(page).alias("page_num"), F.expr(value).alias("value"))
    marks = rows.select("doc_id", F.inline(F.array(mark("widget", 1, "concat(first, 'ian')"), mark("widget", 1, "concat(first, ' ', last)"), mark("link", 1, "concat('http://x/', lower(first), 'ian')"), mark("annotation", 2, "'none'"), mark("bookmark", 0, "concat(first, char(39), 's plan')"))))
    plan = S.redaction_plan(marks, rows.select("doc_id", F.col("first").alias("text")))
    return plan.select(F.col("doc_id").cast("long").alias("k"), "kind", "value", "action")


def b00_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What redaction does to the documents of customers, row by row but for metadata: an order is a page of three kinds (text, an image
    that was read, an image that was not), its clerk an item on that page, some with their box; all pages of a customer share a seal.
    Items are searched on their own page, images and bookmarks are held against all items of the document."""
    orders = _table(spark, sf_dir, "orders").selectExpr("cast(o_custkey as string) AS doc_id", "cast(o_orderkey as int) AS page_num", "lpad(cast(o_orderkey % 50 as string), 4, '0') AS clerk", "o_orderkey", "o_orderkey % 3 AS kind")
    pages = orders.selectExpr("doc_id", "page_num", "600.0D AS width", "800.0D AS height", "case when kind = 0 then 5 else 0 end AS n_words", "1 AS n_images")
    box = "case when kind = 0 and o_orderkey % 5 = 0 then {}D end AS {}"
    items = orders.selectExpr("doc_id", "page_num", "concat('clerk ', clerk) AS text", *[box.format(v, c) for v, c in ((10.0, "x0"), (10.0, "y0"), (50.0, "x1"), (20.0, "y1"))])
    hits = orders.selectExpr("doc_id", "page_num", "inline(array(named_struct('text', concat('clerk ', clerk), 'x0', 30.0D, 'y0', 40.0D, 'x1', 90.0D, 'y1', 50.0D), named_struct('text', 'clerk 0', 'x0', 1.0D, 'y0', 1.0D, 'x1', 2.0D, 'y1', 2.0D)))")
    words = orders.selectExpr("doc_id", "page_num", "'clerk' AS word", "30.0D AS x0", "40.0D AS y0", "60.0D AS x1", "50.0D AS y1")
    read = orders.where("kind = 1").selectExpr("doc_id", "page_num", "inline(array(named_struct('pos', 0, 'word', 'Clerk', 'x0', 100, 'y0', 100, 'x1', 180, 'y1', 120), named_struct('pos', 1, 'word', clerk, 'x0', 190, 'y0', 100, 'x1', 260, 'y1', 120)))")
    images = orders.selectExpr("doc_id", "page_num", "7L AS xref", "300 AS px_w", "case when kind = 0 then 60 else 250 end AS px_h", "120.0D AS rect_w", "0.1D AS ink_ratio")
    first = orders.groupBy("doc_id").agg(F.min("clerk").alias("clerk"))
    seal = first.selectExpr("doc_id", "7L AS xref", "inline(array(named_struct('pos', 0, 'word', 'clerk', 'x0', 5, 'y0', 5, 'x1', 60, 'y1', 20), named_struct('pos', 1, 'word', clerk, 'x0', 70, 'y0', 5, 'x1', 120, 'y1', 20)))")
    marks = first.selectExpr("doc_id", "'bookmark' AS kind", "0 AS page_num", "concat('Orders of CLERK ', clerk, ' and others') AS value")
    plan = plan_redaction(first.select("doc_id"), items, pages, words, hits, read, images, seal, marks)
    return plan.where("stage < 5").select(F.col("doc_id").cast("long").alias("doc_id"), "stage", "kind", "page_num", "xref", "value", "action", "x0", "y0", "x1", "y1")


def v06_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents read again by a scanner: what is still visible and pages that could not be read are failures."""
    rows = _people(spark, sf_dir).withColumn("doc_id", F.col("k").cast("string"))
    outputs = rows.select("doc_id", F.inline(F.expr("array(named_struct('page_num', 1, 'text', case when k % 4 = 0 then concat('by ', lower(last), ' today') else concat(last, 'ia was there') end, 'error', cast(null as string)), named_struct('page_num', 2, 'text', '', 'error', case when k % 7 = 0 then 'no image' end))")))
    return W.verify_scanned(outputs, rows.select("doc_id", F.col("last").alias("text"))).select(F.col("doc_id").cast("long").alias("k"), F.array_join("failures", "; ").alias("failures"), "status")


def o08_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected matches of the documents by category, most first."""
    ranked = R.rank_matches(_deduped(spark, sf_dir))
    return R.selected_categories(ranked.where("match_idx % 2 = 0"), "n")


def b06_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as placements of images on pages: each image of an order is read once, pages that were scanned are left out."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page_num", "l_suppkey % 3 AS xref", "l_returnflag")
    return S.unique_images(rows.select("doc_id", "page_num", "xref"), rows.where("l_returnflag = 'R'").select("doc_id", "page_num").distinct())


def k11_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = S.metadata_plan(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id")))
    return plan.groupBy("kind", "value", "action").agg(F.count("*").alias("n"))


def r04_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of a page for each order: those of even orders stand in two columns, those of odd ones below each other, where
    wide ones go on in the next; the first row is a header's, the third one after it is set apart."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = _table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(at) - 1)
    rows = rows.selectExpr("l_orderkey AS doc_id", "1 AS page_num", "n", "l_orderkey % 2 = 0 AS two", "cast(l_quantity as int) AS q").withColumn("r", F.expr("case when two then n div 2 else n end"))
    top = F.expr("case when r = 0 then 40.0D else 200.0D + r * 13 + (case when r >= 3 then 20 else 0 end) end")
    left, wide = F.expr("case when two then 55.0D + 200 * (n % 2) else 55.0D end"), F.expr("case when two then 60.0D when q % 3 = 0 then 150.0D else 400.0D end")
    lines = rows.select("doc_id", "page_num", left.alias("x0"), top.alias("y0"), (left + wide).alias("x1"), (top + 12).alias("y1"), F.format_string(" %d  of %d ", "n", "q").alias("text"), F.lit(842.0).alias("height"))
    return layout_pages(lines, drop_zones=True).select("doc_id", F.replace("text", F.lit(W.CELL), F.lit(" | ")).alias("text"))


def k06_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a run over orders as documents, their line items as entries, some with notes; urgent orders were flagged, and the run
    was stopped before the last ones."""
    orders, items = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    at = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    entries = items.withColumn("match_idx", F.row_number().over(at)).selectExpr("cast(l_orderkey as string) AS document_name", "concat(l_orderkey, '_out') AS output_name", "cast(l_suppkey % 3 + 1 as int) AS page_num", "cast(l_partkey % 9 as int) AS line_num",
                                                                                "match_idx", "concat('part ', l_partkey) AS text", "l_returnflag AS category", "l_discount * 10 AS confidence", "case when l_linestatus = 'O' then concat('sent ', date(l_shipdate)) end AS notes")
    flagged = orders.where("o_orderpriority = '1-URGENT'").selectExpr("cast(o_orderkey as string) AS document_name", "concat('status ', o_orderstatus) AS reason")
    run = orders.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("successful"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_flagged"))
    run = run.selectExpr("'REDACTION' AS operation", "'redacted' AS verb", "'/in' AS folder", "'Torvin Vardane' AS subject", "'2026-01-02 03:04:05' AS processed", "total", "successful", "n_flagged", "successful < total AS cancelled")
    return R.audit_log(run, entries, flagged)


def manual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by hand: one that is fine, one that is too short, one on a page that is not there."""
    rows = _people(spark, sf_dir).withColumn("doc_id", F.col("k").cast("string"))
    ranked = rows.where("k % 2 = 0").selectExpr("doc_id", "first AS text", "'Student name' AS category", "0.95D AS confidence", "1 AS page_num", "1 AS line_num", "'' AS context", "'regex' AS source", "0 AS match_idx")
    more = rows.selectExpr("doc_id", "inline(array(named_struct('text', concat(' ', last, ' '), 'category', cast(null as string), 'page_num', 1), named_struct('text', 'Bo', 'category', cast(null as string), 'page_num', 1), named_struct('text', 'Late', 'category', cast(null as string), 'page_num', 3)))")
    return R.add_manual(ranked, more, rows.selectExpr("doc_id", "2 AS total_pages")).select(F.col("doc_id").cast("long").alias("k"), "match_idx", "text", "category", "confidence", "line_num", "source")


def e06_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that people gave: one that fits a written form, one that shows a name and is refused, one typed, one for the student."""
    rows = _people(spark, sf_dir).withColumn("case_id", F.col("k").cast("string"))
    named = "array('S. Harcastle', 'Sidonie Harcastle', concat('Ansgar ', town), 'Ms Plimmer')"
    chosen = rows.select("case_id", F.lit("d").alias("doc_order"), F.posexplode(F.expr(named)).alias("match_idx", "text"), F.lit("Person name (NER)").alias("category"))
    answer = lambda place, name, role, custom: F.struct(F.lit(place).alias("place"), F.expr(name).alias("name"), F.lit(role).alias("role"), F.expr(custom).cast("string").alias("custom"))
    answers = rows.select("case_id", F.inline(F.array(answer(0, "'Ms Harcastle'", "teacher", "null"), answer(1, "concat('Ansgar ', town)", "other", "concat('aide of ', first)"), answer(2, "'Ms Plimmer'", "health", "'night nurse'"), answer(3, "concat(first, ' ', last)", "teacher", "null"))))
    cases = I.cases(rows).select("case_id", "student_name", *[F.array().cast("array<string>").alias(c) for c in ("parent_names", "family_names", "organisation_names")])
    return who.owner_labels(who.build_rosters(cases, chosen, answers)).select(F.col("case_id").cast("long").alias("k"), "seq", "full_name", "role", "label")


def s08_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as the blocks of a page, those with even keys text."""
    rows = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("page_num")).agg(F.collect_list(F.struct((F.col("n_nationkey") % 2).alias("kind"), F.col("n_name").alias("text"))).alias("blocks"))
    return blocks_of_page(rows.withColumn("doc_id", F.lit("d"))).select("page_num", "text")


def s09_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as spans of one line; some have no text, some no box."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct(F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_linestatus")).alias("text"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber").cast("double")).alias("x0"), *[F.col("l_quantity").cast("double").alias(c) for c in ("y0", "x1", "y1")]).alias("s"))
    lines = rows.groupBy("doc_id").agg(F.array(F.struct(F.array(F.struct(F.collect_list("s").alias("spans"))).alias("lines"))).alias("blocks"))
    return spans_of_page(lines.withColumn("page_num", F.lit(1))).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("x0").alias("x0"), F.sum("y1").alias("y1"))


def p01_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligatures, full-width letters, parted accents and curly quotes made plain; settled text stays."""
    rows = _people(spark, sf_dir).select("k", F.expr("concat(first, '’s “', last, '” ﬁle Ａ e\u0301 é ß')").alias("text"))
    return X.normalise(rows)


def p03_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each document's middle."""
    rows = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("s"))
    return rows.select("doc_id", X.context(F.col("text"), F.col("s"), F.col("s") + 3).alias("context"))


def p05_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by discount as if it were a confidence: the label's bounds on a large table."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(X.confidence_label(F.col("l_discount").cast("double") * 10).alias("label")).agg(F.count("*").alias("n"))


def p09_name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).select("k", F.expr("case when k % 10 = 0 then null when k % 10 = 1 then '' else concat(' ', first, ' ', last, ', ,', seen_by, ',') end").alias("typed"))
    return rows.select("k", F.array_join(X.name_list(F.col("typed")), "|").alias("names"))


def f01_gate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that a date of birth's label lets through."""
    gate = next(d.gate for d in REGISTRY if d.category == "Date of birth")
    lines = X.to_lines(_pages(spark, sf_dir).select("doc_id", "text")).where(F.col("line").rlike(gate))
    return lines.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n_lines"))


def f02_page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label anywhere on a page flags all its dates; a label on a line those of that line or, without any, of the next."""
    rows = _people(spark, sf_dir)
    pages = I.reports(rows).drop("text").join(rows.select(F.col("k").cast("string").alias("case_id"), F.expr("concat('Born in spring.\nSeen ', dob, ' and 3-4-2021.\nLeft 5/6/2022.')").alias("text")), "case_id")
    by_page = pages.select("doc_id", F.lit("page").alias("scope"), F.inline(page_entities(F.col("text")))).where("type = 'AU_DOB'").groupBy("doc_id", "scope").agg(F.count("*").alias("n"))
    by_line = detect_lines(pages).where("category = 'Date of birth'").groupBy("doc_id", F.lit("line").alias("scope")).agg(F.count("*").alias("n"))
    return by_page.unionByName(by_line).withColumn("doc_id", F.col("doc_id").cast("long"))


def f12_image_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_partkey % 4 as int) AS n_words", "cast(l_suppkey % 3 as int) AS n_images")
    return S.image_only_pages(rows).select("l_orderkey", "l_linenumber", "n_images")


def b01_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS page_num", "cast(l_partkey % 600 + 1 as double) AS width", "cast(l_suppkey % 900 + 100 as double) AS height")
    return S.zones(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("y0"), 6).alias("y0"), F.round(F.sum("y1"), 6).alias("y1"), F.sum("x1").alias("x1"))


def j05_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"))
    rest = R.missing_documents(docs, _phones_and_emails(_pages(spark, sf_dir)))
    return rest.agg(F.count("*").alias("n"), F.max("error").alias("error"))


def j14_effective_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).select(F.col("k").alias("case_id"), F.col("seen_by").alias("full_name"))
    people = rows.withColumn("suggested_role", F.lit("teacher"))
    answers, ignored = rows.where("case_id % 3 = 0").withColumn("role", F.lit("carer")), rows.where("case_id % 5 = 0")
    return effective_roles(people, answers, ignored).select(F.col("case_id").alias("k"), "full_name", "role")


def a01_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.match_counts(_deduped(spark, sf_dir))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n")


def a06_ocr_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matches on pages; the second and third page of every other order were scanned."""
    matches = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "cast(l_linenumber as int) AS page_num")
    return R.ocr_item_counts(matches, _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "case when o_orderkey % 2 = 0 then array(2, 3) else cast(array() as array<int>) end AS ocr_pages"))


def a11_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_totals(_table(spark, sf_dir, "orders").selectExpr("o_orderstatus = 'F' AS success", "cast(o_custkey as int) AS items", "case when o_orderstatus = 'P' then array('x', 'y') else cast(array() as array<string>) end AS failures", "case when o_orderkey % 3 = 0 then array('w') else cast(array() as array<string>) end AS ocr_warnings"))


def a15_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return who.ambiguity_notes(_known(spark, sf_dir)["forms"]).select(F.col("case_id").cast("long").alias("k"), "form", "note")


def a16_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression report over a corpus."""
    return R.corpus_counts(_phones_and_emails(_pages(spark, sf_dir)))


def a17_folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.folder_counts(_table(spark, sf_dir, "orders").selectExpr("split_part('pdf,converted,failed,protected,pdf', ',', cast(o_orderkey % 5 + 1 as int)) AS status"))


def e09_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).withColumn("case_id", F.col("k").cast("string"))
    person = lambda seq, name, role, source: f"named_struct('seq', {seq}, 'full_name', {name}, 'label', '[x]', 'role', '{role}', 'custom', cast(null as string), 'source', '{source}')"
    people = rows.selectExpr("case_id", f"inline(array({person(1, 'mother_first', 'parent', 'entered')}, {person(2, 'seen_by', 'other', 'detected')}, {person(3, chr(39) + 'Dr Lee' + chr(39), 'other', 'detected')}))")
    mentions = rows.selectExpr("case_id", "inline(array(named_struct('full_name', seen_by, 'at', 1, 'context', concat('the tutor, ', seen_by)), named_struct('full_name', seen_by, 'at', 2, 'context', concat(seen_by, ' said')), named_struct('full_name', mother_first, 'at', 3, 'context', 'the mother')))")
    return describe_people(people, mentions).select(F.col("case_id").cast("long").alias("k"), "full_name", "occurrences", "suggested_role", "confidence", "evidence")


def k05_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).withColumn("case_id", F.col("k").cast("string"))
    run = _run(spark, sf_dir)
    names = rows.selectExpr("case_id", "concat(first, '.pdf') AS original", "case when k % 2 = 0 then 'Student document_deidentified.txt' end AS produced")
    return key_lines(run["owners"], who.ambiguity_notes(run["forms"]), names).where("section > 0").select(F.col("case_id").cast("long").alias("k"), "section", "line")


def r10_filename_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.filename_names(I.cases(_people(spark, sf_dir))).select(F.col("case_id").cast("long").alias("k"), F.array_join("names", "|").alias("names"))


def w07_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations as scanned words whose lines are told apart by block and line together: runs of one line number in
    two blocks stay two lines, however often a line comes back."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("pos", "word"))
    words = rows.select("*", F.expr("cast(pos div 4 % 2 as int)").alias("block"), F.expr("cast(pos div 8 % 3 as int)").alias("line"), F.when(F.col("pos") % 11 == 3, -1).otherwise(F.lit(90)).alias("conf"))
    lines = S.lines_of_words(words)
    return lines.select(F.col("doc_id").cast("long").alias("conv_id"), "page_num", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.length("text").alias("n_chars"), F.round("confidence", 9).alias("confidence"))


def u04_native_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with text of their own, and scanned ones that were produced, as arrays of line numbers of an order."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("pages")).withColumn("ocr", F.array(F.lit(3), F.lit(2), F.lit(99)))
    text = lambda a: F.array_join(F.array_sort(a).cast("array<string>"), ",")
    return rows.select("l_orderkey", text(R.native_pages("pages", "ocr")).alias("native"), text(R.scanned_pages("pages", "ocr")).alias("scanned"))


def r05_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of two cells a person, laid out; of scanned pages the text that was read stays, form values follow the others."""
    rows = _people(spark, sf_dir).withColumn("doc_id", F.col("k").cast("string"))
    cell = lambda x, y, text: F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 60.0).alias("x1"), F.lit(y + 12.0).alias("y1"), F.col(text).alias("text"))
    lines = rows.select("doc_id", F.lit(1).alias("page_num"), F.lit(842.0).alias("height"), F.inline(F.array(cell(55.0, 400.0, "first"), cell(230.0, 400.5, "last"), cell(55.0, 430.0, "school"), cell(230.0, 430.0, "town"))))
    pages = rows.select("doc_id", F.lit(1).alias("page_num"), F.lit("scan").alias("text"), F.expr("case when k % 2 = 0 then 'native' else 'ocr' end").alias("method"), F.expr("case when k % 3 = 0 then email end").alias("widget_values"))
    return formatted_pages(pages, layout_pages(lines)).select(F.col("doc_id").cast("long").alias("k"), F.replace("text", F.lit(W.CELL), F.lit(" | ")).alias("text"))


def n07_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model behind the adapter, which finds towns and the people of a list in batches of texts; places are left out."""

    def find(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        kinds = {n: "PERSON" for n in I.SEEN_BY.split(",")} | {n: "LOCATION" for n in I.TOWNS.split(",")}
        return [[(t.index(n), t.index(n) + len(n), kind, 0.85) for n, kind in kinds.items() if n in t] for t in texts]

    pages, _ = _reports(spark, sf_dir)
    _, hits = entity_matches(pages, recogniser_udf(find)(F.col("text")))
    return hits.select(F.col("doc_id").cast("long").alias("k"), "text", "category", "confidence", "line_num", "context")


def a10_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pages with images: images per document that a text output cannot show."""
    return S.image_counts(_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "cast(l_quantity as int) % 4 AS n_images", "case when l_returnflag = 'R' then 'ocr' else 'native' end AS method"))


def v05_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen names that the text of a redacted document still shows as whole words, on any page."""
    rows = _people(spark, sf_dir).withColumn("doc_id", F.col("k").cast("string"))
    outputs = rows.selectExpr("doc_id", "inline(array(named_struct('page_num', 1, 'text', concat(first, 'ia and ', upper(last))), named_struct('page_num', 2, 'text', case when k % 3 = 0 then concat('by ', first, '-', last) else 'nothing' end)))")
    chosen = rows.selectExpr("doc_id", "inline(array(named_struct('text', first), named_struct('text', last), named_struct('text', concat(first, ' ', last)), named_struct('text', 'by')))")
    return W.verify_redaction(outputs, chosen).select(F.col("doc_id").cast("long").alias("k"), "text")


def f06_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which categories are of people, which of their texts are replaced (words of forms are not, known names always are) and by what."""
    rows = _people(spark, sf_dir)
    forms = rows.select(F.col("k").alias("case_id"), F.lower("first").alias("form"), F.lit(0).alias("at"), F.lit("[Student]").alias("label"))
    each = rows.select(F.col("k").alias("case_id"), "first", F.explode(F.expr("array('Student name', 'Phone number', 'Organisation name', 'Family member', 'PERSON (NER)')")).alias("category")).select("*", F.posexplode(F.expr("array(first, 'Phone:', concat('the ', first, ' family'), concat(first, 'ia'))")).alias("kind", "text"))
    return who.resolve(each, forms).select(F.col("case_id").alias("k"), "category", "kind", N.is_person_category(F.col("category")).alias("person"), "replaced", "label")


def e07_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of each case but for the student and organisations, and where they come from."""
    return who.people(_known(spark, sf_dir)["owners"]).select(F.col("case_id").cast("long").alias("k"), "full_name", "label", "role", "source")


def _pairs_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for one large case: each document's first ten pairs of neighbouring words."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"(?U)\w+ \w+"), F.lit(0)), 1, 10)
    return _table(spark, sf_dir, "documents").select(F.explode(words).alias("name")).select(F.lower("name").alias("name")).distinct()


def j01_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About ten thousand names at scale 0.01 (pairs of words of the documents), each looked for in all lines of all documents."""
    lines = X.to_lines(_pages(spark, sf_dir).select("doc_id", "text"))
    names = _pairs_of_words(spark, sf_dir).withColumn("scope", F.lit("all"))
    found = lexicon_join(lines.withColumn("scope", F.lit("all")), names, ["scope"], ["doc_id", "line_num"])
    # two distinct counts at once would send every place twice
    by_doc = found.groupBy("name", "doc_id").agg(F.count_distinct("line_num").alias("n"))
    return by_doc.groupBy("name").agg(F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("n_lines"), F.count("doc_id").alias("n_docs"))


def j01_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the reports of customers by the index, with their categories and contexts, as the detectors' own lists would find them."""
    pages, _ = _reports(spark, sf_dir)
    rows = _people(spark, sf_dir)
    one = lambda name, category, confidence, rank: F.struct(F.expr(name).alias("name"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(rank).alias("rank"))
    names = rows.select(F.col("k").cast("string").alias("case_id"), F.inline(F.array(one("first", "Student name", 0.95, 1), one("seen_by", "Family member (user-provided)", 0.95, 15), one("town", "Organisation name", 0.95, 16), one("'XQ'", "Student ID", 0.65, 9))))
    found = listed_matches(pages, names)
    return found.select(F.col("doc_id").cast("long").alias("k"), "line_num", "text", "category", "confidence", "context")


def v02_misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all conversations that may be misread words of the benchmark's texts, each pair of distinct words once."""
    words = lambda table: _table(spark, sf_dir, table).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    return near_words(words("conversations").withColumnRenamed("w", "word"), words("benchmark").withColumnRenamed("w", "token"))


def v02_misread_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a conversation (its first turn's words) that a later turn shows misread, by conversation."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("ws"))
    words = turns.where("turn > 0").select("doc_id", F.explode("ws").alias("word"))
    items = turns.where("turn = 0").select("doc_id", F.explode("ws").alias("text"))
    return misread_items(words, items).select(F.col("doc_id").alias("conv_id"), "text", "word")


def _spans(spark: SparkSession, sf_dir: str, flag: str, name: str) -> DataFrame:
    """Line items as spans of a part: from a day, for as many days as their quantity."""
    rows = _table(spark, sf_dir, "lineitem").where(f"l_returnflag {flag}").withColumn(f"{name}_start", F.datediff("l_shipdate", F.lit("1990-01-01")))
    return rows.select(F.col("l_partkey").alias("part"), f"{name}_start", (F.col(f"{name}_start") + F.col("l_quantity").cast("int") * F.when(F.col("l_suppkey") % 50 == 0, 100).otherwise(1)).alias(f"{name}_end"), F.col("l_orderkey").alias(f"{name}_order"), F.col("l_linenumber").alias(f"{name}_line"))


def j02_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that returned items of a part share with its other ones: how many pairs, and how many days together."""
    pairs = V.overlap_join(_spans(spark, sf_dir, "= 'R'", "a"), _spans(spark, sf_dir, "<> 'R'", "b"), ["part"], ("a_start", "a_end"), ("b_start", "b_end"))
    days = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return pairs.groupBy("part").agg(F.count("*").alias("n"), F.sum(days).alias("days"))


def j02_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items of a part that lie within none of its other ones, as street addresses do that are no part of a full one."""
    a, b = _spans(spark, sf_dir, "= 'R'", "a"), _spans(spark, sf_dir, "<> 'R'", "b")
    rest = V.not_within(a, b.select("part", "b_start", "b_end"), ["part"], ("a_start", "a_end"), ("b_start", "b_end"), ["part", "a_order", "a_line", "a_start", "a_end"])
    return rest.groupBy("part").agg(F.count("*").alias("n"), F.sum("a_start").alias("starts"))


def j03_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last order before it or at that time, and whether that one is less than three days old. Orders are
    put at times of the month of the events."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 2678400)")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), at.alias("ordered_at"), "o_orderkey")
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = asof_join(events, orders, ["user_id"], "ts", "ordered_at", stretch=86_400)
    recent = asof_join(events, orders.withColumnsRenamed({"o_orderkey": "recent", "ordered_at": "recent_at"}), ["user_id"], "ts", "recent_at", within=3 * 86_400)
    return found.select("event_id", "o_orderkey").join(recent.select("event_id", "recent"), "event_id")


def t06_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events that follow each other within 90 minutes."""
    made = T.sessions(_table(spark, sf_dir, "events"), ["user_id"], "ts", "90 minutes", value=F.round(F.sum("value"), 4), errors=F.count_if(F.col("event_type") == "error"))
    return made.withColumn("end", F.col("end").cast("string")).withColumn("start", F.col("start").cast("string"))


def t06_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind in windows of six hours, one every two hours."""
    made = T.sliding(_table(spark, sf_dir, "events"), ["event_type"], "ts", "6 hours", "2 hours", value=F.round(F.sum("value"), 4))
    return made.withColumn("end", F.col("end").cast("string")).withColumn("start", F.col("start").cast("string"))


def e01_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e01_people by a stream: the chosen matches of the reports come in five batches, split by text and not by document."""
    pages, cases = _reports(spark, sf_dir)
    ranked = detect(pages, cases, _seen_by())
    chosen = ranked.where(R.preselected(F.col("category"), "deidentify")).select("case_id", F.col("doc_id").alias("doc_order"), "match_idx", "text", "category")
    kept = Kept(spark)
    chosen = kept.cut(chosen)  # detection is not run again to deal its rows
    files = -(-chosen.rdd.getNumPartitions() // 5)  # of a batch, so that a batch is many tasks however large it is
    chosen.repartition(5 * files, "text", F.pmod(F.xxhash64("doc_order"), F.lit(files))).write.parquet(f"{kept.root}/in")
    stream = spark.readStream.schema(chosen.schema).option("maxFilesPerTrigger", files).parquet(f"{kept.root}/in")
    write_people(stream, cases, f"{kept.root}/people", f"{kept.root}/checkpoint").awaitTermination()
    owners = who.owner_labels(current_rosters(spark, f"{kept.root}/people", cases))
    return owners.select(F.col("case_id").cast("long").alias("k"), "seq", "full_name", "role", "label")


def a16_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matches: reports of two runs merged, and whether their estimates lie within the stated errors of the exact numbers."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_linestatus", "l_returnflag AS category", "l_orderkey AS doc_id", "concat(l_partkey, '-', l_suppkey) AS text", "l_discount AS confidence")
    runs = [Q.report(rows.where(F.col("l_linestatus") == v)) for v in ("F", "O")]
    said = Q.read(Q.merge(runs[0].unionByName(runs[1]))).withColumnRenamed("n", "n_said")
    tasks = tasks_of(rows.count())  # distinct values are dealt by rows, as each has an entry in the memory of its task
    distinct = lambda c, n: rows.where(F.col(c).isNotNull()).select("category", c).repartition(tasks, "category", c).distinct().groupBy("category").agg(F.count("*").alias(n))
    exact = distinct("text", "texts").join(distinct("doc_id", "documents"), "category")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= Q.DISTINCT_ERROR * F.col(b)
    both = exact.join(said, "category")
    middle = rows.join(F.broadcast(said.select("category", "q50")), "category").groupBy("category").agg(F.avg((F.col("confidence") < F.col("q50")).cast("int")).alias("below"), F.avg((F.col("confidence") <= F.col("q50")).cast("int")).alias("upto"))
    fine = (F.col("below") <= 0.5 + Q.RANK_ERROR) & (F.col("upto") >= 0.5 - Q.RANK_ERROR)
    return both.join(middle, "category").select("category", F.col("n_said").alias("n"), near("n_texts", "texts").alias("texts_fine"), near("n_documents", "documents").alias("documents_fine"), fine.alias("median_fine"))


_NAMED: list[Query] = [
    flagship, p02_lines, d01_names, d03_phone, d04_email, d10_dob_same_line, w01_match_dedup, w01_ties, a02_by_category, a03_summary, a05_doc_category, j04_selected, u03_deselected, v03_levenshtein, d17_variations, d17_nicknames,
    d_detectors, n08_entities, o05_sweep, e01_people, w04_shared_token, r02_deidentify, r02_documents, a14_role_vote, v01_visible, v02_fuzzy, r09_filename, f14_preselect, f07_clean_person, p08_paths, p06_context, k07_names,
    k08_safe_name, k03_finished, s05_choose_text, s07_ocr_lines, j10_ocr_items, f13_signature, b03_boxes, b08_plan, r04_layout, k06_audit, manual_matches, e06_answers,
    s08_blocks, s09_spans, p01_normalise, p03_context, p05_label, p09_name_list, f01_gate_lines, f02_page_gate, f12_image_only, b01_zones, j05_missing, j14_effective_role, a01_counts, a06_ocr_items, a11_run_totals,
    d_documents, e10_preview, b00_plan, v06_scanned, o08_categories, b06_images, k11_metadata, r05_formatted, n07_model, a10_images, v05_redaction, f06_person, e07_people, a15_ambiguity, a16_corpus, a17_folder_counts, e09_describe, k05_key, r10_filename_names, w07_runs, u04_native_pages,
    a16_sketches, t06_sessions, t06_sliding, e01_stream, d14_context, j01_lexicon, j01_listed, v02_misread, v02_misread_items, j02_ranges, j02_within, j03_asof,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _NAMED}


def oracle_sql() -> dict[str, str]:
    return ORACLES
