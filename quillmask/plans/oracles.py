"""SQL that gives the rows of the registered queries, over the driver's tables or people invented from them."""

from __future__ import annotations

from .invented import AUNT, BRACKETED, DOTTED, LANDLINE, LONG_DATE, PEOPLE

_PHONE = r"""'\+61[\s\-]*4\d{2}[\s\-]*\d{3}[\s\-]*\d{3}', '\+61[\s\-]*[2-478][\s\-]*\d{4}[\s\-]*\d{4}', '0[2-478][\s\-]*\d{4}[\s\-]*\d{4}', '\(0[2-478]\)[\s\-]*\d{4}[\s\-]*\d{4}', '04\d{2}[\s\-]*\d{3}[\s\-]*\d{3}', '04\d{8}'"""
_EMAIL = r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"
_DATES = r"""'\d{1,2}/\d{1,2}/\d{2,4}', '\d{1,2}-\d{1,2}-\d{2,4}', '\d{1,2}\.\d{1,2}\.\d{2,4}'"""

#: Lines of all documents, then matches of one set of patterns: the dotted phone patterns look behind themselves, which this
#: dialect lacks; no line holds one.
_LINES = "lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_num FROM documents WHERE text IS NOT NULL)"


def _hits(name: str, category: str, patterns: str) -> str:
    return f"{name} AS (SELECT doc_id, lang, line_num, line, p.nth AS nth, unnest(regexp_extract_all(line, p.p)) AS text, '{category}' AS category FROM lines, (SELECT unnest([{patterns}]) AS p, unnest(range(0, len([{patterns}]))) AS nth) p)"


_FOUND = f"{_LINES}, {_hits('phones', 'Phone number', _PHONE)}, {_hits('emails', 'Email address', _EMAIL)}, found AS (SELECT * FROM phones UNION ALL SELECT * FROM emails)"
_DEDUP = (f"{_FOUND}, deduped AS (SELECT doc_id, lang, line_num, min_by(text, nth) AS text, min_by(category, nth) AS category, 0.95 AS confidence, "
          "min(CASE WHEN category = 'Phone number' THEN nth * 100000 ELSE 9000000 END + instr(line, text)) AS ord FROM found GROUP BY doc_id, lang, line_num, lower(text)), "
          "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_num, ord) - 1 AS match_idx FROM deduped)")  # fmt: skip


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"



ORACLES = {
    "flagship": f"WITH {_DEDUP} SELECT category, 'high' AS label, count(*) AS n FROM deduped GROUP BY category",
    "p02_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS n_chars, max(line_num) AS last_line FROM lines GROUP BY doc_id",
    "d03_phone": f"WITH {_FOUND} SELECT doc_id, line_num, min_by(text, nth) AS text, 0.95::DOUBLE AS confidence FROM phones GROUP BY doc_id, line_num, lower(text)",
    "d04_email": f"WITH {_FOUND} SELECT doc_id, line_num, text, 0.95::DOUBLE AS confidence FROM emails",
    "w01_match_dedup": f"WITH {_DEDUP} SELECT doc_id, match_idx, line_num, text, category FROM ranked",
    "a02_by_category": f"WITH {_DEDUP} SELECT category, count(*) AS n FROM deduped GROUP BY category",
    "a03_summary": f"WITH {_DEDUP}, labelled AS (SELECT category, 'high' AS label FROM deduped) SELECT category, label, count(*) AS n FROM labelled GROUP BY GROUPING SETS ((category), (label), ())",
    "a05_doc_category": f"WITH {_DEDUP} SELECT doc_id, category, count(*) AS n, bool_or(confidence < 0.8) AS uncertain FROM deduped GROUP BY doc_id, category",
    "j04_selected": f"WITH {_DEDUP} SELECT doc_id, match_idx, text FROM ranked WHERE match_idx = 0",
    "u03_deselected": f"WITH {_DEDUP} SELECT DISTINCT doc_id, lower(text) AS text FROM ranked r WHERE match_idx > 0 AND NOT EXISTS (SELECT 1 FROM ranked s WHERE s.doc_id = r.doc_id AND s.match_idx = 0 AND lower(s.text) = lower(r.text))",
    "v03_levenshtein": "SELECT n_name, r_name, levenshtein(lower(n_name), lower(r_name)) AS distance, regexp_matches(lower(r_name), '^[a-z]{5,}$') AND abs(length(n_name) - length(r_name)) <= 2 AND "
                       "levenshtein(lower(n_name), lower(r_name)) <= CASE WHEN length(r_name) <= 7 THEN 1 ELSE 2 END AS close FROM nation JOIN region ON n_regionkey = r_regionkey",
    "r02_documents": f"WITH {_DEDUP} SELECT 'all' AS scope, count(DISTINCT doc_id) AS docs_changed, count(*) AS emails FROM emails",
    "p05_label": "SELECT CASE WHEN l_discount::DOUBLE * 10 >= 0.8 THEN 'high' WHEN l_discount::DOUBLE * 10 >= 0.5 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM lineitem GROUP BY 1",
    "f01_gate_lines": f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines FROM lines WHERE regexp_matches(line, '(?i)DOB|D\\.O\\.B\\.|Date of Birth|Born|Birth Date') GROUP BY doc_id",
    "j05_missing": f"WITH {_FOUND} SELECT count(*) AS n, 'Run detection first' AS error FROM documents d WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = d.doc_id)",
    "a01_counts": f"WITH {_DEDUP} SELECT doc_id, count(*) AS n FROM deduped GROUP BY ROLLUP (doc_id)",
    "a16_corpus": f"WITH {_FOUND}, seen AS (SELECT DISTINCT doc_id, category, lower(text) AS text FROM found) SELECT category, count(*) AS n, count(DISTINCT text) AS n_texts FROM seen GROUP BY category",
}


def _rows(*parts: tuple[str, ...], columns: str, where: dict[int, str] | None = None) -> str:
    """A union of rows of formulas over the invented people."""
    names = columns.split(", ")
    return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {n}" for n, v in zip(names, row, strict=True)) + " FROM p" + (f" WHERE {row_where}" if (row_where := (where or {}).get(i)) else "") for i, row in enumerate(parts))


_FULL, _MOTHER = "first || ' ' || last", "mother_first || ' ' || mother_last"
_NAME = "'Student name', 0.95::DOUBLE"
#: What detectors must find in a report: line, text, category and confidence, and for whom.
_MATCHES = [
    ("1", _FULL, _NAME, ""), ("1", "first", _NAME, ""), ("1", "last", _NAME, ""), ("2", "phone", "'Phone number', 0.95", ""), ("3", "email", "'Email address', 0.95", ""), ("4", "address", "'Address', 0.95", ""), ("4", "town", "'Organisation name', 0.95", ""),
    ("6", "dob", "'Date of birth', 0.90", ""), ("7", "medicare", "'Medicare number', 0.95", ""), ("8", "crn", "'Centrelink CRN', 0.65", ""), ("9", "ndis", "'NDIS number', 0.90", ""), ("10", "abn", "'ABN', 0.90", ""), ("11", "passport", "'Passport number', 0.65", ""),
    ("12", "code", "'Student ID', CASE WHEN k % 2 = 0 THEN 0.95 ELSE 0.65 END", ""), ("13", _MOTHER, "'Parent/Guardian (user-provided)', 0.95", ""), ("13", "last", _NAME, "mother_last = last"), ("14", "street", "'Address', 0.65", ""), ("15", "nick", "'Student name (nickname)', 0.75", "nick IS NOT NULL"),
]
_DETECTED = "found AS (" + " UNION ALL ".join(f"SELECT k AS doc_id, {n} AS line_num, {t} AS text, a AS category, b AS confidence FROM (SELECT *, {c.rpartition(', ')[0] if not c.startswith(chr(39) + 'Student ID') else chr(39) + 'Student ID' + chr(39)} AS a, ({c.rpartition(', ')[2] if not c.startswith(chr(39) + 'Student ID') else c.partition(', ')[2]})::DOUBLE AS b FROM p) q" + (f" WHERE {w}" if w else "") for n, t, c, w in _MATCHES) + ")"
#: The reports with labels: the lines, and how many texts were replaced.
_CLEAN = ["'Report on [Student]'", "'Ring [phone] after lunch'", "'or write to [email]'", "'home: [address]'", "'Date of Birth:'", "'[date of birth]'", "'Medicare [Medicare number]'", "'CRN [Centrelink CRN]'", "'NDIS number: [NDIS number]'", "'ABN: [ABN]'", "'passport no [passport number]'",
          "'code [student ID]'", "'Mother: [Parent]'", "'walks along [address] daily'", "CASE WHEN nick IS NULL THEN 'all was well' ELSE '[Student] was late' END", "'seen by [Other person]'"]
_SAME = "mother_last = last"
_ALL_FORMS = "unnest([first || ' ' || last, first, last, substr(first, 1, 1) || '. ' || last, first || ' ' || substr(last, 1, 1) || '.', substr(first, 1, 1) || '.' || substr(last, 1, 1) || '.'])"
_TURNS = "turns AS (SELECT conv_id, turn::INT AS page_num, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS pos FROM conversations WHERE text IS NOT NULL)"

ORACLES |= {
    "w01_ties": "WITH o AS (SELECT * FROM orders), m AS (SELECT o_custkey AS doc_id, o_orderkey::INT AS line_num, o_orderpriority AS text, 'A' AS category, 0.65::DOUBLE AS confidence FROM o UNION ALL SELECT o_custkey, o_orderkey::INT, o_orderstatus || ' only', 'D', 0.95 FROM o) "
                "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, line_num) - 1)::INT AS match_idx, line_num, text, category, confidence FROM m",
    "d17_variations": f"WITH {PEOPLE} SELECT k, {_ALL_FORMS} AS form FROM p",
    "d17_nicknames": f"WITH {PEOPLE} SELECT k, unnest(CASE first WHEN 'Matthew' THEN ['matt'] WHEN 'Daniel' THEN ['dan', 'danny'] END) AS form FROM p",
    "d_detectors": f"WITH {PEOPLE}, {_DETECTED} SELECT * FROM found",
    "d_documents": f"WITH {_DEDUP} SELECT category, count(*) AS n FROM deduped GROUP BY category",
    "n08_entities": f"WITH {PEOPLE}, n AS (" + " UNION ALL ".join(f"SELECT k AS doc_id, {t} AS text, '{c}' AS category, {x}::DOUBLE AS confidence, {n} AS line_num FROM p" + (f" WHERE {w}" if w else "") for n, t, c, x, w in [
        ("1", _FULL, "Student name", "0.95", ""), ("1", "first", "Student name", "0.95", ""), ("1", "last", "Student name", "0.95", ""), ("13", "last", "Student name", "0.95", _SAME), ("2", "phone", "Phone number", "0.85", ""), ("4", "address", "Address", "0.85", ""), ("6", "dob", "Date of birth", "0.9", ""),
        ("7", "medicare", "Medicare number", "0.9", ""), ("8", "crn", "Centrelink CRN", "0.85", ""), ("9", "ndis", "Centrelink CRN", "0.85", ""), ("16", "seen_by", "Person name (NER)", "0.9", ""), ("1", "first", "Person name (NER variation)", "0.85", ""), ("1", "last", "Person name (NER variation)", "0.85", ""),
        ("13", "last", "Person name (NER variation)", "0.85", _SAME), ("16", "split_part(seen_by, ' ', 1)", "Person name (NER variation)", "0.85", ""), ("16", "split_part(seen_by, ' ', 2)", "Person name (NER variation)", "0.85", "")]) + ") SELECT DISTINCT * FROM n",
    "o05_sweep": f"WITH {PEOPLE}, f AS (" + _rows(("k", "1", "first"), ("k", "2", "mother_first"), ("k", "3", "seen_by"), columns="doc_id, place, name", where={1: "k % 2 = 1"}) + ") SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth, name FROM f",
    "e01_people": f"WITH {PEOPLE} " + _rows(("k", "0", _FULL, "'student'", "'[Student]'"), ("k", "1", _MOTHER, "'parent'", "'[Parent]'"), ("k", "2", "school", "'organisation'", "'[Organisation]'"), ("k", "3", "seen_by", "'other'", "'[Other person]'"), columns="k, seq, full_name, role, label"),
    "e10_preview": f"WITH {PEOPLE} " + _rows(("k", _MOTHER, "'[Parent]'"), ("k", "seen_by", "CASE WHEN k % 3 = 0 THEN '[Teacher]' ELSE '[Psychologist]' END"), columns="k, full_name, label"),
    "w04_shared_token": f"WITH {PEOPLE} SELECT DISTINCT * FROM (" + _rows(("k", "lower(first)", "'[Student]'"), ("k", "lower(last)", f"CASE WHEN {_SAME} THEN '[Family name]' ELSE '[Student]' END"), ("k", "lower(mother_first)", "'[Parent]'"), ("k", "lower(mother_last)", f"CASE WHEN {_SAME} THEN '[Family name]' ELSE '[Parent]' END"), ("k", "lower(town)", "'[Organisation]'"), ("k", "lower(school)", "'[Organisation]'"), columns="k, form, label") + ") t",
    "r02_deidentify": f"WITH {PEOPLE} SELECT k, '--- Page 1 ---' || chr(10) || chr(10) || {' || chr(10) || '.join(_CLEAN)} AS body, CASE WHEN nick IS NULL THEN 14 ELSE 15 END AS n_replaced, 'written' AS status FROM p",
    "a14_role_vote": f"""WITH {PEOPLE}, s AS (SELECT k, k % 8 AS kind, k % 5 = 0 AS tutors FROM p),
      one AS (SELECT k, tutors, kind, ['parent', 'carer', 'teacher', 'school_staff', 'health', 'support_worker', 'other_student', NULL][kind + 1] AS role, ['mother', 'foster', 'tutor', 'chaplain', 'physio', 'advocate', 'classmate', NULL][kind + 1] AS word FROM s)
      SELECT k, CASE WHEN tutors THEN 'teacher' WHEN role IS NOT NULL THEN role ELSE 'health' END AS role, CASE WHEN tutors OR role IS NOT NULL THEN 'likely' ELSE 'possible' END AS confidence, CASE WHEN tutors THEN 'tutor' ELSE coalesce(word, 'Dr') END AS evidence FROM one""",
    "v01_visible": "SELECT n_name, unnest([n_name || 'ic tale', lower(n_name) || chr(39) || 's tale', 'by ' || replace(n_name, ' ', ' - '), 'by ' || replace(n_name, ' ', ''), '[' || n_name || ' 1] here']) AS body, unnest([false, true, true, true, false]) AS visible FROM nation",
    "v02_fuzzy": f"WITH {PEOPLE}, r AS (SELECT k, last, CASE k % 3 WHEN 0 THEN replace(lower(last), 'e', 'c') WHEN 1 THEN last || 'x' ELSE 'nothing' END AS read FROM p) SELECT k, read, abs(length(read) - length(last)) <= 2 AND levenshtein(lower(read), lower(last)) <= CASE WHEN length(last) <= 7 THEN 1 ELSE 2 END AS left_over FROM r",
    "r09_filename": f"WITH {PEOPLE} " + _rows(("k", "0", "'Plan ' || k"), ("k", "1", "'Plan'"), ("k", "2", "'Plan ' || k"), ("k", "3", "'Term Summary'"), ("k", "4", "'Summary'"), ("k", "5", "'document'"), columns="k, kind, safe"),
    "f07_clean_person": f"WITH {PEOPLE} " + _rows(("k", "0", "last", "false"), ("k", "1", _FULL, "false"), ("k", "2", "NULL", "false"), ("k", "3", "NULL", "false"), ("k", "4", "last || '-O' || chr(39) || 'Hara'", "false"), ("k", "5", "NULL", "true"), ("k", "6", "NULL", "false"), ("k", "7", "first", "false"), columns="k, kind, person, form_label"),
    "p08_paths": f"WITH {PEOPLE} " + _rows(("k", "0", "'open [path removed] failed'"), ("k", "1", "'at [path removed] now'"), ("k", "2", "'[path removed]'"), ("k", "3", "'see [path removed] or /etc/x'"), ("k", "4", "'no path of ' || first"), columns="k, kind, scrubbed"),
    "p06_context": f"WITH {PEOPLE} " + _rows(("k", "0", "'...by '", "false"), ("k", "1", "first", "true"), ("k", "2", "' and '", "false"), ("k", "3", "last", "true"), ("k", "4", "'...'", "false"), columns='k, "at", text, matched'),
    "k07_names": "WITH f AS (SELECT o_orderkey AS doc_id, o_orderpriority || ' ' || strftime(o_orderdate, '%Y-%m') AS stem, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS n FROM orders) SELECT doc_id, stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '_deidentified.txt' AS name FROM f",
    "k08_safe_name": f"WITH {PEOPLE} " + _rows(("k", "0", "first || '.txt'", "first || '.docx.pdf'"), ("k", "1", "last || '.txt'", "last || '.txt.pdf'"), ("k", "2", "NULL", "NULL"), ("k", "3", f"{_FULL} || '.txt'", f"{_FULL} || '.pdf'"), columns="k, kind, as_txt, as_pdf"),
    "k03_finished": "SELECT doc_id, lang IS DISTINCT FROM 'en' AS warns, true AS whole, CASE WHEN lang = 'en' THEN 186 ELSE 255 END AS head FROM documents WHERE text IS NOT NULL",
    "s05_choose_text": "WITH d AS (SELECT doc_id, text, length(trim(text)) > 50 AS enough FROM documents WHERE text IS NOT NULL), b AS (SELECT *, o.ocr FROM d, (VALUES (true), (false)) o(ocr)) SELECT doc_id, ocr, CASE WHEN ocr AND NOT enough THEN 4 ELSE length(text) + 2 END AS n_chars, NOT (ocr AND NOT enough) AS with_values, "
                       "CASE WHEN ocr AND NOT enough THEN 'ocr' ELSE 'native' END AS method, CASE WHEN enough THEN 1.0 WHEN ocr THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence FROM b",
    "s07_ocr_lines": f"WITH {_TURNS}, w AS (SELECT *, pos // 5 AS line, pos % 50 + 50 AS conf FROM turns WHERE pos % 7 <> 6 AND trim(word) <> ''), l AS (SELECT conv_id, page_num, line, string_agg(word, ' ' ORDER BY pos) AS t, sum(conf) AS s, count(*) AS n FROM w GROUP BY ALL) "
                     "SELECT conv_id, page_num, string_agg(t, chr(10) ORDER BY line) AS text, round(sum(s) / sum(n) / 100, 9) AS confidence FROM l GROUP BY conv_id, page_num",
    "j10_ocr_items": f"WITH {_TURNS}, w AS (SELECT *, regexp_replace(lower(word), '[^\\p{{L}}\\p{{M}}\\p{{N}}_''’]', '', 'g') AS c FROM turns WHERE pos % 7 <> 6), i AS (SELECT unnest(['the', 'la', 'und']) AS item) "
                     "SELECT conv_id, page_num, item, pos::INT AS pos, pos % 5 * 100 - 4 AS x0, pos // 5 * 20 - 4 AS y0, pos % 5 * 100 + length(word) * 8 + 4 AS x1, pos // 5 * 20 + 19 AS y1 FROM w, i WHERE length(item) >= 3 AND (c = item OR c = item || chr(39) || 's' OR c = item || '’s')",
    "f13_signature": "WITH i AS (SELECT *, l_partkey % 500 + 20 AS px_w, l_suppkey % 240 AS px_h, l_partkey % 400 AS rect_w, l_discount * 5 AS ink FROM lineitem) SELECT l_orderkey, l_linenumber, px_w FROM i WHERE px_h > 0 AND px_w >= 2 * px_h AND rect_w <= 250 AND px_w >= 50 AND px_h <= 200 AND ink <= 0.30",
    "b08_plan": f"WITH {PEOPLE} " + _rows(("k", "'widget'", _FULL, "'delete'"), ("k", "'link'", "'http://x/' || lower(first) || 'ian'", "'delete'"), ("k", "'bookmark'", "first || chr(39) || 's plan'", "'[REDACTED]' || chr(39) || 's plan'"), columns="k, kind, value, action"),
    "v06_scanned": f"WITH {PEOPLE}, f AS (SELECT k, list_sort(list_filter([CASE WHEN k % 4 = 0 THEN 'Page 1: ' || chr(39) || last || chr(39) || ' still visible after redaction' END, CASE WHEN k % 7 = 0 THEN 'OCR verification error: no image' END], lambda x: x IS NOT NULL)) AS f FROM p) SELECT k, array_to_string(f, '; ') AS failures, CASE WHEN len(f) > 0 THEN 'quarantined' ELSE 'written' END AS status FROM f",
    "o08_categories": f"WITH {_DEDUP} SELECT category, count(*) AS n FROM ranked WHERE match_idx % 2 = 0 GROUP BY category",
    "b06_images": "WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS xref FROM lineitem), s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey AS doc_id, xref, count(*) AS n_places FROM i ANTI JOIN s USING (l_orderkey, l_linenumber) GROUP BY ALL",
    "k11_metadata": "SELECT kind, value, action, (SELECT count(*) FROM supplier) AS n FROM (VALUES ('metadata', 'author', 'empty'), ('metadata', 'title', 'empty'), ('metadata', 'subject', 'empty'), ('metadata', 'creator', 'empty'), ('metadata', 'producer', 'empty'), ('metadata', 'keywords', 'empty'), ('metadata', 'creationDate', 'empty'), "
                    "('metadata', 'modDate', 'empty'), ('xmp', 'xmp', 'delete'), ('embedded', '*', 'delete'), ('structure', 'MarkInfo', 'delete'), ('structure', 'StructTreeRoot', 'delete'), ('structure', 'Names', 'delete')) t(kind, value, action)",
    "manual_matches": f"WITH {PEOPLE} " + _rows(("k", "0", "first", "'Student name'", "0.95::DOUBLE", "1", "'regex'"), ("k", "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END", "last", "'Manual'", "1.0", "0", "'manual'"), columns="k, match_idx, text, category, confidence, line_num, source", where={0: "k % 2 = 0"}),
    "e06_answers": f"WITH {PEOPLE} " + _rows(("k", "0", _FULL, "'student'", "'[Student]'"), ("k", "1", "'Sidonie Harcastle'", "'teacher'", "'[Teacher]'"), ("k", "2", "'Ansgar ' || town", "'other'", "'[Other person]'"), ("k", "3", "'Plimmer'", "'health'", "'[Night nurse]'"), columns="k, seq, full_name, role, label"),
    "s08_blocks": "SELECT n_regionkey AS page_num, n_name AS text FROM nation WHERE n_nationkey % 2 = 0",
    "s09_spans": "SELECT l_orderkey AS doc_id, count(*) AS n, sum(l_linenumber)::DOUBLE AS x0, sum(l_quantity)::DOUBLE AS y1 FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 2 GROUP BY l_orderkey",
    "p01_normalise": f"WITH {PEOPLE} SELECT k, first || chr(39) || 's \"' || last || '\" file A é é ß' AS text FROM p",
    "p03_context": "WITH d AS (SELECT doc_id, text, length(text) // 2 AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, trim('...' || substring(text, greatest(s - 50, 0) + 1, s - greatest(s - 50, 0)) || '**' || substring(text, s + 1, 3) || '**' || substring(text, s + 4, 50) || '...') AS context FROM d",
    "p09_name_list": f"WITH {PEOPLE} SELECT k, CASE WHEN k % 10 IN (0, 1) THEN '' ELSE first || ' ' || last || '|' || seen_by END AS names FROM p",
    "f02_page_gate": f"WITH {PEOPLE} " + _rows(("k", "'page'", "3"), ("k", "'line'", "2"), columns="doc_id, scope, n"),
    "f12_image_only": "SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS n_images FROM lineitem WHERE l_partkey % 4 = 0 AND l_suppkey % 3 > 0",
    "b01_zones": "WITH z AS (SELECT l_orderkey AS doc_id, l_partkey % 600 + 1.0 AS w, l_suppkey % 900 + 100.0 AS h FROM lineitem) SELECT doc_id, 2 * count(*) AS n, round(sum(h * 0.92)::DOUBLE, 6) AS y0, round(sum(h * 1.12)::DOUBLE, 6) AS y1, sum(2 * w)::DOUBLE AS x1 FROM z GROUP BY doc_id",
    "j14_effective_role": f"WITH {PEOPLE} SELECT k, seen_by AS full_name, CASE WHEN k % 3 = 0 THEN 'carer' ELSE 'teacher' END AS role FROM p WHERE k % 5 <> 0",
    "a06_ocr_items": "SELECT l_orderkey AS doc_id, count(*) FILTER (o_orderkey % 2 = 0 AND l_linenumber IN (2, 3)) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    "a11_run_totals": "SELECT count(*) AS documents, count(*) FILTER (o_orderstatus = 'F') AS successful, sum(o_custkey)::BIGINT AS items, 2 * count(*) FILTER (o_orderstatus = 'P') AS failures, count(*) FILTER (o_orderkey % 3 = 0) AS ocr_warnings FROM orders",
    "a15_ambiguity": f"WITH {PEOPLE} SELECT k, lower(last) AS form, '\"' || lower(last) || '\" is shared by \"' || {_FULL} || '\" [Student], \"' || {_MOTHER} || '\" [Parent] — on its own it was labelled [Family name].' AS note FROM p WHERE {_SAME}",
    "a17_folder_counts": "SELECT count(*) AS total, count(*) FILTER (o_orderkey % 5 IN (0, 1, 4)) AS processable, count(*) FILTER (o_orderkey % 5 IN (2, 3)) AS flagged FROM orders",
    "e09_describe": f"WITH {PEOPLE} " + _rows(("k", "mother_first", "1", "'parent'", "'entered'", "''"), ("k", "seen_by", "2", "'teacher'", "'likely'", "'tutor'"), ("k", "'Dr Lee'", "0", "'health'", "'possible'", "'Dr'"), columns="k, full_name, occurrences, suggested_role, confidence, evidence"),
    "k05_key": f"WITH {PEOPLE} " + _rows(("k", "1", f"'[Student]  ->  ' || {_FULL}"), ("k", "1", f"'[Parent]  ->  ' || {_MOTHER}"), ("k", "1", "'[Organisation]  ->  ' || school"), ("k", "1", "'[Other person]  ->  ' || seen_by"),
                                         ("k", "2", f"'- \"' || lower(last) || '\" is shared by \"' || {_FULL} || '\" [Student], \"' || {_MOTHER} || '\" [Parent] — on its own it was labelled [Family name].'"), ("k", "3", "first || '.pdf  ->  ' || CASE WHEN k % 2 = 0 THEN 'Student document_deidentified.txt' ELSE '(not produced)' END"), columns="k, section, line", where={4: _SAME}),
    "r10_filename_names": f"WITH {PEOPLE} SELECT k, array_to_string(list_filter([{_FULL}, first, last, {_MOTHER}, mother_first, CASE WHEN mother_last <> last THEN mother_last END, school, town, 'Primary', 'School'], lambda x: x IS NOT NULL), '|') AS names FROM p",
    "u04_native_pages": "WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber::INT))) AS a FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_filter(a, lambda x: x NOT IN (2, 3, 99)), ',') AS native, array_to_string(list_filter(a, lambda x: x IN (2, 3, 99)), ',') AS scanned FROM o",
    "r05_formatted": f"WITH {PEOPLE} SELECT k, CASE WHEN k % 2 = 1 THEN 'scan' ELSE first || ' | ' || last || chr(10) || school || ' | ' || town || CASE WHEN k % 3 = 0 THEN chr(10) || email ELSE '' END END AS text FROM p",
    "n07_model": f"WITH {PEOPLE} SELECT k, seen_by AS text, 'Person name (NER)' AS category, 0.9::DOUBLE AS confidence, 16 AS line_num, 'seen by ' || seen_by AS context FROM p",
    "a10_images": "SELECT l_orderkey AS doc_id, sum(l_quantity::INT % 4)::BIGINT AS n_images FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey HAVING sum(l_quantity::INT % 4) > 0",
    "v05_redaction": f"WITH {PEOPLE} " + _rows(("k", "last"), ("k", "first"), ("k", _FULL), columns="k, text", where={1: "k % 3 = 0", 2: "k % 3 = 0"}),
    "f06_person": f"""WITH {PEOPLE}, c(category, person) AS (VALUES ('Student name', true), ('Phone number', false), ('Organisation name', false), ('Family member', true), ('PERSON (NER)', true)), t(kind, form) AS (VALUES (0, false), (1, true), (2, false), (3, false))
      SELECT k, category, kind, person, NOT (person AND form) AS replaced, CASE WHEN kind = 0 THEN '[Student]' WHEN category = 'Phone number' THEN '[phone]' WHEN category = 'Organisation name' THEN '[organisation]' WHEN kind = 2 THEN '[Student]' ELSE '[name]' END AS label FROM p, c, t""",
    "e07_people": f"WITH {PEOPLE} " + _rows(("k", _MOTHER, "'[Parent]'", "'parent'", "'entered'"), ("k", "seen_by", "'[Other person]'", "'other'", "'detected'"), columns="k, full_name, label, role, source"),
}

_FORMS = ["eriner retion", "eriner", "retion", "e. retion", "eriner r.", "e.r."]


def _form(form: str) -> str:
    """Lines that hold a form as a whole word: a plain test first, as few lines do."""
    end = r"[\p{L}\p{N}_]" if form.endswith(".") else r"($|[^\p{L}\p{N}_])"
    pattern = r"(^|[^\p{L}\p{N}_])" + form.replace(".", r"\.") + end
    return f"SELECT source, doc_id, '{form}' AS form FROM low WHERE contains(line, '{form}') AND regexp_matches(line, '{pattern}')"


_FOUR = "substr(c_mktsegment, 1, 4)"
_BOX = "NULL::DOUBLE AS x0, NULL::DOUBLE AS y0, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1"
_AT = "{}::DOUBLE AS x0, {}::DOUBLE AS y0, {}::DOUBLE AS x1, {}::DOUBLE AS y1"


def _step(stage: int, kind: str, page: str, xref: str, value: str, action: str, box: str, where: str, table: str = "o") -> str:
    return f"SELECT doc_id, {stage} AS stage, '{kind}' AS kind, {page} AS page_num, {xref}::BIGINT AS xref, {value} AS value, '{action}' AS action, {box} FROM {table} WHERE {where}"


ORACLES |= {
    "d01_names": f"WITH {_LINES}, low AS (SELECT coalesce(source, '(none)') AS source, doc_id, lower(line) AS line FROM lines), f AS ({' UNION ALL '.join(map(_form, _FORMS))}) SELECT source, form, count(DISTINCT doc_id) AS n_docs FROM f GROUP BY source, form",
    "f14_preselect": "SELECT category, mode, mode = 'redact' OR category NOT LIKE '%(NER)' OR category IN ('Person name (NER)', 'Location (NER)') AS chosen, shown, count(*) AS n FROM (SELECT l_partkey % 7 AS c FROM lineitem) l JOIN (VALUES (0, 'Student name', 'Student name'), (1, 'Person name (NER)', 'Name (found automatically)'), "
                     "(2, 'Person name (NER variation)', 'Name variation (found automatically)'), (3, 'Location (NER)', 'Possible place name (auto-detected)'), (4, 'ORGANIZATION (NER)', 'Possible organisation (auto-detected)'), (5, 'Date/Time (NER)', 'Date or time (auto-detected)'), (6, 'Phone number', 'Phone number')) AS t(c, category, shown) USING (c), (VALUES ('redact'), ('deidentify')) AS m(mode) GROUP BY category, mode, shown",
    "b03_boxes": f"SELECT c_custkey AS doc_id, c_mktsegment AS text, 9.0::DOUBLE AS x0, -1.0::DOUBLE AS y0, 11.0 + 8 * length(c_mktsegment)::DOUBLE AS x1, 11.0::DOUBLE AS y1 FROM customer WHERE length(c_mktsegment) > 6 "
                 f"UNION ALL SELECT c_custkey, {_FOUR}, 9.0, -1.0, 11.0 + 8 * length({_FOUR}), 11.0 FROM customer WHERE c_custkey % 4 <> 2 AND c_custkey % 7 <> 0",
    "r04_layout": "WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n, l_orderkey % 2 = 0 AS two, l_quantity::INT AS q FROM lineitem), "
                  "c AS (SELECT *, CASE WHEN two THEN n // 2 ELSE n END AS r, CASE WHEN two THEN 60 WHEN q % 3 = 0 THEN 150 ELSE 400 END AS wide FROM l), r AS (SELECT doc_id, r, string_agg(n || ' of ' || q, ' | ' ORDER BY n) AS t, count(*) AS cells, max(wide) AS wide FROM c WHERE r > 0 GROUP BY doc_id, r), "
                  "w AS (SELECT *, max(wide) OVER (PARTITION BY doc_id) AS widest, lag(wide) OVER (PARTITION BY doc_id ORDER BY r) AS above, lag(cells) OVER (PARTITION BY doc_id ORDER BY r) AS cells_above FROM r) "
                  "SELECT doc_id, string_agg(CASE WHEN above IS NULL THEN '' WHEN cells = 1 AND cells_above = 1 AND r <> 3 AND above > 0.5 * widest THEN ' ' WHEN r = 3 THEN chr(10) || chr(10) ELSE chr(10) END || t, '' ORDER BY r) AS text FROM w GROUP BY doc_id",
    "k06_audit": "WITH e AS (SELECT l_orderkey::VARCHAR AS d, l_suppkey % 3 + 1 AS page, l_partkey % 9 AS ln, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS i, 'Page ' || (l_suppkey % 3 + 1) || ', Line ' || (l_partkey % 9) || ': \"part ' || l_partkey || '\" [' || l_returnflag || '] [' "
                 "|| CASE WHEN l_discount * 10 >= 0.8 THEN 'high' WHEN l_discount * 10 >= 0.5 THEN 'medium' ELSE 'low' END || ' confidence]' AS line, CASE WHEN l_linestatus = 'O' THEN '    Note: sent ' || l_shipdate::DATE END AS note FROM lineitem), "
                 "t AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority = '1-URGENT') AS flagged FROM orders), "
                 "a AS (SELECT d, 0 AS page, 0 AS ln, 0 AS i, unnest([0, 1]) AS step, unnest(['DOCUMENT: ' || d || ' → ' || d || '_out', repeat('─', 76)]) AS line FROM (SELECT DISTINCT d FROM e) UNION ALL SELECT d, page, ln, i, 0, line FROM e UNION ALL SELECT d, page, ln, i, 1, note FROM e WHERE note IS NOT NULL UNION ALL SELECT DISTINCT d, 99, 0, 0, 0, '' FROM e), "
                 "h AS (SELECT unnest(range(10)) AS place, unnest(['REDACTION LOG', repeat('=', 61), 'Folder: /in', 'Student: Torvin Vardane', 'Processed: 2026-01-02 03:04:05', 'Total documents: ' || n, 'Successfully redacted: ' || done, 'Flagged for manual review: ' || flagged, 'RUN CANCELLED BY USER — ' || done || ' of ' || n || ' documents were processed', '']) AS line FROM t) "
                 "SELECT 0 AS section, '' AS document_name, '' AS output_name, place::INT AS place, line FROM h UNION ALL SELECT 1, d, d || '_out', (row_number() OVER (PARTITION BY d ORDER BY page, ln, i, step) - 1)::INT, line FROM a "
                 "UNION ALL SELECT 2, '', '', unnest([0, 1]), unnest(['FLAGGED FOR MANUAL REVIEW', repeat('─', 25)]) UNION ALL SELECT 2, o_orderkey::VARCHAR, '', 0, '- ' || o_orderkey || ': status ' || o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 3, '', '', unnest([0, 1]), unnest(['', 'END OF LOG'])",
    "w07_runs": "WITH w AS (SELECT conv_id, turn::INT AS page_num, unnest(string_split(coalesce(text, ''), ' ')) AS word, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS pos FROM conversations), k AS (SELECT * FROM w WHERE pos % 11 <> 3 AND word <> '') "
                "SELECT conv_id, page_num, (count(DISTINCT pos // 4) + sum(length(word) - length(replace(word, chr(10), ''))))::INT AS n_lines, (sum(length(word)) + count(*) - 1)::INT AS n_chars, 0.9::DOUBLE AS confidence FROM k GROUP BY conv_id, page_num",
    "b00_plan": "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey::INT AS p, lpad((o_orderkey % 50)::VARCHAR, 4, '0') AS clerk, o_orderkey % 3 AS kind, o_orderkey % 5 = 0 AS placed, min(lpad((o_orderkey % 50)::VARCHAR, 4, '0')) OVER (PARTITION BY o_custkey) AS first FROM orders), d AS (SELECT DISTINCT doc_id, first FROM o) "
                + " UNION ALL ".join([
                    _step(1, "text", "p", "NULL", "'clerk ' || clerk", "erase", _AT.format(9, 9, 51, 21), "kind = 0 AND placed"), _step(1, "text", "p", "NULL", "'clerk ' || clerk", "erase", _AT.format(29, 39, 91, 51), "kind = 0 AND NOT placed"),
                    _step(1, "scan", "p", "NULL", "'clerk ' || clerk", "blacken", _AT.format(96, 96, 264, 124), "kind = 1"), _step(1, "unread", "p", "NULL", "''", "fail", _BOX, "kind = 2"),
                    _step(2, "image", "p", "7", "'clerk ' || first", "blacken", _AT.format(1, 1, 124, 24), "kind = 0"), _step(3, "signature", "p", "7", "''", "blacken", _BOX, "kind = 0"),
                    _step(4, "bookmark", "0", "NULL", "'Orders of CLERK ' || first || ' and others'", "Orders of [REDACTED] and others", _BOX, "true", "d"),
                ]),
}

#: This dialect counts changes in bytes, so letters of two bytes stand as marks of one.
_PLAIN = "translate({}, 'áàâäãåçéèêëíìîïñóòôöõúùûüýßœæ', '0123456789!#$%&()*+,-./:;<=>?@')"
_CLOSE = r"regexp_full_match(token, '\p{L}{5,}') AND abs(length(word) - length(token)) <= 2 AND levenshtein(" + _PLAIN.format("word") + ", " + _PLAIN.format("token") + ") <= CASE WHEN length(token) <= 7 THEN 1 ELSE 2 END"
_WORDS_OF = r"unnest(regexp_extract_all(lower(text), '\p{L}+'))"
_SPANS = "SELECT l_partkey AS part, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT * CASE WHEN l_suppkey % 50 = 0 THEN 100 ELSE 1 END AS e, l_returnflag = 'R' AS returned FROM lineitem"
#: The context of a text that stands once in a line.
_CONTEXT = "trim('...' || substr(line, greatest(instr(line, text) - 50, 1), least(instr(line, text) - 1, 50)) || '**' || text || '**' || substr(line, instr(line, text) + length(text), 50) || '...')"

ORACLES |= {
    "d10_dob_same_line": f"WITH {PEOPLE} SELECT k AS doc_id, 12 AS line_num, {LONG_DATE} AS text FROM p",
    "d14_context": f"WITH {PEOPLE} " + _rows(
        ("k", "1", "mother_first || ' Penhollow'", "'Parent/Guardian'", "0.65::DOUBLE"), ("k", "2", "seen_by", "'Family member'", "0.65"), ("k", "4", "mother_first || ' Tolvane'", "'Parent/Guardian'", "0.60"), ("k", "6", "medicare", "'Medicare number'", "0.90"),
        ("k", "8", "crn", "'Centrelink CRN'", "0.60"), ("k", "9", LANDLINE, "'Phone number'", "0.95"), ("k", "10", BRACKETED, "'Phone number'", "0.95"), ("k", "11", DOTTED, "'Phone number'", "0.95"), ("k", "12", LONG_DATE, "'Date of birth'", "0.95"),
        ("k", "13", AUNT, "'Family member (user-provided)'", "0.95"), ("k", "14", "'Odette Rowe'", "'Parent/Guardian'", "0.65"), columns="doc_id, line_num, text, category, confidence"),
    "j01_lexicon": r"WITH names AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+ [\p{L}\p{M}\p{N}_]+')[1:10])) AS name FROM documents), "
                   + _LINES + r", t AS (SELECT doc_id, line_num, regexp_extract_all(lower(line), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+') AS x FROM lines), e AS (SELECT doc_id, line_num, x, unnest(range(1, len(x) - 1)) AS i FROM t), "
                   "p AS (SELECT doc_id, line_num, x[i] || ' ' || x[i + 2] AS name FROM e WHERE x[i + 1] = ' ') SELECT name, count(DISTINCT (doc_id, line_num)) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM p SEMI JOIN names USING (name) GROUP BY name",
    "j01_listed": f"WITH {PEOPLE}, f AS ("
                  + _rows(("k", "1", "first", "'Student name'", "0.95", f"'Report on ' || {_FULL}"), ("k", "16", "seen_by", "'Family member (user-provided)'", "0.95", "'seen by ' || seen_by"), ("k", "4", "town", "'Organisation name'", "0.95", "'home: ' || address"), columns="k, line_num, text, category, confidence, line")
                  + f") SELECT k, line_num, text, category, confidence::DOUBLE AS confidence, {_CONTEXT} AS context FROM f",
    "v02_misread": f"SELECT word, token FROM (SELECT DISTINCT {_WORDS_OF} AS word FROM conversations) w, (SELECT DISTINCT {_WORDS_OF} AS token FROM benchmark) t WHERE {_CLOSE}",
    "v02_misread_items": f"WITH w AS (SELECT DISTINCT conv_id, {_WORDS_OF} AS word FROM conversations WHERE turn > 0), t AS (SELECT DISTINCT conv_id, {_WORDS_OF} AS token FROM conversations WHERE turn = 0) SELECT conv_id, token AS text, word FROM w JOIN t USING (conv_id) WHERE {_CLOSE}",
    "j02_ranges": f"WITH x AS ({_SPANS}) SELECT part, count(*) AS n, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS days FROM x a JOIN x b USING (part) WHERE a.returned AND NOT b.returned AND a.s < b.e AND b.s < a.e GROUP BY part",
    "j02_within": f"WITH x AS ({_SPANS}) SELECT part, count(*) AS n, sum(s)::BIGINT AS starts FROM x a WHERE returned AND NOT EXISTS (SELECT 1 FROM x b WHERE b.part = a.part AND NOT b.returned AND a.s >= b.s AND a.e <= b.e AND a.e > a.s) GROUP BY part",
    "j03_asof": "WITH o AS (SELECT o_custkey AS user_id, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2678400) AS otime, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), "
                "f AS (SELECT event_id, ts, otime, o_orderkey FROM events e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.ts >= o.otime) SELECT event_id, o_orderkey, CASE WHEN epoch_us(ts) - epoch_us(otime) <= 3 * 86400000000 THEN o_orderkey END AS recent FROM f",
}

_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ORACLES |= {
    "a16_sketches": "SELECT l_returnflag AS category, count(*) AS n, true AS texts_fine, true AS documents_fine, true AS median_fine FROM lineitem GROUP BY l_returnflag",
    "e01_stream": ORACLES["e01_people"],
    "t06_sessions": "WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 90 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e) "
                    "SELECT user_id, rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start, rtrim(rtrim(strftime(max(ts) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS \"end\", count(*) AS n, round(sum(value), 4) AS value, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id, nth",
    "t06_sliding": "WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR AS s FROM events, range(3) r(i)) "
                   f"SELECT event_type, {_STAMP.format('s')} AS start, {_STAMP.format('s + INTERVAL 6 HOUR')} AS \"end\", count(*) AS n, round(sum(value), 4) AS value FROM w GROUP BY event_type, s",
}
