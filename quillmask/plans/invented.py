"""Reports about invented people, made from the rows of customer, so that operators meet every kind of match on a table.

Every value is a formula over the customer's number, written in SQL that Spark and DuckDB both read. The oracles state what must
be found by the same formulas; they do not search the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import tasks_of

FIRST = "Torvin,Maelis,Quenna,Hadrik,Matthew,Yorvel,Brisda,Daniel,Oswick,Feyra,Lunette,Kadmar"
LAST = "Vardane,Oskeld,Pellorin,Grathwick,Munrose,Tibbance,Ewercliff,Hollobrand,Quillane,Strathvey,Dunmarrow,Beckhollow,Yarnwood"
MOTHERS = "Ilsabet,Gwenora,Nerida,Josmine,Velda"
SEEN_BY = "Sidonie Harcastle,Rufaro Plimmer,Ansgar Woldt"
TOWNS = "Telmora,Brackenlea,Ostmere,Quorrie"


def _pick(names: str, at: str) -> str:
    return f"split_part('{names}', ',', cast({at} % {len(names.split(','))} + 1 as int))"


def _digits(n: int, seed: int) -> str:
    """n digits from 1 to 9 that depend on the number k."""
    return ", ".join(f"cast((k * {(2, 4, 5, 7, 8)[(i + seed) % 5]} + {i * seed + i}) % 9 + 1 as string)" for i in range(n))


def _cut(n: int, seed: int, *widths: int) -> str:
    digits, parts = _digits(n, seed).split(", "), []
    for w in widths:
        parts.append(", ".join(digits[:w]))
        digits = digits[w:]
    return f"concat({', \' \', '.join(parts)})"


#: Columns in order; later ones may use earlier ones.
COLUMNS = [
    ("first", _pick(FIRST, "k")), ("last", _pick(LAST, "k")), ("mother_first", _pick(MOTHERS, "k")),
    ("mother_last", "case when k % 3 = 0 then last else 'Crossfield' end"), ("seen_by", _pick(SEEN_BY, "k")), ("town", _pick(TOWNS, "k")),
    ("phone", f"concat('04', {_cut(8, 1, 2, 3, 3)[7:]}"), ("email", "concat('c', cast(k as string), '@mail', cast(k % 7 as string), '.example.org')"),
    ("address", f"concat(cast(k % 89 + 1 as string), ' Corvane Road, ', town, ' VIC ', {_digits(4, 2)})"), ("dob", "concat(cast(k % 27 + 1 as string), '/', cast(k % 12 + 1 as string), '/', cast(2011 + k % 8 as string))"),
    ("medicare", _cut(10, 3, 4, 5, 1)), ("crn", f"concat({_cut(9, 4, 3, 3, 3)}, 'A')"), ("ndis", f"concat({_digits(9, 5)})"), ("abn", _cut(11, 6, 2, 3, 3, 3)), ("passport", f"concat('N', {_digits(7, 7)})"),
    ("code", f"concat(case when k % 2 = 0 then upper(substr(last, 1, 3)) else 'XQZ' end, {_digits(3, 8)})"), ("street", "concat(cast(k % 50 + 1 as string), ' Fennick Lane')"),
    ("nick", "case first when 'Matthew' then 'Matt' when 'Daniel' then 'Dan' end"),
    ("school", "concat(town, ' Primary School')"),
]
LANDLINE, BRACKETED = f"concat('03 ', {_cut(8, 2, 4, 4)})", f"concat('(07) ', {_cut(8, 5, 4, 4)})"
DOTTED = f"concat('04', {_digits(2, 3)}, '.', {_digits(3, 4)}, '.', {_digits(3, 5)})"
LONG_DATE = "concat(cast(k % 27 + 1 as string), ' ', split_part('January,March,May,Sep,Dec', ',', cast(k % 5 + 1 as int)), ' ', cast(2011 + k % 8 as string))"
AUNT = "concat(split_part('Hesper,Ione,Calista', ',', cast(k % 3 + 1 as int)), ' Quoyle')"
#: Lines of a report, from 1, as SQL.
LINES = ["concat('Report on ', first, ' ', last)", "concat('Ring ', phone, ' after lunch')", "concat('or write to ', email)", "concat('home: ', address)", "'Date of Birth:'", "dob", "concat('Medicare ', medicare)", "concat('CRN ', crn)",
         "concat('NDIS number: ', ndis)", "concat('ABN: ', abn)", "concat('passport no ', passport)", "concat('code ', code)", "concat('Mother: ', mother_first, ' ', mother_last)", "concat('walks along ', street, ' daily')",
         "coalesce(concat(nick, ' was late'), 'all was well')", "concat('seen by ', seen_by)"]


#: A second report: family by context and from the list, numbers on the line below, other forms of phone numbers and dates.
MORE_LINES = ["concat('Father: ', mother_first, ' Penhollow')", "concat('Sister (', seen_by, ') came')", "'Grandmother'", "concat(mother_first, ' Tolvane visited')", "'Medicare card below'", "medicare", "'CRN'", "crn",
              f"concat('call ', {LANDLINE})", f"concat('or ', {BRACKETED})", f"concat('mobile ', {DOTTED})", f"concat('Date of Birth: ', {LONG_DATE})", f"concat('with ', {AUNT}, ' today')", "'Mum, Odette Rowe, rang'"]


def _nested(select: str) -> str:
    """select over the columns, each computed from those before it."""
    out = "SELECT c_custkey AS k FROM customer"
    for name, expression in COLUMNS:
        out = f"SELECT *, {expression} AS {name} FROM ({out}) t"
    return f"{select} FROM ({out}) t"


#: The people as a common table expression named p, for oracles.
PEOPLE = f"p AS ({_nested('SELECT *')})"


#: Customers a task: formulas make much work and many bytes of few bytes, so tasks are dealt by rows.
A_TASK = 25_000


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the columns above, dealt by case. The size that Spark estimates is that of the numbers alone, so no
    join may broadcast what is made of them."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    tasks = tasks_of(rows.count(), A_TASK)  # the count reads no column
    rows = rows.repartition(tasks, F.col("k").cast("string")).hint("merge")
    for name, expression in COLUMNS:
        rows = rows.withColumn(name, F.expr(expression))
    return rows


def reports(rows: DataFrame) -> DataFrame:
    """A page per person (case_id, doc_id, page_num, text)."""
    key = F.col("k").cast("string")
    return rows.select(key.alias("case_id"), key.alias("doc_id"), F.lit(1).alias("page_num"), F.expr(f"concat_ws('\n', {', '.join(LINES)})").alias("text"))


def more_reports(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the second report, and their cases, which list an aunt as family and no parent."""
    key, none = F.col("k").cast("string"), F.array().cast("array<string>")
    pages = rows.select(key.alias("case_id"), key.alias("doc_id"), F.lit(1).alias("page_num"), F.expr(f"concat_ws('\n', {', '.join(MORE_LINES)})").alias("text"))
    return pages, rows.select(key.alias("case_id"), F.concat_ws(" ", "first", "last").alias("student_name"), none.alias("parent_names"), F.array(F.expr(AUNT)).alias("family_names"), none.alias("organisation_names"))


def cases(rows: DataFrame) -> DataFrame:
    """What is known of each case: the names of the person, of the mother, and of the school."""
    none = F.array().cast("array<string>")
    return rows.select(F.col("k").cast("string").alias("case_id"), F.concat_ws(" ", "first", "last").alias("student_name"), F.array(F.concat_ws(" ", "mother_first", "mother_last")).alias("parent_names"), none.alias("family_names"), F.array("school").alias("organisation_names"))
