"""Roles: what the text around a person's name says about the part they play."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import ROLE_KEYWORDS
from ..functions.patterns import EDGE_AFTER, EDGE_BEFORE


def suggest_roles(contexts: DataFrame, keys: tuple[str, ...] = ("case_id", "name")) -> DataFrame:
    """(keys, role, confidence, evidence, snippet) from rows (keys, at, snippet) in the order of at.

    A snippet speaks once for each role that any of its words belongs to. The role with most snippets is likely; a tie is
    unknown. Without any, a name that begins with Dr or Doctor is possibly a health professional."""
    keys = [k for k in keys if k in contexts.columns]
    whole = lambda w: "(?i)" + EDGE_BEFORE + r"\Q" + w + r"\E" + EDGE_AFTER
    words = lambda ws: sorted(ws, key=len, reverse=True)
    first = {r: F.coalesce(*[F.when(F.col("snippet").rlike(whole(w)), F.lit(w)) for w in words(ws)]) for r, ws in ROLE_KEYWORDS.items()}
    votes = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r).alias("role"), e.alias("word")) for i, (r, e) in enumerate(first.items())])
    rows = contexts.select(*keys, "at", "snippet", F.explode(F.filter(votes, lambda v: v["word"].isNotNull())).alias("v"))
    by = rows.groupBy(*keys, F.col("v.role").alias("role")).agg(F.count("*").alias("n"), F.min(F.struct("at", F.col("v.word"), "snippet")).alias("first"))
    best = by.groupBy(*keys).agg(F.max("n").alias("most"), F.max_by(F.struct("role", "first"), "n").alias("b"), F.collect_list("n").alias("counts"))
    best = best.withColumn("clear", F.size(F.filter("counts", lambda c: c == F.col("most"))) == 1)
    out = contexts.select(*keys).distinct().join(best, keys, "left")
    doctor = F.col("name").rlike(r"(?i)^\s*(dr|doctor)\b")
    sure, none = F.col("clear"), F.col("most").isNull()
    pick = lambda likely, possible, else_: F.when(sure, likely).when(none & doctor, possible).otherwise(else_)
    return out.select(*keys, pick(F.col("b.role"), F.lit("health"), F.lit("other")).alias("role"), pick(F.lit("likely"), F.lit("possible"), F.lit("unknown")).alias("confidence"),
                      pick(F.col("b.first.word"), F.lit("Dr"), F.lit("")).alias("evidence"), pick(F.btrim(F.col("b.first.snippet")), F.btrim("name"), F.lit("")).alias("snippet"))


def describe_people(people: DataFrame, mentions: DataFrame) -> DataFrame:
    """people with occurrences and a suggested role. mentions (case_id, full_name, at, context) are resolved to owners; people
    that were entered keep the role of the list they were entered in."""
    counts = mentions.groupBy("case_id", "full_name").agg(F.count("*").alias("n"))
    voted = suggest_roles(mentions.where("context <> ''").select("case_id", F.col("full_name").alias("name"), "at", F.col("context").alias("snippet"))).withColumnsRenamed({"name": "full_name", "role": "suggested", "confidence": "how"})
    rows = people.join(counts, ["case_id", "full_name"], "left").join(voted, ["case_id", "full_name"], "left")
    entered = F.col("source") == "entered"
    doctor = F.col("full_name").rlike(r"(?i)^\s*(dr|doctor)\b")
    other = F.when(doctor, "health").otherwise("other")
    return rows.select("case_id", "seq", "full_name", "label", "role", "custom", "source", F.coalesce("n", F.lit(0)).alias("occurrences"), F.when(entered, F.col("role")).otherwise(F.coalesce("suggested", other)).alias("suggested_role"),
                       F.when(entered, "entered").otherwise(F.coalesce("how", F.when(doctor, "possible").otherwise("unknown"))).alias("confidence"), F.when(entered, "").otherwise(F.coalesce("evidence", F.when(doctor, "Dr").otherwise(""))).alias("evidence"), F.when(entered, "").otherwise(F.coalesce("snippet", F.when(doctor, F.col("full_name")).otherwise(""))).alias("snippet"))


def effective_roles(people: DataFrame, answers: DataFrame, ignored: DataFrame) -> DataFrame:
    """A person's role: the answer given, else the suggestion; dismissed people are left out."""
    rows = people.join(ignored, ["case_id", "full_name"], "left_anti").join(answers.withColumnRenamed("role", "answer"), ["case_id", "full_name"], "left")
    return rows.withColumn("role", F.coalesce("answer", "suggested_role")).drop("answer")
