"""Intervals that overlap or lie within each other, by equi-joins on buckets of the right width; overlapping matches settled.

An interval [start, end) has a level, the least power of two that is no shorter than it, so it touches two buckets of that width at most.
Two intervals meet in buckets of the level of the longer one: each is listed at its own level and at the coarser ones that occur on
the other side. A pair that shares two buckets counts in the first. So a long interval is not cut into many short ones, rows
listed are bounded by levels, and a key with very many intervals is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """Least n with 2^n >= end - start, in whole numbers."""
    size = (end - start).cast("long") - 1
    return F.when(size <= 0, 0).otherwise(F.length(F.bin(size))).cast("int")


def _bucket(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _listed(rows: DataFrame, start: str, end: str, levels: list[int]) -> DataFrame:
    """Rows once for each bucket they touch at each of levels that is not below their own."""
    at = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda m: m >= F.col("_level"))
    rows = rows.withColumn("_m", F.explode(at))
    return rows.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(start), F.col("_m")), _bucket(F.col(end) - 1, F.col("_m")))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: tuple[str, str], right_at: tuple[str, str], within: bool = False) -> DataFrame:
    """All pairs of rows of left and right with equal keys whose intervals (start and end as whole numbers, the end left out) share a
    point; with within, those whose left interval lies in the right one. Columns but for keys must have different names.

    Rows with a null in keys, start or end, and empty intervals, meet nothing. Repeated rows meet each as often as they stand."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are on both sides")
    sides = []
    for rows, (start, end) in ((left, left_at), (right, right_at)):
        rows = rows.where(F.col(start).isNotNull() & (F.col(end) > F.col(start)))
        sides.append(rows.withColumns({start: F.col(start).cast("long"), end: F.col(end).cast("long")}).withColumn("_level", _level(F.col(start), F.col(end))))
    # at most 64 numbers: the levels that occur on either side
    levels = sorted(r[0] for r in sides[0].select("_level").union(sides[1].select("_level")).distinct().collect())
    a = _listed(sides[0], *left_at, levels)
    b = _listed(sides[1], *right_at, levels).withColumnRenamed("_level", "_level2")
    met = a.join(b, [*keys, "_m", "_bucket"]).where(F.col("_m") == F.greatest("_level", "_level2"))
    (ls, le), (rs, re) = ([F.col(c) for c in at] for at in (left_at, right_at))
    shared = (ls >= rs) & (le <= re) if within else (ls < re) & (rs < le)
    met = met.where(shared & (F.col("_bucket") == _bucket(F.greatest(ls, rs), F.col("_m"))))
    return met.drop("_m", "_bucket", "_level", "_level2")


def not_within(left: DataFrame, right: DataFrame, keys: list[str], left_at: tuple[str, str], right_at: tuple[str, str], row: list[str], stretch: int = 1024) -> DataFrame:
    """Rows of left (told apart by row) whose interval lies within none of right. Rows without an interval stay.

    An interval lies within another if one of those that begin no later ends no earlier, so the furthest end so far, in the order of
    starts, settles it, and no pairs are made. Starts of one key are cut into stretches of that many places; what earlier
    stretches reach comes down as one row each, so a key with very many intervals is spread over its stretches."""
    some = lambda at: F.coalesce(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys]) & (F.col(at[1]) > F.col(at[0])), F.lit(False))
    place = lambda at: (F.col(at[0]).cast("long").alias("_s"), F.col(at[1]).cast("long").alias("_e"))
    values = [c for c in left.columns if c not in keys]
    asked = left.where(some(left_at)).select(*keys, *place(left_at), F.struct(*values).alias("_row"))
    rows = asked.unionByName(right.where(some(right_at)).select(*keys, *place(right_at)), allowMissingColumns=True)
    rows = rows.withColumn("_n", F.col("_s") - F.pmod("_s", F.lit(stretch)))
    end = F.max(F.when(F.col("_row").isNull(), F.col("_e")))
    reached = rows.groupBy(*keys, "_n").agg(end.alias("_e")).withColumn("_e", F.max("_e").over(Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)))
    reached = reached.where(F.col("_e").isNotNull()).withColumn("_s", F.col("_n"))
    # of equal starts those of right come first
    so_far = Window.partitionBy(*keys, "_n").orderBy("_s", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = rows.unionByName(reached, allowMissingColumns=True).withColumn("_reach", end.over(so_far)).where(F.col("_row").isNotNull() & F.coalesce(F.col("_reach") < F.col("_e"), F.lit(True)))
    return free.select(*keys, "_row.*").select(*left.columns).unionByName(left.where(~some(left_at)))


def clusters(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """rows with cluster: intervals of one key that are joined by overlaps have one number."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) >= reach, F.lit(True)).cast("int")
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def settle(matches: DataFrame, keys: list[str], start: str = "start", end: str = "end", prefer: tuple[Column, ...] | None = None) -> DataFrame:
    """Of matches that overlap, those that are kept: the best first (by hand before detectors before a model, then higher confidence, then
    longer, then earlier), each unless one that is kept already overlaps it. keys name the stretch of text that start and end count
    in, such as a line; matches of a cluster meet in one row, so a stretch should be no longer than a page."""
    if prefer is None:
        by = F.coalesce(F.create_map(F.lit("manual"), F.lit(0), F.lit("regex"), F.lit(1))[F.col("source")], F.lit(2))
        prefer = (by, -F.col("confidence"), F.col(start) - F.col(end), F.col(start))
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(c for c in matches.columns if c not in keys)])
    row = F.struct(*matches.columns)
    each = clusters(matches, keys, start, end).groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), row.alias("row")))).alias("m"))
    kept = F.aggregate(F.transform("m", lambda x: x["row"]), F.expr(f"cast(array() AS {_array_of(matches)})"), lambda out, x: F.when(F.exists(out, lambda k: (k[start] < x[end]) & (x[start] < k[end])), out).otherwise(F.concat(out, F.array(x))))
    return each.select(F.inline(kept)).select(*matches.columns)


def _array_of(rows: DataFrame) -> str:
    """The type of an array of rows."""
    return f"array<{rows.schema.simpleString()}>"
