"""As-of joins: each row of one table with the last row of another that is no later, by key.

Both tables become one, ordered by time within a key and a stretch of time; the last value is carried forward within each stretch, and from
stretch to stretch by a window over the stretches' last values alone. So a key that holds a third of all rows is spread over its
stretches, and only one small row for each of these meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(time: Column, kind: str) -> Column:
    """Seconds since 1970, with fractions; those of a time without a zone do not depend on the session's."""
    if kind != "timestamp_ntz":
        return time.cast("double")
    of_day = F.hour(time) * 3600 + F.minute(time) * 60 + F.date_part(F.lit("SECOND"), time).cast("double")
    return F.datediff(time, F.lit("1970-01-01").cast("date")) * 86_400.0 + of_day


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, stretch: int = 3600, within: int | None = None, before: bool = False) -> DataFrame:
    """left with right's other columns, of the last row of right with equal keys whose time is no later (with before: earlier) than that of
    left, and, with within, at most so many seconds earlier; nulls where there is none. Times are timestamps of one type (or whole
    seconds); stretch is in seconds and only decides how rows are spread. Columns but for keys must have different names.

    Of rows of right with one time the greatest counts, column by column. Rows of right with a null time or key are never found, rows
    of left with one find nothing; they stay, and so do repeated ones."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are on both sides")
    kinds = {dict(left.dtypes)[left_time], dict(right.dtypes)[right_time]}
    if len(kinds) > 1:
        raise ValueError(f"times are of different types: {sorted(kinds)}")
    kind = kinds.pop()
    value = F.struct(*[c for c in right.columns if c not in keys])
    known = lambda t: F.col(t).isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in [*keys, keys[0]]])
    seconds = lambda t: F.floor(_seconds(F.col(t), kind) / stretch)
    a = left.where(known(left_time)).select(*keys, F.col(left_time).alias("_t"), seconds(left_time).alias("_s"), F.struct(*left.columns).alias("_row"))
    b = right.where(known(right_time)).groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(value).alias("_value")).withColumn("_s", seconds("_t"))
    # at one time what may be found stands before what looks for it, unless it has to be earlier
    side = lambda finds: F.lit(0 if finds == before else 1)
    both = a.withColumn("_side", side(True)).unionByName(b.withColumn("_side", side(False)), allowMissingColumns=True)
    here = Window.partitionBy(*keys, "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_here", F.last("_value", ignorenulls=True).over(here)).where(F.col("_row").isNotNull())
    ends = b.groupBy(*keys, "_s").agg(F.max_by("_value", "_t").alias("_last"))
    stretches = ends.select(*keys, "_s", "_last").unionByName(a.select(*keys, "_s").distinct(), allowMissingColumns=True).groupBy(*keys, "_s").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).where(F.col("_before").isNotNull()).drop("_last")
    found = F.coalesce("_here", "_before")
    if within is not None:
        age = _seconds(F.col("_t"), kind) - _seconds(found[right_time], kind)
        found = F.when(age <= within, found)
    rest = [c for c in right.columns if c not in keys]
    out = rows.join(carried, [*keys, "_s"], "left").select("_row.*", found.alias("_found")).select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in rest])
    without = left.where(~known(left_time) | known(left_time).isNull())
    return out.unionByName(without.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rest]))
