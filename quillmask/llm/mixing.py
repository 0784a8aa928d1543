"""Mixing sources to target weights: how often to take each document so that every source gets its share of words.

A document of a source is due target / source_size copies. Its whole copies are taken; the fractions are rounded by the
pivotal method. Two documents pass mass (size times fraction) to each other, in a random direction that keeps each one's
expectation, until the fraction of one is 0 or 1. Documents meet in groups of bounded size, large ones first, and each
group hands on its unfinished document together with a few small ones of every size class; groups of groups repeat this
up to one group per source, where the partner of each document is all smaller ones together, so that these take up what
the larger ones left over. Every toss is a coin of its own: order and tosses come from different hashes, and tosses differ
by level, so no document's expectation depends on its place. A group never holds more than a bounded number of rows,
whatever share of all rows a source has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import mix

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents in a group of the first level, groups merged at a further level, documents handed on per size class.
GROUP, FAN, SPARE = 4096, 16, 8
#: Rows that one run of a repeated row stands for.
RUN = 4096


def source_targets(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) of rows (source, size, n times): weights repeat over the sources in order of code points, null
    last; together they get share of all words, each at most cap times its own, the excess going to the others by weight.

    Works on one row a source. A source without words has the target 0."""
    per = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * float(cap)
    per = per.withColumn("w", w).withColumn("full", full).withColumn("ratio", F.col("full") / F.col("w"))
    # by the level at which they reach their cap; at the first that does not, what is left is shared by the weights left
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_w).withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("level") * F.col("w")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _round(size: np.ndarray, p: np.ndarray, draw: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Pivotal rounding over documents in their order; those in keep stay as they are. At most one other is left."""
    p = p.copy()
    held = -1
    for i in np.flatnonzero(~keep).tolist():
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held] * size[held], p[i] * size[i]
        up, down = min(size[held] - a, b), min(a, size[i] - b)
        if draw[i] * (up + down) < down:  # the held one gains `up`
            move, full, empty = up, size[held] - a <= b, b <= size[held] - a
            p[held] = 1.0 if full else (a + move) / size[held]
            p[i] = 0.0 if empty else (b - move) / size[i]
        else:
            move, empty, full = down, a <= size[i] - b, size[i] - b <= a
            p[held] = 0.0 if empty else (a - move) / size[held]
            p[i] = 1.0 if full else (b + move) / size[i]
        if not 0 < p[held] < 1:
            held = i if 0 < p[i] < 1 else -1
    return p


def _round_last(size: np.ndarray, p: np.ndarray, draw: np.ndarray, again: np.ndarray) -> np.ndarray:
    """The same over documents in falling size, with all smaller ones together as the partner of each, as long as they can
    take up its fraction. What is left over at the end is a fraction of one of the smallest, which tosses alone. draw and
    again are independent coins."""
    p = p.copy()
    for i in range(len(p) - 1):
        if not 0 < p[i] < 1:
            continue
        room = np.minimum(p[i + 1 :], 1 - p[i + 1 :])
        total = float((room * size[i + 1 :]).sum())
        if max(p[i], 1 - p[i]) * size[i] > total:
            continue
        up = draw[i] < p[i]
        p[i + 1 :] = np.clip(p[i + 1 :] - room * (((1 - p[i]) if up else -p[i]) * size[i] / total), 0, 1)
        p[i] = float(up)
    p = np.where(p < 1e-12, 0.0, np.where(p > 1 - 1e-12, 1.0, p))
    p = _round(size, p, again, np.zeros(len(p), bool))
    alone = (p > 0) & (p < 1)
    return np.where(alone, mix((again * 2.0**53).astype(np.uint64)) * 2.0**-64 < p, p)


def _coins(key: np.ndarray, level: int, which: int) -> np.ndarray:
    """A fresh number from 0 to 1 for each document, level and use."""
    return (mix(mix(key.view(np.uint64) + np.uint64(8 * level + which)) + np.uint64(level)) >> np.uint64(11)) * 2.0**-53


def _group(rows: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    rows = rows.assign(at=_coins(rows["draw64"].to_numpy(np.int64), level, 0)).sort_values(["size", "at", "rid"], ascending=[False, True, True], kind="stable")
    size, p, key = rows["size"].to_numpy(), rows["p"].to_numpy(), rows["draw64"].to_numpy(np.int64)
    draw, again = (_coins(key, level, i) for i in (1, 2))
    keep = np.zeros(len(rows), bool)
    if not last:
        seen: dict[int, int] = {}
        for i, s in enumerate(size.tolist()):
            c = int(s).bit_length()
            if 0 < p[i] < 1 and seen.get(c, 0) < SPARE:
                seen[c] = seen.get(c, 0) + 1
                keep[i] = True
    made = _round_last(size.astype(float), p, draw, again) if last else _round(size.astype(float), p, draw, keep)
    return rows.assign(p=made).drop(columns="at")


def _step(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        return _group(rows, level, last)

    return step


def mix_sources(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """(id_col, size, source_size, target, copies, taken) for every row of docs: its words, those of its source, the words
    the source should give, how often to take the document, and the words so taken. copies never exceeds cap rounded up.

    Null texts have size 0 and are never taken. A null source is a source of its own, the last one. Rows that agree in id,
    source and text are one unit with a number of copies and share its outcome out among themselves, so a row that is
    repeated very often stays one row until the result; reruns on the same rows agree whatever their order. Null ids are
    allowed. An empty table gives an empty one; columns other than the three named are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("draw64"))
    rows = scratch.save(rows.groupBy("id", "source", "size", "draw64").agg(F.count("*").alias("n")), "sizes")
    targets = scratch.save(source_targets(rows, weights, share, cap), "targets")
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.when(F.col("size") > 0, F.floor(due + 1e-12)).otherwise(0)
    rows = rows.withColumn("base", whole.cast("long")).withColumn("p", F.when(F.col("size") > 0, F.greatest(due - F.floor(due + 1e-12), F.lit(0.0)) * F.col("n")).otherwise(0.0))
    rows = rows.withColumn("more", F.floor(F.col("p") + 1e-12).cast("long")).withColumn("p", F.greatest(F.col("p") - F.col("more"), F.lit(0.0)))
    groups = F.ceil(F.col("n_docs") / GROUP)
    rows = rows.select(F.coalesce("id", F.lit(0)).alias("rid"), F.col("id").isNull().alias("nameless"), "source", "size", "draw64", "n", "source_size", "target", "base", "more", "p", F.pmod("draw64", groups).alias("g"))
    ended = rows.where("p <= 0 or p >= 1")
    open_ = rows.where("p > 0 and p < 1")
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / GROUP))).first()[0] or 1
    level = 0
    while True:
        last = most <= 1
        open_ = scratch.save(open_.groupBy("source", "g").applyInPandas(_step(level, last), open_.schema), f"level-{level}")
        ended = ended.unionByName(open_.where("p <= 0 or p >= 1"))
        if last:
            break
        open_ = open_.where("p > 0 and p < 1").withColumn("g", F.floor(F.col("g") / FAN))
        most, level = -(-most // FAN), level + 1
    # a unit's rows again, dealt out in runs so that no array grows with their number
    extra = F.col("more") + F.when(F.col("p") >= 0.5, 1).otherwise(0)
    ended = ended.withColumn("extra", extra).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))))
    ended = ended.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, F.col("n")) - 1)))
    copies = F.col("base") + (F.col("nth") < F.col("extra")).cast("long")
    ended = ended.select(F.when(~F.col("nameless"), F.col("rid")).alias(id_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return scratch.last(ended, "mix")
