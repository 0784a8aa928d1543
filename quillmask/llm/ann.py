"""Approximate nearest neighbours by collision counting on single projections.

Every vector (scaled to length one) has one value on each of many random directions; each direction keeps its values
sorted. A query opens a window around its own place on every direction, and windows widen step by step (virtual rehashing:
the same sorted arrays serve every radius). In each step only the vectors between the old and the new ends of a window are
met, and their collisions are added to what was counted before. A vector that has collided on a given share of the
directions is verified with its exact cosine, once. A query ends when the k best that it has verified lie within the radius
that its windows stand for; vectors that near would very likely have collided often enough by then. No vector is left out
for there being too many.

Rows are dealt into blocks once for every QUERIES queries; all queries of a block search it in one task, and the best of
all blocks are merged. Every row is indexed; nothing is fitted to the data.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, numbered

#: Rows and queries of a block.
ROWS, QUERIES = 16384, 16384
#: The first radius and how much wider the next one is.
FIRST, WIDER = 0.2, 1.25


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    """m unit directions, orthogonal in runs of dim."""
    rng = np.random.default_rng(seed)
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))]
    return np.concatenate(runs, axis=1)[:, :m]


def _scaled(rows: pd.Series) -> np.ndarray:
    """Vectors over a power of two near their largest number, which changes no cosine and lets no square overflow."""
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


class _Block:
    """The sorted arrays of one block of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, a: np.ndarray):
        self.ids, self.x = ids, x
        self.norm = np.sqrt((x * x).sum(axis=1))
        value = ((x / self.norm[:, None]) @ a).T
        self.order = np.argsort(value, axis=1, kind="stable")
        self.line = np.take_along_axis(value, self.order, axis=1)

    def search(self, name: int, q: np.ndarray, place: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows verified for a query with values place on the directions, and their cosines."""
        m, n = self.line.shape
        least, norm = max(1, int(np.ceil(share * m))), np.sqrt((q * q).sum())
        count, radius = np.zeros(n, np.int64), FIRST
        low = high = np.array([np.searchsorted(line, v) for line, v in zip(self.line, place, strict=True)])
        rows, scores, near = [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(0)
        while True:
            reach = radius / np.sqrt(len(q))
            wide_low, wide_high = (np.array([np.searchsorted(line, v + r, side) for line, v in zip(self.line, place, strict=True)]) for r, side in ((-reach, "left"), (reach, "right")))
            wide_low, wide_high = np.minimum(wide_low, low), np.maximum(wide_high, high)
            met = [o[a:b] for o, a, b in zip(self.order, wide_low.tolist(), low.tolist(), strict=True) if a < b] + [o[a:b] for o, a, b in zip(self.order, high.tolist(), wide_high.tolist(), strict=True) if a < b]
            low, high = wide_low, wide_high
            if met:
                before = count
                count = before + np.bincount(np.concatenate(met), minlength=n)
                hit = np.flatnonzero((count >= least) & (before < least))
                # one product a row in a fixed order, so that equal vectors score equal in any block
                cosine = np.einsum("ij,j->i", self.x[hit], q) / (self.norm[hit] * norm)
                rows.append(hit)
                scores.append(cosine)
                near = np.append(near, cosine[self.ids[hit] != name])
            if len(near) >= k:
                near = -np.partition(-near, k - 1)[:k]
                if 2 - 2 * near[k - 1] <= radius * radius:
                    break
            if low.max() == 0 and high.min() == n:
                break
            radius *= WIDER
        return np.concatenate(rows), np.concatenate(scores)


def _search(rows: pd.DataFrame, queries: pd.DataFrame, k: int, m: int, share: float, seed: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(rows) or not len(queries):
        return empty
    asked = _scaled(queries["embedding"])
    a = directions(asked.shape[1], m, seed)
    places = (asked / np.sqrt((asked * asked).sum(axis=1))[:, None]) @ a
    out = []
    for start in range(0, len(rows), ROWS):
        part = rows.iloc[start : start + ROWS].sort_values("vec_id", kind="stable")
        block = _Block(part["vec_id"].to_numpy(), _scaled(part["embedding"]), a)
        for name, q, place in zip(queries["vec_id"].to_numpy(), asked, places, strict=True):
            hit, score = block.search(name, q, place, k, share)
            other = block.ids[hit] != name
            hit, score = hit[other], score[other]
            best = np.lexsort((block.ids[hit], -score))[:k]
            out.append((np.full(len(best), name), block.ids[hit][best], score[best]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null, not zero and has finite numbers only."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    return vectors.where(F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                       m: int = 96, share: float = 0.62, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors found nearest by cosine, itself (the
    same id) left out, nearest first and ties to the smaller id; all of them if there are fewer.

    A vector that is null, zero or holds null or non-finite numbers takes no part, nor does a null id. Vectors of another
    length than the query's are no candidates. A query has no rows if there is no candidate; so has an empty table. Rows
    that repeat an id are candidates of their own, and rows are dealt by their place in the table, so that no id or vector
    fills a block. Rows of queries that repeat another one are one query; those that share only the id share k places. m directions are used; vectors within the
    windows of share * m of them are verified."""
    pick = [F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.size(vec_col).alias("dim")]
    scratch = Scratch(vectors.sparkSession, "ann")
    rows = usable(numbered(vectors, scratch), vec_col).where(F.col(id_col).isNotNull()).select(*pick, "_row")
    asked = usable(queries, vec_col).where(F.col(id_col).isNotNull()).select(*pick).distinct()
    n_rows, n_asked = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // QUERIES))
    deal = lambda df, own, n, key, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    rows = deal(rows, "rb", n_rows, "_row", "qb", n_asked).drop("_row").groupBy("dim", "rb", "qb")
    asked = deal(asked, "qb", n_asked, "vec_id", "rb", n_rows).groupBy("dim", "rb", "qb")
    search = partial(_search, k=k, m=m, share=share, seed=seed)

    def both(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return search(rows, queries)

    found = rows.cogroup(asked).applyInPandas(both, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
