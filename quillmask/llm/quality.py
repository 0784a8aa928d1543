"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles of the training rows. Rounds of boosting go through the features in turn; each
turn fits a shallow tree over the bins of one feature to the gradients and adds its leaves, times a small rate, to that
feature's lookup table. Then the pairs whose coarse grids explain most of what is left get tables of their own, boosted
by shallow trees that split either feature. A score is the logistic function of a sum of table entries, looked up for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stream import small_batches, tidy
from .textstats import FEATURES, TextStats
from .words import as_strings, pieces

#: Most labelled rows that a model is fitted on, those with the least hash of their id.
MAX_TRAIN = 20_000


def _leaves(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """The values that a tree of so many splits over ordered bins gives each bin."""
    edges = [0, len(g)]
    G, H = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    for _ in range(splits):
        best = (1e-9, 0)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = np.arange(a + 1, b)
            if len(at):
                more = gain(a, at) + gain(at, b) - gain(a, b)
                best = max(best, (float(more.max()), int(at[more.argmax()])))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def _boxes(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """The values that a tree of so many splits, each of one of two features, gives the cells of a grid."""
    # sums over all cells above and to the left of a corner
    G, H = (np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for x in (g, h))
    total = lambda s, a, b, c, d: s[b, d] - s[a, d] - s[b, c] + s[a, c]
    worth = lambda *box: total(G, *box) ** 2 / (total(H, *box) + ridge)
    boxes = [(0, g.shape[0], 0, g.shape[1])]
    for _ in range(splits):
        best, where = 1e-9, None
        for n, (a, b, c, d) in enumerate(boxes):
            for across, at in ((False, np.arange(a + 1, b)), (True, np.arange(c + 1, d))):
                if len(at):
                    parts = ((a, b, c, at), (a, b, at, d)) if across else ((a, at, c, d), (at, b, c, d))
                    more = worth(*parts[0]) + worth(*parts[1]) - worth(a, b, c, d)
                    if more.max() > best:
                        best, where = float(more.max()), (n, across, int(at[more.argmax()]))
        if where is None:
            break
        n, across, at = where
        a, b, c, d = boxes.pop(n)
        boxes += [(a, b, c, at), (a, b, at, d)] if across else [(a, at, c, d), (at, b, c, d)]
    out = np.empty(g.shape)
    for box in boxes:
        out[box[0] : box[1], box[2] : box[3]] = total(G, *box) / (total(H, *box) + ridge)
    return out


@dataclass
class AdditiveModel:
    """fit() learns the tables from features and 0/1 labels; score() gives probabilities. Training is deterministic."""

    bins: int = 32
    coarse: int = 8
    rounds: int = 120
    pair_rounds: int = 40
    n_pairs: int = 6
    rate: float = 0.15
    splits: int = 3
    ridge: float = 1.0
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse_cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        quantiles = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1])) if len(v) else np.zeros(0)
        self.cuts, self.coarse_cuts = ([quantiles(v, n) for v in x.T] for n in (self.bins, self.coarse))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        if not len(y) or y.min() == y.max():  # nothing to tell apart: the share of label 1, pulled to one half
            p = (y.sum() + 1) / (len(y) + 2)
            self.base = float(np.log(p / (1 - p)))
            return self
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        at = [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f, b in enumerate(at):
                step = self._step(b, len(self.tables[f]), y, score)
                self.tables[f] += step
                score += step[b]
        low = [np.searchsorted(c, v, "right") for c, v in zip(self.coarse_cuts, x.T, strict=True)]
        cell = lambda i, j: low[i] * (len(self.coarse_cuts[j]) + 1) + low[j]
        p = 1 / (1 + np.exp(-score))
        worth = []
        for i, j in combinations(range(x.shape[1]), 2):
            n = (len(self.coarse_cuts[i]) + 1) * (len(self.coarse_cuts[j]) + 1)
            g, h = np.bincount(cell(i, j), y - p, n), np.bincount(cell(i, j), p * (1 - p), n)
            worth.append((-float((g * g / (h + self.ridge)).sum()), i, j))
        for _, i, j in sorted(worth)[: self.n_pairs]:
            self.pairs[i, j] = np.zeros((len(self.coarse_cuts[i]) + 1, len(self.coarse_cuts[j]) + 1))
        for _ in range(self.pair_rounds):
            for (i, j), table in self.pairs.items():
                c = cell(i, j)
                p = 1 / (1 + np.exp(-score))
                g, h = np.bincount(c, y - p, table.size), np.bincount(c, p * (1 - p), table.size)
                step = self.rate * _boxes(g.reshape(table.shape), h.reshape(table.shape), self.splits, self.ridge)
                table += step
                score += step.ravel()[c]
        return self

    def _step(self, b: np.ndarray, n: int, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-score))
        return self.rate * _leaves(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), self.splits, self.ridge)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (c, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(c, x[:, f], "right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse_cuts[i], x[:, i], "right"), np.searchsorted(self.coarse_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (text, label) to (label, features)."""
    for batch in batches:
        text = as_strings(batch.column(0))
        for a, b in pieces(text):
            x = TextStats(text.slice(a, b - a)).features()
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), flat], ["label", "x"])


def _score(batches: Iterator[pa.RecordBatch], model, text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = as_strings(batch.column(text_at))
        for a, b in pieces(text):
            score = model.value.score(TextStats(text.slice(a, b - a)).features())
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(score)], names)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> AdditiveModel:
    """A model fitted on at most max_train rows of docs that labels (id_col, label_col: 0 or 1) marks; null ids and other
    labels are left out. Without labels, or with labels of one kind, it scores every text alike."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "label").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("text", "label")  # at most max_train rows of two numbers
    got = rows.mapInArrow(tidy(_features), "label double, x array<double>").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # the same sums however the rows came in
    return AdditiveModel().fit(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """docs with score, from 0 to 1, that depends on the text alone. Null and empty texts score as a text without words;
    repeated texts score alike; an empty table gives an empty one. A column named score is refused with a ValueError."""
    small_batches(docs.sparkSession)
    if "score" in docs.columns:
        raise ValueError("column score would be overwritten")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidy(_score, model=model, text_at=docs.columns.index(text_col), names=schema.names), schema)
