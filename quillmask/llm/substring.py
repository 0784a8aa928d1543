"""Substring dedup: words covered by a window of k words that also starts anywhere else.

Method: a de Bruijn graph of words is compacted. Its edges are the k-word windows, joined where one follows the other. Most
windows occur once and never enter the graph: every window has a least n-gram (its anchor), which depends on its words
alone, and an anchor met once cannot repeat. Consecutive windows with one anchor are kept as one row (source coordinates,
anchor, hashes of the first and last window) for about twelve windows. The graph is built from what is left:

* Where all rows of an anchor are alike, the row is a path without branches already. Where they differ, each distinct row is
  unrolled once, at its source coordinates, into its windows, and windows met at least twice are edges.
* In and out degrees: an edge or path has a successor if the same one follows all its occurrences, and a predecessor
  likewise; at the end of a text there is none.
* Nonbranching paths are compacted, first within an anchor, then by joins that double the compacted length in every round.
* A compacted path is found again at all source coordinates of its first window, and the words there are compared: all its
  occurrences must have the same words (by a cryptographic digest), and there must be two. If hashes had made different
  words look alike, the work is done again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, numbered
from .stream import tidy
from .words import Words, as_strings, pieces, window_hash

#: Rounds of doubling: enough for paths of 2^ROUNDS rows. Sets of hashes that are tried.
ROUNDS, TRIES = 40, 3


def _paths(w: Words, k: int, anchor: int, seed: int) -> tuple[np.ndarray, ...]:
    """Document, first word, windows, anchor hash, hashes of the first and the last window of all runs of windows that share
    an anchor; k - anchor + 1 windows at most do."""
    one = w.hashes(seed)
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    n = len(one) - k + 1
    if n <= 0:
        return none
    from_word, gram = w.windows(one, anchor)
    value = np.full(len(one), np.uint64(2**64 - 1))
    value[from_word] = gram
    wide = k - anchor + 1
    best, arg, size = value, np.arange(len(value)), 1
    while size < wide:  # leftmost least value of each run of `wide` n-grams, by doubling
        step = min(size, wide - size)
        m = len(best) - step
        right = best[step : step + m] < best[:m]
        best, arg = np.where(right, best[step : step + m], best[:m]), np.where(right, arg[step : step + m], arg[:m])
        size += step
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 : k - 1 + n])
    if not len(at):
        return none
    p, whole = arg[at], window_hash(one, k)
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
    start = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    return w.doc[start], start - w.first[w.doc[start]], count, value[p[new]], whole[start], whole[start + count - 1]


def _sketch(batches: Iterator[pa.RecordBatch], k: int, anchor: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = as_strings(batch.column(1))
        for a, b in pieces(text):
            w = Words(text.slice(a, b - a))
            doc, start, count, *hashes = _paths(w, k, anchor, seed)
            off = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
            flat = [pa.array(x.astype(np.int32)) for x in (start, count)] + [pa.array(x.view(np.int64)) for x in hashes]
            lists = [pa.ListArray.from_arrays(off, x) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["row", "start", "count", "m", "f", "l"])


_MET = "row long, start int, count int, m long, f long, l long, follows long, precedes long, mixed boolean"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of repeated anchors, by their place in the lists of a text, with the windows just behind and before them."""
    for batch in batches:
        flags, lists = batch.column(6), [batch.column(i) for i in range(1, 6)]
        at, size = lists[0].offsets.to_numpy().astype(np.int64), np.diff(flags.offsets.to_numpy())
        some = flags.flatten()
        place = some.field("pos").to_numpy() + np.repeat(at[:-1], size)
        end = np.repeat(at[1:], size)
        start, count, m, f, l = (x.values.to_numpy()[place] for x in lists)  # noqa: E741
        first, last = lists[3].values.to_numpy(), lists[4].values.to_numpy()
        follows = pa.array(first[np.minimum(place + 1, len(first) - 1)], pa.int64(), mask=place + 1 >= end)
        precedes = pa.array(last[np.maximum(place - 1, 0)], pa.int64(), mask=place == np.repeat(at[:-1], size))
        row = np.repeat(batch.column(0).to_numpy(), size)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (row, start, count, m, f, l)), follows, precedes, some.field("mixed")], [x.split()[0] for x in _MET.split(", ")])


_WINDOW = "m long, f long, l long, count int, idx int, h long, follows long, precedes long, n long"


def _unroll(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The windows of the rows that each text is the source of, with the one window before and after each (null: several)."""
    for batch in batches:
        text, todo = as_strings(batch.column(0)), batch.column(1)
        for a, b in pieces(text):
            w = Words(text.slice(a, b - a))
            whole = window_hash(w.hashes(seed), k).view(np.int64)
            some = todo.slice(a, b - a)
            rows = some.flatten()
            size = np.diff(some.offsets.to_numpy()) if len(some) else np.zeros(0, np.int64)
            start, count = rows.field("start").to_numpy(), rows.field("count").to_numpy()
            first = w.first[np.repeat(np.arange(b - a), size)] + start
            each = np.repeat(np.arange(len(count)), count)
            idx = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            at = first[each] + idx
            ends = []
            for name, step, edge in (("follows", 1, idx == count[each] - 1), ("precedes", -1, idx == 0)):
                outer = rows.field(name)
                value = np.where(edge, outer.fill_null(0).to_numpy()[each], whole[np.clip(at + step, 0, max(len(whole) - 1, 0))] if len(whole) else 0)
                ends.append(pa.array(value, pa.int64(), mask=edge & outer.is_null().to_numpy(zero_copy_only=False)[each]))
            same = [pa.array(rows.field(x).to_numpy()[each]) for x in ("m", "f", "l", "count")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(idx.astype(np.int32)), pa.array(whole[at]), *ends, pa.array(rows.field("n").to_numpy()[each])], ["m", "f", "l", "count", "idx", "h", "follows", "precedes", "n"])


class _Plain:
    """The words of one text with one space after each, as bytes."""

    def __init__(self, w: Words, d: int):
        self.f, self.g = w.first[d], w.first[d + 1]
        self.base = w.off[d]
        self.start, self.stop = w.start[self.f : self.g] - self.base, w.stop[self.f : self.g] - self.base
        self.raw = np.append(w.data[self.base : w.off[d + 1]], np.uint8(32))
        self.raw[self.stop] = 32

    def words(self, keep: np.ndarray) -> bytes:
        edge = np.zeros(len(self.raw) + 1, np.int8)
        edge[self.start[keep]] += 1
        edge[self.stop[keep] + 1] -= 1
        return self.raw[np.cumsum(edge)[:-1] > 0].tobytes()[:-1]


def _prove(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Chain and digest of the words at the coordinates of every occurrence."""
    for batch in batches:
        text, marks = as_strings(batch.column(0)), batch.column(1)
        for a, b in pieces(text):
            w, some = Words(text.slice(a, b - a)), marks.slice(a, b - a)
            chains, one, two = [], [], []
            for d in range(b - a):
                plain, rows = _Plain(w, d), some[d].values
                raw = plain.words(np.ones(len(plain.start), bool)) + b" "
                at = np.append(0, np.cumsum(plain.stop - plain.start + 1)).tolist()
                chains.append(rows.field("chain").to_numpy())
                for s, n in zip(rows.field("start").to_pylist(), rows.field("total").to_pylist(), strict=True):
                    x = hashlib.blake2b(raw[at[s] : at[s + n + k - 1]], digest_size=16).digest()
                    one.append(int.from_bytes(x[:8], "little", signed=True))
                    two.append(int.from_bytes(x[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chains) if chains else [], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["chain", "d1", "d2"])


def _cut(batches: Iterator[pa.RecordBatch], k: int, names: list[str], text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows with their words counted, those covered by a marked window counted and the others joined by one space."""
    for batch in batches:
        text, marks = as_strings(batch.column(text_at)), batch.column(batch.num_columns - 1)
        for a, b in pieces(text):
            w = Words(text.slice(a, b - a))
            some = marks.slice(a, b - a)
            n_words, n_removed, kept = np.diff(w.first), np.zeros(b - a, np.int64), []
            for d in range(b - a):
                plain = _Plain(w, d)
                keep = np.ones(n_words[d], bool)
                if some[d].is_valid and len(some[d].values):
                    rows = some[d].values
                    start, total = rows.field("start").to_numpy(), rows.field("total").to_numpy()
                    run = np.zeros(n_words[d] + 1, np.int64)
                    np.add.at(run, start, 1)
                    np.add.at(run, start + total + k - 1, -1)
                    keep = np.cumsum(run)[:-1] == 0
                    n_removed[d] = n_words[d] - keep.sum()
                kept.append(plain.words(keep).decode())
            yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[:-1]), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names)


def _only(name: str) -> F.Column:
    """The one value that all rows of a group have, else null; a null is a value of its own."""
    return F.when((F.count(name) == F.count("*")) & (F.min(name) == F.max(name)), F.min(name)).alias(name)


_ROW = ["m", "f", "l", "count"]


def _graph(texts: DataFrame, scratch: Scratch, k: int, anchor: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of repeated anchors, windows of unrolled rows, and the vertices of the graph: first and last window, number of
    windows, and the only window that follows and precedes them."""
    sketch = texts.mapInArrow(tidy(_sketch, k=k, anchor=anchor, seed=seed), "row long, start array<int>, count array<int>, m array<long>, f array<long>, l array<long>")
    sketch = scratch.save(sketch.where(F.size("m") > 0), "sketch")
    anchors = sketch.select(F.inline(F.arrays_zip("m", "f", "l", "count"))).select("m", F.xxhash64("f", "l", "count").alias("c"))
    anchors = anchors.groupBy("m").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    anchors = scratch.save(anchors.select("m", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    # only anchors and places are dealt out by anchor; the hashes come from the lists of each text
    flags = scratch.save(sketch.select("row", F.posexplode("m").alias("pos", "m")).join(anchors, "m").select("row", "pos", "mixed"), "flags")
    by_row = flags.groupBy("row").agg(F.collect_list(F.struct("pos", "mixed")).alias("flags"))
    met = scratch.save(sketch.join(by_row.hint("merge"), "row").select(*sketch.columns, "flags").mapInArrow(tidy(_met), _MET), "met")
    scratch.drop("sketch", "anchors", "flags")

    kinds = met.groupBy(*_ROW, "mixed").agg(F.count("*").alias("n"), _only("follows"), _only("precedes"), F.min(F.when(F.col("mixed"), F.struct("row", "start"))).alias("at"))
    kinds = scratch.save(kinds, "kinds")
    todo = kinds.where("mixed").groupBy("at.row").agg(F.collect_list(F.struct(F.col("at.start").alias("start"), *_ROW, "follows", "precedes", "n")).alias("todo"))
    windows = scratch.save(texts.join(todo.hint("merge"), "row").select("text", "todo").mapInArrow(tidy(_unroll, k=k, seed=seed), _WINDOW), "windows")
    edges = windows.groupBy("h").agg(F.sum("n").alias("n"), _only("follows"), _only("precedes"), F.min(F.struct(*_ROW, "idx")).alias("at")).where("n > 1")
    # a window's first place; the windows of an anchor's row that only follow each other are compacted there
    order = Window.partitionBy(*_ROW).orderBy("idx")
    edges = edges.select("h", "follows", "precedes", "at.*").withColumns({"on": F.lag("follows").over(order) == F.col("h"), "back": F.lag("h").over(order) == F.col("precedes"), "next": F.lag("idx").over(order) == F.col("idx") - 1})
    edges = edges.withColumn("run", F.sum(F.when(F.col("on") & F.col("back") & F.col("next"), 0).otherwise(1)).over(order))
    runs = edges.groupBy(*_ROW, "run").agg(F.min_by("h", "idx").alias("first"), F.max_by("h", "idx").alias("last"), F.count("*").alias("size"), F.max_by("follows", "idx").alias("follows"), F.min_by("precedes", "idx").alias("precedes"))
    paths = kinds.where("not mixed").select(F.col("f").alias("first"), F.col("l").alias("last"), F.col("count").cast("long").alias("size"), "follows", "precedes")
    vertices = scratch.save(paths.unionByName(runs.select(*paths.columns)), "vertices")
    scratch.drop("kinds")
    return met, windows, vertices


def _compact(vertices: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(chain, total): the first window and the number of windows of every nonbranching path that cannot be longer. None if
    the graph has a cycle of such paths, which texts cannot make but hashes that collide can."""
    a, b = vertices.select("first", "last", "size", "follows"), vertices.select(F.col("first").alias("follows"), F.col("precedes").alias("last"))
    links = scratch.save(a.where("follows is not null").join(b.where("last is not null"), ["follows", "last"], "left_semi").select("first", F.col("follows").alias("to")), "links")
    ends = vertices.select("first", F.col("size").alias("total")).join(links, "first", "left")
    table = scratch.save(ends, "round-0")
    for step in range(1, ROUNDS):
        if table.where("to is not null").isEmpty():
            break
        more = table.select(F.col("first").alias("to"), F.col("total").alias("more"), F.col("to").alias("beyond"))
        longer = table.where("to is not null").join(more, "to").select("first", (F.col("total") + F.col("more")).alias("total"), F.col("beyond").alias("to"))
        table = scratch.save(table.where("to is null").unionByName(longer), f"round-{step}")
        scratch.drop(f"round-{step - 1}")
    else:
        return None
    return scratch.save(table.join(links.select(F.col("to").alias("first")), "first", "left_anti").select(F.col("first").alias("chain"), "total"), "chains")


def remove_repeated_spans(docs: DataFrame, scratch: Scratch, text_col: str = "text", k: int = 35, anchor: int = 12) -> DataFrame:
    """docs with n_words, n_removed and kept: the words not covered by a k-word window whose words also start anywhere else
    (the same text included), joined by one space. 2 <= anchor < k.

    Null texts count as empty: 0, 0 and "". Texts of fewer than k words lose nothing. Repeated rows are copies of each
    other and lose all windows; ids may be null or repeated. An empty table gives an empty one. Other columns stay as they
    are; a column that has the name of a result (or of a helper: _row, _marks) is refused with a ValueError."""
    clash = {"n_words", "n_removed", "kept", "_row", "_marks"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    docs = numbered(docs, Scratch(docs.sparkSession, "rows"))
    texts = docs.select(F.col("_row").alias("row"), F.col(text_col).alias("text"))
    for seed in range(TRIES):
        met, windows, vertices = _graph(texts, scratch, k, anchor, seed)
        chains = _compact(vertices, scratch)
        scratch.drop("vertices", "links", *(f"round-{i}" for i in range(ROUNDS)))
        if chains is None:
            continue
        # where compacted paths begin; both sides of these joins are written, so that a key with very many rows can be split
        inner = scratch.save(windows.select(*_ROW, "idx", F.col("h").alias("chain")).join(chains, "chain"), "inner")
        spans = met.where("mixed").join(inner, _ROW).select("row", (F.col("start") + F.col("idx")).alias("start"), "total", "chain")
        whole = met.where("not mixed").withColumn("chain", F.col("f")).join(chains, "chain").select("row", "start", "total", "chain")
        marked = scratch.save(spans.unionByName(whole), "marked")
        scratch.drop("met", "windows", "chains", "inner")
        marks = marked.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "total", "chain")).alias("_marks"))
        rows = scratch.save(docs.join(marks.hint("merge"), "_row", "left").drop("_row"), "rows")
        scratch.drop("marked")
        proof = rows.where("_marks is not null").select(text_col, "_marks").mapInArrow(tidy(_prove, k=k), "chain long, d1 long, d2 long")
        proof = proof.groupBy("chain").agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in ("d1", "d2")))
        if proof.where("n < 2 or mind1 <> maxd1 or mind2 <> maxd2").isEmpty():
            break
    else:
        raise RuntimeError(f"hashes of different words agree in {TRIES} sets of hashes")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return rows.mapInArrow(tidy(_cut, k=k, names=schema.names, text_at=rows.columns.index(text_col)), schema)
