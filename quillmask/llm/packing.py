"""Packing of tokens into sequences: order-preserving dynamic programming over places to cut.

The documents of a partition, in their order, are one stream of tokens. Windows of at most SIZE tokens end at documents, at
sentences, or, within a run without either, at every sixteenth token. The cheapest chain of cuts is found for about a million
tokens at a time: a window costs its padding, what is given for cutting where it ends, and a little for being one more. Its
beginning is the least key of a queue that stays in order as places enter and leave it, so a place costs a constant amount of
work whatever the number of places within reach; lengths that need no padding (powers of two) are tried besides. The last window
is not settled but goes on into the next million. At the end of a partition every token is a place to cut, so that what is left
can be told apart into lengths without padding where that is cheaper.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import GROUP, _gather, cut_column
from .coders import FileBpe, file_bpe
from .stream import small_batches, tidy, together
from .words import as_strings

SIZE = 2048


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: a cut at the end of a sentence, one within a sentence, and one more window. A sentence longer than
    long has a place to cut at every step tokens."""

    sentence: int = 6
    within: int = 24
    window: int = 2
    long: int = 48
    step: int = 16


def choose_cuts(pos: np.ndarray, cost: np.ndarray, size: int, window: int, least_power: int = 1) -> np.ndarray:
    """The places (ends of windows, as indices into pos) of the cheapest chain from pos[0] to the last place. pos ascends by at
    most size; cost is what a cut at each place is charged. Lengths from least_power need no padding if they are powers of two.
    Of equal chains the one with the longest last window wins."""
    n = len(pos)
    # beginnings that need no padding, by the place they end at
    ends, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    power = least_power
    while power < size:
        i = np.searchsorted(pos, pos - power)
        hit = np.flatnonzero(pos[i] == pos - power)
        ends.append(hit)
        begins.append(i[hit])
        power *= 2
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(ends, kind="stable")
    exact = begins[order].tolist()
    upto = np.searchsorted(ends[order], np.arange(n), "right").tolist()
    at, charge = pos.tolist(), (cost + window).tolist()
    best, back, key, line = [0] * n, [0] * n, [0] * n, [0] * (n + 1)
    head, tail, x = 0, 1, upto[0]
    key[0] = at[0]
    for j in range(1, n):
        here = at[j]
        low = here - size
        while at[line[head]] < low:
            head += 1
        i = line[head]
        least = key[i] - low  # what leads to i, and the padding from there to here
        stop = upto[j]
        while x < stop:
            e = exact[x]
            if best[e] < least:
                least, i = best[e], e
            x += 1
        least += charge[j]
        best[j], back[j] = least, i
        k = least + here
        key[j] = k
        while tail > head and key[line[tail - 1]] > k:
            tail -= 1
        line[tail] = j
        tail += 1
    out = []
    j = n - 1
    while j:
        out.append(j)
        j = back[j]
    return np.array(out[::-1], np.int64)


class Boundaries:
    """Which tokens end a sentence, by their bytes and by those of the token behind."""

    def __init__(self, tokens: list[bytes]):
        close = "\"')]}»”’"
        stops = (".", "!", "?", "…", "。", "！", "？", "؟", "।")
        text = [t.decode(errors="replace") for t in tokens]
        bare = [t.rstrip(" \n\t\r" + close) for t in text]
        self.stop = np.array([b.endswith(stops) for b in bare])
        # full stops of scripts without blanks, and the ends of lines, need nothing behind them
        self.alone = np.array([b.endswith(stops[4:]) or "\n" in t for b, t in zip(bare, text, strict=True)])
        self.blank = np.array([t[:1].isspace() for t in text])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Places behind tokens that end a sentence."""
        if not len(ids):
            return np.zeros(0, np.int64)
        fine = self.alone[ids]
        fine[:-1] |= self.stop[ids[:-1]] & self.blank[ids[1:]]
        return np.flatnonzero(fine) + 1


def places(ids: np.ndarray, at: np.ndarray, bounds: Boundaries, size: int, costs: Costs, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut a stream of documents (at: where each begins, and the end) and what a cut there is charged."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    cost[bounds.ends(ids)] = costs.sentence
    cost[at] = 0
    known = np.flatnonzero(cost >= 0)
    gap = np.diff(known)
    wide = np.flatnonzero(gap > min(costs.long, size))
    step = min(costs.step, size)
    more = (gap[wide] - 1) // step
    inner = np.repeat(known[wide], more) + step * (np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1)
    cost[inner] = costs.within
    if last:
        tail = np.arange(max(0, n - 2 * size), n)
        cost[tail[cost[tail] < 0]] = costs.within
    pos = np.flatnonzero(cost >= 0)
    return pos, cost[pos]


@dataclass
class _Open:
    """Documents whose ids are not in a settled window yet: their rows, ids, where each begins, how many of its ids were settled
    before, and how many it has in all."""

    rows: pa.RecordBatch
    ids: np.ndarray
    at: np.ndarray
    done: np.ndarray
    total: np.ndarray


def _encode(coder: FileBpe, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ids with the end behind each text, for parts of a column. Texts that hold the string of a special token are rare and are
    encoded whole."""
    for part in cut_column(column):
        ids, at = coder.encode(part)
        raw = part.data.tobytes()
        odd = sorted({int(np.searchsorted(part.off, place, "right")) - 1 for s in coder.special for place in _found(raw, s)})
        size = np.diff(at)
        if odd:
            cut = [ids[at[d] : at[d + 1]] for d in range(len(size))]
            for d in odd:
                cut[d] = coder.encode_special(raw[part.off[d] : part.off[d + 1]].decode())
            size = np.array([len(x) for x in cut])
            ids, at = np.concatenate(cut), np.append(0, np.cumsum(size))
        out = np.full(len(ids) + len(size), end_id, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
        yield part.a, part.b, out, at + np.arange(len(at))


def _found(raw: bytes, what: bytes) -> Iterator[int]:
    place = raw.find(what)
    while place >= 0:
        yield place
        place = raw.find(what, place + 1)


def _join(held: _Open | None, rows: pa.RecordBatch, ids: np.ndarray, at: np.ndarray) -> _Open:
    new = _Open(rows, ids, at, np.zeros(rows.num_rows, np.int64), np.diff(at))
    if held is None:
        return new
    return _Open(pa.concat_batches([held.rows, rows]), np.concatenate([held.ids, ids]), np.append(held.at[:-1], at + held.at[-1]), np.append(held.done, new.done), np.append(held.total, new.total))


def _settle(open_: _Open, cuts: np.ndarray, first: int, digest: bool, names: list[str]) -> tuple[pa.RecordBatch, _Open | None]:
    """Pieces of the windows that end at cuts, numbered from first, and what is left open."""
    stop = int(cuts[-1])
    edges = np.union1d(open_.at[open_.at <= stop], np.append(0, cuts))
    begin, end = edges[:-1], edges[1:]
    doc = np.searchsorted(open_.at, begin, "right") - 1
    window = np.searchsorted(cuts, begin, "right")
    offset = begin - np.append(0, cuts)[window]
    start = begin - open_.at[doc] + open_.done[doc]
    size = end - begin
    if digest:
        raw, four = open_.ids.astype("<u4").tobytes(), 4
        content = pa.array([zlib.crc32(raw[four * a : four * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.int64())
    else:
        content = pa.ListArray.from_arrays(pa.array(np.append(begin, stop).astype(np.int32)), pa.array(open_.ids[:stop]))
    columns = [c.take(pa.array(doc)) for c in open_.rows.columns]
    out = pa.RecordBatch.from_arrays([*columns, *map(pa.array, (start, size)), content, *map(pa.array, (open_.total[doc], first + window, offset))], names)
    if stop == open_.at[-1]:
        return out, None
    d = int(np.searchsorted(open_.at, stop, "right")) - 1
    at = np.append(0, open_.at[d + 1 :] - stop)
    done = open_.done[d:].copy()
    done[0] += stop - open_.at[d]
    return out, _Open(open_.rows.slice(d), open_.ids[stop:].copy(), at, done, open_.total[d:])


def _pack(batches: Iterator[pa.RecordBatch], path: str, text_at: int, size: int, end_id: int, costs: Costs, digest: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    coder = file_bpe(path)
    bounds = Boundaries(coder.tokens)
    context = TaskContext.get()
    number, open_ = (context.partitionId() if context else 0) << 36, None

    def settled(last: bool) -> pa.RecordBatch | None:
        nonlocal number, open_
        pos, cost = places(open_.ids, open_.at, bounds, size, costs, last)
        # in the midst of a stream a short window is no gain over a full one, at its end it may be
        cuts = pos[choose_cuts(pos, cost, size, costs.window, 1 if last else max(1, size // 4))]
        cuts = cuts if last else cuts[:-1]
        if not len(cuts):
            return None
        out, open_ = _settle(open_, cuts, number, digest, names)
        number += len(cuts)
        return out

    for batch in together(batches, text_at, GROUP):
        rest = batch.select([i for i in range(batch.num_columns) if i != text_at])
        for a, b, ids, at in _encode(coder, as_strings(batch.column(text_at)), end_id):
            open_ = _join(open_, rest.slice(a, b - a), ids, at)
            out = settled(last=False)
            if out is not None:
                yield out
    if open_ is not None:
        yield settled(last=True)


def pack_documents(docs: DataFrame, path: str, text_col: str = "text", size: int = SIZE, end_id: int = 1, costs: Costs = Costs(), digest: bool = False) -> DataFrame:
    """A row for each piece of each document: docs' columns without the text, then start (its document's ids before it), length,
    ids (or with digest ids_crc32: of the ids as unsigned little-endian 32-bit numbers), doc_tokens (with the end), sequence_id and offset
    (its place in the sequence). A document is its text's ids under the tokenizers file at path, in which strings of special
    tokens are those tokens, then end_id. Documents keep their order within a partition and sequences never span partitions.

    Sequences have size ids at most; one that is shorter is to be padded unless its length is a power of two. Null and empty
    texts are the end alone. Rows are told apart by their place, so null and repeated ids are pieces of their own documents; an
    empty table has no pieces. A column that has the name of a result is refused with a ValueError."""
    small_batches(docs.sparkSession)
    long = T.LongType()
    content = T.StructField("ids_crc32", long) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    added = [T.StructField("start", long), T.StructField("length", long), content, *(T.StructField(n, long) for n in ("doc_tokens", "sequence_id", "offset"))]
    clash = {f.name for f in added} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + added)
    run = tidy(_pack, path=path, text_at=docs.columns.index(text_col), size=size, end_id=end_id, costs=costs, digest=digest, names=schema.names)
    return docs.mapInArrow(run, schema)


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: sequences, tokens, padding and cuts (sequences that end within a document) of the pieces of pack_documents."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max_by(F.col("start") + F.col("length") < F.col("doc_tokens"), "offset").alias("cut"))
    full = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return each.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(full, 0).otherwise(size - F.col("n"))).alias("padding"), F.count_if("cut").alias("cuts"))
