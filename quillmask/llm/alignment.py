"""Alignment of two tokenizers' ids over the same bytes: groups between common cuts, links of overlapping tokens, counts of pairs.

A batch of texts is one run of bytes for both vocabularies. Token ends are cumulative sums of token lengths; those that both
share cut the texts into groups, which tokens look up by binary search, and repetition of each token by the number of those it
overlaps gives all links. Texts are worked on in chunks: a chunk keeps its distinct pairs once, and each text the places of its
pairs among them. Counts of pairs are added up over the corpus in two shuffles, the first one salted, joined back to the pairs
of each chunk (never to those of each text), and met by the texts of the chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BLANK, ByteBpe, Part, _gather, cut_column
from .coders import file_bpe, piece_bpe
from .scratch import Scratch
from .stream import small_batches, tidy, together

#: Bytes of text of a chunk. Each of its links takes some tens of bytes while it is worked on.
CHUNK = 2 << 20
#: Parts that the count of a pair is first added up in.
SALT = 16
_OWN = ["_chunk", "_at", "_times", "_a", "_b", "_n"]
#: What a chunk has for each text, and at its end once for all of them.
_FIELDS = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups", "string"), ("_chunk", "long"), ("_at", "array<int>"), ("_times", "array<int>"), ("_a", "array<int>"), ("_b", "array<int>"), ("_n", "array<long>")]


def same_bytes(coder: ByteBpe, ids: np.ndarray, at: np.ndarray, part: Part) -> np.ndarray:
    """Which texts the bytes of their tokens give again."""
    got, edge = _gather(*coder._bytes, ids)
    start, stop = edge[at[:-1]], edge[at[1:]]
    fine = stop - start == np.diff(part.off)
    want = np.flatnonzero(fine)
    size = np.diff(part.off)[want]
    a, edges = _gather(got, start[want], size, np.arange(len(want)))
    b, _ = _gather(part.data, part.off[:-1][want], size, np.arange(len(want)))
    wrong = np.append(0, np.cumsum(a != b))[edges]
    fine[want] = wrong[1:] == wrong[:-1]
    return fine


def _only(ids: np.ndarray, at: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the fine texts; the others have none."""
    n = np.where(fine, np.diff(at), 0)
    return ids[np.repeat(fine, np.diff(at))], np.append(0, np.cumsum(n))


class Aligned:
    """Tokens of some texts (ids and where each text's begin), by group, and their links."""

    def __init__(self, a: ByteBpe, b: ByteBpe, ids: tuple[np.ndarray, np.ndarray], at: tuple[np.ndarray, np.ndarray]):
        self.coders, self.ids, self.at = (a, b), ids, at
        ends = [np.cumsum(c._bytes[2][i]) for c, i in zip(self.coders, ids, strict=True)]
        starts = [e - c._bytes[2][i] for e, c, i in zip(ends, self.coders, ids, strict=True)]
        #: places where tokens of both end; the ends of texts are among them
        self.common = np.intersect1d(*ends, assume_unique=True)
        self.group = [np.searchsorted(self.common, e) for e in ends]
        first = np.searchsorted(ends[1], starts[0], "right")
        n = np.searchsorted(starts[1], ends[0], "left") - first
        left = np.repeat(np.arange(len(n)), n)
        right = np.arange(len(left)) + np.repeat(first - (np.cumsum(n) - n), n)
        #: ids of the linked tokens, as one number, and the first link of each text
        self.pairs = ids[0][left].astype(np.int64) << 32 | ids[1][right]
        self.links = np.append(0, np.cumsum(n))[at[0]]
        last = np.append(-1, self.group[0])[at[0]]
        self.n_groups = np.diff(last)

    def groups(self) -> list[str]:
        """Ids of each text by group: a1,a2|b1;a3|b2,b3."""
        label = np.concatenate([2 * self.group[0], 2 * self.group[1] + 1])
        order = np.argsort(label, kind="stable")
        size = np.concatenate([c._decimal[2][i] for c, i in zip(self.coders, self.ids, strict=True)])
        flat = np.concatenate([_gather(*c._decimal, i)[0] for c, i in zip(self.coders, self.ids, strict=True)])
        out, edge = _gather(flat, np.cumsum(size) - size, size, order)
        label = label[order]
        if len(label):  # each number has a comma behind it: what stands behind the last one of a side tells how it goes on
            turn = np.flatnonzero(label[1:] != label[:-1])
            out[edge[turn + 1] - 1] = np.where(label[turn] % 2 == 0, ord("|"), ord(";"))
        where = edge[self.at[0] + self.at[1]].tolist()
        raw = out.tobytes()
        return [raw[a : b - 1].decode() if b > a else "" for a, b in zip(where[:-1], where[1:], strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, text_at: int, digest: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    a, b = file_bpe(path_a), piece_bpe(path_b)
    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 36
    for batch in together(batches, text_at, CHUNK):
        rest = [c for i, c in enumerate(batch.columns) if i != text_at]
        text = batch.column(text_at).cast(pa.large_string())
        empty = pc.fill_null(pc.equal(pc.binary_length(text), 0), True)
        text = pc.if_else(empty, pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(text, ""), pa.scalar("", pa.large_string())))
        for part in cut_column(text, BLANK, CHUNK):
            made = [c.encode(part) for c in (a, b)]
            fine = np.logical_and(*(same_bytes(c, *x, part) for c, x in zip((a, b), made, strict=True)))
            ids, at = zip(*(_only(*x, fine) for x in made), strict=True)
            x = Aligned(a, b, ids, at)
            groups = x.groups()
            if digest:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            kinds, place, n = np.unique(x.pairs, return_inverse=True, return_counts=True)
            # the distinct pairs of each text, by their places among those of the chunk
            own = np.repeat(np.arange(part.b - part.a), np.diff(x.links)) * max(len(kinds), 1) + place
            own, times = np.unique(own, return_counts=True)
            edges = np.searchsorted(own, np.arange(part.b - part.a + 1) * max(len(kinds), 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(v.astype(np.int32))) for v in (own % max(len(kinds), 1), times)]
            size = part.b - part.a
            none = [pa.nulls(size, schema.field(f).type) for f in ("_a", "_b", "_n")]
            counts = [np.diff(x.at[0]), np.diff(x.at[1]), x.n_groups, np.diff(x.links)]
            yield pa.RecordBatch.from_arrays([*(c.slice(part.a, size) for c in rest), *map(pa.array, counts), pa.array(groups, pa.string()), pa.array(np.full(size, chunk)), *lists, *none], schema=schema)
            if len(kinds):
                whole = [pa.array([v], schema.field(f).type) for f, v in (("_a", kinds >> 32), ("_b", kinds & 0xFFFFFFFF), ("_n", n))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]) if f.name == "_chunk" else whole[_OWN.index(f.name) - 3] if f.name in _OWN[3:] else pa.nulls(1, f.type) for f in schema], schema=schema)
            chunk += 1


def _look_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Texts of a chunk with the number of their links whose count is the highest of its B id, and the sum of counts."""
    order = np.argsort(pairs["_at"].to_numpy())
    count = pairs["_count"].to_numpy()[order]
    best = pairs["_best"].to_numpy()[order].astype(np.int64)
    at, times = (texts[c].combine_chunks() for c in ("_at", "_times"))
    owner = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy(zero_copy_only=False))
    place, times = (pc.list_flatten(v).to_numpy() for v in (at, times))
    sums = []
    for value in (best, count):
        run = np.append(0, np.cumsum(times * value[place]))  # whole numbers, so sums are exact
        edge = np.searchsorted(owner, np.arange(len(at) + 1))
        sums.append(run[edge[1:]] - run[edge[:-1]])
    rest = texts.drop_columns(["_chunk", "_at", "_times"])
    return rest.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))


def pair_counts(pairs: DataFrame, salt: int = SALT) -> DataFrame:
    """(a, b, count, best) of rows (a, b, n): how many links hold each pair, added up by pair and salt and then by pair, and whether no
    other pair of the same b has more."""
    some = pairs.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salt))).groupBy("a", "b", "_salt").agg(F.sum("n").alias("n"))
    whole = some.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return whole.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch, text_col: str = "text", digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables. One has docs' columns without the text, then n_a, n_b, n_groups, n_links, groups (a1,a2|b1;a3|b2,b3 by decimal ids, or with digest
    groups_sha256, the lowercase hex digest of that), n_best (links whose count is the highest of their B id, ties included) and count_sum
    (of the counts of all links). The other has (a, b, count, best): how often the corpus links each pair of ids.

    A is the tokenizers file path_a over a space and the text, B the sentencepiece file path_b over the text, before which it puts a
    space itself. Strings of special tokens are plain text. Texts that are null or empty, or whose tokens' bytes differ from a
    space and the text, have no tokens: numbers are 0 and groups is empty. Ids and other columns are never looked at, so null
    and repeated ones need no care, and an empty table gives empty tables. A column that has the name of a result or begins with _ is refused
    with a ValueError."""
    spark = docs.sparkSession
    small_batches(spark)
    name = "groups_sha256" if digest else "groups"
    clash = sorted({c for c in docs.columns if c.startswith("_")} | {name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"} & set(docs.columns))
    if clash:
        raise ValueError(f"columns {clash} would be overwritten")
    rest = [f for f in docs.schema.fields if f.name != text_col]
    own = [T.StructField(name if n == "groups" else n, T._parse_datatype_string(t)) for n, t in _FIELDS]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rest] + own)
    from pyspark.sql.pandas.types import to_arrow_schema

    run = tidy(_chunks, path_a=path_a, path_b=path_b, text_at=docs.columns.index(text_col), digest=digest, schema=to_arrow_schema(schema))
    both = scratch.save(docs.mapInArrow(run, schema), "chunks")
    pairs = both.where("_a is not null").select("_chunk", F.posexplode(F.arrays_zip("_a", "_b", "_n")).alias("_at", "x")).select("_chunk", "_at", F.col("x._a").alias("a"), F.col("x._b").alias("b"), F.col("x._n").alias("n"))
    counts = scratch.save(pair_counts(pairs.select("a", "b", "n")), "counts")
    known = pairs.join(counts.hint("merge"), ["a", "b"]).select(F.col("_chunk").alias("_of"), "_at", F.col("count").alias("_count"), F.col("best").alias("_best"))
    texts = both.where("_a is null").drop("_a", "_b", "_n")
    kept = T.StructType([f for f in texts.schema.fields if not f.name.startswith("_")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    met = texts.groupBy("_chunk").cogroup(known.groupBy("_of")).applyInArrow(_look_up, kept)
    return met, counts
