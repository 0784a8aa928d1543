"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a threshold, and the groups they form.

Method: a prefix-filtered join with verification, in place of a product of the document by n-gram incidence matrix with its transpose
that accumulates overlap counts (the README has the numbers of entries of both). N-grams are ordered (those found to be frequent last,
else by hash) and only the leading ones of each row, as many as the threshold allows two similar rows to differ in, are
columns. Every column becomes one or more blocks of rows. Within a block, numpy lists the pairs and drops the pairs that sizes, positions and a parity bitmap prove to lie below the bound. Of
the remaining pairs only a spanning forest leaves the block: one row fewer than the block has, however many copies it
holds. Their overlaps are then counted on the whole sets. A block with a refuted pair is taken up again, with what is
known by then and more forests, until no block holds an unproven pair; so no link between groups is lost.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .scratch import Scratch
from .stream import are_few, few, tidy, whole_groups
from .words import Words, as_strings, mix, pieces

#: Rows of one column that are multiplied with each other in one task; a longer column is cut into blocks of this size.
BLOCK = 4096
#: Frequent n-grams that are ordered last; a bound on what is broadcast (8 bytes each). Any set gives the same result.
MOST_FREQUENT = 200_000
#: Most spanning forests that a block sends out at once; what is unproven after them waits for the next turn.
FORESTS = 32
_BITS = 512


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    for a, b in pieces(column):
        w = Words(column.slice(a, b - a), lower=True)
        one = w.hashes()
        at, wide = w.windows(one, k)
        cut = np.searchsorted(at, w.first)
        for d in range(w.n):
            n = w.first[d + 1] - w.first[d]
            if n >= k:
                s = np.sort(wide[cut[d] : cut[d + 1]])
                keep = np.ones(len(s), bool)
                keep[1:] = s[1:] != s[:-1]
                yield s[keep]
            elif n:
                with np.errstate(over="ignore"):
                    h = np.uint64(n)
                    for x in one[w.first[d] : w.first[d + 1]]:
                        h = mix(np.asarray(h * np.uint64(31) + x))
                yield np.asarray([h], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _prefix(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    p = len(s) - -(-num * len(s) // den) + 1
    if len(frequent) and len(s):
        at = np.searchsorted(frequent, s)
        last = frequent[np.minimum(at, len(frequent) - 1)] == s
        s = np.concatenate([s[~last], s[last]])
    return s[: p if len(s) else 0]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for batch in batches:
        parts = [_prefix(s, none, num, den) for s in shingle_sets(as_strings(batch.column(0)), k)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *parts]).view(np.int64))], ["h"])


def _parity(s: np.ndarray, bits: int) -> bytes:
    """Which of so many (a power of two) low-bit classes of hashes have an odd number of members, a bit each. Two sets
    differ in at least as many members as their bits differ in."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _sketch(batches: Iterator[pa.RecordBatch], frequent, k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    frequent = frequent.value
    for batch in batches:
        n, s1, s2, parts, bits, wide = [], [], [], [], [], []
        for s in shingle_sets(as_strings(batch.column(1)), k):
            n.append(len(s))
            s1.append(mix(s + np.uint64(1)).sum(dtype=np.uint64))
            s2.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            parts.append(_prefix(s, frequent, num, den))
            bits.append(_parity(s, _BITS))
            wide.append(_parity(s, max(_BITS, 4 << len(s).bit_length())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), _lists(parts), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())],
            ["id", "n", "s1", "s2", "prefix", "bits", "wide"],
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(as_strings(batch.column(1)), k)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "s"])


def _refute(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Whether the wide bitmaps leave a pair possible; the wider one is folded onto the other."""
    for batch in batches:
        ok = []
        for a, b, n in zip(batch.column(2), batch.column(3), (batch.column(4).to_numpy() + batch.column(5).to_numpy()).tolist(), strict=True):
            a, b = sorted((np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b)), key=len)
            if len(a) < len(b):
                b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
            ok.append(int(np.bitwise_count(a ^ b).sum()) <= n - 2 * -(-num * n // (num + den)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["x", "y", "maybe"])


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(den * both >= num * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["x", "y", "ok"])


def _root(parent: array, u: int) -> int:
    while (p := parent[u]) != u:
        parent[u] = u = parent[p]
    return u


def _forest(batches: Iterator[pa.RecordBatch], num: int, den: int, layers: int) -> Iterator[pa.RecordBatch]:
    """Per block, up to `layers` edge-disjoint spanning forests of the pairs not proven unlinked."""
    for t in whole_groups(batches, ["h", "bi", "bj"]):
        h, bi, bj, blk, ids, n, pos = (t[c].to_numpy() for c in ("h", "bi", "bj", "blk", "id", "n", "pos"))
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(h), -1)
        comp = t["comp"].to_numpy()
        known = {(int(i), int(j)) for i, js in zip(ids, t["bad"].to_pylist(), strict=True) if js for j in js}
        change = np.ones(len(h), bool)
        change[1:] = (h[1:] != h[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        gid = np.cumsum(change) - 1
        order = np.lexsort((n, gid))
        h, bi, bj, blk, ids, n, pos, gid, bits, comp = (x[order] for x in (h, bi, bj, blk, ids, n, pos, gid, bits, comp))
        _, node = np.unique(np.stack([gid, comp]), axis=1, return_inverse=True)
        node = node.ravel()
        nodes = int(node.max()) + 1 if len(node) else 0
        parents: list[array] = []  # of each forest that was begun
        key = (gid << np.int64(32)) + np.minimum(n, 2**31 - 1)
        far = np.searchsorted(key, (gid << np.int64(32)) + np.minimum(n * den // num, 2**31 - 1), "right")
        count = np.maximum(far - np.arange(len(h)) - 1, 0)
        ends = np.concatenate([[0], np.cumsum(count)])
        out: list[int] = []
        others: list[int] = []
        a = 0
        while a < len(h):
            b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + 250_000, "right")) - 1), len(h))
            i = np.repeat(np.arange(a, b), count[a:b])
            j = np.arange(len(i)) - np.repeat(ends[a:b] - ends[a], count[a:b]) + i + 1
            need = -(-num * (n[i] + n[j]) // (num + den))
            keep = (pos[i] <= n[i] - need) & (pos[j] <= n[j] - need) & (comp[i] != comp[j]) & ((bi[i] == bj[i]) | (blk[i] != blk[j]))
            i, j, need = i[keep], j[keep], need[keep]
            keep = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j] - 2 * need
            for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                if known and (int(ids[x]), int(ids[y])) in known:
                    continue
                for layer in range(layers):
                    if layer == len(parents):
                        parents.append(array("i", range(nodes)))
                    u, v = _root(parents[layer], int(node[x])), _root(parents[layer], int(node[y]))
                    if u != v:
                        parents[layer][u] = v
                        out.append(x)
                        others.append(y)
                        break
            a = b
        x, y = ids[out], ids[others]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[out], bi[out], bj[out], np.minimum(x, y), np.maximum(x, y))], ["h", "bi", "bj", "x", "y"])


def _frequent(docs: DataFrame, scratch: Scratch, k: int, num: int, den: int) -> np.ndarray:
    """Leading n-grams of unusually many documents, at most MOST_FREQUENT: all from that count on which leaves no more."""
    rows = docs.select("text").mapInArrow(tidy(_prefixes, k=k, num=num, den=den), "h long").groupBy("h").count()
    # two passes over the text, but only one number per leading n-gram is shuffled
    rows = scratch.save(rows.where("count >= 32").select("h", F.floor(F.log2("count") * 8).cast("int").alias("level")), "often")
    least, n = None, 0
    for level, size in sorted(rows.groupBy("level").count().collect(), reverse=True):  # a few hundred levels at most
        n += size
        if n > MOST_FREQUENT:
            break
        least = level
    got = rows.where(F.col("level") >= least).select("h").toPandas()["h"].to_numpy(np.int64) if least is not None else np.zeros(0, np.int64)
    scratch.drop("often")
    return np.sort(got.view(np.uint64))


def _both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (x, y) with columns of both ids."""
    for side in ("x", "y"):
        pairs = pairs.join(of.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def ngram_jaccard_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs: the size of its set of distinct k-word shingles (A-Z
    lower-cased; fewer than k words: the whole sequence) and the smallest id reachable over links, where
    den * intersection >= num * union. 0 < num <= den.

    Texts that are null, empty or without words have an empty set, link with nothing and are their own component.
    Rows with equal sets form one class, joined through its smallest id; repeated rows each get their row. A null id keeps
    its row; the component of its class is given. No rows give no rows; columns other than the two named are ignored."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, scratch, k, num, den))
    sketch = docs.mapInArrow(tidy(_sketch, frequent=frequent, k=k, num=num, den=den), "id long, n long, s1 long, s2 long, prefix array<long>, bits binary, wide binary")
    sketch = scratch.save(sketch, "sketch")
    classes = scratch.save(sketch.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep")), "classes")
    reps = sketch.join(classes.where("rep is not null").select(F.col("rep").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi")
    reps = scratch.save(reps.dropDuplicates(["id", "s1", "s2"]).select("id", "n", "prefix", "bits"), "reps")

    entries = reps.select("id", "n", F.posexplode("prefix").alias("pos", "h"))
    counts = entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    # written out, so that the join deals both sides anew and a column with very many rows can be split
    counts = scratch.save(counts, "counts")
    entries = entries.join(counts, "h").withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int"))
    entries = entries.withColumn("blk", F.pmod(F.xxhash64("id"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    entries = entries.select("h", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "id", "n", "pos")
    entries = scratch.save(entries.join(reps.select("id", "bits"), "id"), "entries")

    def forest(rows: DataFrame, layers: int, name: str) -> DataFrame:
        rows = rows.select("h", "bi", "bj", "blk", "id", "n", "pos", "bits", "comp", "bad").repartition("h", "bi", "bj").sortWithinPartitions("h", "bi", "bj")
        return scratch.save(rows.mapInArrow(tidy(_forest, num=num, den=den, layers=layers), "h long, bi int, bj int, x long, y long"), name)

    state = entries.withColumn("comp", F.col("id")).withColumn("bad", F.lit(None).cast("array<long>"))
    links = refuted = sets = None
    turn, layers, every = 0, 1, False
    while True:
        edges = forest(state, layers, f"edges-{turn}")
        scratch.drop("reps", "counts", f"labels-{turn - 1}")
        pairs = scratch.save(edges.select("x", "y").distinct(), f"pairs-{turn}")
        named = scratch.save(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), f"named-{turn}")
        bits = sketch.select("id", "n", "wide").join(few(named), "id", "left_semi")
        maybe = _both(pairs, bits, ["wide", "n"]).select("x", "y", "wide_x", "wide_y", "n_x", "n_y")
        maybe = scratch.save(maybe.mapInArrow(tidy(_refute, num=num, den=den), "x long, y long, maybe boolean"), f"maybe-{turn}")
        if not every:
            named = maybe.where("maybe").select(F.explode(F.array("x", "y")).alias("id")).distinct()
            named = scratch.save(named if sets is None else named.join(sets, "id", "left_anti"), f"texts-{turn}")
            every = not are_few(named)
            if every:  # the texts are shuffled once, for all turns, not again for the ids of each
                named = entries.select("id").distinct()
                named = named if sets is None else named.join(sets, "id", "left_anti")
            more = docs.join(named.hint("merge") if every else F.broadcast(named), "id", "left_semi")
            more = scratch.save(more.mapInArrow(tidy(_sets, k=k), "id long, s binary"), f"sets-{turn}")
            sets = more if sets is None else sets.unionByName(more)
        found = _both(maybe.where("maybe").select("x", "y"), sets, ["s"]).select("x", "y", "s_x", "s_y")
        found = scratch.save(found.mapInArrow(tidy(_verify, num=num, den=den), "x long, y long, ok boolean"), f"found-{turn}")
        good = found.where("ok").select("x", "y").distinct()
        links = good if links is None else links.unionByName(good)
        wrong = pairs.join(good, ["x", "y"], "left_anti")
        refuted = wrong if refuted is None else refuted.unionByName(wrong)
        if wrong.isEmpty():
            break
        labels = scratch.save(connected_components(links, scratch, f"cc{turn}").select(F.col("node").alias("id"), "label"), f"labels-{turn}")
        active = scratch.save(edges.join(wrong, ["x", "y"], "left_semi").select("h", "bi", "bj").distinct(), f"active-{turn}")
        bad = refuted.unionByName(refuted.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy(F.col("x").alias("id")).agg(F.collect_set("y").alias("bad"))
        # only blocks with a refuted pair can hold an unproven one
        entries = scratch.save(entries.join(few(active), ["h", "bi", "bj"], "left_semi"), f"entries-{turn}")
        scratch.drop("entries", *(f"{x}-{turn}" for x in ("edges", "named", "maybe", "texts", "active")), f"entries-{turn - 1}")
        state = entries.join(labels, "id", "left").join(bad, "id", "left").withColumn("comp", F.coalesce("label", "id"))
        turn, layers = turn + 1, min(4 * layers, FORESTS)
    scratch.drop("entries", "reps", "counts", *(f"{x}-{i}" for i in range(turn + 1) for x in ("entries", "sets", "edges", "maybe", "named", "texts", "labels")))
    labels = connected_components(links, scratch, "cc")
    classes = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("s1", "s2", F.coalesce("label", "rep").alias("c"))
    out = sketch.select("id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")).alias("component_id"))
    return scratch.last(out, "groups")
