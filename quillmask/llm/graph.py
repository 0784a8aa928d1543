"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stream import tidy
from .scratch import Scratch

#: Up to so many edges (16 bytes each) are joined up in one task; more go through distributed steps.
SMALL = 200_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest reachable node of each, by union and find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    nodes = np.array(list(root), np.int64)
    labels = np.array([find(x) for x in root], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, label): the smallest node that each node of edges (x, y) can reach.

    Few edges are joined up in one task. Beyond that bound, large-star and small-star steps alternate until no edge changes. Each is a minimum per node (combined before its
    shuffle, and written out) and an equi-join of written tables, so a node with very many neighbours is split by adaptive
    execution and its neighbours are never gathered. Steps are written out; only two are kept at a time. Nulls and loops are dropped; no edges give no rows."""
    e = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x < y").distinct()
    e = scratch.save(e, f"{name}-0")
    if e.count() <= SMALL:
        return scratch.save(e.coalesce(1).mapInArrow(tidy(_local), "node long, label long"), f"{name}-all")
    print_of = [F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")]
    seen, step = tuple(e.agg(*print_of).first()), 0
    while seen[0]:
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        low = scratch.save(low, f"{name}-low-{step}")
        large = both.join(low, "x").where("y > x").select(F.col("m").alias("x"), "y").where("x < y").distinct()
        large = scratch.save(large, f"{name}-large-{step}")
        least = large.groupBy("y").agg(F.min("x").alias("m"))
        least = scratch.save(least, f"{name}-least-{step}")
        small = large.join(least, "y").select(F.least("x", "m").alias("a"), F.explode(F.array("x", "y")).alias("b"), "m")
        small = small.select(F.col("m").alias("x"), F.col("b").alias("y")).where("x < y").distinct()
        e = scratch.save(small, f"{name}-{step + 1}")
        scratch.drop(*(f"{name}{x}-{step}" for x in ("", "-low", "-large", "-least")))
        now, step = tuple(e.agg(*print_of).first()), step + 1
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct()
    return e.select(F.col("y").alias("node"), F.col("x").alias("label")).unionByName(roots)
