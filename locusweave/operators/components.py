"""Connected components of large graphs by alternating large-star and small-star steps.

Vertices are numbers, and edges between near ones are brought together first, by blocks of the axis,
where each task joins what it holds into a forest. The steps then replace edges by edges to the
smallest neighbour (Kiveris et al. 2014): the number of edges never grows, hubs are spread by the
map-side minimum before the join, and a handful of rounds ends with a star around the smallest
vertex of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.session import by_merge, release, settle

MOST_ROUNDS = 60
#: Edges that a task joins into a forest together.
HELD = 1 << 20
#: Bits of the positions in a block, pass by pass.
BLOCKS = (16, 24)


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` vertices that each is linked to by edges of ``u`` and ``v``."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v = a[apart], b[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(upper := root[root], root):
            root = upper


def _forest(rows: pa.Table) -> pa.RecordBatch:
    """Of edges (scope, u, v) one from each vertex to the smallest of its tree; loops stay."""
    *scope, u, v = (c.combine_chunks() for c in rows.columns)
    group = np.zeros(len(u), np.int64)
    for column in scope:
        code = column.dictionary_encode().indices.to_numpy()
        group = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    names = np.unique(np.concatenate([u.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)]), return_inverse=True)[1]
    number, row, vertex = np.unique(np.tile(group, 2) * (int(names.max(initial=0)) + 1) + names, return_index=True, return_inverse=True)
    root = _roots(vertex[: len(u)], vertex[len(u) :], len(number))
    both = pa.concat_arrays([u, v])
    # A root has an edge of its own only if nothing else holds it: a vertex with loops alone.
    alone = np.bincount(root, minlength=len(number))[root] == 1
    kept = np.flatnonzero((root != np.arange(len(root))) | alone)
    place = pa.array(row[kept] % len(u))
    return pa.RecordBatch.from_arrays([*(c.take(place) for c in scope), both.take(pa.array(row[kept])), both.take(pa.array(row[root[kept]]))], schema=rows.schema)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield _forest(pa.Table.from_batches(held))
            held = []
    if held:
        yield _forest(pa.Table.from_batches(held))


def _unsettled(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Vertices that keep the edges ``u`` to ``v`` from being stars around each ``v``."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low")))
    counted = edges.select(*scope, F.explode(ends).alias("e")).groupBy(*scope, "e.x").agg(F.sum("e.low").alias("edges"), F.min("e.low").alias("low"))
    return counted.where("edges > 1 or (edges = 1 and low = 0)")


def _star(edges: DataFrame, scope: list[str]) -> DataFrame:
    """``u, v, m`` with ``m`` the smallest of ``u`` and its neighbours ``v``."""
    least = edges.groupBy(*scope, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(by_merge(least), [*scope, "u"])


def components(edges: DataFrame, scope: list[str], u: str, v: str) -> DataFrame:
    """``scope``, ``vertex``, ``component`` (its smallest vertex) of every vertex of an edge.

    Edges with a null in these columns are left out; loops, repeated and reversed edges do no harm;
    no edges give no rows.
    """
    known = edges.dropna(subset=[*scope, u, v])
    given = known.select(*scope, F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    forests = given
    for bits in BLOCKS:
        forests = forests.repartition(*scope, F.shiftright("u", bits)).mapInArrow(_forests, given.schema)
    first = settle(forests.distinct())
    now = first.where("u <> v")
    for _ in range(MOST_ROUNDS):
        if _unsettled(now, scope).isEmpty():
            break
        both = now.unionByName(now.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, scope).where("v > u").select(*scope, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        starred = _star(large, scope)
        small = starred.select(*scope, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select(*scope, "u", F.col("m").alias("v")))
        before, now = now, settle(small.where("u <> v").distinct())
        release(before)
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(*scope, F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.select(*scope, F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    lone = first.where("u = v").select(*scope, F.col("u").alias("vertex"), F.col("u").alias("component"))
    return ends.unionByName(roots).unionByName(lone.join(by_merge(ends.unionByName(roots).select(*scope, "vertex")), [*scope, "vertex"], "left_anti"))
