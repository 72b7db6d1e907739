"""Merging overlapping intervals into periods, with the gaps between them.

The state of an entity is an ordered map of disjoint intervals (:class:`IntervalMap`). An entity may
hold any share of the rows, so its axis is cut into blocks of ``BLOCK`` positions by interval start:
a block's map has at most ``BLOCK`` entries. Runs of overlapping intervals are joined map-side
first, travel to the task of their block, and enter its map there. What crosses block borders is
settled from one small summary row per block: the furthest end seen before it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from locusweave.session import settle

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
#: Rows that are joined into runs together before they are shuffled.
HELD = 1 << 17


class IntervalMap:
    """Disjoint half-open intervals in order; intervals that overlap or touch are one."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts = starts or []
        self.ends = ends or []

    def insert(self, start: int, end: int) -> int:
        """Add an interval; returns by how much the number of periods changed."""
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start = min(start, self.starts[lo])
            end = max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]
        return 1 - max(0, hi - lo)

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


def _groups(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row, the same for rows that are equal in all columns (null equals null)."""
    out = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        code = column.dictionary_encode("encode").indices.to_numpy()
        out = np.unique(out * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    return out


def joined_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of intervals of a group that overlap or touch: a row of each run, its start, its end."""
    order = np.lexsort((start, group))
    places, rank = np.unique(np.concatenate([start, end]), return_inverse=True)
    n = len(start)
    apart = group[order] * (2 * n + 1)  # the groups lie one behind the other on one axis of ranks
    s, e = rank[:n][order] + apart, rank[n:][order] + apart
    reach = np.maximum.accumulate(e)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), s[1:] > reach[:-1]]))
    last = np.append(first[1:], n) - 1
    return order[first], start[order[first]], places[reach[last] - apart[last]]


def _local_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (keys, block, start, end), the joined runs of each entity and block."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
        at, start, end = joined_runs(_groups(columns[:-2]), columns[-2].to_numpy(), columns[-1].to_numpy())
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in columns[:-2]), pa.array(start), pa.array(end)], schema=rows.schema)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield from flush()
    if held:
        yield from flush()


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by keys and block in, one row for each block out: its periods in order."""
    state, key, out, schema = IntervalMap(), None, [], None
    for batch in batches:
        schema = batch.schema
        *keys, starts, ends = (c.to_pylist() for c in batch.columns)
        for now, start, end in zip(zip(*keys, strict=True), starts, ends, strict=True):
            if now != key:
                if key is not None:
                    out.append((key, state))
                state, key = IntervalMap(), now
                if len(out) >= 2000:
                    yield _block_rows(out, schema)
                    out = []
            state.insert(start, end)
    if key is not None:
        yield _block_rows([*out, (key, state)], schema)


def _block_rows(out: list, schema: pa.Schema) -> pa.RecordBatch:
    period = pa.StructArray.from_arrays(
        [pa.array([x for _, m in out for x in side(m)], pa.int64()) for side in (lambda m: m.starts, lambda m: m.ends)], names=["s", "e"]
    )
    offsets = np.append(0, np.cumsum([len(m.starts) for _, m in out])).astype(np.int32)
    keys = [pa.array([k[i] for k, _ in out], schema.types[i]) for i in range(len(schema) - 2)]
    return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets), period)], names=[*schema.names[:-2], "__periods"])


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Columns ``keys``, ``kind`` (``period`` or ``gap``), ``start_pos``, ``end_pos``; half-open.

    Rows whose start is null or negative, or whose end is null or not after the start, are no
    intervals. Null keys form an entity of their own; repeated rows count once; an empty input
    gives no rows; other columns of ``df`` are ignored. Writes one checkpoint of the blocks' maps.
    """
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    cut = df.where((s >= 0) & (e > s)).select(*named, F.shiftright(s, BLOCK_BITS).alias("__block"), s.alias("__s"), e.alias("__e"))
    place = [f"__k{i}" for i in range(len(keys))] + ["__block"]
    period = StructType([StructField("s", LongType()), StructField("e", LongType())])
    mapped = StructType([*cut.select(*place).schema.fields, StructField("__periods", ArrayType(period))])
    # A struct of the keys is an entity's name: null fields in it are equal.
    blocks = settle(
        cut.mapInArrow(_local_runs, cut.schema)
        .repartition(*place)
        .sortWithinPartitions(*place)
        .mapInArrow(_block_maps, mapped)
        .select(F.struct(*(F.col(f"__k{i}").alias(f"k{i}") for i in range(len(keys)))).alias("__entity"), "__block", "__periods")
    )
    return joined_blocks(blocks).select(
        *(F.col(f"__entity.k{i}").alias(k) for i, k in enumerate(keys)), "kind", F.col("s").alias("start_pos"), F.col("e").alias("end_pos")
    )


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """``__entity, kind, s, e``: periods and gaps of whole entities from ``__entity, __block,
    __periods``, the maps of all their blocks; what goes over block borders is put together.
    ``blocks`` is read several times."""
    # One small row per block tells how far the blocks before it reach.
    before = Window.partitionBy("__entity").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    reach = blocks.select("__entity", "__block", F.element_at("__periods", -1)["e"].alias("__last")).select(
        "__entity", "__block", F.max("__last").over(before).alias("__carry")
    )
    cut_at = F.coalesce(F.col("__carry"), F.lit(-1))
    split = (
        blocks.join(reach, ["__entity", "__block"])
        .withColumn("__new", F.filter("__periods", lambda p: p["s"] > cut_at))
        .withColumn("__absorbed", F.array_max(F.transform(F.filter("__periods", lambda p: p["s"] <= cut_at), lambda p: p["e"])))
    )
    # Inside a block every new period but the last is final; a gap ends where a new period starts.
    n = F.size("__new")
    inner = F.transform(
        F.slice("__new", 1, F.greatest(n - 1, F.lit(0))),
        lambda p: F.struct(F.lit("period").alias("kind"), p["s"].alias("s"), p["e"].alias("e")),
    )
    reached = F.greatest(F.col("__carry"), F.col("__absorbed"))
    gaps = F.filter(
        F.transform(
            "__new",
            lambda p, i: F.struct(
                F.lit("gap").alias("kind"), F.when(i == 0, reached).otherwise(F.get("__new", i - 1)["e"]).alias("s"), p["s"].alias("e")
            ),
        ),
        lambda g: g["s"].isNotNull(),
    )
    within = split.select("__entity", F.explode(F.concat(inner, gaps)).alias("r")).select("__entity", "r.kind", "r.s", "r.e")
    # The last new period of a block goes on through the blocks up to the next new period.
    order = Window.partitionBy("__entity").orderBy("__block")
    opened = F.when(n > 0, F.element_at("__new", -1))
    ends = (
        split.select("__entity", "__block", "__absorbed", opened.alias("__open"))
        .withColumn("__now", F.count("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__was", F.col("__now") - F.col("__open").isNotNull().cast("int"))
        .select(
            "__entity",
            F.explode(
                F.array(
                    F.struct(F.col("__was").alias("g"), F.lit(None).cast("bigint").alias("s"), F.col("__absorbed").alias("e")),
                    F.struct(F.col("__now").alias("g"), F.col("__open.s").alias("s"), F.col("__open.e").alias("e")),
                )
            ).alias("r"),
        )
        .where("r.e is not null")
        .groupBy("__entity", "r.g")
        .agg(F.max("r.s").alias("s"), F.max("r.e").alias("e"))
        .select("__entity", F.lit("period").alias("kind"), "s", "e")
    )
    return within.unionByName(ends)
