"""Per-key aggregates that stay balanced when a few keys hold most of the rows.

A plain ``groupBy(key)`` sends every partial state of a key to one reducer. Here the chunk that a
task reads is combined where it lies, one state per key, and states merge in rounds of ``fan_in``
until one per key is left, so that no task ever merges more than ``fan_in`` states of a key at a
time, however many rows the key has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 16


@dataclass(frozen=True)
class State:
    """A mergeable aggregate: ``start`` makes it from rows, ``merge`` combines columns of it."""

    name: str
    start: Column
    how: str = "sum"

    def merge(self) -> Column:
        column = F.col(self.name)
        return {
            "sum": F.sum,
            "min": F.min,
            "max": F.max,
            "hll": F.hll_union_agg,
            "kll": F.kll_merge_agg_double,
        }[self.how](column).alias(self.name)


def tree_aggregate(df: DataFrame, keys: list[str], states: list[State], chunks: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct ``keys`` with the merged ``states``.

    A chunk is what one task of ``df`` holds: a partition of a file scan
    (``spark.sql.files.maxPartitionBytes``) or of a shuffle
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), both of a set size. A task hands on one
    state per key, so that the first shuffle carries keys times tasks at most. ``chunks`` is how many
    tasks there are, or about (more of them share chunks); it sets the number of rounds, and is the
    number of shuffle partitions unless given. All rows of a task are in one chunk: a task that runs
    again after an executor was lost makes the same states, in whatever order its rows come. Null
    keys form a group like any other; an empty input gives no rows.
    """
    chunks = max(1, chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunk = "__chunk"
    merged, start = df.withColumn(chunk, F.pmod(F.spark_partition_id(), F.lit(chunks))), True
    while chunks > 1 or start:
        chunks = math.ceil(chunks / fan_in)
        wider = merged.withColumn(chunk, F.floor(F.col(chunk) / fan_in))
        merged = wider.groupBy(*keys, chunk).agg(*(s.start.alias(s.name) if start else s.merge() for s in states))
        start = False
    return merged.drop(chunk)


def distinct_accepted_pairs(expected_output: DataFrame, chrom: Column) -> DataFrame:
    """Accepted pairs counted once: rows with a null chromosome left out, rows that are equal in
    the canonical chromosome and all columns but ``loaded_at`` collapsed (null equals null)."""
    rest = [c for c in expected_output.columns if c not in ("chr", "loaded_at")]
    return (
        expected_output.where(F.col("chr").isNotNull())
        .select(chrom.alias("chrom"), *(F.col(f"`{c}`") for c in rest if c != "chrom"))
        .distinct()
    )


def dominant_keys(counts: DataFrame, key: str, n: str, share: int) -> DataFrame:
    """The keys whose count is at least one ``share``-th of all counts together."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) * share >= total).select(key)
