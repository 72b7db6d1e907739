"""Periods and gaps over a stream: the ordered interval map of an entity's block is keyed state.

What reaches over block borders is put together after each batch, for the entities it touched:

    streamed_periods(stream, keys, start, end).writeStream.outputMode("update").foreachBatch(join_batch(folder))
    latest_periods(spark, folder)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from locusweave.operators.intervals import BLOCK_BITS, IntervalMap, joined_blocks
from locusweave.session import release, settle

STATE = "starts array<bigint>, ends array<bigint>"
BLOCKS = "entity string, block bigint, periods array<struct<s:bigint,e:bigint>>, epoch bigint"
PERIODS = "entity string, kind string, start_pos bigint, end_pos bigint, epoch bigint"
OUTPUT = "entity string, block bigint, kind string, start_pos bigint, end_pos bigint"


def _take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = IntervalMap(*map(list, state.get)) if state.exists else IntervalMap()
    for batch in batches:
        for start, end in zip(batch["start_pos"].tolist(), batch["end_pos"].tolist(), strict=True):
            held.insert(start, end)
    state.update((held.starts, held.ends))
    found = [("period", s, e) for s, e in zip(held.starts, held.ends, strict=True)] + [("gap", s, e) for s, e in held.gaps()]
    yield pd.DataFrame([(*key, *f) for f in found], columns=["entity", "block", "kind", "start_pos", "end_pos"])


def streamed_periods(stream: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """After each batch, the periods and inner gaps of the entities and blocks it touched, in update
    mode: the newest output of an entity and block replaces its earlier ones. Late intervals merge
    like others. A block's state has no more entries than positions, so state is bounded.
    A block knows nothing of its neighbours: :func:`join_batch` makes whole periods of the output."""
    entity = F.to_json(F.struct(*(F.col(k) for k in keys)), {"ignoreNullFields": "false"})
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    rows = stream.where((s >= 0) & (e > s)).select(entity.alias("entity"), F.shiftright(s, BLOCK_BITS).alias("block"), s.alias("start_pos"), e.alias("end_pos"))
    return rows.groupBy("entity", "block").applyInPandasWithState(_take, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def join_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over :func:`streamed_periods`: keeps the blocks' maps below ``folder`` and
    writes the periods and gaps of all entities the batch touched, over all their blocks.

    Each batch writes folders of its own, so that a batch run again replaces what it wrote."""

    def take(found: DataFrame, epoch: int) -> None:
        spark = found.sparkSession
        period = F.struct(F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
        maps = found.where("kind = 'period'").groupBy("entity", "block").agg(F.sort_array(F.collect_list(period)).alias("periods"))
        maps.write.mode("overwrite").parquet(f"{folder}/blocks/epoch={epoch}")
        log = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").where(F.col("epoch") <= epoch)
        touched = log.where(F.col("epoch") == epoch).select("entity").distinct()
        own = log.join(touched, "entity", "left_semi")
        newest = own.groupBy("entity", "block").agg(F.max("epoch").alias("epoch"))
        held = own.join(newest, ["entity", "block", "epoch"])
        blocks = settle(held.select(F.col("entity").alias("__entity"), F.col("block").alias("__block"), F.col("periods").alias("__periods")))
        whole = joined_blocks(blocks).select(F.col("__entity").alias("entity"), "kind", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"))
        whole.write.mode("overwrite").parquet(f"{folder}/periods/epoch={epoch}")
        release(blocks)

    return take


def latest_periods(spark: SparkSession, folder: str) -> DataFrame:
    """``entity, kind, start_pos, end_pos`` of all entities, as of the last batch that touched each."""
    log = spark.read.schema(PERIODS).parquet(f"{folder}/periods")
    newest = log.groupBy("entity").agg(F.max("epoch").alias("epoch"))
    return log.join(newest, ["entity", "epoch"]).select("entity", "kind", "start_pos", "end_pos")
