"""Joins whose sides grow with the data do not gather one of them in the driver."""

import pytest
from pyspark.sql import functions as F

from locusweave.operators import calls, trees, windows
from locusweave.operators.components import components
from locusweave.session import settle


@pytest.fixture(scope="module")
def tables(spark):
    """Settled tables of a few kB, which any side of a join may be broadcast by."""
    found = spark.range(50).select(F.lit("1").alias("chrom"), F.col("id").alias("component"), F.col("id").alias("window_id"), F.expr("array(id * 10, id * 10 + 3, id * 10 + 5)").alias("sites"))
    pairs = spark.range(50).select(F.lit("1").alias("chrom"), (F.col("id") * 10).alias("left_pos"), (F.col("id") * 10 + 3).alias("right_pos"))
    resolved = spark.range(300).selectExpr("'1' as chrom", "cast(id div 2 as string) as read_id", "10 * (id div 6) + 3 * (id % 2) as pos", "cast(id % 3 as int) % 2 as allele", "0.01 as error")
    return settle(found), settle(pairs), settle(resolved)


def broadcasts(df):
    """Broadcasts in the plan, those of subplans and of plans that may still change included."""
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") + df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_window_opinions_and_patterns(tables):
    found, pairs, resolved = tables
    patterns = windows.read_patterns(found, resolved, ["chrom", "read_id"])
    fits = trees.fit_windows(found, patterns)
    opinions = calls.window_opinions(found, fits, pairs)
    assert [broadcasts(df) for df in (patterns, fits, opinions)] == [0, 0, 0]


def test_pairs_of_windows_and_components(tables):
    found, pairs, _ = tables
    assert broadcasts(windows.assign_pairs(pairs, found)) == 0
    assert broadcasts(calls.multiplicity(found, pairs)) == 0
    assert broadcasts(components(pairs, ["chrom"], "left_pos", "right_pos")) == 0
