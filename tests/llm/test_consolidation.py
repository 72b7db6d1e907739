import random

from conftest import rows
from pyspark.sql import functions as F

from locusweave.llm.consolidation import connected_groups

SCHEMA = "chrom string, u long, v long"


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for c, u, v in links:
        a, b = sorted((find((c, u)), find((c, v))))
        parent[b] = a
    return sorted((c, x, find((c, x))[1]) for c, x in parent)


def test_chains_hubs_loops_and_repeats(spark):
    rng = random.Random(5)
    links = [("1", i, i + 1) for i in range(100, 400)]  # one long chain
    links += [("2", 7, i) for i in range(1000, 1300)]  # a hub
    links += [("3", rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [("4", 5, 5), ("4", 9, 8), ("4", 8, 9)] + links[:40]
    dirty = [(None, 1, 2), ("5", None, 2), ("5", 2, None)]
    df = spark.createDataFrame(links + dirty, SCHEMA).withColumn("group", F.lit(0)).withColumn("vertex", F.lit("clash")).withColumn("a", F.lit(1))
    assert rows(connected_groups(df, ["chrom"], "u", "v")) == brute(links)


def test_empty_and_strings(spark):
    assert connected_groups(spark.createDataFrame([], SCHEMA), ["chrom"], "u", "v").count() == 0
    df = spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y")], "u string, v string")
    assert rows(connected_groups(df, [], "u", "v")) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
