from conftest import rows
from pyspark.sql import functions as F

from locusweave.functions.chrom import canonical_chrom
from locusweave.operators.tree_aggregation import State, distinct_accepted_pairs, dominant_keys, tree_aggregate

PAIRS = "chr string, position1 long, position2 long, relation string, total int, loaded_at string"


def test_rounds_give_the_plain_aggregate_for_a_dominant_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    states = [State("n", F.count(F.lit(1))), State("s", F.sum("id")), State("lo", F.min("id"), "min"), State("hi", F.max("id"), "max")]
    merged = tree_aggregate(df.repartition(40), ["k"], states, 40, fan_in=3)
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    assert rows(merged, "k", "n", "s", "lo", "hi") == rows(plain)  # a null key is a group too


def test_sketch_states_merge(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 700).alias("v"))
    merged = tree_aggregate(df, ["k"], [State("h", F.hll_sketch_agg("v"), "hll")], 30)
    for _, estimate in rows(merged.select("k", F.hll_sketch_estimate("h"))):
        assert abs(estimate - 350) < 20


def test_pairs_sent_again_count_once(spark):
    data = [
        ("chr1", 1, 2, "timing", 5, "a"), (" CHR1 ", 1, 2, "timing", 5, "b"), ("1", 1, 2, "timing", None, "b"), ("1", 1, 2, "timing", None, "c"),
        ("Mito", 3, 4, "timing", 5, "a"), ("chrM", 3, 4, "timing", 5, "a"), (None, 1, 2, "timing", 5, "a"),
    ]
    df = spark.createDataFrame(data, PAIRS).withColumn("chrom", F.lit("clash"))
    got = distinct_accepted_pairs(df, canonical_chrom(F.col("chr")))
    assert rows(got, "chrom", "position1", "total") == [("1", 1, None), ("1", 1, 5), ("MT", 3, 5)]


def test_dominant_keys_and_empty_input(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 89), ("c", 1), (None, 0)], "chrom string, n long")
    assert rows(dominant_keys(counts, "chrom", "n", 10)) == [("a",), ("b",)]
    empty = spark.createDataFrame([], PAIRS)
    pairs = distinct_accepted_pairs(empty, canonical_chrom(F.col("chr")))
    assert rows(dominant_keys(tree_aggregate(pairs, ["chrom"], [State("n", F.count(F.lit(1)))]), "chrom", "n", 10)) == []


def _records(spark, df):
    """What each exchange of a query wrote, the first one last."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    written, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return written


def test_a_task_hands_on_one_state_per_key(spark):
    # Five keys, one of them with nine tenths of the rows, in 64 tasks: rounds of 64, 16, 4 and 1 states a key.
    df = spark.range(0, 64_000, numPartitions=64).select(F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id") % 40 / 10).cast("int").alias("k"), "id")
    merged = tree_aggregate(df, ["k"], [State("n", F.count(F.lit(1)))], 64, fan_in=4)
    keys = df.select("k").distinct().count()
    written = _records(spark, merged)[::-1]
    assert written[0] == keys * 64 and written[1] <= keys * 16 and written[2] <= keys * 4
    assert rows(merged) == rows(df.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
