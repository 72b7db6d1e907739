from itertools import combinations

from conftest import SMALL, rows
from pyspark.sql import functions as F

from locusweave.llm import cooccurrence
from locusweave.session import table

SCHEMA = "g string, b long, pos long, allele int"


def test_dirty_rows_make_no_calls(spark):
    data = [("x", 1, 10, 1), ("x", 1, 10, 1), ("x", 1, 20, 0), ("x", 1, 30, 1), ("x", 1, 30, 0), ("x", 1, 40, 2), (None, 1, 10, 1), ("x", None, 10, 1), ("x", 1, None, 1), ("x", 1, 50, None)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("alt", F.lit("clash")).withColumn("left", F.lit(1))
    called = cooccurrence.calls(df, ["g", "b"], "pos", "allele")
    assert rows(called) == [("x", 1, 10, True), ("x", 1, 20, False)]
    pairs = cooccurrence.with_association(cooccurrence.pair_counts(called, ["g", "b"], "pos", ["g"]))
    assert rows(pairs) == [("x", 10, 20, 0, 1, 0, 0, 1, None, None)]


def test_counts_against_brute_force(spark):
    obs = table(spark, SMALL, "observations").dropna(subset=["chrom"])
    called = cooccurrence.calls(obs, ["chrom", "bam", "read_id"], "pos", "allele")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in cooccurrence.pair_counts(called, ["chrom", "bam", "read_id"], "pos", ["chrom"]).collect()}
    baskets, seen = {}, {}
    for r in obs.collect():
        if None not in (r.read_id, r.pos, r.bam) and r.allele in (0, 1):
            seen.setdefault((r.chrom, r.bam, r.read_id, r.pos), set()).add(r.allele)
    for (*key, pos), alleles in seen.items():
        if len(alleles) == 1:
            baskets.setdefault(tuple(key), {})[pos] = alleles.pop()
    want = {}
    for (chrom, *_), items in baskets.items():
        for a, b in combinations(sorted(items), 2):
            counts = want.setdefault((chrom, a, b), [0, 0, 0, 0, 0])
            counts[2 * (1 - items[a]) + 1 - items[b]] += 1
            counts[4] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_gate_and_empty(spark):
    columns = "g string, left long, right long, alt_alt long, alt_ref long, ref_alt long, ref_ref long, total long"
    data = [("x", 1, 2, 4, 0, 0, 2, 6), ("x", 1, 3, 4, 0, 0, 1, 5), ("x", 1, 4, 3, 0, 0, 9, 12)]
    found = cooccurrence.associated(spark.createDataFrame(data, columns))
    assert rows(found, "right") == [(2,)]  # a lift of exactly 1.5 counts
    empty = cooccurrence.calls(spark.createDataFrame([], SCHEMA), ["g", "b"], "pos", "allele")
    assert cooccurrence.associated(cooccurrence.pair_counts(empty, ["g", "b"], "pos", ["g"])).count() == 0
