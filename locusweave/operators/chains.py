"""Maximal chains of timing edges between clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.session import release, settle

CYCLE = "timing edges form a cycle"


def _name(column: str) -> Column:
    return F.col(column).cast("string")


def _stretches(arcs: DataFrame) -> DataFrame:
    """``chrom, source, target, via``: arcs between clusters where paths begin, end, meet or part, and
    the clusters in between, of which each has one arc in and one out.

    Those find the head of their stretch by pointer jumping, whose rounds grow with the logarithm of
    the longest stretch. Clusters that never find one lie on a ring without a way in: an error.
    """
    ends = F.array(F.struct(F.col("source").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degree = arcs.select("chrom", F.explode(ends).alias("e")).groupBy("chrom", "e.x").agg(F.sum("e.out").alias("out"), F.sum("e.into").alias("into"))
    inner = settle(degree.where("out = 1 and into = 1").select("chrom", "x"))
    side = lambda end, flag: inner.select("chrom", F.col("x").alias(end), F.lit(True).alias(flag))
    marked = settle(arcs.join(side("source", "from_inner"), ["chrom", "source"], "left").join(side("target", "to_inner"), ["chrom", "target"], "left").na.fill(False, ["from_inner", "to_inner"]))
    direct = marked.where("not from_inner and not to_inner").select("chrom", "source", "target", F.array().cast("array<string>").alias("via"))
    at = settle(
        marked.where("to_inner").select(
            "chrom", F.col("target").alias("x"), F.when(F.col("from_inner"), F.col("source")).otherwise(F.col("target")).alias("at"), F.col("from_inner").cast("bigint").alias("steps")
        )
    )
    heads = settle(marked.where("to_inner and not from_inner").select("chrom", F.col("target").alias("at")))
    n, reach = at.count(), 1
    while not at.join(heads, ["chrom", "at"], "left_anti").isEmpty():
        if reach > n:
            raise ValueError(CYCLE)
        ahead = at.select("chrom", F.col("x").alias("at"), F.col("at").alias("further"), F.col("steps").alias("more"))
        before, at = at, settle(at.join(ahead, ["chrom", "at"]).select("chrom", "x", F.col("further").alias("at"), (F.col("steps") + F.col("more")).alias("steps")))
        release(before)
        reach *= 2
    members = F.transform(F.sort_array(F.collect_list(F.struct("steps", _name("x").alias("x")))), lambda m: m["x"])
    runs = at.groupBy("chrom", "at").agg(members.alias("via"), F.max_by("x", "steps").alias("tail"))
    into = marked.where("to_inner and not from_inner").select("chrom", "source", F.col("target").alias("at"))
    onward = marked.where("from_inner and not to_inner").select("chrom", F.col("source").alias("tail"), "target")
    return direct.unionByName(runs.join(into, ["chrom", "at"]).join(onward, ["chrom", "tail"]).select("chrom", "source", "target", "via"))


def _numbered(paths: DataFrame) -> DataFrame:
    """Adds ``chain_index``, from 0 per chromosome in the order of the paths. They are sorted in
    ranges, so that the paths from one root may lie in many tasks, and numbered by what comes before."""
    placed = settle(paths.orderBy("chrom", "path").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy("chrom", part).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("chrom").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("chrom", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    index = F.col("__at") - F.col("__first") + F.col("__start")
    return placed.withColumn("__part", part).join(starts, ["chrom", "__part"]).select("chrom", index.alias("chain_index"), "path")


def timing_chains(edges: DataFrame) -> DataFrame:
    """``chrom, chain_index, path``: every path from a cluster no timing edge enters to one none
    leaves, with three clusters or more; chains are numbered from 0 per chromosome in the order of
    their cluster names as strings.

    Stretches without a branch are taken as one arc, so that long chains take few rounds; paths then
    grow by one arc per round, all at once, and those that cannot grow are set aside. The number of
    paths is part of the result and can be large. A cycle anywhere raises an error, also one that no
    path leads to.
    """
    timing = settle(edges.where("relation = 'timing'").select("chrom", "source", "target").distinct())
    if timing.isEmpty():
        return timing.select("chrom", F.lit(0).cast("bigint").alias("chain_index"), F.array().cast("array<string>").alias("path"))
    stretches = _stretches(timing)
    onward = timing.select("chrom", F.col("source").alias("target"), F.lit(False).alias("leaf")).distinct()
    arcs = settle(stretches.join(onward, ["chrom", "target"], "left").na.fill(True, ["leaf"]))
    entered = timing.select("chrom", F.col("target").alias("source")).distinct()
    roots = timing.select("chrom", "source").distinct().join(entered, ["chrom", "source"], "left_anti")
    growing = settle(roots.select("chrom", F.col("source").alias("end"), F.array(_name("source")).alias("path"), F.lit(False).alias("leaf")))
    done = []
    more = not growing.isEmpty()
    while more:
        grown = growing.where("not leaf").drop("leaf").join(arcs.withColumnRenamed("source", "end"), ["chrom", "end"])
        longer = F.concat("path", "via", F.array(_name("target")))
        growing = settle(grown.select("chrom", F.col("target").alias("end"), longer.alias("path"), "leaf", F.array_contains("path", _name("target")).alias("again")))
        done.append(growing.where("leaf").select("chrom", "path"))
        # A path that met a cycle comes back to one of its clusters, so this ends.
        again, more = growing.agg(F.max("again"), F.count_if(~F.col("leaf")) > 0).first()
        if again:
            raise ValueError(CYCLE)
    if not done:
        raise ValueError(CYCLE)
    paths = reduce(DataFrame.unionByName, done)
    # Without a cycle every cluster lies on a path from a root.
    seen = paths.select("chrom", F.explode("path").alias("source")).distinct()
    if not arcs.select("chrom", _name("source").alias("source")).distinct().join(seen, ["chrom", "source"], "left_anti").isEmpty():
        raise ValueError(CYCLE)
    return _numbered(paths.where(F.size("path") >= 3))
