"""Places of sites on a drawing of the graph: evenly spaced ranks, not distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.chrom import graph_sort_key
from locusweave.operators.axis import ranked

#: Fixed values of the drawing.
NODE_GAP, LEVEL_GAP, COMPONENT_GAP = 80.0, 70.0, 220.0
LEVEL_WIDTH = 0.05
NODE_HEIGHT, BIN_WIDTH, BINS = 35.0, 0.1, 10
BIN_HEIGHT = 2 * NODE_HEIGHT
BAND_HEIGHT, BAND_GAP = BINS * BIN_HEIGHT, 4 * NODE_HEIGHT


def component_layout(nodes: DataFrame) -> DataFrame:
    """Adds ``x`` and ``y`` to ``chrom, pos, component, vaf``: sites of a component in order of
    position, components side by side in order of their first site, and one level per VAF step that
    occurs in the component, the higher the VAF the higher up. A missing VAF counts as 0."""
    placed = ranked(nodes.withColumn("__level", F.floor(F.coalesce("vaf", F.lit(0.0)) / LEVEL_WIDTH)), ["chrom", "component"], "pos")
    # VAF steps are few, so a component's levels fit in a short array.
    per = placed.groupBy("chrom", "component").agg(F.max("size").alias("__n"), F.sort_array(F.collect_set("__level")).alias("__levels"))
    before = Window.partitionBy("chrom").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    width = (F.col("__n") - 1) * NODE_GAP + COMPONENT_GAP
    starts = per.select("chrom", "component", "__levels", F.coalesce(F.sum(width).over(before), F.lit(0.0)).alias("__start"))
    level = F.array_position("__levels", F.col("__level")) - 1
    y = ((F.size("__levels") - 1) / 2.0 - level) * LEVEL_GAP
    joined = placed.join(starts, ["chrom", "component"]).withColumn("x", F.col("__start") + (F.col("rank") - 1) * NODE_GAP).withColumn("y", y)
    return joined.select(*nodes.columns, "x", "y")


def md5_mod(name: Column, modulus: int) -> Column:
    """The md5 digest of ``name``, read as one number, modulo ``modulus``."""
    digits = F.split(F.md5(name.cast("string").cast("binary")), "")
    digit = lambda c: F.conv(c, 16, 10).cast("int")
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0), lambda a, c: (a * 16 + digit(c)) % modulus)


def band_y(name: Column, vaf: Column, haplotype: Column) -> Column:
    """Height in the simplified drawing: a band per haplotype (HP1, others, HP2), in it a bin per
    tenth of VAF with the highest on top, and inside the bin a fixed scatter by the site's name."""
    band = F.when(haplotype == "HP1", 0).when(haplotype == "HP2", 2).otherwise(1)
    bin_ = BINS - 1 - F.least(F.floor(F.coalesce(vaf, F.lit(0.0)) / BIN_WIDTH).cast("int"), F.lit(BINS - 1))
    scatter = (md5_mod(name, 1000) / 1000.0 - 0.5) * NODE_HEIGHT
    return band * (BAND_HEIGHT + BAND_GAP) + (bin_ + 0.5) * BIN_HEIGHT + scatter


def ranking_layout(nodes: DataFrame) -> DataFrame:
    """Adds ``x`` to ``ranking, chrom, pos``: all sites of a ranking in one row, with a wider gap
    where the chromosome changes."""
    placed = ranked(nodes, ["ranking", "chrom"], "pos")
    # One row per ranking and chromosome.
    chroms = placed.groupBy("ranking", "chrom").agg(F.max("size").alias("__n")).withColumn("__key", graph_sort_key(F.col("chrom")))
    order = Window.partitionBy("ranking").orderBy("__key")
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = chroms.select("ranking", "chrom", before.alias("__before"), (F.row_number().over(order) - 1).alias("__gaps"))
    x = (F.col("__before") + F.col("rank") - 1) * NODE_GAP + F.col("__gaps") * COMPONENT_GAP
    return placed.join(starts, ["ranking", "chrom"]).withColumn("x", x).select(*nodes.columns, "x")
