"""Order along a position axis without ordering a whole group in one task.

The axis is cut into blocks of ``2**BITS`` positions. Ranks and neighbours are found inside each
block, and one small summary row per block carries them over its borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16


def ranked(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Adds ``rank`` (from 1) and ``size`` within ``keys``; values of ``pos`` are distinct there."""
    cut = df.withColumn("__block", F.shiftright(pos, BITS))
    counts = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("size"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(pos))
    return cut.withColumn("__in", inside).join(sums, [*keys, "__block"]).withColumn("rank", F.col("__in") + F.col("__before")).drop("__in", "__before", "__block")


def with_next(df: DataFrame, keys: list[str], pos: str, name: str) -> DataFrame:
    """Adds the next larger value of ``pos`` within ``keys``, null for the last; values are distinct."""
    cut = df.withColumn("__block", F.shiftright(pos, BITS))
    firsts = cut.groupBy(*keys, "__block").agg(F.min(pos).alias("__first"))
    later = firsts.select(*keys, "__block", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__block")).alias("__later"))
    inside = F.lead(pos).over(Window.partitionBy(*keys, "__block").orderBy(pos))
    return cut.withColumn(name, inside).join(later, [*keys, "__block"]).withColumn(name, F.coalesce(name, "__later")).drop("__block", "__later")
