"""How often two items occur in the same basket, and how much more often than by chance.

Items are made distinct per basket, ordered pairs come from one equi-join of the baskets with
themselves (sorted, streamed and spilled by Spark; no basket is collected), and the pair counts
combine map-side before they are shuffled. No key of the plan is a single item or chromosome, so
an item that is in a tenth or a third of all baskets does not gather in one task. Calls are made
distinct by basket and item before they meet by basket, which takes one exchange more than meeting
at once would, but a basket that holds a third of all rows is spread until its rows are distinct,
and adaptive execution may split what is left of it. A basket of n items has n (n - 1) / 2 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.pairs import together

COUNTS = ("alt_alt", "alt_ref", "ref_alt", "ref_ref")


def calls(observations: DataFrame, basket: list[str], item: str, state: str) -> DataFrame:
    """``basket``, ``item``, ``alt`` (boolean): the one call of each basket at each item.

    Rows with a null in any of the columns or with a state other than 0 and 1 do not count; rows
    sent again count once; where rows of a basket disagree on the state there is no call.
    """
    keys = [*basket, item]
    usable = observations.select(*keys, state).where(F.col(state).isin(0, 1)).dropna(subset=keys)
    low, high = F.min(state), F.max(state)
    return usable.groupBy(*keys).agg(low.alias("__low"), high.alias("__high")).where("__low = __high").select(*keys, (F.col("__low") == 1).alias("alt"))


def pair_counts(called: DataFrame, basket: list[str], item: str, group: list[str]) -> DataFrame:
    """``group``, ``left``, ``right``, the four counts and ``total`` of each pair of items.

    ``called`` has one row per basket and item with the boolean ``alt``; ``group`` are those basket
    columns that both items of a pair share (a pair is counted per group). ``left < right``.
    """
    left = called.select(*basket, F.col(item).alias("left"), F.col("alt").alias("left_alt"))
    right = called.select(*basket, F.col(item).alias("right"), F.col("alt").alias("right_alt"))
    pairs = together(left, right, basket).where("left < right")
    l, r = F.col("left_alt"), F.col("right_alt")
    hits = (l & r, l & ~r, ~l & r, ~l & ~r)
    return pairs.groupBy(*group, "left", "right").agg(
        *(F.count_if(hit).alias(name) for name, hit in zip(COUNTS, hits, strict=True)), F.count(F.lit(1)).alias("total")
    )


def with_association(counts: DataFrame) -> DataFrame:
    """Adds ``lift`` (observed over expected joint ALT share) and ``pmi`` (its binary logarithm).

    Marginals are those of the baskets that hold both items. ``lift`` is null where one of the
    items never shows ALT there; ``pmi`` is null also where they never show it together.
    """
    aa, n = F.col("alt_alt"), F.col("total")
    expected = (aa + F.col("alt_ref")) * (aa + F.col("ref_alt"))
    lift = F.try_divide((aa * n).cast("double"), expected.cast("double"))
    return counts.withColumn("lift", lift).withColumn("pmi", F.when(F.col("lift") > 0, F.log2("lift")))


def associated(counts: DataFrame, least_together: int = 4, lift_num: int = 3, lift_den: int = 2) -> DataFrame:
    """Pairs seen together ``least_together`` times or more with a lift of ``lift_num/lift_den`` or
    more, compared in whole numbers."""
    aa, n = F.col("alt_alt"), F.col("total")
    enough = lift_den * aa * n >= lift_num * (aa + F.col("alt_ref")) * (aa + F.col("ref_alt"))
    return counts.where((aa >= least_together) & enough)
