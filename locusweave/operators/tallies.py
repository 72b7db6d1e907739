"""Counts that the run's reports give: labels, relations, and sizes of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("HP1", "HP2", "MIXED", "UNKNOWN")


def label_tally(sites: DataFrame, label: Column) -> DataFrame:
    """Sites by haplotype label, per chromosome and, with a null chromosome, for the genome. Labels
    in any spelling but the known ones, and null, count as unknown; rows with a null chromosome
    count for the genome only."""
    given = F.upper(F.trim(label))
    known = F.when(given.isin(*LABELS), given).otherwise("UNKNOWN")
    counts = [F.count_if(F.col("__label") == h).alias(h.lower()) for h in LABELS]
    rolled = sites.select("chrom", known.alias("__label")).rollup("chrom").agg(*counts, F.count(F.lit(1)).alias("sites"), F.grouping("chrom").alias("__all"))
    return rolled.where("chrom is not null or __all = 1").drop("__all")


def relation_tally(edges: DataFrame, supported: Column, agreeing: Column) -> DataFrame:
    """Edges by chromosome and relation: all, those whose reads show the relation, and those that
    are left once divergent ones must also lie on one haplotype."""
    shown = F.coalesce(supported, F.lit(False))
    agreed = shown & ((F.col("relation") != "divergent") | F.coalesce(agreeing, F.lit(False)))
    return edges.groupBy("chrom", "relation").agg(
        F.count(F.lit(1)).alias("inferred"), F.count_if(shown).alias("supported"), F.count_if(agreed).alias("same_haplotype")
    )


def size_histogram(members: DataFrame, keys: list[str], size: str = "sites") -> DataFrame:
    """How many groups there are of each size; ``keys`` name a group of ``members``, the first of
    them the chromosome."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    return sizes.groupBy(keys[0], size).agg(F.count(F.lit(1)).alias("groups"))
