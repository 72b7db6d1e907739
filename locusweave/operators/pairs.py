"""Read support of site pairs, and the gates that pairs and calls pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
RELATIONS = ("cooccurring", "left_before_right", "right_before_left", "divergent")
LEAST_INFORMATIVE, LEAST_ALT_ALT = 3, 2
LARGEST_GAP = 1400.0


def together(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal ``keys``, by a sort-merge join that spills and that adaptive
    execution splits where a key is hot. The keys' hash leads: rows are sorted by one number, and
    compared in full only where it is equal. Columns other than the keys must differ."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        # Both sides are written alike, so that Spark sees where they are the same and shuffles once.
        return df.select(*(F.col(c).alias(f"{mark}{c}" if c in keys else c) for c in df.columns))

    same = F.xxhash64(*(f"__1{k}" for k in keys)) == F.xxhash64(*(f"__2{k}" for k in keys))
    for k in keys:
        same = same & (F.col(f"__1{k}") == F.col(f"__2{k}"))
    met = side(one, "__1").join(side(two, "__2").hint("merge"), same)
    return met.drop(*(f"__2{k}" for k in keys)).withColumnsRenamed({f"__1{k}": k for k in keys})


def pair_candidates(resolved: DataFrame, read: list[str]) -> DataFrame:
    """``chrom, left_pos, right_pos`` with the four counts over the reads that cover both sites.

    One equi-join of the reads with themselves; counts combine map-side. Pairs with fewer than two
    informative reads (anything but REF at both sites) are left out, as they cannot be eligible.
    """
    one = resolved.select(*read, F.col("pos").alias("left_pos"), F.col("allele").alias("l"))
    two = resolved.select(*read, F.col("pos").alias("right_pos"), F.col("allele").alias("r"))
    both = together(one, two, read).where("left_pos < right_pos")
    code = 2 * (1 - F.col("l")) + 1 - F.col("r")
    counts = [F.count_if(code == k).alias(n) for k, n in enumerate(("alt_alt", "alt_ref", "ref_alt", "ref_ref"))]
    counted = both.groupBy("chrom", "left_pos", "right_pos").agg(*counts)
    return counted.where(informative() >= min(LEAST_INFORMATIVE, LEAST_ALT_ALT))


def informative() -> Column:
    return F.col("alt_alt") + F.col("alt_ref") + F.col("ref_alt")


def eligible(pairs: DataFrame) -> DataFrame:
    """Pairs with enough reads for a relation to be inferred."""
    return pairs.where((informative() >= LEAST_INFORMATIVE) | (F.col("alt_alt") >= LEAST_ALT_ALT))


def clean_candidates(candidates: DataFrame, chrom: Column) -> DataFrame:
    """An earlier run's pair counts, put right: canonical chromosome, positions in order (with the
    one-sided counts exchanged along), the newest row of each pair, rows with nulls left out."""
    swap = F.col("left_pos") > F.col("right_pos")
    put = candidates.select(
        chrom.alias("chrom"),
        F.least("left_pos", "right_pos").alias("left_pos"),
        F.greatest("left_pos", "right_pos").alias("right_pos"),
        F.col("alt_alt"),
        F.when(swap, F.col("ref_alt")).otherwise(F.col("alt_ref")).alias("alt_ref"),
        F.when(swap, F.col("alt_ref")).otherwise(F.col("ref_alt")).alias("ref_alt"),
        F.col("ref_ref"),
        F.col("loaded_at"),
    )
    kept = put.dropna(subset=["chrom", "alt_alt", "alt_ref", "ref_alt", "ref_ref"]).where("left_pos < right_pos")
    last = F.max(F.struct("loaded_at", "alt_alt", "alt_ref", "ref_alt", "ref_ref")).alias("s")
    return kept.groupBy("chrom", "left_pos", "right_pos").agg(last).select("chrom", "left_pos", "right_pos", "s.alt_alt", "s.alt_ref", "s.ref_alt", "s.ref_ref")


def supports(relation: Column) -> Column:
    """Whether the reads of a pair show what ``relation`` claims."""
    aa, ar, ra = (F.col(c) >= 1 for c in ("alt_alt", "alt_ref", "ref_alt"))
    return (
        F.when(relation == "cooccurring", aa)
        .when(relation == "left_before_right", aa & ar)
        .when(relation == "right_before_left", aa & ra)
        .when(relation == "divergent", ar & ra)
        .otherwise(False)
    )


def same_haplotype(left: str, right: str) -> Column:
    """Whether both labels are the same of HP1 and HP2."""
    return F.coalesce((F.col(left) == F.col(right)) & F.col(left).isin("HP1", "HP2"), F.lit(False))


def same_haplotype_gate(calls: DataFrame, labels: DataFrame) -> DataFrame:
    """Drops divergent calls unless both sites carry the same of HP1 and HP2. ``labels`` has
    ``chrom, pos, label``; a site without a row has no label."""
    left = labels.select("chrom", F.col("pos").alias("left_pos"), F.col("label").alias("left_label"))
    right = labels.select("chrom", F.col("pos").alias("right_pos"), F.col("label").alias("right_label"))
    both = calls.join(left, ["chrom", "left_pos"], "left").join(right, ["chrom", "right_pos"], "left")
    return both.where((F.col("relation") != "divergent") | same_haplotype("left_label", "right_label"))


def margin(bics: Column) -> Column:
    """Half the gap between the two lowest of an array of BICs; null if there are fewer than two."""
    ranked = F.array_sort(bics)
    return F.greatest(F.lit(0.0), F.get(ranked, F.lit(1)) - F.get(ranked, F.lit(0))) / 2


def probabilities(bics: Column) -> Column:
    """Relative weights of the models behind an array of BICs, summing to one."""
    least = F.array_min(bics)
    weights = F.transform(bics, lambda b: F.exp(-F.least(F.lit(LARGEST_GAP), b - least) / 2))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))
