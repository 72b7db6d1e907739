"""From delivered observations to resolved calls, read haplotypes, and site summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
ERROR_FLOOR, ERROR_CEILING = 0.01, 0.49
MINOR_PERCENT = 15
READ_VOTES, SITE_READS = 2, 1
MORE_ALT_READS, MORE_ALT_PERCENT = 3, 8


def phred_error(quality: Column) -> Column:
    """Error probability of a phred score, kept between floor and ceiling."""
    return F.least(F.lit(ERROR_CEILING), F.greatest(F.lit(ERROR_FLOOR), F.pow(F.lit(10.0), -F.greatest(quality, F.lit(0)) / F.lit(10.0))))


def allele_of(base: Column, ref: Column, alt: Column) -> Column:
    """0 for REF (also written ``.`` and ``,``), 1 for ALT, null for another base; REF goes first."""
    symbol = F.upper(base)
    return F.when(base.isin(".", ",") | (symbol == F.upper(ref)), 0).when(symbol == F.upper(alt), 1)


def resolve(observations: DataFrame, read: list[str]) -> DataFrame:
    """One call per read and site: ``read``, ``pos``, ``allele``, ``error``.

    Rows with a null in the read's key or ``pos`` and alleles other than 0 and 1 are left out. Calls
    sent again count once, with their smallest error (null errors give way to known ones; a call
    without any is as uncertain as possible). A read that contradicts itself has no call.
    """
    usable = observations.where(F.col("allele").isin(0, 1)).dropna(subset=[*read, "pos"])
    error = F.coalesce(F.min(F.when(~F.isnan("error"), F.col("error"))), F.lit(ERROR_CEILING))
    return (
        usable.groupBy(*read, "pos")
        .agg(F.min("allele").alias("allele"), F.max("allele").alias("__high"), error.alias("error"))
        .where(F.col("allele") == F.col("__high"))
        .select(*read, "pos", "allele", F.least(F.lit(ERROR_CEILING), F.greatest(F.lit(ERROR_FLOOR), F.col("error"))).alias("error"))
    )


def observation_statistics(observations: DataFrame, read: list[str]) -> DataFrame:
    """One row per ``chrom``: rows, usable rows, other bases, resent rows, contradicting calls."""
    keyed = observations.dropna(subset=[*read, "pos", "allele"])
    usable = F.col("allele").isin(0, 1)
    calls = keyed.groupBy(*read, "pos").agg(
        F.count_if(usable).alias("used"),
        F.count_if(~usable).alias("other"),
        (F.min(F.when(usable, F.col("allele"))) != F.max(F.when(usable, F.col("allele")))).alias("contradicts"),
    )
    return calls.groupBy("chrom").agg(
        F.sum(F.col("used") + F.col("other")).alias("n_rows"),
        F.sum("used").alias("usable"),
        F.sum("other").alias("non_ref_alt"),
        F.sum(F.greatest(F.col("used") - 1, F.lit(0))).alias("resent"),
        F.count_if("contradicts").alias("contradicting"),
        F.count_if((F.col("used") > 0) & ~F.coalesce("contradicts", F.lit(False))).alias("calls"),
    )


def haplotype(hp1: Column, hp2: Column, least: int, none: str) -> Column:
    """The haplotype that ``hp1`` and ``hp2`` votes name: ``none`` below ``least`` votes, MIXED if
    the minority is above 15 % or the votes are even."""
    minor, total = F.least(hp1, hp2), hp1 + hp2
    return (
        F.when(total < least, none)
        .when((100 * minor > MINOR_PERCENT * total) | (hp1 == hp2), "MIXED")
        .when(hp1 > hp2, "HP1")
        .otherwise("HP2")
    )


def read_votes(candidate_reads: DataFrame, marker_calls: DataFrame, read: list[str]) -> DataFrame:
    """``read``, ``hp1``, ``hp2``, ``assignment`` of each candidate read; reads without any marker
    are UNASSIGNED with no votes. ``marker_calls`` carry ``is_hp1`` (0 or 1)."""
    votes = (
        marker_calls.join(candidate_reads, read, "left_semi")
        .groupBy(*read)
        .agg(F.count_if(F.col("is_hp1") == 1).alias("hp1"), F.count_if(F.col("is_hp1") == 0).alias("hp2"))
    )
    filled = candidate_reads.select(*read).distinct().join(votes, read, "left").na.fill(0, ["hp1", "hp2"])
    return filled.withColumn("assignment", haplotype(F.col("hp1"), F.col("hp2"), READ_VOTES, "UNASSIGNED"))


def assignment_totals(votes: DataFrame) -> DataFrame:
    """Reads per chromosome and assignment."""
    return votes.groupBy("chrom", "assignment").agg(F.count(F.lit(1)).alias("reads"))


def site_summary(calls: DataFrame, votes: DataFrame, read: list[str]) -> DataFrame:
    """Per site: distinct reads (other bases included), REF and ALT reads by haplotype, the site's
    label and its haplotypes' ALT shares. ``calls`` have ``read``, ``pos`` and ``allele`` (0, 1, or
    another value or null for another base); a read counts once per site, by its largest allele."""
    known = F.when(F.col("allele").isin(0, 1), F.col("allele"))
    once = calls.groupBy(*read, "pos").agg(F.max(known).alias("allele"))
    hp = F.when(F.col("assignment").isin("HP1", "HP2"), F.col("assignment")).otherwise("none")
    tagged = once.join(votes.select(*read, "assignment"), read, "left").withColumn("hp", F.coalesce(hp, F.lit("none")))
    counts = [
        F.count_if((F.col("hp") == h) & (F.col("allele") == a)).alias(f"{n}_{k}")
        for h, n in (("HP1", "hp1"), ("HP2", "hp2"), ("none", "untagged"))
        for k, a in (("ref", 0), ("alt", 1))
    ]
    summed = tagged.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("total_coverage"), *counts)
    share = lambda h: F.try_divide(F.col(f"{h}_alt"), F.col(f"{h}_alt") + F.col(f"{h}_ref")).cast("float")
    return (
        summed.withColumn("label", haplotype(F.col("hp1_alt"), F.col("hp2_alt"), SITE_READS, "UNKNOWN"))
        .withColumn("alt_reads", F.col("hp1_alt") + F.col("hp2_alt") + F.col("untagged_alt"))
        .withColumn("ref_reads", F.col("hp1_ref") + F.col("hp2_ref") + F.col("untagged_ref"))
        .withColumns({f"{h}_vaf": F.when(share(h).isNull(), "NA").otherwise(F.format_string("%.6f", share(h))) for h in ("hp1", "hp2")})
    )


def supported(summary: DataFrame) -> DataFrame:
    """Sites with more than 3 ALT reads or an ALT share above 8 % (strictly, in whole numbers)."""
    alt, depth = F.col("alt_reads"), F.col("alt_reads") + F.col("ref_reads")
    return summary.where((alt > MORE_ALT_READS) | ((depth > 0) & (100 * alt > MORE_ALT_PERCENT * depth)))


def clean_sites(sites: DataFrame, chrom: Column) -> DataFrame:
    """One row per position: canonical chromosome, first base of REF and of the first ALT, upper
    case. Rows without position or ALT are left out; of a position listed twice with different
    alleles the alphabetically last ALT stays."""
    ref = F.upper(F.substring(F.trim("ref"), 1, 1))
    alt = F.upper(F.substring(F.trim(F.split("alt", ",")[0]), 1, 1))
    tidy = sites.select(chrom.alias("chrom"), F.col("pos"), ref.alias("ref"), alt.alias("alt"))
    named = tidy.where("chrom is not null and pos is not null and alt <> ''")
    return named.groupBy("chrom", "pos").agg(F.max(F.struct("alt", "ref")).alias("s")).select("chrom", "pos", "s.ref", "s.alt")


def outside_regions(sites: DataFrame, regions: DataFrame, bits: int = 14) -> DataFrame:
    """Sites that lie in none of the half-open regions ``chrom, start_pos, end_pos`` (0-based).

    ``regions`` are disjoint per chromosome (merge them first), so each site is inside at most one.
    Both sides are cut into bins of ``2**bits`` positions and joined on chromosome and bin; a region
    takes part in every bin it touches. Sites at null positions are kept.
    """
    at = F.col("pos") - 1
    bins = F.sequence(F.shiftright("start_pos", bits), F.shiftright(F.col("end_pos") - 1, bits))
    cut = regions.where("start_pos >= 0 and end_pos > start_pos").select(
        F.col("chrom").alias("__chrom"), F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"), F.explode(bins).alias("__bin")
    )
    inside = (F.col("chrom") == F.col("__chrom")) & (F.shiftright(at, bits) == F.col("__bin")) & (at >= F.col("__s")) & (at < F.col("__e"))
    return sites.join(cut, inside, "left_anti")
