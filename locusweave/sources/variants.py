"""Variant, region and pileup files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.operators.observations import allele_of, phred_error
from locusweave.sources.delivered_lines import parse_pileup

_FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")
_ONE_BASE = r"^[ACGTNacgtn]$"


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """The records of variant files (plain or gzip): the eight fixed columns and, as they stand,
    ``format`` and the array ``samples``. Header lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(r"\S"))
    f = F.split("value", "\t")
    named = [F.get(f, F.lit(i)).alias(n) for i, n in enumerate(_FIXED)]
    rest = F.when(F.size(f) > 9, F.slice(f, 10, F.size(f))).otherwise(F.array().cast("array<string>"))
    return lines.select(*named, F.get(f, F.lit(8)).alias("format"), rest.alias("samples")).withColumn("pos", F.col("pos").cast("bigint"))


def sample_names(spark: SparkSession, path: str) -> DataFrame:
    """``sample, place``: the names in the header, with their place in ``samples``."""
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM"))
    f = F.split("value", "\t")
    return header.select(F.posexplode(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0)))).alias("place", "sample")).distinct()


def passes(records: DataFrame) -> DataFrame:
    """Only PASS records, if any record says PASS at all; else all of them."""
    says = F.array_contains(F.split(F.lower("filter"), ";"), "pass")
    any_says = records.agg(F.max(says).alias("any")).scalar()
    return records.where(says | ~F.coalesce(any_says, F.lit(False)))


def somatic_sites(records: DataFrame) -> DataFrame:
    """``chrom, pos, ref, alt`` of single-base records: the first ALT counts."""
    alt = F.split("alt", ",")[0]
    kept = records.where(F.col("ref").rlike(_ONE_BASE) & alt.rlike(_ONE_BASE))
    return kept.select("chrom", "pos", F.upper("ref").alias("ref"), F.upper(alt).alias("alt"))


def phased_markers(records: DataFrame, place: int = 0) -> DataFrame:
    """``chrom, pos, ref, alt, alt_haplotype`` of biallelic single-base records whose genotype at
    ``place`` is phased and heterozygous: ALT lies on haplotype 1 if the first allele is 1. Further
    alleles of a polyploid genotype are not looked at."""
    at = F.array_position(F.split("format", ":"), "GT") - 1
    genotype = F.get(F.split(F.get("samples", F.lit(place)), ":"), at.cast("int"))
    single = F.col("ref").rlike(_ONE_BASE) & F.col("alt").rlike(r"^[ACGTNacgtn]$") & (F.upper("ref") != F.upper("alt"))
    kept = records.where(single & (at >= 0)).withColumn("gt", genotype).where(F.col("gt").rlike(r"^(?:0\|1|1\|0)"))
    hap = F.when(F.col("gt").startswith("1"), 1).otherwise(2)
    return kept.select("chrom", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), hap.alias("alt_haplotype"))


def read_regions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``chrom, start_pos, end_pos`` of region files: fields lie between blanks of any kind; blank
    and comment lines and lines without whole numbers are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S") & ~F.ltrim("value").startswith("#"))
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.select(f[0].alias("chrom"), F.get(f, F.lit(1)).try_cast("bigint").alias("start_pos"), F.get(f, F.lit(2)).try_cast("bigint").alias("end_pos"))
    return rows.where("start_pos is not null and end_pos is not null")


def kept_alignments(alignments: DataFrame, least_mapq: int = 20) -> DataFrame:
    """Alignments that are mapped and primary or supplementary, of at least this mapping quality."""
    return alignments.where((F.col("flag").bitwiseAND(260) == 0) & (F.col("mapq") >= least_mapq))


def pileup_observations(raw: DataFrame, sites: DataFrame, chrom: Column) -> DataFrame:
    """Observations (``chrom, bam, read_id, pos, allele, error``) from the pileup lines that load,
    at the given sites. Alleles other than REF and ALT are 2."""
    loaded = parse_pileup(raw).where("reason is null").select(F.col("row.chrom").alias("chrom"), F.col("row.pos").cast("bigint").alias("pos"), F.posexplode("row.inputs").alias("bam", "i"))
    place = F.sequence(F.lit(0), F.col("i.depth") - 1)
    reads = loaded.where("i.depth > 0").select(chrom.alias("chrom"), "bam", "pos", "i", F.explode(place).alias("k"))
    at = F.col("k") + 1
    calls = reads.select("chrom", "bam", "pos", F.get("i.names", F.col("k")).alias("read_id"), F.substring("i.symbols", at, F.lit(1)).alias("base"), (F.ascii(F.substring("i.quals", at, F.lit(1))) - 33).alias("q"))
    joined = calls.join(sites.select("chrom", "pos", "ref", "alt"), ["chrom", "pos"])
    allele = F.coalesce(allele_of(F.col("base"), F.col("ref"), F.col("alt")), F.lit(2))
    return joined.select("chrom", "bam", "read_id", "pos", allele.alias("allele"), phred_error(F.col("q")).alias("error"))
