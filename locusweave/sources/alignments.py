"""Observations from alignments: which base each read shows at each site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.observations import allele_of, phred_error

BITS = 14
_STEP = r"([0-9]+)([MIDNSHP=X])"


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    """The stretches of a read that lie on the reference without a break: an array of
    ``<first, last, offset>``, first and last position on the reference and the place in the read
    of the first base. Null or ``*`` as cigar gives no stretch."""
    sizes = F.transform(F.regexp_extract_all(cigar, F.lit(_STEP), F.lit(1)), lambda n: n.cast("bigint"))
    steps = F.arrays_zip(sizes.alias("n"), F.regexp_extract_all(cigar, F.lit(_STEP), F.lit(2)).alias("op"))
    block = "array<struct<first:bigint,last:bigint,offset:bigint>>"
    start = F.struct(pos.cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("read"), F.array().cast(block).alias("blocks"))

    def walk(state: Column, step: Column) -> Column:
        n, op = step["n"], step["op"]
        on_both = op.isin("M", "=", "X")
        here = F.struct(state["at"].alias("first"), (state["at"] + n - 1).alias("last"), state["read"].alias("offset"))
        return F.struct(
            (state["at"] + F.when(on_both | op.isin("D", "N"), n).otherwise(0)).alias("at"),
            (state["read"] + F.when(on_both | op.isin("I", "S"), n).otherwise(0)).alias("read"),
            F.when(on_both & (n > 0), F.concat(state["blocks"], F.array(here))).otherwise(state["blocks"]).alias("blocks"),
        )

    return F.aggregate(steps, start, walk, lambda s: s["blocks"])


def alignment_observations(alignments: DataFrame, sites: DataFrame) -> DataFrame:
    """``chrom, bam, read_id, pos, allele, error`` of every alignment at every site that one of its
    bases lies on; alleles other than REF and ALT are 2.

    ``alignments`` has ``chrom, bam, read_id, pos`` (1-based), ``cigar, seq, qual`` (null or ``*``
    where there are no qualities: such calls are as uncertain as possible); every row is an
    observation of its own. ``sites`` has ``chrom, pos, ref, alt``, one row per position. Alignments
    without position, cigar or sequence, and deleted or skipped positions, give no row.

    Both sides meet in bins of ``2**BITS`` positions, so a site that very many reads cover is a hot
    key on one side only, which adaptive execution splits.
    """
    blocks = alignments.where(F.col("seq") != "*").select("chrom", "bam", "read_id", "seq", "qual", F.explode(aligned_blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    bins = F.sequence(F.shiftright("b.first", BITS), F.shiftright("b.last", BITS))
    spread = blocks.withColumn("__bin", F.explode(bins))
    marks = sites.select("chrom", "pos", "ref", "alt", F.shiftright("pos", BITS).alias("__bin"))
    met = spread.join(marks, ["chrom", "__bin"]).where((F.col("pos") >= F.col("b.first")) & (F.col("pos") <= F.col("b.last")))
    place = (F.col("b.offset") + F.col("pos") - F.col("b.first")).cast("int")
    base, letter = F.substring("seq", place, F.lit(1)), F.substring("qual", place, F.lit(1))
    score = F.when((F.col("qual") == "*") | F.col("qual").isNull() | (letter == ""), 0).otherwise(F.ascii(letter) - 33)
    allele = F.coalesce(allele_of(base, F.col("ref"), F.col("alt")), F.lit(2))
    return met.where(base != "").select("chrom", "bam", "read_id", "pos", allele.alias("allele"), phred_error(score).alias("error"))
