"""Chromosome names. The reference data model has several normalisers that must not be unified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the mitochondrial chromosome.
MITOCHONDRIAL = ("M", "MT", "MITO")
BLANKS = " \t\n\x0b\f\r"


def bare_chrom(chrom: Column) -> Column:
    """Without surrounding blanks and without a leading ``chr`` of any case, in upper case."""
    name = F.upper(F.btrim(chrom, F.lit(BLANKS)))
    return F.when(name.startswith("CHR"), F.substring(name, 4, 2**31 - 1)).otherwise(name)


def canonical_chrom(chrom: Column) -> Column:
    """:func:`bare_chrom` with all mitochondrial spellings written ``MT``; null stays null."""
    bare = bare_chrom(chrom)
    return F.when(bare.isin(*MITOCHONDRIAL), F.lit("MT")).otherwise(bare)


def canonical_chrom_sql(column: str) -> str:
    """DuckDB's spelling of :func:`canonical_chrom`."""
    bare = rf"upper(regexp_replace(regexp_replace({column}, '^\s+|\s+$', '', 'g'), '^(?i:chr)', ''))"
    return f"CASE WHEN {bare} IN ('M', 'MT', 'MITO') THEN 'MT' ELSE {bare} END"


def is_standard(chrom: Column) -> Column:
    """Names that belong to the genome proper: 1 to 22, X, Y, M and MT, with or without ``chr``."""
    return chrom.rlike(r"^(?:chr)?(?:[1-9]|1[0-9]|2[0-2]|X|Y|M|MT)$")


def graph_sort_key(chrom: Column) -> Column:
    """Order of chromosomes in graph outputs: numbers, X, Y, M (and MT alike), then other names."""
    bare = bare_chrom(chrom)
    rank = (
        F.when(bare.rlike(r"^[0-9]+$"), bare.try_cast("int"))
        .when(bare == "X", 23)
        .when(bare == "Y", 24)
        .when(bare.isin("M", "MT"), 25)
        .otherwise(1000)
    )
    return F.struct(rank.alias("rank"), F.when(rank == 1000, bare).otherwise("").alias("name"))
