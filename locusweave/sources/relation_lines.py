"""Relation files: one pair of sites per line, its figures as ``KEY=value`` tokens between blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.acceptance import CARRIED

#: Fixed values of the format: the keys of both sites, and of the pair.
SITE_KEYS = {"VAF": "vaf", "HVAF": "hvaf", "HAP": "hap", "HP_READS": "hp_reads"}
PAIR_KEYS = {"RELIABILITY": "reliability", "BEST_SCORE": "best_score", "MARGIN": "margin"}
COUNT_KEYS = ("ALT_ALT", "ALT_REF", "REF_ALT", "REF_REF")
ORDERED = ("left_before_right", "right_before_left")
_MISSING = ("", "NA", "NAN", "NULL", ".")


def edges_of_lines(lines: DataFrame, line: str, relation: Column) -> DataFrame:
    """Edges from the lines of relation files: ``chrom, u, v, relation`` and the figures.

    ``relation`` names what a line's file holds: ``cooccurring``, ``divergent``, or one of the two
    ordered relations, which become ``timing`` edges from the earlier to the later site. Missing
    counts and VAFs are zero; missing haplotype VAFs and labels are null; unknown keys are passed
    over, and of a repeated key the last counts. Null and blank lines, and lines without a
    chromosome and two whole positions, give no row.
    """
    kept = lines.select(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")).alias("__line"), relation.alias("__relation"))
    tokens = F.split("__line", " ")
    pairs = F.filter(F.slice(tokens, 4, F.greatest(F.size(tokens) - 3, F.lit(0))), lambda t: F.instr(t, "=") > 0)
    cut = kept.select(
        F.get(tokens, F.lit(0)).alias("chrom"),
        F.get(tokens, F.lit(1)).try_cast("bigint").alias("__1"),
        F.get(tokens, F.lit(2)).try_cast("bigint").alias("__2"),
        "__relation",
        pairs.alias("__pairs"),
    ).where("chrom <> '' and __1 is not null and __2 is not null")

    def value(key: str) -> Column:
        found = F.filter("__pairs", lambda t: F.startswith(t, F.lit(f"{key}=")))
        last = F.try_element_at(found, F.lit(-1))
        return F.substring(last, F.lit(len(key) + 2), F.length(last))

    def number(key: str) -> Column:
        text = value(key)
        return F.when(~F.upper(text).isin(*_MISSING), text.try_cast("double"))

    turned = F.col("__relation") == ORDERED[1]
    sides = {}
    for key, name in SITE_KEYS.items():
        read = number if key.endswith("VAF") else value
        one, two = read(f"{key}1"), read(f"{key}2")
        if read is value:
            one, two = (F.when(~F.upper(x).isin(*_MISSING), x) for x in (one, two))
        if key == "VAF":
            one, two = F.coalesce(one, F.lit(0.0)), F.coalesce(two, F.lit(0.0))
        sides[f"{name}_u"] = F.when(turned, two).otherwise(one)
        sides[f"{name}_v"] = F.when(turned, one).otherwise(two)
    count = {k: F.coalesce(value(k).try_cast("bigint"), F.lit(0).cast("bigint")) for k in COUNT_KEYS}
    return cut.select(
        "chrom",
        F.when(turned, F.col("__2")).otherwise(F.col("__1")).alias("u"),
        F.when(turned, F.col("__1")).otherwise(F.col("__2")).alias("v"),
        F.when(F.col("__relation").isin(*ORDERED), "timing").otherwise(F.col("__relation")).alias("relation"),
        *(F.coalesce(number(k), F.lit(0.0)).alias(n) for k, n in PAIR_KEYS.items()),
        count["ALT_ALT"].alias("alt_alt"),
        F.when(turned, count["REF_ALT"]).otherwise(count["ALT_REF"]).alias("alt_ref"),
        F.when(turned, count["ALT_REF"]).otherwise(count["REF_ALT"]).alias("ref_alt"),
        count["REF_REF"].alias("ref_ref"),
        *(c.alias(n) for n, c in sides.items()),
    )


def relation_of_edge() -> Column:
    """The relation of an edge as relation files name it: a timing edge points left to right or right
    to left."""
    ordered = F.when(F.col("u") <= F.col("v"), ORDERED[0]).otherwise(ORDERED[1])
    return F.when(F.col("relation") == "timing", ordered).otherwise(F.col("relation"))


def line_of_edge() -> Column:
    """The line of an edge, lower position first for an ordered pair. Nulls read ``NA``."""
    turned = relation_of_edge() == ORDERED[1]
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    token = lambda key, c: F.concat(F.lit(f"{key}="), F.coalesce(c.cast("string"), F.lit("NA")))
    counts = {
        "ALT_ALT": F.col("alt_alt"),
        "ALT_REF": pick("alt_ref", "ref_alt"),
        "REF_ALT": pick("ref_alt", "alt_ref"),
        "REF_REF": F.col("ref_ref"),
    }
    total = F.col("alt_alt") + F.col("alt_ref") + F.col("ref_alt") + F.col("ref_ref")
    return F.concat_ws(
        " ",
        "chrom",
        pick("u", "v"),
        pick("v", "u"),
        token("VAF1", pick("vaf_u", "vaf_v")),
        token("VAF2", pick("vaf_v", "vaf_u")),
        token("HVAF1", pick("hvaf_u", "hvaf_v")),
        token("HVAF2", pick("hvaf_v", "hvaf_u")),
        token("HAP1", pick("hap_u", "hap_v")),
        token("HAP2", pick("hap_v", "hap_u")),
        token("HP_READS1", pick("hp_reads_u", "hp_reads_v")),
        token("HP_READS2", pick("hp_reads_v", "hp_reads_u")),
        *(token(k, c) for k, c in counts.items()),
        token("TOTAL", total),
        token("RELIABILITY", F.col("reliability")),
        token("BEST_SCORE", F.col("best_score")),
        token("MARGIN", F.col("margin")),
    )


def with_carried(edges: DataFrame) -> DataFrame:
    """``edges`` with the columns of :data:`CARRIED`, null where they are missing."""
    return edges.withColumns({c: F.lit(None).cast("string") for c in CARRIED if c not in edges.columns})


def write_relation_files(edges: DataFrame, path: str) -> None:
    """One folder of lines per relation, ``file=<relation>`` below ``path``; overwrites."""
    with_carried(edges).select(relation_of_edge().alias("file"), line_of_edge().alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def read_relation_files(spark, path: str) -> DataFrame:
    """The edges of what :func:`write_relation_files` wrote, or of files laid out the same way."""
    return edges_of_lines(spark.read.text(path), "value", F.col("file"))
