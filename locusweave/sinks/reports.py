"""Result tables in the layout that their readers expect, and the condensed graph as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the headers of the site table and of the vote table.
SITE_COLUMNS = {
    "CHR": "chrom",
    "POSITION": "pos",
    "TOTAL_COVERAGE": "total_coverage",
    "HP1_SUPPORTING": "hp1_alt",
    "HP1_UNSUPPORTING": "hp1_ref",
    "HP2_SUPPORTING": "hp2_alt",
    "HP2_UNSUPPORTING": "hp2_ref",
    "UNKNOWN_SUPPORTING": "untagged_alt",
    "UNKNOWN_UNSUPPORTING": "untagged_ref",
    "HP1_HVAF": "hp1_vaf",
    "HP2_HVAF": "hp2_vaf",
    "HP_ASSIGNMENT": "label",
}
VOTE_COLUMNS = (
    "CHROM",
    "READ_NAME",
    "HP1_GERMLINE_VOTES",
    "HP2_GERMLINE_VOTES",
    "TOTAL_INFORMATIVE_GERMLINE_MUTATIONS",
    "MINORITY_FRACTION",
    "ASSIGNMENT",
)


def site_table(summary: DataFrame) -> DataFrame:
    """A site summary under the headers of the site table; other columns are left out."""
    return summary.select(*(F.col(c).alias(name) for name, c in SITE_COLUMNS.items()))


def vote_table(votes: DataFrame, read_name: str = "read_id") -> DataFrame:
    """Read votes under the headers of the vote table; the minority fraction of a read without
    votes is null (``NA`` in a file)."""
    total = F.col("hp1") + F.col("hp2")
    minority = F.round(F.try_divide(F.least("hp1", "hp2"), total), 6)
    columns = (F.col("chrom"), F.col(read_name), F.col("hp1"), F.col("hp2"), total, minority, F.col("assignment"))
    return votes.select(*(c.alias(name) for c, name in zip(columns, VOTE_COLUMNS, strict=True)))


def condensed_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``chrom, element``: one JSON object per cluster and per edge between clusters.

    Names and positions are strings, so that viewers do not round them. Members of a cluster and
    the edges behind a condensed edge are tables of their own (``chrom, pos, cluster`` and the
    accepted edges with their clusters): no row here grows with the size of a cluster.
    """
    text = lambda c, name: F.col(c).cast("string").alias(name)
    node = F.struct(
        F.struct(
            text("cluster", "id"),
            "cluster_size",
            "chrom",
            text("position", "position"),
            text("position_min", "position_min"),
            "vaf",
            "haplotype",
            "mixed_haplotypes",
            F.col("hp_counts").alias("hp_counts(hp1/hp2/unk)"),
        ).alias("data")
    )
    counts = F.concat_ws("/", "alt_alt", "alt_ref", "ref_alt", "ref_ref")
    label = F.format_string("%s | rel=%.3f | n=%d", counts, F.col("reliability"), F.col("support_edge_count"))
    edge = F.struct(
        F.struct(
            F.concat_ws("-", "source", "target", "relation").alias("id"),
            text("source", "source"),
            text("target", "target"),
            "relation",
            "reliability",
            (F.col("relation") == "timing").alias("directed"),
            counts.alias("read_counts"),
            label.alias("label"),
            "support_edge_count",
        ).alias("data")
    )
    return nodes.select("chrom", F.to_json(node).alias("element")).unionByName(edges.select("chrom", F.to_json(edge).alias("element")))


def write_condensed_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder of JSON lines per chromosome; overwrites."""
    condensed_elements(nodes, edges).write.mode("overwrite").partitionBy("chrom").text(path)
