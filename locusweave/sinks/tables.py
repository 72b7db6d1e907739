"""Result tables as files: tab-separated values, edge lines, and graphs as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.sources.relation_lines import with_carried


def write_tsv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Tab-separated with a header; missing values read ``NA``. Overwrites what is there."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path, sep="\t", header=True, nullValue="NA", emptyValue="")


def edge_line(reason: Column | None = None) -> Column:
    """One text line per edge: its ends, relation and figures and, for rejected ones, why. Missing
    haplotype reads are ``UNKNOWN``, other missing figures ``NA``."""
    token = lambda key, c, missing="NA": F.concat(F.lit(f"{key}="), F.coalesce(c.cast("string"), F.lit(missing)))
    counts = ("alt_alt", "alt_ref", "ref_alt", "ref_ref")
    parts = [F.col("chrom"), F.col("u"), F.col("v"), token("RELATION", F.col("relation")), token("VAF1", F.col("vaf_u")), token("VAF2", F.col("vaf_v"))]
    parts += [token(c.upper(), F.col(c)) for c in counts]
    parts.append(token("TOTAL", F.col(counts[0]) + F.col(counts[1]) + F.col(counts[2]) + F.col(counts[3])))
    parts += [token(f"HP_READS{k}", F.col(f"hp_reads_{end}"), "UNKNOWN") for k, end in ((1, "u"), (2, "v"))]
    parts += [token(c.upper(), F.col(c)) for c in ("reliability", "best_score", "margin")]
    if reason is not None:
        parts.append(token("REASON", reason))
    return F.concat_ws(" ", *parts)


def write_edge_lines(edges: DataFrame, path: str, with_reason: bool = False) -> None:
    """Edge lines in the order of the decision within each chromosome's components; overwrites."""
    known = with_carried(edges).withColumns({c: F.lit(None).cast("double") for c in ("vaf_u", "vaf_v") if c not in edges.columns})
    order = [c for c in ("chrom", "component", "accept_order", "u", "v") if c in edges.columns]
    lines = known.orderBy(*order).select(edge_line(F.col("reason") if with_reason else None).alias("value"))
    lines.write.mode("overwrite").text(path)


def _object(df: DataFrame, fields: dict[str, Column]) -> Column:
    """The JSON object of those fields whose columns ``df`` has; nulls are left out."""
    return F.struct(*(c.alias(name) for name, c in fields.items() if name in df.columns or name in _DERIVED))


#: Fields that are made of other columns.
_DERIVED = {"id", "position", "source", "target", "directed", "read_counts", "label"}


def graph_elements(nodes: DataFrame, edges: DataFrame, scope: str = "") -> DataFrame:
    """``chrom, element`` with one JSON object per node and edge, ready for a graph viewer.

    ``nodes`` have ``chrom, pos`` and any of the further fields of a node, and ``x`` and ``y`` if
    they are placed; ``edges`` have ``chrom, u, v, relation, reliability`` and any further fields of
    an edge. ``scope`` goes before all names (an SQL expression, as for graphs of several
    chromosomes). Numbers that serve as names are strings; a graph is as many lines as it has
    elements, so no task ever holds a whole one.
    """
    name = lambda *c: F.concat(F.expr(scope), F.lit(":"), *c) if scope else F.concat(*c)
    text = lambda c: F.col(c).cast("string")
    own = {"id": name(text("pos")), "position": text("pos"), "chrom": F.col("chrom")}
    plain = (
        "vaf hvaf haplotype hp_reads cn_hp1 cn_hp2 component_id cooc_cluster_id component_rank component_timing_edges component_total_edges"
    ).split()
    node = [_object(nodes, own | {c: F.col(c) for c in plain}).alias("data")]
    if {"x", "y"} <= set(nodes.columns):
        node.append(F.struct("x", "y").alias("position"))
    tail = [F.lit("-"), F.col("accept_order").cast("string")] if "accept_order" in edges.columns else []
    counts = F.concat_ws("/", *(c for c in ("alt_alt", "alt_ref", "ref_alt", "ref_ref") if c in edges.columns))
    fields = {
        "id": name(text("u"), F.lit("-"), text("v"), F.lit("-"), F.col("relation"), *tail),
        "source": name(text("u")),
        "target": name(text("v")),
        "relation": F.col("relation"),
        "rejected_relation": F.col("rejected_relation"),
        "rejection_reason": F.col("rejection_reason"),
        "reliability": F.col("reliability"),
        "directed": F.col("relation") == "timing",
        "inferred": F.col("inferred"),
        "read_counts": F.when(counts != "", counts),
        "label": F.when(counts != "", F.concat(counts, F.format_string(" | rel=%.3f", F.col("reliability")))),
    }
    kept = {k: c for k, c in fields.items() if k in edges.columns or k in _DERIVED}
    edge = F.struct(F.struct(*(c.alias(k) for k, c in kept.items())).alias("data"))
    return nodes.select("chrom", F.to_json(F.struct(*node)).alias("element")).unionByName(edges.select("chrom", F.to_json(edge).alias("element")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, scope: str = "", by: str = "chrom") -> None:
    """A folder of JSON lines per value of ``by``; overwrites, so that none of an earlier run stay."""
    graph_elements(nodes, edges, scope).write.mode("overwrite").partitionBy(by).text(path)
