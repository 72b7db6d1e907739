"""Reports over the decided graph: components, haplotype counters, connectivity, condensed view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.axis import ranked
from locusweave.operators.components import components

RELATIONS = ("cooccurring", "timing", "divergent")


def read_support() -> Column:
    return F.col("alt_alt") + F.col("alt_ref") + F.col("ref_alt") + F.col("ref_ref")


def component_stats(accepted: DataFrame) -> DataFrame:
    """Per component of accepted edges: extent, sites, edges by relation, mean read support. The
    component is named by its first position."""
    found = components(accepted, ["chrom"], "u", "v")
    nodes = found.groupBy("chrom", "component").agg(
        F.min("vertex").alias("min_pos"), F.max("vertex").alias("max_pos"), F.count(F.lit(1)).alias("num_nodes")
    )
    counts = [F.count_if(F.col("relation") == r).alias(n) for r, n in zip(RELATIONS, ("cooccurrence_edges", "timing_edges", "divergent_edges"), strict=True)]
    edges = (
        accepted.select("chrom", "u", "relation", read_support().alias("__support"))
        .join(found.withColumnRenamed("vertex", "u"), ["chrom", "u"])
        .groupBy("chrom", "component")
        .agg(*counts, F.sum("__support").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    )
    return (
        nodes.join(edges, ["chrom", "component"])
        .withColumn("span_bp", F.col("max_pos") - F.col("min_pos"))
        .withColumn("avg_read_support", F.round(F.col("__sum") / F.col("__n"), 6))
        .drop("__sum", "__n")
    )


def haplotype_counters(edges: DataFrame) -> DataFrame:
    """Per chromosome and relation, and for the genome (null chromosome), how edges join
    haplotypes; anything but HP1 and HP2 is unknown. Relations without an edge have zeros."""
    hp = lambda c: F.when(F.col(c).isin("HP1", "HP2"), F.col(c)).otherwise("UNKNOWN")
    u, v = hp("hap_u"), hp("hap_v")
    unknown = (u == "UNKNOWN") | (v == "UNKNOWN")
    one = {
        "total": F.lit(True),
        "same_haplotype": ~unknown & (u == v),
        "different_haplotype": ~unknown & (u != v),
        "at_least_one_unknown": unknown,
        "hp1_hp1": (u == "HP1") & (v == "HP1"),
        "hp2_hp2": (u == "HP2") & (v == "HP2"),
    }
    tests = [F.count_if((F.col("relation") == r) & t).alias(f"{r}|{n}") for r in RELATIONS for n, t in one.items()]
    wide = edges.rollup("chrom").agg(*tests, F.grouping("chrom").alias("__all")).where("chrom is not null or __all = 1")
    per = F.array(*(F.struct(F.lit(r).alias("relation"), *(F.col(f"{r}|{n}").alias(n) for n in one)) for r in RELATIONS))
    return wide.select("chrom", F.explode(per).alias("c")).select("chrom", "c.*")


def connectivity(sites: DataFrame, proposed: DataFrame, decided: DataFrame) -> DataFrame:
    """Per chromosome, and for the genome (null chromosome): sites, those in any relation, in the graph, with a timing edge, orphaned
    (all edges rejected), without any relation, and accepted and timing edges."""
    ends = lambda df: df.select("chrom", F.explode(F.array("u", "v")).alias("pos")).distinct()
    accepted = decided.where("status = 'accepted'")
    timing = accepted.where("relation = 'timing'")
    parts = [
        (sites.select("chrom", "pos").distinct(), "total_sites"),
        (ends(proposed), "in_relations"),
        (ends(accepted), "in_graph"),
        (ends(timing), "with_timing"),
        (accepted.select("chrom"), "accepted_edges"),
        (timing.select("chrom"), "timing_edges"),
    ]
    names = [n for _, n in parts]
    stacked = None
    for df, name in parts:
        one = df.select("chrom", *((F.lit(1) if n == name else F.lit(0)).cast("bigint").alias(n) for n in names))
        stacked = one if stacked is None else stacked.unionByName(one)
    rolled = stacked.where("chrom is not null").rollup("chrom").agg(*(F.sum(n).alias(n) for n in names), F.grouping("chrom").alias("__all"))
    summed = rolled.where("chrom is not null or __all = 1").drop("__all")
    return summed.withColumn("orphaned", F.col("in_relations") - F.col("in_graph")).withColumn("singleton", F.col("total_sites") - F.col("in_relations"))


def site_annotations(edges: DataFrame) -> DataFrame:
    """``chrom, pos, vaf, hvaf, haplotype, hp_reads`` of each end of an edge: the first VAF and the
    first haplotype VAF that an edge gives, in the order of acceptance or, of edges without one, of
    the partner; its haplotype and haplotype reads, MIXED if edges disagree, UNKNOWN if none says."""
    has = lambda c: F.col(c) if c in edges.columns else F.lit(None).cast("string" if c[0:2] == "hp" else "double")

    def end(own: str, other: str):
        order = F.col("accept_order").cast("bigint") if "accept_order" in edges.columns else F.col(other)
        return F.struct(
            F.col(own).alias("pos"), order.alias("order"), has(f"vaf_{own}").alias("vaf"), has(f"hvaf_{own}").alias("hvaf"), F.col(f"hap_{own}").alias("hap"), has(f"hp_reads_{own}").alias("reads")
        )

    ends = edges.select("chrom", F.explode(F.array(end("u", "v"), end("v", "u"))).alias("e")).select("chrom", "e.*")
    first = lambda c: F.min(F.when(F.col(c).isNotNull() & ~F.isnan(c), F.struct("order", c)))[c].alias(c)
    said = lambda c, name: F.when(F.min(c) == F.max(c), F.min(c)).when(F.min(c).isNotNull(), "MIXED").otherwise("UNKNOWN").alias(name)
    return ends.groupBy("chrom", "pos").agg(first("vaf"), first("hvaf"), said("hap", "haplotype"), said("reads", "hp_reads"))


def exported_annotations(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """:func:`site_annotations` of the accepted edges, and for sites that only rejected edges touch,
    of those; a haplotype VAF that accepted edges do not give comes from rejected ones."""
    known, other = site_annotations(accepted), site_annotations(rejected)
    late = other.select("chrom", "pos", F.col("hvaf").alias("__late"))
    filled = known.join(late, ["chrom", "pos"], "left").withColumn("hvaf", F.coalesce("hvaf", "__late")).drop("__late")
    return filled.unionByName(other.join(known, ["chrom", "pos"], "left_anti"))


def condensed_nodes(clusters: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per cluster: size, lower median and first position, median VAF, majority haplotype
    (the alphabetically first among equals) and whether haplotypes mix.

    ``clusters`` has ``chrom, pos, cluster``. Medians are exact: of positions by their rank, of VAFs
    from counts per value, which are shares of small numbers of reads and so few."""
    placed = ranked(clusters.select("chrom", "cluster", "pos"), ["chrom", "cluster"], "pos")
    members = placed.join(annotations, ["chrom", "pos"], "left").withColumn("haplotype", F.coalesce("haplotype", F.lit("UNKNOWN")))
    hp = [F.count_if(F.col("haplotype") == h).alias(f"n_{h.lower()}") for h in ("HP1", "HP2", "MIXED", "UNKNOWN")]
    rows = members.groupBy("chrom", "cluster").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.min(F.when(F.col("rank") == F.floor((F.col("size") + 1) / 2), F.col("pos"))).alias("position"),
        F.min("pos").alias("position_min"),
        F.expr("percentile_cont(0.5) within group (order by vaf)").alias("vaf"),
        *hp,
    )
    tally = F.array(*(F.struct((-F.col(f"n_{h.lower()}")).alias("n"), F.lit(h).alias("h")) for h in ("HP1", "HP2", "MIXED", "UNKNOWN")))
    return (
        rows.withColumn("haplotype", F.array_min(tally)["h"])
        .withColumn("mixed_haplotypes", (F.col("n_mixed") > 0) | ((F.col("n_hp1") > 0) & (F.col("n_hp2") > 0)))
        .withColumn("vaf", F.round("vaf", 6))
        .withColumn("hp_counts", F.concat_ws("/", "n_hp1", "n_hp2", (F.col("cluster_size") - F.col("n_hp1") - F.col("n_hp2"))))
        .drop("n_hp1", "n_hp2", "n_mixed", "n_unknown")
    )


def condensed_edges(accepted: DataFrame) -> DataFrame:
    """Timing and divergent edges between clusters: summed counts, the highest reliability, how many
    edges stand behind each. ``accepted`` carries ``cluster_u`` and ``cluster_v``; timing keeps its
    direction, divergent edges start at the lower cluster."""
    between = accepted.where("relation <> 'cooccurring' and cluster_u <> cluster_v")
    turn = (F.col("relation") == "divergent") & (F.col("cluster_u") > F.col("cluster_v"))
    keyed = between.select(
        "chrom",
        F.when(turn, F.col("cluster_v")).otherwise(F.col("cluster_u")).alias("source"),
        F.when(turn, F.col("cluster_u")).otherwise(F.col("cluster_v")).alias("target"),
        "relation",
        "reliability",
        "alt_alt",
        F.when(turn, F.col("ref_alt")).otherwise(F.col("alt_ref")).alias("alt_ref"),
        F.when(turn, F.col("alt_ref")).otherwise(F.col("ref_alt")).alias("ref_alt"),
        "ref_ref",
    )
    return keyed.groupBy("chrom", "source", "target", "relation").agg(
        F.max("reliability").alias("reliability"),
        *(F.sum(c).alias(c) for c in ("alt_alt", "alt_ref", "ref_alt", "ref_ref")),
        F.count(F.lit(1)).alias("support_edge_count"),
    )


def support_details(accepted: DataFrame) -> DataFrame:
    """The accepted edges behind each condensed edge, one row each, under the condensed edge's
    ``source, target, relation``."""
    between = accepted.where("relation <> 'cooccurring' and cluster_u <> cluster_v")
    turn = (F.col("relation") == "divergent") & (F.col("cluster_u") > F.col("cluster_v"))
    return between.select(
        "chrom",
        F.when(turn, F.col("cluster_v")).otherwise(F.col("cluster_u")).alias("source"),
        F.when(turn, F.col("cluster_u")).otherwise(F.col("cluster_v")).alias("target"),
        "relation",
        "u",
        "v",
        F.concat_ws("/", "alt_alt", "alt_ref", "ref_alt", "ref_ref").alias("read_counts"),
        "reliability",
    )


def span_summary(stats: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per contig: components, mean and median span, mean sites, and the ten largest spans and
    sizes; contigs without components have zeros and empty lists."""
    tops = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, 10)
    # A chromosome's components are few against its sites; only the ten largest values are kept.
    grouped = stats.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("components"), F.avg("span_bp").alias("mean_span"), F.median("span_bp").alias("median_span"), F.avg("num_nodes").alias("mean_nodes")
    )
    for column, name in (("span_bp", "top_spans"), ("num_nodes", "top_nodes")):
        best = stats.withColumn("__r", F.row_number().over(Window.partitionBy("chrom").orderBy(F.desc(column), "component"))).where("__r <= 10")
        grouped = grouped.join(best.groupBy("chrom").agg(tops(column).alias(name)), "chrom")
    listed = contigs.select("chrom", "contig_order").join(grouped, "chrom", "left")
    none = F.array().cast("array<bigint>")
    return listed.select(
        "chrom",
        "contig_order",
        F.coalesce("components", F.lit(0)).alias("components"),
        *(F.round(F.coalesce(c, F.lit(0.0)), 1).alias(c) for c in ("mean_span", "median_span", "mean_nodes")),
        *(F.array_join(F.coalesce(F.col(c).cast("array<bigint>"), none), ",").alias(c) for c in ("top_spans", "top_nodes")),
    )
