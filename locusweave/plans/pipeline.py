"""The whole computation composed: from observations and sites to graphs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.config import PhaseConfig
from locusweave.operators import acceptance, calls, chains, copy_number, graph_reports, layout, observations, pairs, simplify, tallies, trees, windows
from locusweave.operators.components import components
from locusweave.session import settle


def infer(config: PhaseConfig, obs: DataFrame, sites: DataFrame, read: list[str], markers: DataFrame | None = None, regions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Votes, site summaries, relationship calls and proposed edges.

    ``obs`` are observations with canonical chromosomes, ``sites`` the somatic sites, ``markers``
    marker calls with ``is_hp1`` and ``regions`` disjoint excluded regions, both optional.
    """
    wanted = sites.where(config.keeps(F.col("chrom"))).select("chrom", "pos").distinct()
    if regions is not None:
        wanted = observations.outside_regions(wanted, regions)
    held = obs.join(wanted, ["chrom", "pos"], "left_semi")
    reads = held.select(*read).distinct()
    none = reads.select(*read, F.lit(0).cast("bigint").alias("hp1"), F.lit(0).cast("bigint").alias("hp2"), F.lit("UNASSIGNED").alias("assignment"))
    votes = none if markers is None else observations.read_votes(reads, markers, read)
    summary = settle(observations.site_summary(held, votes, read))
    kept = observations.supported(summary)
    resolved = settle(observations.resolve(held.join(kept, ["chrom", "pos"], "left_semi"), read))
    eligible = settle(pairs.eligible(pairs.pair_candidates(resolved, read)))
    found_windows = settle(windows.all_windows(eligible, config.window_size, config.window_stride))
    fits = settle(trees.fit_windows(found_windows, windows.read_patterns(found_windows, resolved, read, config.error_digits)))
    called = settle(calls.relationship_calls(calls.results_of(eligible, found_windows, fits)))
    calls.check_calls(called)
    labels = kept.select("chrom", "pos", "label") if config.divergent_same_hp and markers is not None else None
    annotated = _annotated(calls.proposals(called, labels), kept)
    found = {"votes": votes, "sites": summary, "kept_sites": kept, "pairs": eligible, "calls": called, "proposals": annotated}
    found["windows"] = calls.window_table(found_windows, fits)
    found["window_opinions"] = calls.window_opinions(found_windows, fits, eligible)
    found["window_multiplicity"] = calls.multiplicity(found_windows, eligible)
    found["observation_statistics"] = observations.observation_statistics(held, read)
    found["label_tally"] = tallies.label_tally(kept, F.col("label"))
    found["vote_totals"] = observations.assignment_totals(votes)
    sides = kept.select("chrom", "pos", "label")
    labelled = called.join(sides.withColumnsRenamed({"pos": "left_pos", "label": "__l"}), ["chrom", "left_pos"], "left").join(
        sides.withColumnsRenamed({"pos": "right_pos", "label": "__r"}), ["chrom", "right_pos"], "left"
    )
    found["relation_tally"] = tallies.relation_tally(labelled, pairs.supports(F.col("relation")), pairs.same_haplotype("__l", "__r"))
    return found


def _annotated(edges: DataFrame, kept: DataFrame) -> DataFrame:
    depth = F.col("alt_reads") + F.col("ref_reads")
    vaf = F.coalesce(F.try_divide(F.col("alt_reads"), depth), F.lit(0.0))
    # The share of ALT on the haplotype that a site is assigned to.
    hvaf = F.when(F.col("label") == "HP1", F.col("hp1_vaf")).when(F.col("label") == "HP2", F.col("hp2_vaf")).try_cast("double")
    reads = F.concat_ws("/", "hp1_alt", "hp2_alt")
    fields = {"vaf": vaf, "hap": F.col("label"), "hvaf": hvaf, "hp_reads": reads}
    side = lambda end: kept.select("chrom", F.col("pos").alias(end), *(c.alias(f"{name}_{end}") for name, c in fields.items()))
    return edges.join(side("u"), ["chrom", "u"], "left").join(side("v"), ["chrom", "v"], "left")


def _exported(decided: DataFrame) -> DataFrame:
    """The edges of the exported graph: accepted ones, and rejected ones as ``unknown`` with what
    was tried and why it failed."""
    taken = F.col("status") == "accepted"
    kept = decided.where("status <> 'repeated' and u <> v")
    return kept.select(
        "chrom",
        "u",
        "v",
        F.when(taken, F.col("relation")).otherwise("unknown").alias("relation"),
        F.when(~taken, F.col("relation")).alias("rejected_relation"),
        F.col("reason").alias("rejection_reason"),
        "reliability",
        *("alt_alt", "alt_ref", "ref_alt", "ref_ref"),
        "accept_order",
    )


def _copy_numbers(spans: DataFrame, cn_tracks: DataFrame | None) -> DataFrame | None:
    """``chrom, span, cn_hp1, cn_hp2`` of spans, or nothing without tracks."""
    return None if cn_tracks is None else copy_number.annotated_spans(spans, cn_tracks, ["chrom"]).select("chrom", "span", "cn_hp1", "cn_hp2")


def _with_copy_number(nodes: DataFrame, numbers: DataFrame | None, key: str) -> DataFrame:
    return nodes if numbers is None else nodes.join(numbers.withColumnRenamed("span", key), ["chrom", key], "left")


def _ranked_graph(simple: DataFrame, nodes: DataFrame, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, placed, and edges of the top components, per ranking."""
    renamed = {"rank": "component_rank", "timing_edges": "component_timing_edges", "total_edges": "component_total_edges"}
    chosen = top.withColumnsRenamed(renamed).drop("interesting_edges")
    members = settle(nodes.drop("x", "y").join(chosen, ["chrom", "component"]))
    height = layout.band_y(F.concat_ws(":", "chrom", "pos"), F.col("vaf"), F.col("haplotype"))
    ends = members.select("ranking", "chrom", F.col("pos").alias("u"))
    return layout.ranking_layout(members).withColumn("y", height), simple.join(ends, ["chrom", "u"])


def build_graphs(config: PhaseConfig, proposals: DataFrame, contigs: DataFrame, cn_tracks: DataFrame | None = None, sites: DataFrame | None = None) -> dict[str, DataFrame]:
    """Accepted and rejected edges, and every view and report of the graph: nodes and edges of the
    full graph, of the simplified one and of the rankings, and of the condensed one with the members
    of its clusters and the edges behind its edges. ``sites`` are all sites, for the connectivity."""
    decided = settle(acceptance.decide(settle(acceptance.ordered(settle(proposals)))))
    accepted = settle(decided.where("status = 'accepted'"))
    rejected = decided.where("status = 'rejected'")
    exported = settle(_exported(decided))
    annotations = settle(graph_reports.exported_annotations(accepted, rejected))
    simplify.check_nodes(exported, annotations)
    point = annotations.select("chrom", F.col("pos").alias("span"), F.col("pos").alias("first"), F.col("pos").alias("last"))
    at_sites = _copy_numbers(point, cn_tracks)
    at_sites = settle(at_sites) if at_sites is not None else None

    def placed(edges: DataFrame) -> DataFrame:
        found = components(edges, ["chrom"], "u", "v").withColumnRenamed("vertex", "pos")
        nodes = annotations.join(found, ["chrom", "pos"], "left").withColumn("component", F.coalesce("component", "pos"))
        return _with_copy_number(layout.component_layout(nodes), at_sites, "pos")

    ends = F.array(F.struct(F.col("u").alias("pos"), F.col("cluster_u").alias("cluster")), F.struct(F.col("v").alias("pos"), F.col("cluster_v").alias("cluster")))
    clusters = settle(accepted.select("chrom", F.explode(ends).alias("h")).select("chrom", "h.*").distinct())
    extent = clusters.groupBy("chrom", F.col("cluster").alias("span")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    condensed = settle(graph_reports.condensed_edges(accepted))
    stats = settle(graph_reports.component_stats(accepted))
    simple = settle(simplify.simplified(exported, annotations))
    top = settle(simplify.top_components(simple, config.top_components))
    joined = simple.where("relation = 'cooccurring'")
    cooc = simplify.clusters_of(joined).select("chrom", "pos", F.col("cluster").alias("cooc_cluster_id"))
    simple_nodes = settle(placed(simple).join(cooc, ["chrom", "pos"], "left").withColumn("component_id", F.col("component")))
    top_nodes, top_edges = _ranked_graph(simple, simple_nodes, top)
    out = {
        "accepted": accepted,
        "rejected": rejected,
        "annotations": annotations,
        "graph_nodes": placed(accepted),
        "graph_edges": exported,
        "component_stats": stats,
        "haplotype_counters": graph_reports.haplotype_counters(accepted),
        "clusters": clusters,
        "condensed_nodes": _with_copy_number(graph_reports.condensed_nodes(clusters, annotations), _copy_numbers(extent, cn_tracks), "cluster"),
        "condensed_edges": condensed,
        "condensed_support": graph_reports.support_details(accepted),
        "simplified": simple,
        "simplified_nodes": simple_nodes,
        "fragmented_clusters": simplify.fragmented(simplify.nearest_neighbours(exported), simplify.clusters_of(exported)),
        "top_components": top,
        "top_nodes": top_nodes,
        "top_edges": top_edges,
        "timing_chains": chains.timing_chains(condensed),
        "global_summary": graph_reports.span_summary(stats, contigs),
    }
    if sites is not None:
        out["connectivity"] = graph_reports.connectivity(sites, proposals, decided)
    if cn_tracks is not None:
        spans = stats.select("chrom", F.col("component").alias("span"), F.col("min_pos").alias("first"), F.col("max_pos").alias("last"))
        out["component_copy_number"] = copy_number.annotated_spans(spans, cn_tracks, ["chrom"])
        out["copy_number_segments"] = copy_number.common_segments(cn_tracks, ["chrom"])
    return out
