"""Queries of the phase-graph operators over the domain's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.functions.chrom import canonical_chrom, canonical_chrom_sql
from locusweave.operators import acceptance, calls, chains, copy_number, graph_reports, layout, observations, pairs, simplify, tallies, windows
from locusweave.operators.components import components
from locusweave.operators.intervals import periods_and_gaps
from locusweave.plans import star
from locusweave.session import settle, table
from locusweave.sinks import reports
from locusweave.sources import relation_lines

READ = ["chrom", "bam", "read_id"]
WINDOW, STRIDE = 4, 3


def _canonical(df: DataFrame) -> DataFrame:
    return df.withColumn("chrom", canonical_chrom(F.col("chrom")))


def _chrom():
    return canonical_chrom(F.col("chrom"))


# ---------------------------------------------------------------- observations and pairs


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return observations.resolve(_canonical(table(spark, sf, "observations")), READ)


def obs_resolved(spark, sf):
    return _resolved(spark, sf).withColumn("error", F.round("error", 6))


def obs_stats(spark, sf):
    return observations.observation_statistics(_canonical(table(spark, sf, "observations")), READ)


def sites_clean(spark, sf):
    return observations.clean_sites(table(spark, sf, "sites"), _chrom())


def excluded_sites(spark, sf):
    regions = periods_and_gaps(_canonical(table(spark, sf, "excluded_regions")).where("chrom is not null"), ["chrom"], "start_pos", "end_pos")
    return observations.outside_regions(sites_clean(spark, sf), regions.where("kind = 'period'"))


def pair_candidates(spark, sf):
    return pairs.pair_candidates(_resolved(spark, sf), READ)


def pair_gate(spark, sf):
    return _gate(_resolved(spark, sf))


def _gate(resolved: DataFrame) -> DataFrame:
    return pairs.eligible(pairs.pair_candidates(resolved, READ))


def candidates_clean(spark, sf):
    return pairs.clean_candidates(table(spark, sf, "candidates"), _chrom())


def candidate_components(spark, sf):
    found = components(pairs.eligible(candidates_clean(spark, sf)), ["chrom"], "left_pos", "right_pos")
    return found.withColumnsRenamed({"vertex": "pos"})


def read_votes(spark, sf):
    obs = star.observations(spark, sf)
    return observations.read_votes(obs.select(*star.READ).distinct(), star.markers(spark, sf), star.READ)


def read_assignment_totals(spark, sf):
    return observations.assignment_totals(read_votes(spark, sf))


def site_summary(spark, sf):
    return observations.site_summary(star.observations(spark, sf), read_votes(spark, sf), star.READ)


def support_filtered_sites(spark, sf):
    return observations.supported(site_summary(spark, sf)).select("chrom", "pos", "alt_reads", "ref_reads", "label")


# ---------------------------------------------------------------- windows, trees, calls


def _eligible(spark, sf):
    return settle(pair_gate(spark, sf))


def regular_windows(spark, sf):
    eligible = _eligible(spark, sf)
    return _listed(_regular_windows(eligible))


def _regular_windows(eligible: DataFrame) -> DataFrame:
    return windows.regular_windows(windows.site_components(eligible), eligible, WINDOW, STRIDE)


def regular_window_sites(spark, sf):
    """The regular windows of full size, one row per site, named by their first site."""
    full = _regular_windows(_eligible(spark, sf)).where(F.size("sites") == WINDOW)
    return full.select("chrom", "component", F.col("sites")[0].alias("first"), F.posexplode("sites").alias("place", "pos"))


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("sites", F.array_join(F.col("sites").cast("array<string>"), ","))


def all_windows(spark, sf):
    return _listed(windows.all_windows(_eligible(spark, sf), WINDOW, STRIDE))


def pair_window_assignment(spark, sf):
    eligible = _eligible(spark, sf)
    return _listed(windows.assign_pairs(eligible, settle(windows.all_windows(eligible, WINDOW, STRIDE))))


def window_read_patterns(spark, sf):
    """The patterns of reads over each window, as ``place:allele:error`` of the covered sites."""
    resolved = settle(_resolved(spark, sf))
    found = windows.read_patterns(settle(windows.all_windows(settle(_gate(resolved)), WINDOW, STRIDE)), resolved, READ)
    call = lambda c: F.format_string("%d:%d:%.6f", c["i"], c["allele"], c["err"])
    return found.select("chrom", "window_id", F.array_join(F.transform("pattern", call), ",").alias("pattern"), "reads")


def relationship_calls(spark, sf):
    """The whole inference: windows, tree fits, and the relation of each eligible pair."""
    results = calls.pair_results(_eligible(spark, sf), settle(_resolved(spark, sf)), READ, WINDOW, STRIDE)
    called = calls.relationship_calls(results)
    bics = F.array(*(F.col(f"bic_{r}") for r in pairs.RELATIONS))
    return called.withColumn("probabilities", pairs.probabilities(bics)).drop("sites")


def proposals(spark, sf):
    return calls.proposals(calls.relationship_calls(calls.pair_results(_eligible(spark, sf), settle(_resolved(spark, sf)), READ, WINDOW, STRIDE)))


def window_conflicts(spark, sf):
    """Pairs that several windows speak for, and whether the windows agree."""
    from locusweave.operators.trees import fit_windows

    resolved = settle(_resolved(spark, sf))
    eligible = settle(_gate(resolved))
    found = settle(windows.all_windows(eligible, WINDOW, STRIDE))
    fits = fit_windows(found, windows.read_patterns(found, resolved, READ))
    return calls.window_opinions(found, fits, eligible)


# ---------------------------------------------------------------- delivered edges


def edges_clean(spark, sf):
    return acceptance.clean_edges(table(spark, sf, "edges"), _chrom())


def edge_order(spark, sf):
    kept = acceptance.ordered(settle(edges_clean(spark, sf)))
    return kept.select("chrom", "component", "accept_order", "u", "v", "relation", "reliability")


def _decided(spark, sf) -> DataFrame:
    return settle(acceptance.decide(settle(acceptance.ordered(settle(edges_clean(spark, sf))))))


def accepted_edges(spark, sf):
    return _decided(spark, sf).where("status = 'accepted'").select("chrom", "u", "v", "relation", "reliability", "cluster_u", "cluster_v")


def rejected_edges(spark, sf):
    return _decided(spark, sf).where("status = 'rejected'").select("chrom", "u", "v", "relation", "reliability", "reason")


def graph_connectivity(spark, sf):
    return graph_reports.connectivity(sites_clean(spark, sf), edges_clean(spark, sf), _decided(spark, sf))


def _first_edges(spark, sf) -> DataFrame:
    """The delivered edges under a decision that SQL can take as well: of all edges between two
    sites the first in the order of acceptance is accepted."""
    order = (F.desc("reliability"), "relation_rank", F.desc(pairs.informative()), "u", "v", "relation")
    place = F.row_number().over(Window.partitionBy("chrom", F.least("u", "v"), F.greatest("u", "v")).orderBy(*order))
    return _proper(spark, sf).withColumn("status", F.when(place == 1, "accepted").otherwise("rejected"))


def connectivity_of_first_edges(spark, sf):
    return graph_reports.connectivity(sites_clean(spark, sf), edges_clean(spark, sf), _first_edges(spark, sf))


def chains_of_best_arcs(spark, sf):
    """Chains over each cluster's best timing arc, of those that lead to a later cluster."""
    condensed = graph_reports.condensed_edges(_with_clusters(settle(_first_edges(spark, sf).where("status = 'accepted'"))))
    best = Window.partitionBy("chrom", "source").orderBy(F.desc("reliability"), F.desc("support_edge_count"), "target")
    arcs = condensed.where("relation = 'timing' and source < target").withColumn("place", F.row_number().over(best)).where("place = 1")
    return chains.timing_chains(arcs).withColumn("path", F.array_join("path", ">"))


def simplified_proposals(spark, sf):
    """The simplified view of all delivered edges as they are, ``unknown`` ones included."""
    known = acceptance.clean_edges(table(spark, sf, "edges"), _chrom(), (*graph_reports.RELATIONS, "unknown")).where("u <> v")
    edges = settle(known)
    return simplify.simplified(edges, settle(graph_reports.site_annotations(edges)))


def edge_haplotype_summary(spark, sf):
    return graph_reports.haplotype_counters(edges_clean(spark, sf))


def _proper(spark, sf):
    return settle(edges_clean(spark, sf).where("u <> v"))


def component_stats(spark, sf):
    return graph_reports.component_stats(_proper(spark, sf))


def accepted_component_stats(spark, sf):
    return graph_reports.component_stats(settle(_decided(spark, sf).where("status = 'accepted'")))


def cross_haplotype_filter(spark, sf):
    kept = edges_clean(spark, sf)
    return simplify.without_cross_haplotype(kept, graph_reports.site_annotations(kept)).select("chrom", "u", "v", "relation")


def nearest_neighbour_thinning(spark, sf):
    return simplify.nearest_neighbours(edges_clean(spark, sf))


def condensed_nodes(spark, sf):
    proper = _proper(spark, sf)
    return graph_reports.condensed_nodes(simplify.clusters_of(proper), graph_reports.site_annotations(proper))


def condensed_edges(spark, sf):
    return graph_reports.condensed_edges(_with_clusters(_proper(spark, sf)))


def _with_clusters(edges: DataFrame) -> DataFrame:
    home = settle(simplify.clusters_of(edges))
    side = lambda end: home.select("chrom", F.col("pos").alias(end), F.col("cluster").alias(f"cluster_{end}"))
    return edges.join(side("u"), ["chrom", "u"]).join(side("v"), ["chrom", "v"])


def relation_dedup(spark, sf):
    proper = _proper(spark, sf)
    home = settle(simplify.clusters_of(proper))
    kept = [simplify.best_per_cluster(proper, r, home) for r in ("timing", "divergent")]
    return kept[0].unionByName(kept[1]).select("chrom", "u", "v", "relation")


def _exported(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The edges of the exported graph and its sites' annotations. Rejected edges are ``unknown``, and
    so are those delivered under that relation, which are never decided."""
    decided = _decided(spark, sf).where("status <> 'repeated' and u <> v")
    accepted = F.col("status") == "accepted"
    unknown = acceptance.clean_edges(table(spark, sf, "edges"), _chrom(), ("unknown",)).where("u <> v")
    rejected = decided.where(~accepted).withColumn("relation", F.lit("unknown"))
    rejected = settle(rejected.unionByName(unknown, allowMissingColumns=True))
    kept = decided.where(accepted)
    return settle(kept.unionByName(rejected)), settle(graph_reports.exported_annotations(kept, rejected))


def simplified_graph(spark, sf):
    """The simplified view of all edges: accepted ones, and rejected ones as ``unknown``."""
    return simplify.simplified(*_exported(spark, sf))


def _nodes(edges: DataFrame) -> DataFrame:
    found = components(edges, ["chrom"], "u", "v").withColumnRenamed("vertex", "pos")
    return found.join(graph_reports.site_annotations(edges), ["chrom", "pos"])


def graph_layout(spark, sf):
    """Places of the sites in the drawing of all edges, and their height in the simplified one."""
    placed = layout.component_layout(_nodes(_proper(spark, sf)))
    return placed.select("chrom", "pos", "component", "x", "y")


def topn_layout(spark, sf):
    """Places of the sites of the top components of the simplified graph in each ranking's drawing."""
    exported, annotations = _exported(spark, sf)
    graph = settle(simplify.simplified(exported, annotations))
    found = components(graph, ["chrom"], "u", "v").withColumnRenamed("vertex", "pos")
    nodes = settle(found.join(annotations, ["chrom", "pos"]))
    top = simplify.top_components(graph, 50).select("ranking", "chrom", "component")
    placed = layout.ranking_layout(nodes.join(top, ["chrom", "component"]).select("ranking", "chrom", "pos", "vaf", "haplotype"))
    height = layout.band_y(F.concat_ws(":", "chrom", "pos"), F.col("vaf"), F.col("haplotype"))
    return placed.select("ranking", "chrom", "pos", "x", F.round(height, 6).alias("y"))


def topn_simplified(spark, sf):
    """The rankings over the simplified graph, unknown edges included."""
    return simplify.top_components(settle(simplified_graph(spark, sf)), 50)


def topn_components(spark, sf):
    """The same rankings over the proposals before acceptance."""
    return simplify.top_components(_proper(spark, sf), 50)


def timing_chains(spark, sf):
    accepted = _decided(spark, sf).where("status = 'accepted'")
    return chains.timing_chains(settle(graph_reports.condensed_edges(accepted))).withColumn("path", F.array_join("path", ">"))


def global_summary(spark, sf):
    contigs = table(spark, sf, "contigs").select(_chrom().alias("chrom"), "contig_order")
    return graph_reports.span_summary(component_stats(spark, sf), contigs)


# ---------------------------------------------------------------- intervals and copy number


def interval_coverage(spark, sf):
    """Base pairs that the candidates' closed spans cover on each chromosome, and their sum."""
    spans = candidates_clean(spark, sf).select("chrom", F.col("left_pos").alias("s"), (F.col("right_pos") + 1).alias("e"))
    spans = settle(spans)
    merged = periods_and_gaps(spans, ["chrom"], "s", "e").where("kind = 'period'")
    total = spans.groupBy("chrom").agg(F.sum(F.col("e") - F.col("s")).alias("summed_bp"))
    return merged.groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("covered_bp")).join(total, "chrom")


def _tracks(spark, sf):
    return copy_number.tracks(table(spark, sf, "cn_segments").where("profile_id is not null"), F.col("profile_id"), _chrom())


def cn_best_segment(spark, sf):
    """The best segment of each track of a profile over each region of the list of its number."""
    regions = table(spark, sf, "excluded_regions").where("start_pos >= 0 and end_pos > start_pos and bed_id is not null")
    spans = regions.select(F.col("bed_id").alias("owner"), _chrom().alias("chrom"), (F.col("start_pos") + 1).alias("first"), F.col("end_pos").alias("last")).distinct()
    best = copy_number.best_segment(spans.withColumn("span", F.struct("first", "last")), settle(_tracks(spark, sf)), ["owner", "chrom"])
    return best.select("owner", "chrom", F.col("span.first").alias("first"), F.col("span.last").alias("last"), "hp", "state", "confidence", "start", "end", "overlap")


def cn_merged_segments(spark, sf):
    return copy_number.common_segments(settle(_tracks(spark, sf)), ["owner", "chrom"])


def component_copy_number(spark, sf):
    """Both copy-number states of every profile over the extent of each component."""
    stats = component_stats(spark, sf)
    spans = stats.select("chrom", F.col("component").alias("span"), F.col("min_pos").alias("first"), F.col("max_pos").alias("last"))
    found = copy_number.annotated_spans(spans, settle(_tracks(spark, sf)), ["chrom"], ("owner",))
    return found.select("owner", "chrom", F.col("span").alias("component"), "cn_hp1", "cn_hp2", "cn_total")


# ---------------------------------------------------------------- tallies and relation files


def site_label_tally(spark, sf):
    return tallies.label_tally(support_filtered_sites(spark, sf), F.col("label"))


def site_table(spark, sf):
    return reports.site_table(site_summary(spark, sf))


def vote_table(spark, sf):
    return reports.vote_table(read_votes(spark, sf))


def relation_tally(spark, sf):
    # A timing edge's counts follow its direction, so that its first site is the left one.
    as_called = F.when(F.col("relation") == "timing", "left_before_right").otherwise(F.col("relation"))
    return tallies.relation_tally(edges_clean(spark, sf), pairs.supports(as_called), pairs.same_haplotype("hap_u", "hap_v"))


def component_sizes(spark, sf):
    return tallies.size_histogram(candidate_components(spark, sf), ["chrom", "component"])


def relation_lines_read(spark, sf):
    """The edges written as lines of relation files and read again."""
    lines = edges_clean(spark, sf).select(relation_lines.line_of_edge().alias("line"), relation_lines.relation_of_edge().alias("file"))
    return relation_lines.edges_of_lines(lines, "line", F.col("file"))


QUERIES = {
    f.__name__: f
    for f in (
        obs_resolved, obs_stats, sites_clean, excluded_sites, pair_candidates, pair_gate, candidates_clean, candidate_components,
        read_votes, read_assignment_totals, site_summary, support_filtered_sites,
        regular_windows, regular_window_sites, all_windows, pair_window_assignment, window_read_patterns, relationship_calls, proposals, window_conflicts,
        connectivity_of_first_edges, chains_of_best_arcs, simplified_proposals,
        edges_clean, edge_order, accepted_edges, rejected_edges, graph_connectivity, edge_haplotype_summary, component_stats,
        accepted_component_stats, cross_haplotype_filter, nearest_neighbour_thinning, condensed_nodes, condensed_edges, relation_dedup,
        simplified_graph, graph_layout, topn_layout, topn_components, topn_simplified, timing_chains, global_summary, interval_coverage, cn_best_segment, cn_merged_segments,
        component_copy_number, site_label_tally, site_table, vote_table, relation_tally, component_sizes, relation_lines_read,
    )
}

# ---------------------------------------------------------------- SQL twins

_C = canonical_chrom_sql("chrom")

_RESOLVED = f"""
SELECT {_C} AS chrom, bam, read_id, pos, min(allele) AS allele,
       least(0.49, greatest(0.01, coalesce(min(CASE WHEN NOT isnan(error) THEN error END), 0.49))) AS error
FROM observations
WHERE chrom IS NOT NULL AND bam IS NOT NULL AND read_id IS NOT NULL AND pos IS NOT NULL AND allele IN (0, 1)
GROUP BY ALL HAVING min(allele) = max(allele)"""

_SITES = f"""
SELECT chrom, pos, s.ref AS ref, s.alt AS alt FROM (
  SELECT chrom, pos, max({{'alt': alt, 'ref': ref}}) AS s FROM (
    SELECT {_C} AS chrom, pos, upper(substring(trim(ref), 1, 1)) AS ref, upper(substring(trim(split_part(alt, ',', 1)), 1, 1)) AS alt FROM sites)
  WHERE chrom IS NOT NULL AND pos IS NOT NULL AND alt <> '' GROUP BY chrom, pos)"""

_PAIRS = f"""
WITH r AS ({_RESOLVED})
SELECT a.chrom, a.pos AS left_pos, b.pos AS right_pos,
       CAST(count(*) FILTER (a.allele = 1 AND b.allele = 1) AS bigint) AS alt_alt,
       CAST(count(*) FILTER (a.allele = 1 AND b.allele = 0) AS bigint) AS alt_ref,
       CAST(count(*) FILTER (a.allele = 0 AND b.allele = 1) AS bigint) AS ref_alt,
       CAST(count(*) FILTER (a.allele = 0 AND b.allele = 0) AS bigint) AS ref_ref
FROM r a JOIN r b ON a.chrom = b.chrom AND a.bam = b.bam AND a.read_id = b.read_id AND a.pos < b.pos
GROUP BY ALL HAVING count(*) FILTER (a.allele = 1 OR b.allele = 1) >= 2"""
_GATE = "alt_alt + alt_ref + ref_alt >= 3 OR alt_alt >= 2"

_CANDIDATES = f"""
SELECT chrom, left_pos, right_pos, s.alt_alt, s.alt_ref, s.ref_alt, s.ref_ref FROM (
  SELECT chrom, left_pos, right_pos,
         max({{'loaded_at': loaded_at, 'alt_alt': alt_alt, 'alt_ref': alt_ref, 'ref_alt': ref_alt, 'ref_ref': ref_ref}}) AS s FROM (
    SELECT {_C} AS chrom, least(left_pos, right_pos) AS left_pos, greatest(left_pos, right_pos) AS right_pos, loaded_at, alt_alt,
           CASE WHEN left_pos > right_pos THEN ref_alt ELSE alt_ref END AS alt_ref,
           CASE WHEN left_pos > right_pos THEN alt_ref ELSE ref_alt END AS ref_alt, ref_ref
    FROM candidates WHERE left_pos IS NOT NULL AND right_pos IS NOT NULL)
  WHERE chrom IS NOT NULL AND alt_alt IS NOT NULL AND alt_ref IS NOT NULL AND ref_alt IS NOT NULL AND ref_ref IS NOT NULL AND left_pos < right_pos
  GROUP BY chrom, left_pos, right_pos)"""


def _reach(edges: str, name: str = "") -> str:
    """Recursive SQL: ``reach(chrom, pos, component)`` over ``edges(chrom, u, v)``; its tables begin
    with ``name``."""
    e0, ways, walk = f"{name}e0", f"{name}both_ways", f"{name}walk"
    return f"""{e0} AS ({edges}), {ways} AS (SELECT chrom, u AS a, v AS b FROM {e0} UNION SELECT chrom, v, u FROM {e0}),
{walk} AS (SELECT DISTINCT chrom, a AS pos, a AS hit FROM {ways}
         UNION SELECT {walk}.chrom, {walk}.pos, {ways}.b FROM {walk} JOIN {ways} ON {ways}.chrom = {walk}.chrom AND {ways}.a = {walk}.hit),
{name}reach AS (SELECT chrom, pos, min(hit) AS component FROM {walk} GROUP BY chrom, pos)"""


_LABEL = """CASE WHEN {a} + {b} < {least} THEN '{none}'
     WHEN 100 * least({a}, {b}) > 15 * ({a} + {b}) OR {a} = {b} THEN 'MIXED'
     WHEN {a} > {b} THEN 'HP1' ELSE 'HP2' END"""
_VOTES = f"""
SELECT chrom, read_id, hp1, hp2, {_LABEL.format(a="hp1", b="hp2", least=2, none="UNASSIGNED")} AS assignment FROM (
  SELECT o.chrom, o.read_id, CAST(count(*) FILTER (m.is_hp1 = 1) AS bigint) AS hp1, CAST(count(*) FILTER (m.is_hp1 = 0) AS bigint) AS hp2
  FROM (SELECT DISTINCT chrom, read_id FROM ({star.DUCK_OBS})) o
  LEFT JOIN ({star.DUCK_MARKERS}) m ON o.chrom = m.chrom AND o.read_id = m.read_id
  GROUP BY o.chrom, o.read_id)"""
_HP_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (hp = '{h}' AND allele = {a}) AS bigint) AS {n}_{k}"
    for h, n in (("HP1", "hp1"), ("HP2", "hp2"), ("none", "untagged"))
    for k, a in (("ref", 0), ("alt", 1))
)
_SUMMARY = f"""
SELECT *, {_LABEL.format(a="hp1_alt", b="hp2_alt", least=1, none="UNKNOWN")} AS label,
       hp1_alt + hp2_alt + untagged_alt AS alt_reads, hp1_ref + hp2_ref + untagged_ref AS ref_reads,
       CASE WHEN hp1_alt + hp1_ref = 0 THEN 'NA' ELSE printf('%.6f', CAST(CAST(hp1_alt / (hp1_alt + hp1_ref) AS float) AS double)) END AS hp1_vaf,
       CASE WHEN hp2_alt + hp2_ref = 0 THEN 'NA' ELSE printf('%.6f', CAST(CAST(hp2_alt / (hp2_alt + hp2_ref) AS float) AS double)) END AS hp2_vaf
FROM (
  SELECT o.chrom, o.pos, count(*) AS total_coverage, {_HP_COUNTS} FROM (
    SELECT o.*, CASE WHEN v.assignment IN ('HP1', 'HP2') THEN v.assignment ELSE 'none' END AS hp FROM (
      SELECT chrom, read_id, pos, max(CASE WHEN allele IN (0, 1) THEN allele END) AS allele FROM ({star.DUCK_OBS}) GROUP BY ALL) o
    LEFT JOIN ({_VOTES}) v ON o.chrom = v.chrom AND o.read_id = v.read_id) o
  GROUP BY o.chrom, o.pos)"""

_REL = "lower(regexp_replace(relation, '^\\s+|\\s+$', '', 'g'))"
_TURN = f"(u > v AND {_REL} <> 'timing')"


def _two(a: str, b: str) -> str:
    return f"CASE WHEN {_TURN} THEN {b} ELSE {a} END"


def _hap(a: str, b: str) -> str:
    given = f"upper(trim({_two(a, b)}))"
    return f"CASE WHEN {given} IN ('HP1', 'HP2', 'MIXED', 'UNKNOWN') THEN {given} END"


def _known(column: str, otherwise: str) -> str:
    return f"coalesce(CASE WHEN NOT isnan({column}) THEN {column} END, {otherwise}) AS {column}"


def _said(column: str) -> str:
    return f"CASE WHEN upper({column}) NOT IN ('', 'NA', 'NAN', 'NULL', '.') THEN {column} END AS {column}"


_EDGE_FIELDS = (
    "reliability", "alt_alt", "alt_ref", "ref_alt", "ref_ref", "vaf_u", "vaf_v", "hap_u", "hap_v",
    "hvaf_u", "hvaf_v", "hp_reads_u", "hp_reads_v", "best_score", "margin",
)
_EDGES = f"""
SELECT chrom, u, v, relation, {", ".join(f"s.{c} AS {c}" for c in _EDGE_FIELDS)},
       CAST(CASE WHEN relation = 'cooccurring' THEN 0 WHEN relation = 'divergent' THEN 1 WHEN u < v THEN 2 ELSE 3 END AS int) AS relation_rank FROM (
  SELECT chrom, u, v, relation, arg_max({{{", ".join(f"'{c}': {c}" for c in _EDGE_FIELDS)}}}, (loaded_at, {", ".join(_EDGE_FIELDS)})) AS s FROM (
    SELECT {_C} AS chrom, {_two("u", "v")} AS u, {_two("v", "u")} AS v, {_REL} AS relation,
           coalesce(CASE WHEN NOT isnan(reliability) THEN reliability END, 0.0) AS reliability,
           coalesce(CAST(alt_alt AS bigint), 0) AS alt_alt, coalesce(CAST({_two("alt_ref", "ref_alt")} AS bigint), 0) AS alt_ref,
           coalesce(CAST({_two("ref_alt", "alt_ref")} AS bigint), 0) AS ref_alt, coalesce(CAST(ref_ref AS bigint), 0) AS ref_ref,
           {_two("vaf_u", "vaf_v")} AS vaf_u, {_two("vaf_v", "vaf_u")} AS vaf_v, {_hap("hap_u", "hap_v")} AS hap_u, {_hap("hap_v", "hap_u")} AS hap_v,
           {_two("hvaf_u", "hvaf_v")} AS hvaf_u, {_two("hvaf_v", "hvaf_u")} AS hvaf_v, {_two("hp_reads_u", "hp_reads_v")} AS hp_reads_u, {_two("hp_reads_v", "hp_reads_u")} AS hp_reads_v,
           best_score, margin, loaded_at
    FROM edges)
  WHERE relation IN ('cooccurring', 'timing', 'divergent') AND chrom IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL
  GROUP BY chrom, u, v, relation)"""
_PROPER = f"SELECT * FROM ({_EDGES}) WHERE u <> v"
_WITH_UNKNOWN = _EDGES.replace("relation IN ('cooccurring', 'timing', 'divergent')", "relation IN ('cooccurring', 'timing', 'divergent', 'unknown')")
_FIRST = f"""
SELECT *, row_number() OVER (PARTITION BY chrom, least(u, v), greatest(u, v)
            ORDER BY reliability DESC, relation_rank, alt_alt + alt_ref + ref_alt DESC, u, v, relation) = 1 AS taken FROM ({_PROPER})"""

_ENDS = """SELECT chrom, u AS pos, v AS other, vaf_u AS vaf, hap_u AS hap FROM {e} UNION ALL SELECT chrom, v, u, vaf_v, hap_v FROM {e}"""


def _sites_of(e: str) -> str:
    return f"""
SELECT chrom, pos, arg_min(vaf, (other, vaf)) FILTER (vaf IS NOT NULL AND NOT isnan(vaf)) AS vaf,
       CASE WHEN min(hap) = max(hap) THEN min(hap) WHEN min(hap) IS NOT NULL THEN 'MIXED' ELSE 'UNKNOWN' END AS haplotype
FROM ({_ENDS.format(e=e)}) GROUP BY chrom, pos"""


_CLUSTERS = f"""p AS ({_PROPER}), {_reach("SELECT chrom, u, v FROM p WHERE relation = 'cooccurring'")},
clusters AS (SELECT n.chrom, n.pos, coalesce(r.component, n.pos) AS cluster
             FROM (SELECT chrom, u AS pos FROM p UNION SELECT chrom, v FROM p) n LEFT JOIN reach r ON r.chrom = n.chrom AND r.pos = n.pos)"""

_STATS = f"""
WITH RECURSIVE p AS ({_PROPER}), {_reach("SELECT chrom, u, v FROM p")},
n AS (SELECT chrom, component, min(pos) AS min_pos, max(pos) AS max_pos, count(*) AS num_nodes FROM reach GROUP BY chrom, component),
s AS (SELECT p.chrom, r.component, CAST(count(*) FILTER (relation = 'cooccurring') AS bigint) AS cooccurrence_edges,
             CAST(count(*) FILTER (relation = 'timing') AS bigint) AS timing_edges, CAST(count(*) FILTER (relation = 'divergent') AS bigint) AS divergent_edges,
             count(*) AS total_edges, round(CAST(sum(alt_alt + alt_ref + ref_alt + ref_ref) AS double) / count(*), 6) AS avg_read_support
      FROM p JOIN reach r ON r.chrom = p.chrom AND r.pos = p.u GROUP BY p.chrom, r.component)"""

_COUNTERS = " UNION ALL ".join(
    f"""SELECT g.chrom, '{r}' AS relation, CAST(count(*) FILTER (x.relation = '{r}') AS bigint) AS total,
  CAST(count(*) FILTER (x.relation = '{r}' AND hu = hv AND hu <> 'UNKNOWN') AS bigint) AS same_haplotype,
  CAST(count(*) FILTER (x.relation = '{r}' AND hu <> hv AND hu <> 'UNKNOWN' AND hv <> 'UNKNOWN') AS bigint) AS different_haplotype,
  CAST(count(*) FILTER (x.relation = '{r}' AND (hu = 'UNKNOWN' OR hv = 'UNKNOWN')) AS bigint) AS at_least_one_unknown,
  CAST(count(*) FILTER (x.relation = '{r}' AND hu = 'HP1' AND hv = 'HP1') AS bigint) AS hp1_hp1,
  CAST(count(*) FILTER (x.relation = '{r}' AND hu = 'HP2' AND hv = 'HP2') AS bigint) AS hp2_hp2
FROM (SELECT DISTINCT chrom FROM x UNION ALL SELECT NULL) g JOIN x ON g.chrom IS NULL OR g.chrom = x.chrom GROUP BY g.chrom"""
    for r in graph_reports.RELATIONS
)

_CN = f"""
SELECT DISTINCT profile_id AS owner, {_C} AS chrom, start_pos + 1 AS start, end_pos AS "end", hp,
       CASE WHEN NOT isnan(state) THEN state END AS state, CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence
FROM (SELECT *, 'hp1' AS hp, hp1_state AS state, hp1_confidence AS confidence FROM cn_segments
      UNION ALL SELECT *, 'hp2', hp2_state, hp2_confidence FROM cn_segments)
WHERE profile_id IS NOT NULL AND chrom IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos"""


def _best_cn(spans: str) -> str:
    """The best segment of each track over ``spans(owner, chrom, first, last)``."""
    return f"""
SELECT x.owner, x.chrom, x.first, x.last, s.hp, s.state, s.confidence, s.start, s."end",
       least(x.last, s."end") - greatest(x.first, s.start) + 1 AS overlap
FROM ({spans}) x JOIN ({_CN}) s ON s.owner = x.owner AND s.chrom = x.chrom AND s.start <= x.last AND s."end" >= x.first
QUALIFY row_number() OVER (PARTITION BY x.owner, x.chrom, x.first, x.last, s.hp
  ORDER BY least(x.last, s."end") - greatest(x.first, s.start) DESC, coalesce(s.confidence, '-inf'::double) DESC, s.start, s."end", coalesce(s.state, -1)) = 1"""


_CUTS = f"""SELECT owner, chrom, start AS first, nxt - 1 AS last FROM (
  SELECT owner, chrom, start, lead(start) OVER (PARTITION BY owner, chrom ORDER BY start) AS nxt FROM (
    SELECT owner, chrom, start FROM ({_CN}) UNION SELECT owner, chrom, "end" + 1 FROM ({_CN}))) WHERE nxt IS NOT NULL"""

_REGULAR = f"""
WITH RECURSIVE gate AS MATERIALIZED (SELECT chrom, left_pos AS u, right_pos AS v FROM ({_PAIRS}) WHERE {_GATE}), {_reach("SELECT chrom, u, v FROM gate")},
m AS (SELECT chrom, component, pos, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY chrom, component) AS n FROM reach
      WINDOW w AS (PARTITION BY chrom, component ORDER BY pos)),
o AS (SELECT chrom, component, k AS first FROM m WHERE k <= n - {WINDOW} AND (k % {STRIDE} = 0 OR k = n - {WINDOW})),
s AS (SELECT m.chrom, m.component, o.first, m.k - o.first AS place, m.pos
      FROM o JOIN m ON m.chrom = o.chrom AND m.component = o.component AND m.k BETWEEN o.first AND o.first + {WINDOW - 1}),
e AS (SELECT a.chrom, a.component, a.first, a.place AS i, b.place AS j FROM s a JOIN s b USING (chrom, component, first)
      JOIN both_ways g ON g.chrom = a.chrom AND g.a = a.pos AND g.b = b.pos),
seen AS (SELECT chrom, component, first, CAST(0 AS bigint) AS place FROM o
         UNION SELECT e.chrom, e.component, e.first, CAST(e.j AS bigint) FROM seen JOIN e USING (chrom, component, first) WHERE e.i = seen.place),
whole AS (SELECT chrom, component, first FROM seen GROUP BY ALL HAVING count(*) = {WINDOW}),
regular AS MATERIALIZED (
  SELECT chrom, component, list(pos ORDER BY pos) AS sites FROM m WHERE n < {WINDOW} GROUP BY chrom, component
  UNION ALL SELECT chrom, component, list(pos ORDER BY pos) FROM s JOIN whole USING (chrom, component, first) GROUP BY chrom, component, first)"""


def _wider(rows: str, sites: str) -> str:
    """``rows`` (chrom, component, u, v and the columns ``sites``) with the nearest further site ``z``."""
    away = ", ".join(f"abs(g.b - {c})" for c in sites.split(", "))
    return f"""SELECT r.chrom, r.component, {", ".join(f"r.{c}" for c in sites.split(", "))}, arg_min(g.b, (least({away}), g.b)) AS z
  FROM {rows} r JOIN both_ways g ON g.chrom = r.chrom AND g.a IN ({sites}) AND g.b NOT IN ({sites}) GROUP BY ALL"""


# Each pair that no regular window holds grows a window; of these, ``scan`` keeps in the order of the
# pairs those whose pair is in none that it kept before.
_WINDOWS = f"""{_REGULAR},
held AS (SELECT DISTINCT chrom, a, b FROM (SELECT chrom, a, unnest(sites) AS b FROM (SELECT chrom, sites, unnest(sites) AS a FROM regular)) WHERE a < b),
missed AS (SELECT g.chrom, r.component, g.u, g.v FROM gate g JOIN reach r ON r.chrom = g.chrom AND r.pos = g.u
           WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.chrom = g.chrom AND h.a = g.u AND h.b = g.v)),
three AS (SELECT chrom, component, u, v, z AS w FROM ({_wider("missed", "u, v")})),
grown AS MATERIALIZED (SELECT chrom, component, u, v, list_sort([u, v, w, z]) AS sites, row_number() OVER (PARTITION BY chrom, component ORDER BY u, v) AS k
          FROM ({_wider("three", "u, v, w")})),
hits AS MATERIALIZED (SELECT q.chrom, q.component, q.k, list(p.k) AS taken FROM grown q
         JOIN grown p ON p.chrom = q.chrom AND p.component = q.component AND p.k >= q.k AND list_contains(q.sites, p.u) AND list_contains(q.sites, p.v) GROUP BY ALL),
scan AS (SELECT chrom, component, list(k ORDER BY k) AS todo, CAST(0 AS bigint) AS kept FROM grown GROUP BY chrom, component
         UNION ALL SELECT s.chrom, s.component, list_filter(s.todo, lambda x: NOT list_contains(h.taken, x)), s.todo[1]
         FROM scan s JOIN hits h ON h.chrom = s.chrom AND h.component = s.component AND h.k = s.todo[1]),
every AS (SELECT chrom, component, sites, row_number() OVER (PARTITION BY chrom ORDER BY sites) - 1 AS window_id FROM (
  SELECT chrom, component, sites FROM regular
  UNION SELECT g.chrom, g.component, g.sites FROM grown g JOIN scan s ON s.chrom = g.chrom AND s.component = g.component AND s.kept = g.k))"""

ORACLES = {
    "obs_resolved": f"SELECT chrom, bam, read_id, pos, allele, round(error, 6) AS error FROM ({_RESOLVED})",
    "obs_stats": f"""
SELECT chrom, CAST(sum(used + other) AS bigint) AS n_rows, CAST(sum(used) AS bigint) AS usable, CAST(sum(other) AS bigint) AS non_ref_alt,
       CAST(sum(greatest(used - 1, 0)) AS bigint) AS resent, CAST(count(*) FILTER (lo <> hi) AS bigint) AS contradicting,
       CAST(count(*) FILTER (used > 0 AND lo = hi) AS bigint) AS calls FROM (
  SELECT {_C} AS chrom, bam, read_id, pos, count(*) FILTER (allele IN (0, 1)) AS used, count(*) FILTER (allele NOT IN (0, 1)) AS other,
         min(allele) FILTER (allele IN (0, 1)) AS lo, max(allele) FILTER (allele IN (0, 1)) AS hi
  FROM observations WHERE chrom IS NOT NULL AND bam IS NOT NULL AND read_id IS NOT NULL AND pos IS NOT NULL AND allele IS NOT NULL GROUP BY ALL)
GROUP BY chrom""",
    "sites_clean": _SITES,
    "excluded_sites": f"""
SELECT * FROM ({_SITES}) s WHERE NOT EXISTS (
  SELECT 1 FROM excluded_regions r WHERE {canonical_chrom_sql("r.chrom")} = s.chrom AND r.start_pos >= 0 AND r.end_pos > r.start_pos
    AND s.pos - 1 >= r.start_pos AND s.pos - 1 < r.end_pos)""",
    "pair_candidates": _PAIRS,
    "pair_gate": f"SELECT * FROM ({_PAIRS}) WHERE {_GATE}",
    "candidates_clean": _CANDIDATES,
    "candidate_components": f"WITH RECURSIVE {_reach(f'SELECT chrom, left_pos AS u, right_pos AS v FROM ({_CANDIDATES}) WHERE {_GATE}')} SELECT * FROM reach",
    "read_votes": _VOTES,
    "read_assignment_totals": f"SELECT chrom, assignment, count(*) AS reads FROM ({_VOTES}) GROUP BY chrom, assignment",
    "site_summary": _SUMMARY,
    "support_filtered_sites": f"""
SELECT chrom, pos, alt_reads, ref_reads, label FROM ({_SUMMARY})
WHERE alt_reads > 3 OR (alt_reads + ref_reads > 0 AND 100 * alt_reads > 8 * (alt_reads + ref_reads))""",
    "edges_clean": _EDGES,
    "edge_order": f"""
WITH RECURSIVE p AS ({_EDGES}), {_reach("SELECT chrom, u, v FROM p")}
SELECT p.chrom, r.component, CAST(row_number() OVER (PARTITION BY p.chrom, r.component
         ORDER BY reliability DESC, relation_rank, alt_alt + alt_ref + ref_alt DESC, least(u, v), greatest(u, v), u) AS int) AS accept_order,
       u, v, relation, reliability
FROM p JOIN reach r ON r.chrom = p.chrom AND r.pos = p.u""",
    "edge_haplotype_summary": f"""
WITH x AS (SELECT chrom, relation, CASE WHEN hap_u IN ('HP1', 'HP2') THEN hap_u ELSE 'UNKNOWN' END AS hu,
                  CASE WHEN hap_v IN ('HP1', 'HP2') THEN hap_v ELSE 'UNKNOWN' END AS hv FROM ({_EDGES}))
{_COUNTERS}""",
    "component_stats": f"{_STATS} SELECT n.*, s.* EXCLUDE (chrom, component, total_edges), max_pos - min_pos AS span_bp FROM n JOIN s USING (chrom, component)",
    "cross_haplotype_filter": f"""
WITH p AS ({_EDGES}), a AS ({_sites_of("p")})
SELECT p.chrom, p.u, p.v, p.relation FROM p
LEFT JOIN a x ON x.chrom = p.chrom AND x.pos = p.u LEFT JOIN a y ON y.chrom = p.chrom AND y.pos = p.v
WHERE NOT coalesce((x.haplotype = 'HP1' AND y.haplotype = 'HP2') OR (x.haplotype = 'HP2' AND y.haplotype = 'HP1'), false)""",
    "nearest_neighbour_thinning": f"""
WITH p AS (SELECT DISTINCT chrom, u, v FROM ({_EDGES}) WHERE relation = 'cooccurring' AND u <> v)
SELECT DISTINCT chrom, u, v FROM (
  SELECT chrom, u, min(v) AS v FROM p GROUP BY chrom, u UNION ALL SELECT chrom, max(u), v FROM p GROUP BY chrom, v)""",
    "condensed_nodes": f"""
WITH RECURSIVE {_CLUSTERS}, a AS ({_sites_of("p")}),
m AS (SELECT c.chrom, c.cluster, c.pos, a.vaf, coalesce(a.haplotype, 'UNKNOWN') AS h FROM clusters c LEFT JOIN a ON a.chrom = c.chrom AND a.pos = c.pos),
t AS (SELECT chrom, cluster, arg_min(h, (-n, h)) AS haplotype FROM (SELECT chrom, cluster, h, count(*) AS n FROM m GROUP BY ALL) GROUP BY chrom, cluster)
SELECT m.chrom, m.cluster, count(*) AS cluster_size, CAST(quantile_disc(pos, 0.5) AS bigint) AS position, min(pos) AS position_min, round(median(vaf), 6) AS vaf,
       any_value(t.haplotype) AS haplotype,
       count(*) FILTER (h = 'MIXED') > 0 OR (count(*) FILTER (h = 'HP1') > 0 AND count(*) FILTER (h = 'HP2') > 0) AS mixed_haplotypes,
       concat(count(*) FILTER (h = 'HP1'), '/', count(*) FILTER (h = 'HP2'), '/', count(*) FILTER (h NOT IN ('HP1', 'HP2'))) AS hp_counts
FROM m JOIN t ON t.chrom = m.chrom AND t.cluster = m.cluster GROUP BY m.chrom, m.cluster""",
    "condensed_edges": f"""
WITH RECURSIVE {_CLUSTERS},
b AS (SELECT p.*, x.cluster AS cu, y.cluster AS cv, p.relation = 'divergent' AND x.cluster > y.cluster AS turn FROM p
      JOIN clusters x ON x.chrom = p.chrom AND x.pos = p.u JOIN clusters y ON y.chrom = p.chrom AND y.pos = p.v
      WHERE p.relation <> 'cooccurring' AND x.cluster <> y.cluster)
SELECT chrom, CASE WHEN turn THEN cv ELSE cu END AS source, CASE WHEN turn THEN cu ELSE cv END AS target, relation, max(reliability) AS reliability,
       CAST(sum(alt_alt) AS bigint) AS alt_alt, CAST(sum(CASE WHEN turn THEN ref_alt ELSE alt_ref END) AS bigint) AS alt_ref,
       CAST(sum(CASE WHEN turn THEN alt_ref ELSE ref_alt END) AS bigint) AS ref_alt, CAST(sum(ref_ref) AS bigint) AS ref_ref, count(*) AS support_edge_count
FROM b GROUP BY ALL""",
    "relation_dedup": f"""
WITH RECURSIVE {_CLUSTERS},
ends AS (SELECT p.*, u AS node, v AS other FROM p WHERE relation <> 'cooccurring' UNION ALL SELECT p.*, v, u FROM p WHERE relation <> 'cooccurring'),
r AS (SELECT e.chrom, e.u, e.v, e.relation, row_number() OVER (PARTITION BY e.chrom, e.relation, e.node, c.cluster
        ORDER BY alt_alt + alt_ref + ref_alt DESC, reliability DESC, u DESC, v DESC) AS k
      FROM ends e JOIN clusters c ON c.chrom = e.chrom AND c.pos = e.other)
SELECT chrom, u, v, relation FROM r GROUP BY ALL HAVING max(k) = 1""",
    "graph_layout": f"""
WITH RECURSIVE p AS ({_PROPER}), {_reach("SELECT chrom, u, v FROM p")}, a AS ({_sites_of("p")}),
m AS (SELECT r.chrom, r.pos, r.component, CAST(floor(coalesce(a.vaf, 0.0) / 0.05) AS bigint) AS lvl,
             row_number() OVER (PARTITION BY r.chrom, r.component ORDER BY r.pos) AS k FROM reach r JOIN a ON a.chrom = r.chrom AND a.pos = r.pos),
d AS (SELECT *, dense_rank() OVER (PARTITION BY chrom, component ORDER BY lvl) - 1 AS step FROM m),
c AS (SELECT chrom, component, count(*) AS n, max(step) AS steps FROM d GROUP BY ALL),
o AS (SELECT *, coalesce(sum((n - 1) * 80.0 + 220.0) OVER (PARTITION BY chrom ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM c)
SELECT d.chrom, d.pos, d.component, CAST(o.start + (k - 1) * 80.0 AS double) AS x, CAST((o.steps / 2.0 - step) * 70.0 AS double) AS y
FROM d JOIN o ON o.chrom = d.chrom AND o.component = d.component""",
    "topn_components": f"""{_STATS},
k AS (SELECT *, timing_edges + divergent_edges AS interesting_edges FROM s),
o AS (SELECT *, CASE WHEN regexp_full_match(chrom, '[0-9]+') THEN CAST(chrom AS int) WHEN chrom = 'X' THEN 23 WHEN chrom = 'Y' THEN 24
                     WHEN chrom IN ('M', 'MT') THEN 25 ELSE 1000 END AS ck FROM k WHERE interesting_edges > 0),
z AS (SELECT 'timing_edges' AS ranking, timing_edges AS score, * FROM o UNION ALL SELECT 'interesting_edges', interesting_edges, * FROM o
      UNION ALL SELECT 'total_edges', total_edges, * FROM o)
SELECT * FROM (
  SELECT ranking, CAST(row_number() OVER (PARTITION BY ranking ORDER BY score DESC, ck, CASE WHEN ck = 1000 THEN chrom ELSE '' END, component) AS int) AS rank,
         chrom, component, timing_edges, interesting_edges, total_edges FROM z) WHERE rank <= 50""",
    "global_summary": f"""{_STATS},
g AS (SELECT chrom, count(*) AS components, avg(max_pos - min_pos) AS mean_span, median(max_pos - min_pos) AS median_span, avg(num_nodes) AS mean_nodes,
             array_to_string(list_slice(list_sort(list(max_pos - min_pos), 'DESC'), 1, 10), ',') AS top_spans,
             array_to_string(list_slice(list_sort(list(num_nodes), 'DESC'), 1, 10), ',') AS top_nodes FROM n GROUP BY chrom)
SELECT {canonical_chrom_sql("c.chrom")} AS chrom, c.contig_order, coalesce(components, 0) AS components, round(coalesce(mean_span, 0.0), 1) AS mean_span,
       round(coalesce(median_span, 0.0), 1) AS median_span, round(coalesce(mean_nodes, 0.0), 1) AS mean_nodes,
       coalesce(top_spans, '') AS top_spans, coalesce(top_nodes, '') AS top_nodes
FROM contigs c LEFT JOIN g ON g.chrom = {canonical_chrom_sql("c.chrom")}""",
    "interval_coverage": f"""
WITH s AS (SELECT chrom, left_pos AS s, right_pos AS e FROM ({_CANDIDATES})),
a AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM a),
c AS (SELECT chrom, k, max(e) - min(s) + 1 AS bp FROM b GROUP BY ALL)
SELECT chrom, CAST(sum(bp) AS bigint) AS covered_bp, (SELECT CAST(sum(e - s + 1) AS bigint) FROM s WHERE s.chrom = c.chrom) AS summed_bp FROM c GROUP BY chrom""",
    "cn_best_segment": _best_cn(
        f"SELECT DISTINCT bed_id AS owner, {_C} AS chrom, start_pos + 1 AS first, end_pos AS last FROM excluded_regions "
        "WHERE start_pos >= 0 AND end_pos > start_pos AND bed_id IS NOT NULL"
    ),
    "cn_merged_segments": f"""
SELECT owner, chrom, first AS start, last AS "end", max(state) FILTER (hp = 'hp1') AS cn_hp1, max(state) FILTER (hp = 'hp2') AS cn_hp2, sum(state) AS cn_total
FROM ({_best_cn(_CUTS)}) GROUP BY owner, chrom, first, last""",
    "component_copy_number": f"""
WITH RECURSIVE p AS ({_PROPER}), {_reach("SELECT chrom, u, v FROM p")},
n AS (SELECT chrom, component, min(pos) AS first, max(pos) AS last FROM reach GROUP BY chrom, component),
x AS (SELECT DISTINCT o.owner, n.chrom, n.first, n.last, n.component FROM n JOIN (SELECT DISTINCT owner, chrom FROM ({_CN})) o ON o.chrom = n.chrom),
b AS ({_best_cn("SELECT DISTINCT owner, chrom, first, last FROM x")})
SELECT owner, chrom, x.component, max(state) FILTER (hp = 'hp1') AS cn_hp1, max(state) FILTER (hp = 'hp2') AS cn_hp2, sum(state) AS cn_total
FROM b JOIN x USING (owner, chrom, first, last) GROUP BY owner, chrom, x.component""",
    "site_label_tally": f"""
SELECT chrom, CAST(count(*) FILTER (label = 'HP1') AS bigint) AS hp1, CAST(count(*) FILTER (label = 'HP2') AS bigint) AS hp2,
       CAST(count(*) FILTER (label = 'MIXED') AS bigint) AS mixed, CAST(count(*) FILTER (label = 'UNKNOWN') AS bigint) AS unknown, count(*) AS sites
FROM ({_SUMMARY}) WHERE alt_reads > 3 OR (alt_reads + ref_reads > 0 AND 100 * alt_reads > 8 * (alt_reads + ref_reads))
GROUP BY ROLLUP (chrom)""",
    "relation_tally": f"""
WITH x AS (SELECT chrom, relation, coalesce(hap_u = hap_v AND hap_u IN ('HP1', 'HP2'), false) AS same,
                  CASE relation WHEN 'cooccurring' THEN alt_alt >= 1 WHEN 'timing' THEN alt_alt >= 1 AND alt_ref >= 1 ELSE alt_ref >= 1 AND ref_alt >= 1 END AS shown
           FROM ({_EDGES}))
SELECT chrom, relation, count(*) AS inferred, CAST(count(*) FILTER (shown) AS bigint) AS supported,
       CAST(count(*) FILTER (shown AND (relation <> 'divergent' OR same)) AS bigint) AS same_haplotype
FROM x GROUP BY chrom, relation""",
    "component_sizes": f"""
WITH RECURSIVE {_reach(f'SELECT chrom, left_pos AS u, right_pos AS v FROM ({_CANDIDATES}) WHERE {_GATE}')}
SELECT chrom, sites, count(*) AS groups FROM (SELECT chrom, component, count(*) AS sites FROM reach GROUP BY chrom, component) GROUP BY chrom, sites""",
    "relation_lines_read": f"""
SELECT chrom, u, v, relation, reliability, {_known("best_score", "0.0")}, {_known("margin", "0.0")}, alt_alt, alt_ref, ref_alt, ref_ref,
       {_known("vaf_u", "0.0")}, {_known("vaf_v", "0.0")}, {_known("hvaf_u", "NULL")}, {_known("hvaf_v", "NULL")}, hap_u, hap_v, {_said("hp_reads_u")}, {_said("hp_reads_v")}
FROM ({_EDGES})""",
    "site_table": f"SELECT {', '.join(f'{c} AS {n}' for n, c in reports.SITE_COLUMNS.items())} FROM ({_SUMMARY})",
    "vote_table": f"""
SELECT chrom AS CHROM, read_id AS READ_NAME, hp1 AS HP1_GERMLINE_VOTES, hp2 AS HP2_GERMLINE_VOTES, hp1 + hp2 AS TOTAL_INFORMATIVE_GERMLINE_MUTATIONS,
       CASE WHEN hp1 + hp2 > 0 THEN round(CAST(least(hp1, hp2) AS double) / (hp1 + hp2), 6) END AS MINORITY_FRACTION, assignment AS ASSIGNMENT FROM ({_VOTES})""",
    "connectivity_of_first_edges": f"""
WITH d AS ({_FIRST}), e AS ({_EDGES}), s AS (SELECT DISTINCT chrom, pos FROM ({_SITES})),
r AS (SELECT chrom, u AS pos FROM e UNION SELECT chrom, v FROM e),
g AS (SELECT chrom, u AS pos FROM d WHERE taken UNION SELECT chrom, v FROM d WHERE taken),
t AS (SELECT chrom, u AS pos FROM d WHERE taken AND relation = 'timing' UNION SELECT chrom, v FROM d WHERE taken AND relation = 'timing'),
c AS (SELECT chrom, 'total_sites' AS k FROM s UNION ALL SELECT chrom, 'in_relations' FROM r UNION ALL SELECT chrom, 'in_graph' FROM g
      UNION ALL SELECT chrom, 'with_timing' FROM t UNION ALL SELECT chrom, 'accepted_edges' FROM d WHERE taken
      UNION ALL SELECT chrom, 'timing_edges' FROM d WHERE taken AND relation = 'timing')
SELECT *, in_relations - in_graph AS orphaned, total_sites - in_relations AS singleton FROM (
  SELECT chrom, {", ".join(f"CAST(count(*) FILTER (k = '{k}') AS bigint) AS {k}" for k in ("total_sites", "in_relations", "in_graph", "with_timing", "accepted_edges", "timing_edges"))}
  FROM c GROUP BY ROLLUP (chrom))""",
    "chains_of_best_arcs": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT * FROM ({_FIRST}) WHERE taken), {_reach("SELECT chrom, u, v FROM d WHERE relation = 'cooccurring'")},
h AS (SELECT n.chrom, n.pos, coalesce(r.component, n.pos) AS cluster
      FROM (SELECT chrom, u AS pos FROM d UNION SELECT chrom, v FROM d) n LEFT JOIN reach r ON r.chrom = n.chrom AND r.pos = n.pos),
k AS (SELECT d.chrom, x.cluster AS s, y.cluster AS t, max(reliability) AS w, count(*) AS n FROM d
      JOIN h x ON x.chrom = d.chrom AND x.pos = d.u JOIN h y ON y.chrom = d.chrom AND y.pos = d.v WHERE relation = 'timing' AND x.cluster < y.cluster GROUP BY ALL),
a AS MATERIALIZED (SELECT chrom, s, t FROM k QUALIFY row_number() OVER (PARTITION BY chrom, s ORDER BY w DESC, n DESC, t) = 1),
p AS (SELECT chrom, t AS at, [CAST(s AS varchar), CAST(t AS varchar)] AS path FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.chrom = a.chrom AND b.t = a.s)
      UNION ALL SELECT p.chrom, a.t, list_append(p.path, CAST(a.t AS varchar)) FROM p JOIN a ON a.chrom = p.chrom AND a.s = p.at)
SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY path) - 1 AS chain_index, array_to_string(path, '>') AS path FROM p
WHERE len(path) >= 3 AND NOT EXISTS (SELECT 1 FROM a WHERE a.chrom = p.chrom AND a.s = p.at)""",
    "simplified_proposals": f"""
WITH RECURSIVE x AS MATERIALIZED (SELECT * FROM ({_WITH_UNKNOWN}) WHERE u <> v), n AS ({_sites_of("x")}),
q AS MATERIALIZED (SELECT x.* FROM x LEFT JOIN n a ON a.chrom = x.chrom AND a.pos = x.u LEFT JOIN n b ON b.chrom = x.chrom AND b.pos = x.v
      WHERE NOT coalesce((a.haplotype = 'HP1' AND b.haplotype = 'HP2') OR (a.haplotype = 'HP2' AND b.haplotype = 'HP1'), false)),
{_reach("SELECT chrom, u, v FROM q WHERE relation = 'cooccurring'")},
h AS MATERIALIZED (SELECT n.chrom, n.pos, coalesce(r.component, n.pos) AS cluster
      FROM (SELECT chrom, u AS pos FROM q UNION SELECT chrom, v FROM q) n LEFT JOIN reach r ON r.chrom = n.chrom AND r.pos = n.pos),
thin AS MATERIALIZED (SELECT DISTINCT chrom, u, v FROM (
  SELECT chrom, u, min(v) AS v FROM q WHERE relation = 'cooccurring' GROUP BY chrom, u UNION ALL SELECT chrom, max(u), v FROM q WHERE relation = 'cooccurring' GROUP BY chrom, v)),
{_reach("SELECT chrom, u, v FROM thin", "t_")},
piece AS (SELECT h.chrom, h.cluster, coalesce(r.component, h.pos) AS piece, min(h.pos) AS first, max(h.pos) AS last
          FROM h LEFT JOIN t_reach r ON r.chrom = h.chrom AND r.pos = h.pos GROUP BY ALL),
bridge AS (SELECT chrom, last AS u, lead(first) OVER (PARTITION BY chrom, cluster ORDER BY first) AS v FROM piece),
ends AS (SELECT q.*, u AS node, v AS other FROM q WHERE relation IN ('timing', 'divergent') UNION ALL SELECT q.*, v, u FROM q WHERE relation IN ('timing', 'divergent')),
placed AS (SELECT e.chrom, e.u, e.v, e.relation, e.reliability, row_number() OVER (PARTITION BY e.chrom, e.relation, e.node, h.cluster
             ORDER BY alt_alt + alt_ref + ref_alt DESC, reliability DESC, u DESC, v DESC) AS k FROM ends e JOIN h ON h.chrom = e.chrom AND h.pos = e.other)
SELECT t.chrom, t.u, t.v, 'cooccurring' AS relation, max(q.reliability) AS reliability, false AS inferred
FROM thin t JOIN q ON q.chrom = t.chrom AND q.u = t.u AND q.v = t.v AND q.relation = 'cooccurring' GROUP BY t.chrom, t.u, t.v
UNION ALL SELECT chrom, u, v, 'cooccurring', 0.0, true FROM bridge WHERE v IS NOT NULL
UNION ALL SELECT chrom, u, v, relation, any_value(reliability), false FROM placed GROUP BY chrom, u, v, relation HAVING max(k) = 1
UNION ALL SELECT chrom, u, v, relation, reliability, false FROM q WHERE relation = 'unknown'""",
    "regular_window_sites": f"""{_REGULAR}
SELECT s.chrom, s.component, min(s.pos) OVER (PARTITION BY s.chrom, s.component, s.first) AS first, CAST(s.place AS int) AS place, s.pos
FROM s JOIN whole ON whole.chrom = s.chrom AND whole.component = s.component AND whole.first = s.first""",
    "regular_windows": f"{_REGULAR} SELECT chrom, component, array_to_string(sites, ',') AS sites FROM regular",
    "all_windows": f"{_WINDOWS} SELECT chrom, component, window_id, array_to_string(sites, ',') AS sites FROM every",
    "pair_window_assignment": f"""{_WINDOWS},
x AS (SELECT w.*, CAST(i AS int) AS i, CAST(j AS int) AS j, sites[i + 1] AS left_pos, sites[j + 1] AS right_pos, (len(sites) - 1) / 2.0 AS mid
      FROM every w, range({WINDOW}) a(i), range({WINDOW}) b(j) WHERE i < j AND j < len(sites))
SELECT x.chrom, left_pos, right_pos, window_id, array_to_string(sites, ',') AS sites, i, j, count(*) OVER (PARTITION BY x.chrom, left_pos, right_pos) AS n_windows
FROM x JOIN gate ON gate.chrom = x.chrom AND gate.u = left_pos AND gate.v = right_pos
QUALIFY row_number() OVER (PARTITION BY x.chrom, left_pos, right_pos
  ORDER BY len(sites) DESC, abs(i - mid) + abs(j - mid), greatest(abs(i - mid), abs(j - mid)), sites[-1] - sites[1], x.sites) = 1""",
    "window_read_patterns": f"""{_WINDOWS},
x AS (SELECT chrom, window_id, unnest(sites) AS pos, generate_subscripts(sites, 1) - 1 AS i FROM every),
r AS (SELECT x.chrom, x.window_id, string_agg(printf('%d:%d:%.6f', i, allele, error), ',' ORDER BY i) AS pattern
      FROM x JOIN ({_RESOLVED}) o ON o.chrom = x.chrom AND o.pos = x.pos GROUP BY x.chrom, x.window_id, o.bam, o.read_id)
SELECT chrom, window_id, pattern, count(*) AS reads FROM r GROUP BY chrom, window_id, pattern""",
}
