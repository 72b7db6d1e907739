"""The simplified graph: fewer edges between the same clusters, and rankings of its components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.chrom import graph_sort_key
from locusweave.operators.axis import with_next
from locusweave.operators.components import components


def without_cross_haplotype(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """Drops every edge that joins an HP1 site with an HP2 site, whatever its relation."""
    label = lambda end: annotations.select("chrom", F.col("pos").alias(end), F.col("haplotype").alias(f"__{end}"))
    both = edges.join(label("u"), ["chrom", "u"], "left").join(label("v"), ["chrom", "v"], "left")
    crossing = F.array_sort(F.array("__u", "__v")) == F.array(F.lit("HP1"), F.lit("HP2"))
    return both.where(~F.coalesce(crossing, F.lit(False))).drop("__u", "__v")


def _mirrored(edges: DataFrame) -> DataFrame:
    end = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    return edges.withColumn("__e", F.explode(F.array(end("u", "v"), end("v", "u")))).withColumns({"node": F.col("__e.node"), "other": F.col("__e.other")}).drop("__e")


def nearest_neighbours(edges: DataFrame) -> DataFrame:
    """Of the cooccurring edges those to a site's nearest partner on either side, once each."""
    ends = _mirrored(edges.where("relation = 'cooccurring' and u <> v").select("chrom", "u", "v").distinct())
    near = ends.groupBy("chrom", "node").agg(
        F.min(F.when(F.col("other") > F.col("node"), F.col("other"))).alias("right"),
        F.max(F.when(F.col("other") < F.col("node"), F.col("other"))).alias("left"),
    )
    picked = near.select("chrom", "node", F.explode(F.array("right", "left")).alias("other")).where("other is not null")
    return picked.select("chrom", F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def bridges(thinned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges that hold the pieces of a thinned cluster together: from the last site of each piece
    to the first of the next. ``clusters`` has ``chrom, pos, cluster``."""
    found = components(thinned, ["chrom"], "u", "v").withColumnRenamed("vertex", "pos")
    pieces = (
        clusters.join(found, ["chrom", "pos"], "left")
        .withColumn("piece", F.coalesce("component", "pos"))
        .groupBy("chrom", "cluster", "piece")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    following = with_next(pieces, ["chrom", "cluster"], "first", "v")
    return following.where("v is not null").select("chrom", F.col("last").alias("u"), "v")


def fragmented(thinned: DataFrame, clusters: DataFrame) -> DataFrame:
    """``chrom, cluster, pieces`` of the clusters that thinning took apart."""
    found = components(thinned, ["chrom"], "u", "v").withColumnRenamed("vertex", "pos")
    piece = F.coalesce("component", "pos")
    counted = clusters.join(found, ["chrom", "pos"], "left").groupBy("chrom", "cluster").agg(F.count_distinct(piece).alias("pieces"))
    return counted.where("pieces > 1")


def check_nodes(edges: DataFrame, annotations: DataFrame) -> None:
    """Raises if an end of an edge is no node, or a node is there more than once."""
    ends = edges.select("chrom", F.explode(F.array("u", "v")).alias("pos")).distinct()
    if ends.join(annotations, ["chrom", "pos"], "left_anti").limit(1).count():
        raise ValueError("an edge ends at a site that is no node")
    if annotations.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a node is there more than once")


def best_per_cluster(edges: DataFrame, relation: str, clusters: DataFrame) -> DataFrame:
    """Edges of ``relation`` that are the best of their site towards the other end's cluster, seen
    from both ends: by informative reads, reliability, then the edge's positions."""
    home = clusters.select("chrom", F.col("pos").alias("other"), F.col("cluster").alias("towards"))
    rank = Window.partitionBy("chrom", "node", "towards").orderBy(
        F.desc(F.col("alt_alt") + F.col("alt_ref") + F.col("ref_alt")), F.desc("reliability"), F.desc("u"), F.desc("v")
    )
    own = edges.where(F.col("relation") == relation)
    ends = _mirrored(own).join(home, ["chrom", "other"], "left").withColumn("towards", F.coalesce("towards", "other"))
    losers = ends.withColumn("__r", F.row_number().over(rank)).where("__r > 1").select("chrom", "u", "v").distinct()
    return own.join(losers, ["chrom", "u", "v"], "left_anti")


def clusters_of(edges: DataFrame) -> DataFrame:
    """``chrom, pos, cluster``: cooccurring sites share the cluster of their first position; a site
    without a cooccurring edge is a cluster of its own."""
    nodes = edges.select("chrom", F.explode(F.array("u", "v")).alias("pos")).distinct()
    found = components(edges.where("relation = 'cooccurring'"), ["chrom"], "u", "v").withColumnsRenamed({"vertex": "pos", "component": "cluster"})
    return nodes.join(found, ["chrom", "pos"], "left").withColumn("cluster", F.coalesce("cluster", "pos"))


def simplified(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """``chrom, u, v, relation, reliability, inferred`` of the simplified graph. ``edges`` are all
    edges of the exported graph, rejected ones under the relation ``unknown``."""
    kept = without_cross_haplotype(edges, annotations)
    clusters = clusters_of(kept)
    thin = nearest_neighbours(kept)
    strength = kept.where("relation = 'cooccurring'").groupBy("chrom", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("reliability").alias("reliability"))
    parts = [
        thin.join(strength, ["chrom", "u", "v"]).select("chrom", "u", "v", F.lit("cooccurring").alias("relation"), "reliability", F.lit(False).alias("inferred")),
        bridges(thin, clusters.where(F.col("cluster").isNotNull())).select(
            "chrom", "u", "v", F.lit("cooccurring").alias("relation"), F.lit(0.0).alias("reliability"), F.lit(True).alias("inferred")
        ),
        *(
            best_per_cluster(kept, r, clusters).select("chrom", "u", "v", F.lit(r).alias("relation"), "reliability", F.lit(False).alias("inferred"))
            for r in ("timing", "divergent")
        ),
        kept.where("relation = 'unknown'").select("chrom", "u", "v", "relation", "reliability", F.lit(False).alias("inferred")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_components(graph: DataFrame, n: int) -> DataFrame:
    """The first ``n`` components in each of three rankings (timing edges, timing and divergent
    edges, all edges), among those with a timing or divergent edge."""
    found = components(graph, ["chrom"], "u", "v").withColumnRenamed("vertex", "u")
    tallied = graph.select("chrom", "u", "relation").join(found, ["chrom", "u"]).groupBy("chrom", "component").agg(
        F.count_if(F.col("relation") == "timing").alias("timing_edges"),
        F.count_if(F.col("relation").isin("timing", "divergent")).alias("interesting_edges"),
        F.count(F.lit(1)).alias("total_edges"),
    )
    # The component is named by its first position, which also breaks ties.
    of = tallied.where("interesting_edges > 0").select(
        "*", F.explode(F.array(*(F.struct(F.lit(k).alias("ranking"), F.col(k).alias("score")) for k in ("timing_edges", "interesting_edges", "total_edges")))).alias("s")
    )
    order = Window.partitionBy("s.ranking").orderBy(F.desc("s.score"), graph_sort_key(F.col("chrom")), "component")
    return of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        "s.ranking", "rank", "chrom", "component", "timing_edges", "interesting_edges", "total_edges"
    )
