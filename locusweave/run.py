"""From files to graphs in one call.

    python -m locusweave.run --somatic-vcf S.vcf.gz --alignments reads.parquet --output-dir OUT

Alignments are a table with ``chrom, bam, read_id, flag, mapq, pos, cigar, seq, qual``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.config import PhaseConfig, check_chromosomes, check_regions
from locusweave.functions.chrom import canonical_chrom, graph_sort_key, is_standard
from locusweave.operators.copy_number import tracks
from locusweave.operators.intervals import periods_and_gaps
from locusweave.operators.observations import clean_sites
from locusweave.plans.pipeline import build_graphs, infer
from locusweave.session import settle
from locusweave.sinks import reports
from locusweave.sinks.tables import write_edge_lines, write_graph, write_tsv
from locusweave.sources import variants
from locusweave.sources.alignments import alignment_observations
from locusweave.sources.delivered_lines import parse_copy_number
from locusweave.sources.relation_lines import write_relation_files

READ = ["chrom", "bam", "read_id"]


def _canonical(df: DataFrame) -> DataFrame:
    return df.where(is_standard(F.trim("chrom"))).withColumn("chrom", canonical_chrom(F.col("chrom")))


def named_alignments(alignments: DataFrame) -> DataFrame:
    """Kept alignments of the genome proper, each a read of its own: a name that occurs again, as
    with supplementary alignments, is told apart by place and shape."""
    kept = _canonical(variants.kept_alignments(alignments))
    return kept.withColumn("read_id", F.concat_ws("/", "read_id", "flag", "pos", "cigar"))


def marker_calls(observed: DataFrame, markers: DataFrame) -> DataFrame:
    """Votes of reads at phased markers: ``read``, ``is_hp1``. Other bases do not vote."""
    at = markers.select("chrom", "pos", "alt_haplotype")
    hit = observed.where(F.col("allele").isin(0, 1)).join(at, ["chrom", "pos"])
    return hit.select(*READ, ((F.col("allele") == 1) == (F.col("alt_haplotype") == 1)).cast("int").alias("is_hp1"))


def phase(
    config: PhaseConfig,
    alignments: DataFrame,
    somatic: DataFrame,
    germline: DataFrame | None = None,
    sample: int = 0,
    regions: DataFrame | None = None,
    cn_lines: DataFrame | None = None,
    contigs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Everything that inference and graph building give, from variant records (``somatic`` and
    ``germline``, as :func:`variants.read_variants` reads them), alignments, excluded regions and
    the lines of a copy-number profile (``line_id, line``). ``contigs`` (``chrom, contig_order``)
    are the chromosomes that summaries list, also those without a site; a site on any other is an
    error. Without them they are the chromosomes of the sites."""
    if config.divergent_same_hp and germline is None:
        raise ValueError("divergent_same_hp needs germline variants")
    sites = settle(clean_sites(_canonical(variants.somatic_sites(variants.passes(somatic))), F.col("chrom")))
    reads = named_alignments(alignments)
    observed = settle(alignment_observations(reads, sites))
    marks = None
    if germline is not None:
        markers = settle(_canonical(variants.phased_markers(variants.passes(germline), sample)).dropDuplicates(["chrom", "pos"]))
        marks = marker_calls(alignment_observations(reads, markers), markers)
    apart = None
    if regions is not None:
        check_regions(regions)
        merged = periods_and_gaps(_canonical(regions), ["chrom"], "start_pos", "end_pos")
        apart = settle(merged.where("kind = 'period'").drop("kind"))
    found = infer(config, observed, sites, READ, marks, apart)
    proposals = settle(found["proposals"])
    if contigs is None:
        named = sites.select("chrom").distinct()
        # Only names of the genome proper are left, 25 at most.
        in_order = F.sort_array(F.collect_set(F.struct(graph_sort_key(F.col("chrom")).alias("key"), "chrom")))
        listed = named.agg(F.transform(in_order, lambda x: x["chrom"]).alias("all"))
        contigs = named.select("chrom", F.array_position(listed.scalar(), F.col("chrom")).cast("int").alias("contig_order"))
    else:
        contigs = _canonical(contigs).select("chrom", "contig_order")
        check_chromosomes(sites, contigs, config)
    cn = None
    if cn_lines is not None:
        rows = parse_copy_number(cn_lines).where("reason is null").select("row.*")
        cn = settle(tracks(rows, F.lit(0), canonical_chrom(F.col("chrom"))))
    return {**found, "proposals": proposals, **build_graphs(config, proposals, contigs, cn, found["kept_sites"])}


def write_results(out: dict[str, DataFrame], path: str) -> None:
    """Every table as parquet; the site and vote tables as tab-separated values; all calls and the
    proposals as relation files; accepted and rejected edges as lines; the full, simplified, ranked
    and condensed graphs as JSON lines. ``path`` must not hold anything yet."""
    spark = next(iter(out.values())).sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and len(files.listStatus(place)):
        raise ValueError(f"{path} is not empty")
    for name, df in out.items():
        df.write.parquet(f"{path}/tables/{name}")
    read = lambda name: spark.read.parquet(f"{path}/tables/{name}")
    write_tsv(reports.site_table(read("sites")), f"{path}/site_table")
    write_tsv(reports.vote_table(read("votes")), f"{path}/vote_table")
    write_relation_files(read("proposals"), f"{path}/relations")
    write_edge_lines(read("accepted"), f"{path}/accepted_edges")
    write_edge_lines(read("rejected"), f"{path}/rejected_edges", with_reason=True)
    write_graph(read("graph_nodes"), read("graph_edges"), f"{path}/graph")
    write_graph(read("simplified_nodes"), read("simplified"), f"{path}/simplified_graph")
    for ranking in ("timing_edges", "interesting_edges", "total_edges"):
        own = [read(t).where(F.col("ranking") == ranking) for t in ("top_nodes", "top_edges")]
        write_graph(*own, f"{path}/top_graphs/{ranking}", "chrom")
    reports.write_condensed_graph(read("condensed_nodes"), read("condensed_edges"), f"{path}/condensed_graph")


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="locusweave.run", description=__doc__.splitlines()[0])
    parser.add_argument("--somatic-vcf", required=True)
    parser.add_argument("--alignments", required=True, help="parquet table of alignments")
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--germline-vcf")
    parser.add_argument("--germline-vcf-sample-name")
    parser.add_argument("--exclude-regions-bed", action="append", default=[])
    parser.add_argument("--exclude-chrom", action="append", default=[])
    parser.add_argument("--cn-bed")
    parser.add_argument("--contigs", help="parquet table of chrom, contig_order")
    parser.add_argument("--divergent-same-hp", action="store_true")
    parser.add_argument("--top-components", type=int, default=50)
    parser.add_argument("--window-size", type=int, default=4)
    parser.add_argument("--window-stride", type=int, default=3)
    parser.add_argument("--error-digits", type=int, help="decimal places of errors in the tree fit, where scores are not whole")
    return parser.parse_args(given)


def _sample_place(spark: SparkSession, path: str, name: str | None) -> int:
    """The place of the named sample, which may be left out where there is only one."""
    names = variants.sample_names(spark, path)
    found = names.where(F.col("sample") == name) if name else names
    places = found.limit(2).collect()
    if len(places) != 1:
        raise ValueError(f"{path} has no single sample {name or ''}".rstrip())
    return places[0]["place"]


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    spark = SparkSession.builder.appName("locusweave").getOrCreate()
    config = PhaseConfig(args.window_size, args.window_stride, args.top_components, args.divergent_same_hp, tuple(args.exclude_chrom), args.error_digits)
    germline = variants.read_variants(spark, args.germline_vcf) if args.germline_vcf else None
    place = _sample_place(spark, args.germline_vcf, args.germline_vcf_sample_name) if args.germline_vcf else 0
    regions = variants.read_regions(spark, args.exclude_regions_bed) if args.exclude_regions_bed else None
    cn = spark.read.text(args.cn_bed).select(F.lit(None).cast("bigint").alias("line_id"), F.col("value").alias("line")) if args.cn_bed else None
    contigs = spark.read.parquet(args.contigs) if args.contigs else None
    out = phase(config, spark.read.parquet(args.alignments), variants.read_variants(spark, args.somatic_vcf), germline, place, regions, cn, contigs)
    write_results(out, args.output_dir)


if __name__ == "__main__":
    main()
