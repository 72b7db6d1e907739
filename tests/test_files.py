import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusweave.config import PhaseConfig, check_chromosomes, check_regions
from locusweave.operators.axis import ranked, with_next
from locusweave.operators.observations import haplotype, outside_regions, resolve
from locusweave.sinks import tables as sinks
from locusweave.sources import variants
from locusweave.streaming.intervals import streamed_periods

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
chr1\t10\t.\ta\tG,T\t.\tPASS\t.\tGT\t1|0\t0|1
chr1\t11\t.\tA\tAG\t.\tq10;PASS\t.\tGT\t1|0\t0|1
chr1\t12\t.\tA\tC\t.\tlow\t.\tGT\t0|1\t0/1
chr1\t13\t.\tA\tC\t.\tpass\t.\tDP:GT\t3:0|1/1\t2:1|1
chr1\t14\t.\tA\t*\t.\tPASS\t.\tGT\t0|1\t0|1
"""


def test_variant_files(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    path = str(tmp_path / "x.vcf")
    records = variants.read_variants(spark, path)
    assert rows(variants.sample_names(spark, path)) == [(0, "S1"), (1, "S2")]
    kept = variants.passes(records)
    assert rows(kept, "pos") == [(10,), (11,), (13,), (14,)]
    assert variants.passes(records.where("pos = 12")).count() == 1  # no record says PASS
    assert rows(variants.somatic_sites(kept)) == [("chr1", 10, "A", "G"), ("chr1", 13, "A", "C")]
    assert rows(variants.phased_markers(kept)) == [("chr1", 13, "A", "C", 2)]
    assert rows(variants.phased_markers(records, 1)) == []


def test_region_files_and_exclusion(spark, tmp_path):
    (tmp_path / "x.bed").write_text("# c\n\nchr1 10\t20 note\nchr1\t20\t30\nchr1\tx\t3\n")
    regions = variants.read_regions(spark, str(tmp_path / "x.bed"))
    assert rows(regions) == [("chr1", 10, 20), ("chr1", 20, 30)]
    check_regions(regions)
    with pytest.raises(ValueError):
        check_regions(spark.createDataFrame([("1", 5, 5)], "chrom string, start_pos long, end_pos long"))
    sites = spark.createDataFrame([("chr1", p) for p in (10, 11, 30, 31)] + [("chr2", 15), ("chr1", None)], "chrom string, pos long")
    assert rows(outside_regions(sites, regions, bits=2), "pos", "chrom") == [(None, "chr1"), (10, "chr1"), (15, "chr2"), (31, "chr1")]
    contigs = spark.createDataFrame([("chr1",)], "chrom string")
    with pytest.raises(ValueError):
        check_chromosomes(sites, contigs, PhaseConfig())
    check_chromosomes(sites, contigs, PhaseConfig(exclude_chroms=("2",)))


def test_pileup_to_observations(spark):
    raw = spark.createDataFrame([(1, "1\t5\tA\t3\t.gT\tI+!\ta,b,c\t1\tG\t5\td"), (2, "bad"), (3, "1\t6\tA\t1\t.\tI\ta")], "line_id long, line string")
    sites = spark.createDataFrame([("1", 5, "A", "G")], "chrom string, pos long, ref string, alt string")
    got = rows(variants.pileup_observations(raw, sites, F.col("chrom")), "bam", "read_id", "allele", F.round("error", 4))
    assert got == [(0, "a", 0, 0.01), (0, "b", 1, 0.1), (0, "c", 2, 0.49), (1, "d", 1, 0.01)]
    kept = spark.createDataFrame([(0, 20), (4, 60), (256, 60), (2048, 60), (0, 19)], "flag int, mapq int")
    assert rows(variants.kept_alignments(kept)) == [(0, 20), (2048, 60)]


def test_resolution_and_labels(spark):
    data = [("1", "a", 5, 1, 0.2), ("1", "a", 5, 1, None), ("1", "a", 6, 1, 0.1), ("1", "a", 6, 0, 0.1), ("1", "b", 5, 0, None), ("1", "c", 5, 2, 0.1), ("1", "d", 5, 0, 1e-9), ("1", None, 5, 0, 0.1), ("1", "e", 5, 1, float("nan"))]
    df = spark.createDataFrame(data, "chrom string, read_id string, pos long, allele int, error double")
    assert rows(resolve(df, ["chrom", "read_id"])) == [("1", "a", 5, 1, 0.2), ("1", "b", 5, 0, 0.49), ("1", "d", 5, 0, 0.01), ("1", "e", 5, 1, 0.49)]
    votes = spark.createDataFrame([(17, 3), (16, 3), (1, 1), (1, 0), (0, 2), (5, 5)], "a long, b long")
    assert [r[0] for r in votes.select(haplotype(F.col("a"), F.col("b"), 2, "NONE")).collect()] == ["HP1", "MIXED", "MIXED", "NONE", "HP2", "MIXED"]


def test_axis(spark):
    data = [("a", p) for p in (5, 70_000, 70_001, 400_000)] + [("b", 9)]
    df = spark.createDataFrame(data, "k string, p long")
    assert rows(ranked(df, ["k"], "p"), "k", "p", "rank", "size") == [("a", 5, 1, 4), ("a", 70_000, 2, 4), ("a", 70_001, 3, 4), ("a", 400_000, 4, 4), ("b", 9, 1, 1)]
    assert rows(with_next(df, ["k"], "p", "n"), "k", "p", "n") == [("a", 5, 70_000), ("a", 70_000, 70_001), ("a", 70_001, 400_000), ("a", 400_000, None), ("b", 9, None)]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("1", 5, 0.5, "HP1")], "chrom string, pos long, vaf double, haplotype string")
    edges = spark.createDataFrame([("1", 5, 6, "timing", 1.5, 1, 2, 3, 4, "timing_cycle")], "chrom string, u long, v long, relation string, reliability double, alt_alt int, alt_ref int, ref_alt int, ref_ref int, reason string")
    sinks.write_edge_lines(edges, str(tmp_path / "e"), with_reason=True)
    assert rows(spark.read.text(str(tmp_path / "e"))) == [
        ("1 5 6 RELATION=timing VAF1=NA VAF2=NA ALT_ALT=1 ALT_REF=2 REF_ALT=3 REF_REF=4 TOTAL=10 HP_READS1=UNKNOWN HP_READS2=UNKNOWN RELIABILITY=1.5 BEST_SCORE=NA MARGIN=NA REASON=timing_cycle",)
    ]
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).where("data.directed and data.source = '5'").count() == 1
    sinks.write_tsv(nodes.withColumn("x", F.lit(None).cast("string")), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first().x == "NA"


def test_streamed_periods(spark, tmp_path):
    schema = "owner long, start_pos long, end_pos long"
    batches = [[(1, 5, 10), (1, 20, 30), (2, 1, 2)], [(1, 8, 21), (None, 3, 4), (1, 9, 9)], [(1, 40, 41)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    latest = {}

    def keep(df, epoch):
        new = {}
        for r in df.collect():
            new.setdefault((r.entity, r.block), []).append((r.kind, r.start_pos, r.end_pos))
        latest.update({k: sorted(v) for k, v in new.items()})

    query = streamed_periods(stream, ["owner"], "start_pos", "end_pos").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert latest == {('{"owner":1}', 0): [("gap", 30, 40), ("period", 5, 30), ("period", 40, 41)], ('{"owner":2}', 0): [("period", 1, 2)], ('{"owner":null}', 0): [("period", 3, 4)]}
