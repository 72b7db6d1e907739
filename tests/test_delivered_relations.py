import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusweave.operators import copy_number, tallies
from locusweave.sources.alignments import aligned_blocks, alignment_observations
from locusweave.sources.relation_lines import edges_of_lines, read_relation_files, write_relation_files

LINES = [
    ("chr1 10 20 VAF1=0.5 VAF2=0.25 HVAF1=NA HVAF2=0.75 HAP1=HP1 HAP2=HP2 HP_READS1=3/0 ALT_ALT=4 ALT_REF=2 REF_ALT=1 REF_REF=9 RELIABILITY=3.5 BEST_SCORE=-7 MARGIN=3.5", "cooccurring"),
    ("chr1\t10  20 VAF1=0.5 VAF2=0.25 ALT_REF=2 REF_ALT=1 HAP1=HP1 note RELIABILITY=1 RELIABILITY=2", "right_before_left"),
    ("chr1 10 20", "left_before_right"),
    ("  ", "divergent"),
    (None, "divergent"),
    ("chr1 x 20 VAF1=1", "divergent"),
    ("chr1 10", "divergent"),
]


def test_relation_lines(spark):
    lines = spark.createDataFrame(LINES, "line string, file string")
    got = rows(
        edges_of_lines(lines, "line", F.col("file")),
        "relation", "u", "v", "reliability", "margin", "alt_alt", "alt_ref", "ref_alt", "vaf_u", "vaf_v", "hvaf_u", "hvaf_v", "hap_u", "hap_v", "hp_reads_u",
    )
    assert got == [
        ("cooccurring", 10, 20, 3.5, 3.5, 4, 2, 1, 0.5, 0.25, None, 0.75, "HP1", "HP2", "3/0"),
        ("timing", 10, 20, 0.0, 0.0, 0, 0, 0, 0.0, 0.0, None, None, None, None, None),
        ("timing", 20, 10, 2.0, 0.0, 0, 1, 2, 0.25, 0.5, None, None, None, "HP1", None),
    ]
    assert edges_of_lines(lines.limit(0), "line", F.col("file")).count() == 0


def test_relation_files_round_trip(spark, tmp_path):
    columns = "chrom string, u bigint, v bigint, relation string, reliability double, alt_alt bigint, alt_ref bigint, ref_alt bigint, ref_ref bigint, vaf_u double, vaf_v double, hap_u string, hap_v string"
    edges = spark.createDataFrame(
        [
            ("1", 5, 9, "timing", 0.1, 1, 2, 3, 4, 0.3, 0.1, "HP1", "HP2"),
            ("1", 9, 5, "timing", 0.2, 1, 2, 3, 4, 0.3, 0.1, "HP1", "HP2"),
            ("1", 5, 9, "divergent", 1e-7, 0, 2, 3, 4, 0.0, 1.0, "MIXED", "UNKNOWN"),
            ("2", 5, 9, "cooccurring", 12345.678, 7, 0, 0, 1, 0.0, 1.0, "HP1", "HP1"),
        ],
        columns,
    )
    write_relation_files(edges, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").glob("file=*")) == [f"file={n}" for n in ("cooccurring", "divergent", "left_before_right", "right_before_left")]
    assert rows(read_relation_files(spark, str(tmp_path / "r")), *edges.columns) == rows(edges)


def _plain(pos, cigar, site):
    """Place (from 1) in the read of the base at a site, or null, one operation at a time."""
    at, read, n = pos, 1, ""
    for c in cigar:
        if c.isdigit():
            n += c
            continue
        for _ in range(int(n)):
            if c in "M=X" and at == site:
                return read
            at += c in "M=XDN"
            read += c in "M=XIS"
        n = ""
    return None


ALIGNED = [
    ("1", 0, "a", 100, "3S4M2D3M1I2M", "TTTACGTACGTAC", "IIIIIIIIIIII!"),
    ("1", 0, "b", 101, "5M100N5M", "ACGTACGTAC", "*"),
    ("1", 1, "c", 102, "2H1=1X3M", "CCGTA", None),
    ("1", 1, "d", 103, "*", "ACG", "III"),
    ("1", 1, "e", None, "3M", "ACG", "III"),
    ("1", 1, "f", 103, None, "ACG", "III"),
    ("1", 1, "g", 103, "3M", "*", "III"),
    (None, 1, "h", 103, "3M", "ACG", "III"),
    ("1", 1, "i", 16370, "40M", "ACGT" * 10, "I" * 40),
]


def test_alignments_at_sites(spark):
    reads = spark.createDataFrame(ALIGNED, "chrom string, bam int, read_id string, pos bigint, cigar string, seq string, qual string")
    places = [*range(98, 120), 205, 206, 207, 16369, 16383, 16384, 16390, 16409, 16410]
    sites = spark.createDataFrame([("1", p, "A", "C") for p in places], "chrom string, pos bigint, ref string, alt string")
    got = rows(alignment_observations(reads.withColumn("ref", F.lit(1)), sites), "read_id", "pos", "allele")
    want = []
    for chrom, _, name, pos, cigar, seq, _ in ALIGNED:
        if None in (chrom, pos, cigar) or "*" in (cigar, seq):
            continue
        for site in places:
            if (k := _plain(pos, cigar, site)) is not None:
                want.append((name, site, {"A": 0, "C": 1}.get(seq[k - 1], 2)))
    assert got == sorted(want) and len({name for name, *_ in got}) == 4
    errors = dict(((r, p), e) for r, p, e in rows(alignment_observations(reads, sites), "read_id", "pos", "error"))
    assert errors["a", 100] == pytest.approx(0.01) and errors["a", 110] == 0.49 and errors["b", 101] == 0.49 and errors["c", 102] == 0.49
    assert alignment_observations(reads, sites.limit(0)).count() == 0
    blocks = reads.where("read_id = 'a'").select(aligned_blocks(F.col("pos"), F.col("cigar")).alias("b")).first()["b"]
    assert [tuple(b) for b in blocks] == [(100, 103, 4), (106, 108, 8), (109, 110, 12)]


def test_tallies(spark):
    sites = spark.createDataFrame([("1", "hp1 "), ("1", None), ("2", "HP2"), ("2", "odd"), (None, "MIXED")], "chrom string, label string")
    assert rows(tallies.label_tally(sites, F.col("label")), "chrom", "hp1", "hp2", "mixed", "unknown", "sites") == [
        (None, 1, 1, 1, 2, 5),
        ("1", 1, 0, 0, 1, 2),
        ("2", 0, 1, 0, 1, 2),
    ]
    edges = spark.createDataFrame([("1", "divergent", True, None), ("1", "divergent", True, True), ("1", "timing", True, False), ("1", "timing", None, True)], "chrom string, relation string, s boolean, a boolean")
    assert rows(tallies.relation_tally(edges, F.col("s"), F.col("a"))) == [("1", "divergent", 2, 2, 1), ("1", "timing", 2, 1, 1)]
    members = spark.createDataFrame([("1", 1), ("1", 1), ("1", 5), ("1", 5), ("2", 1)], "chrom string, component int")
    assert rows(tallies.size_histogram(members, ["chrom", "component"])) == [("1", 2, 2), ("2", 1, 1)]
    assert tallies.size_histogram(members.limit(0), ["chrom", "component"]).count() == 0


def test_best_segment_of_each_profile(spark):
    spans = spark.createDataFrame([("1", 7, 10, 20)], "chrom string, span int, first bigint, last bigint")
    parts = [("x", "1", "hp1", 1, 15, 2.0, 0.5), ("x", "1", "hp1", 16, 30, 3.0, 0.5), ("x", "1", "hp2", 1, 30, None, None), ("y", "1", "hp2", 20, 30, 1.0, None), ("z", "1", "hp1", 21, 30, 9.0, 1.0)]
    segments = spark.createDataFrame(parts, "owner string, chrom string, hp string, start bigint, end bigint, state double, confidence double")
    found = copy_number.annotated_spans(spans, segments, ["chrom"], ("owner",))
    assert rows(found, "owner", "span", "cn_hp1", "cn_hp2", "cn_total") == [("x", 7, 2.0, None, 2.0), ("y", 7, None, 1.0, 1.0)]
