import random

import pytest
from conftest import rows

from locusweave import run

SITES = (1000, 1100, 1200, 1300, 9000)
MARKS = (1050, 1150)


def _files(spark, where):
    """Reads of two haplotypes; on the first, sites 1000 and 1100 come together and 1200 after."""
    rng = random.Random(5)
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n"
    (where / "s.vcf").write_text(head + "".join(f"chr7\t{p}\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\n" for p in SITES))
    (where / "g.vcf").write_text(head + f"chr7\t{MARKS[0]}\t.\tA\tG\t.\tPASS\t.\tGT\t1|0\nchr7\t{MARKS[1]}\t.\tA\tG\t.\tPASS\t.\tGT\t0|1\n")
    (where / "x.bed").write_text("chr7 8990 9010\n")
    (where / "cn.bed").write_text("chr7\t900\t2000\t30\t2\t0.9\t20\t1\t0.8\n")
    reads = []
    for k in range(60):
        hap, early, late = k % 2 + 1, rng.random() < 0.6, rng.random() < 0.5
        seq = ["A"] * 500
        shown = {1000: "C", 1100: "C", 1200: "C" if late else "A"} if hap == 1 and early else {1300: "C"} if hap == 2 else {}
        shown[MARKS[hap - 1]] = "G"
        for p, base in shown.items():
            seq[p - 950] = base
        reads.append(("chr7", 0, f"r{k}", 0, 60, 945, "5S500M", "T" * 5 + "".join(seq), "I" * 505))
    reads += [("chr7", 0, "r0", 256, 60, 945, "5S500M", "C" * 505, None), ("chrUn", 0, "z", 0, 60, 945, "500M", "C" * 500, None)]
    spark.createDataFrame(
        [(c, b, n, f, q, p + 5, g, s, u) for c, b, n, f, q, p, g, s, u in reads],
        "chrom string, bam int, read_id string, flag int, mapq int, pos bigint, cigar string, seq string, qual string",
    ).write.parquet(str(where / "reads.parquet"))


def test_from_files_to_graphs(spark, tmp_path):
    _files(spark, tmp_path)
    at = lambda name: str(tmp_path / name)
    run.main(
        ["--somatic-vcf", at("s.vcf"), "--alignments", at("reads.parquet"), "--output-dir", at("out"), "--germline-vcf", at("g.vcf"),
         "--exclude-regions-bed", at("x.bed"), "--cn-bed", at("cn.bed")]
    )
    read = lambda name: spark.read.parquet(at(f"out/tables/{name}"))
    assert rows(read("sites"), "chrom", "pos", "label") == [("7", 1000, "HP1"), ("7", 1100, "HP1"), ("7", 1200, "HP1"), ("7", 1300, "HP2")]
    assert {(a, n) for a, n in rows(read("votes").groupBy("assignment").count())} == {("HP1", 30), ("HP2", 30)}
    relation = {(u, v): r for u, v, r in rows(read("accepted"), "u", "v", "relation")}
    assert relation[1000, 1100] == "cooccurring" and relation[1000, 1200] == "timing" and relation[1000, 1300] == "divergent"
    assert rows(read("component_copy_number"), "cn_hp1", "cn_hp2", "cn_total") == [(2.0, 1.0, 3.0)]
    lines = [r["value"] for r in spark.read.text(at("out/relations")).collect()]
    assert any(x.startswith("7 1000 1100 VAF1=") for x in lines)
    assert spark.read.text(at("out/condensed_graph")).count() == read("condensed_nodes").count() + read("condensed_edges").count()


def test_sample_must_be_named(spark, tmp_path):
    (tmp_path / "g.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n")
    assert run._sample_place(spark, str(tmp_path / "g.vcf"), "S2") == 1
    for name in (None, "S3"):
        with pytest.raises(ValueError):
            run._sample_place(spark, str(tmp_path / "g.vcf"), name)
