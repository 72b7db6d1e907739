import json

from conftest import rows

from locusweave.sinks import reports


def test_site_and_vote_tables(spark):
    sites = spark.createDataFrame(
        [("1", 5, 7, 1, 2, 0, 3, 1, 0, "0.333333", "0.000000", "HP1", "more")],
        "chrom string, pos bigint, total_coverage bigint, hp1_alt int, hp1_ref int, hp2_alt int, hp2_ref int, untagged_alt int, untagged_ref int, hp1_vaf string, hp2_vaf string, label string, other string",
    )
    table = reports.site_table(sites)
    assert table.columns[:5] == ["CHR", "POSITION", "TOTAL_COVERAGE", "HP1_SUPPORTING", "HP1_UNSUPPORTING"] and table.columns[-1] == "HP_ASSIGNMENT"
    assert rows(table) == [("1", 5, 7, 1, 2, 0, 3, 1, 0, "0.333333", "0.000000", "HP1")]
    votes = spark.createDataFrame([("1", "a", 2, 1, "MIXED"), ("1", "b", 0, 0, "UNASSIGNED"), (None, None, 0, 3, "HP2")], "chrom string, read_id string, hp1 bigint, hp2 bigint, assignment string")
    assert rows(reports.vote_table(votes), "READ_NAME", "TOTAL_INFORMATIVE_GERMLINE_MUTATIONS", "MINORITY_FRACTION") == [(None, 3, 0.0), ("a", 3, 0.333333), ("b", 0, None)]
    assert reports.site_table(sites.limit(0)).count() == 0 and reports.vote_table(votes.limit(0)).count() == 0


def test_condensed_graph(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("1", 5, 2, 5, 5, 0.25, "HP1", False, "2/0/0"), ("1", 90000000, 1, 90000000, 90000000, None, "UNKNOWN", False, "0/0/1")],
        "chrom string, cluster bigint, cluster_size bigint, position bigint, position_min bigint, vaf double, haplotype string, mixed_haplotypes boolean, hp_counts string",
    )
    edges = spark.createDataFrame(
        [("1", 5, 90000000, "timing", 2.5, 3, 2, 0, 1, 2)],
        "chrom string, source bigint, target bigint, relation string, reliability double, alt_alt bigint, alt_ref bigint, ref_alt bigint, ref_ref bigint, support_edge_count bigint",
    )
    reports.write_condensed_graph(nodes, edges, str(tmp_path / "g"))
    found = [json.loads(r["value"])["data"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    one = {d["id"]: d for d in found}
    assert one["90000000"]["position"] == "90000000" and "vaf" not in one["90000000"] and one["5"]["hp_counts(hp1/hp2/unk)"] == "2/0/0"
    edge = one["5-90000000-timing"]
    assert (edge["directed"], edge["read_counts"], edge["label"]) == (True, "3/2/0/1", "3/2/0/1 | rel=2.500 | n=2")
