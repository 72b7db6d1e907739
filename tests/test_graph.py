import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from locusweave.functions.chrom import canonical_chrom
from locusweave.operators import acceptance, chains, simplify
from locusweave.operators.acceptance import PhaseState
from locusweave.operators.components import components

C, T, D = "cooccurring", "timing", "divergent"
CASES = [
    ([(1, 1, C)], "self_loop"),
    ([(1, 2, T), (1, 2, D)], "pair_type_conflict"),
    ([(1, 2, T), (2, 1, T)], "pair_direction_conflict"),
    ([(1, 2, T), (1, 2, T)], None),
    ([(1, 2, T), (2, 3, C), (1, 3, C)], "cluster_merge_noncooccurring"),
    ([(1, 3, T), (2, 3, D), (1, 2, C)], "cluster_merge_pair_relation_conflict"),
    ([(1, 3, T), (3, 2, T), (1, 2, C)], "cluster_merge_pair_timing_direction_conflict"),
    ([(1, 3, T), (3, 4, T), (4, 2, T), (1, 2, C)], "cluster_merge_timing_cycle"),
    ([(1, 2, D), (1, 3, T), (2, 4, T), (3, 4, C)], "cluster_merge_divergent_shared_timing_descendant_conflict"),
    ([(1, 2, C), (1, 2, C), (2, 1, T)], "pair_type_conflict"),
    ([(1, 2, C), (2, 3, C), (1, 3, T)], "cluster_internal_timing"),
    ([(1, 2, C), (2, 3, D), (1, 3, T)], "cluster_pair_relation_conflict"),
    ([(1, 2, C), (3, 2, T), (1, 3, T)], "cluster_pair_timing_direction_conflict"),
    ([(1, 3, D), (2, 3, T), (1, 2, T)], "cluster_pair_timing_implies_divergent_transitive_conflict"),
    ([(1, 2, D), (1, 3, T), (2, 3, T)], "cluster_pair_divergent_shared_timing_descendant_conflict"),
    ([(1, 2, T), (2, 3, T), (3, 1, T)], "timing_cycle"),
    ([(1, 2, C), (2, 3, C), (1, 3, D)], "cluster_internal_divergent"),
    ([(1, 2, C), (2, 3, T), (1, 3, D)], "cluster_pair_relation_conflict"),
    ([(1, 2, T), (2, 3, T), (1, 3, D)], "cluster_pair_divergent_timing_transitive_conflict"),
    ([(1, 3, T), (2, 3, T), (1, 2, D)], "cluster_pair_divergent_shared_timing_descendant_conflict"),
]


@pytest.mark.parametrize(("edges", "reason"), CASES)
def test_each_rule(edges, reason):
    state = PhaseState()
    for e in edges[:-1]:
        assert state.offer(*e)[0] in ("accepted", "repeated")
    assert state.offer(*edges[-1]) == (("rejected", reason) if reason else ("repeated", None))


def test_accepted_edges_stay_consistent():
    rng = random.Random(2)
    for _ in range(60):
        state, kept = PhaseState(), []
        for _ in range(120):
            u, v, r = rng.randrange(14), rng.randrange(14), rng.choice([C, T, T, D])
            if state.offer(u, v, r)[0] == "accepted":
                kept.append((u, v, r))
        home = state.home
        after = {c: {home[v] for u, v, r in kept if r == T and home[u] == c} for c in set(home.values())}
        for c in after:  # closure by walking
            seen, todo = set(), [c]
            while todo:
                todo += [x for x in after[todo.pop()] if x not in seen and not seen.add(x)]
            assert c not in seen and seen == state.below[c]
        for u, v, r in kept:
            a, b = home[u], home[v]
            assert (a == b) == (r == C)
            if r == D:
                assert not (b in state.below[a] or a in state.below[b] or state.below[a] & state.below[b])


EDGE = "chrom string, u long, v long, relation string, reliability double, alt_alt int, alt_ref int, ref_alt int, ref_ref int, vaf_u double, vaf_v double, hap_u string, hap_v string, loaded_at string"


def test_cleaned_edges_in_order_and_decided(spark):
    data = [
        ("chr1", 2, 1, " COOCCURRING", 5.0, 4, 1, 2, 3, 0.1, 0.2, "hp1", ".", "b"),
        ("1", 1, 2, "cooccurring", 4.0, 4, 2, 1, 3, 0.2, 0.1, None, "HP1", "a"),
        ("1", 3, 1, "timing", float("nan"), None, 1, 2, 3, None, 0.2, None, None, "a"),
        ("1", 1, 3, "divergent", 9.0, 0, 1, 2, 3, None, 0.2, None, None, "a"),
        ("1", 1, None, "timing", 9.0, 0, 1, 2, 3, None, 0.2, None, None, "a"),
        (None, 1, 2, "timing", 9.0, 0, 1, 2, 3, None, 0.2, None, None, "a"),
        ("1", 1, 2, "unknown", 9.0, 0, 1, 2, 3, None, 0.2, None, None, "a"),
        ("2", 7, 7, "cooccurring", 1.0, 0, 1, 2, 3, None, 0.2, None, None, "a"),
    ]
    clean = acceptance.clean_edges(spark.createDataFrame(data, EDGE).withColumn("component", F.lit("clash")), canonical_chrom(F.col("chrom")))
    got = rows(clean, "chrom", "u", "v", "relation", "reliability", "alt_alt", "alt_ref", "ref_alt", "hap_u", "hap_v")
    assert got == [("1", 1, 2, C, 5.0, 4, 2, 1, None, "HP1"), ("1", 1, 3, D, 9.0, 0, 1, 2, None, None), ("1", 3, 1, T, 0.0, 0, 1, 2, None, None), ("2", 7, 7, C, 1.0, 0, 1, 2, None, None)]
    decided = acceptance.decide(acceptance.ordered(clean))
    assert rows(decided, "chrom", "component", "accept_order", "status", "reason", "cluster_v") == [
        ("1", 1, 1, "accepted", None, 3), ("1", 1, 2, "accepted", None, 1), ("1", 1, 3, "rejected", "pair_type_conflict", 1), ("2", 7, 1, "rejected", "self_loop", 7),
    ]
    assert acceptance.decide(acceptance.ordered(clean.limit(0))).count() == 0


def test_components_of_chains_and_loops(spark):
    data = [("a", i, i + 1) for i in range(60)] + [("a", 200, 200), ("b", 5, 4), ("b", 4, 5), ("b", 4, 4), (None, 1, 2), ("b", None, 1)]
    df = spark.createDataFrame(data, "k string, x long, y long")
    expected = sorted([("a", i, 0) for i in range(61)] + [("a", 200, 200), ("b", 4, 4), ("b", 5, 4)])
    assert rows(components(df, ["k"], "x", "y")) == expected
    assert components(df.limit(0), ["k"], "x", "y").count() == 0


SLIM = "chrom string, u long, v long, relation string, reliability double, alt_alt long, alt_ref long, ref_alt long, ref_ref long"


def test_thinning_bridges_and_dedup(spark):
    cooc = [("1", a, b, C, 1.0, 1, 0, 0, 0) for a, b in ((1, 2), (1, 5), (2, 6), (5, 6), (1, 6))]
    assert rows(simplify.nearest_neighbours(spark.createDataFrame(cooc, SLIM))) == [("1", 1, 2), ("1", 1, 5), ("1", 2, 6), ("1", 5, 6)]
    split = spark.createDataFrame([("1", 1, 2), ("1", 5, 6)], "chrom string, u long, v long")
    cluster = spark.createDataFrame([("1", p, 1) for p in (1, 2, 5, 6, 9)], "chrom string, pos long, cluster long")
    assert rows(simplify.bridges(split, cluster)) == [("1", 2, 5), ("1", 6, 9)]
    assert rows(simplify.fragmented(split, cluster)) == [("1", 1, 3)]
    for nodes in ([("1", 1)], [("1", 1), ("1", 2), ("1", 5), ("1", 6), ("1", 6)]):
        with pytest.raises(ValueError, match="node"):
            simplify.check_nodes(split, spark.createDataFrame(nodes, "chrom string, pos long"))
    timing = [("1", 1, 10, T, 1.0, 1, 1, 1, 0), ("1", 1, 11, T, 2.0, 1, 1, 1, 0), ("1", 2, 11, T, 2.0, 0, 1, 1, 0)]
    home = spark.createDataFrame([("1", 1, 1), ("1", 2, 1), ("1", 10, 10), ("1", 11, 10)], "chrom string, pos long, cluster long")
    assert rows(simplify.best_per_cluster(spark.createDataFrame(timing, SLIM), T, home), "u", "v") == [(1, 11)]


def test_chains(spark):
    schema = "chrom string, source long, target long, relation string"
    data = [("1", 1, 2, T), ("1", 2, 3, T), ("1", 2, 30, T), ("1", 5, 3, T), ("1", 9, 8, D), ("2", 4, 6, T), ("2", 6, 7, T), ("2", 4, 7, T)]
    assert rows(chains.timing_chains(spark.createDataFrame(data, schema))) == [("1", 0, ["1", "2", "3"]), ("1", 1, ["1", "2", "30"]), ("2", 0, ["4", "6", "7"])]
    assert chains.timing_chains(spark.createDataFrame([], schema)).count() == 0
    ring = [("1", 8, 9, T), ("1", 9, 8, T)]
    crossed = [("1", 8, 9, T), ("1", 9, 8, T), ("1", 9, 7, T), ("1", 7, 8, T)]
    for cycle in (ring, [("1", 0, 1, T), ("1", 1, 2, T), ("1", 2, 1, T)], [*data, *ring], [*data, *crossed]):
        with pytest.raises(ValueError, match="cycle"):
            chains.timing_chains(spark.createDataFrame(cycle, schema))


def test_layout(spark):
    import hashlib

    from locusweave.operators import layout

    nodes = spark.createDataFrame([("1", 5, 5, 0.5), ("1", 9, 5, 0.52), ("1", 70_000, 5, None), ("1", 7, 7, 0.1)], "chrom string, pos long, component long, vaf double")
    got = rows(layout.component_layout(nodes), "pos", "x", "y")
    assert got == [(5, 0.0, -35.0), (7, 380.0, 0.0), (9, 80.0, -35.0), (70_000, 160.0, 35.0)]
    ranking = spark.createDataFrame([("a", "X", 1), ("a", "2", 8), ("a", "2", 3), ("b", "X", 1)], "ranking string, chrom string, pos long")
    assert rows(layout.ranking_layout(ranking)) == [("a", "2", 3, 0.0), ("a", "2", 8, 80.0), ("a", "X", 1, 380.0), ("b", "X", 1, 0.0)]
    names = spark.createDataFrame([("1:5",), ("x",)], "n string")
    for name, mod in rows(names.select("n", layout.md5_mod(F.col("n"), 1000))):
        assert mod == int(hashlib.md5(name.encode()).hexdigest(), 16) % 1000
    y = names.limit(1).select(layout.band_y(F.lit("x"), F.lit(1.0), F.lit("HP2"))).first()[0]
    scatter = (int(hashlib.md5(b"x").hexdigest(), 16) % 1000 / 1000 - 0.5) * 35
    assert abs(y - (2 * 840 + 35 + scatter)) < 1e-9


def test_rankings_of_the_simplified_graph(spark, tmp_path):
    from locusweave.plans import reference

    edges = [
        ("chr1", 10, 20, C, 9.0, None, None), ("chr1", 20, 30, T, 8.0, None, None), ("chr1", 30, 40, C, 7.0, None, None),
        ("chr1", 50, 40, " Unknown", 6.0, None, None), ("chr1", 50, 60, T, 5.0, None, "HP1"), ("chr1", 10, 20, D, 1.0, None, None),
        ("chr1", 60, 90, "unknown", 1.0, "HP1", "HP2"), ("chr1", 70, 80, T, 9.0, "HP1", "HP2"), ("chr1", 80, 80, "unknown", 1.0, None, None),
        ("chr2", 5, 6, T, 1.0, None, None), ("chr2", 8, 9, C, 1.0, None, None),
    ]
    data = [(c, u, v, r, w, 4, 2, 1, 3, 0.2, 0.2, a, b, "a") for c, u, v, r, w, a, b in edges]
    spark.createDataFrame(data, EDGE).write.parquet(str(tmp_path / "edges.parquet"))
    got = rows(reference.topn_simplified(spark, str(tmp_path)), "ranking", "rank", "chrom", "component", "timing_edges", "interesting_edges", "total_edges")
    # A rejected and a delivered unknown edge count; no edge across haplotypes is left.
    assert got == sorted((k, *rest) for k in ("timing_edges", "interesting_edges", "total_edges") for rest in ((1, "1", 10, 2, 2, 6), (2, "2", 5, 1, 1, 1)))
    placed = rows(reference.topn_layout(spark, str(tmp_path)).where("ranking = 'timing_edges'"), "chrom", "pos", "x")
    assert placed == [("1", p, 80.0 * i) for i, p in enumerate((10, 20, 30, 40, 50, 60))] + [("2", 5, 700.0), ("2", 6, 780.0)]


def test_a_chain_of_any_length(spark):
    n = 10_500
    data = [("1", k, k + 1, T) for k in range(n)] + [("1", 3, 20_000, T), ("1", 20_000, 20_001, T)]
    got = chains.timing_chains(spark.createDataFrame(data, "chrom string, source long, target long, relation string")).collect()
    assert [(r.chain_index, len(r.path), r.path[-1]) for r in sorted(got, key=lambda r: r.chain_index)] == [(0, 6, "20001"), (1, n + 1, str(n))]
    assert next(r.path for r in got if r.chain_index == 1) == [str(k) for k in range(n + 1)]


def test_chains_against_plain_walks(spark):
    rng = random.Random(6)
    arcs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(55)})
    below = {}
    for a, b in arcs:
        below.setdefault(a, []).append(b)
    paths, todo = [], [[a] for a in below if a not in {b for _, b in arcs}]
    while todo:
        path = todo.pop()
        todo += [[*path, b] for b in below.get(path[-1], [])]
        if path[-1] not in below and len(path) > 2:
            paths.append([str(x) for x in path])
    got = chains.timing_chains(spark.createDataFrame([("2", a, b, T) for a, b in arcs], "chrom string, source long, target long, relation string"))
    assert [r.path for r in got.orderBy("chain_index").collect()] == sorted(paths)
