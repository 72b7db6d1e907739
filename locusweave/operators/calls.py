"""From fitted windows to relationship calls and the proposals that the graph may accept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators.pairs import RELATIONS, margin, same_haplotype_gate, supports
from locusweave.operators.trees import fit_windows
from locusweave.operators.windows import all_windows, assign_pairs, covered_pairs, read_patterns
from locusweave.session import by_merge, settle

#: In which order relations of equal reliability are tried.
RELATION_RANK = {"cooccurring": 0, "divergent": 1, "left_before_right": 2, "right_before_left": 3}


def pair_results(pairs: DataFrame, resolved: DataFrame, read: list[str], size: int, stride: int) -> DataFrame:
    """Each eligible pair with its counts, its window, and the lowest BIC of each relation there."""
    windows = settle(all_windows(pairs, size, stride))
    return results_of(pairs, windows, fit_windows(windows, read_patterns(windows, resolved, read)))


def results_of(pairs: DataFrame, windows: DataFrame, fits: DataFrame) -> DataFrame:
    """:func:`pair_results` from windows and their fits."""
    found = assign_pairs(pairs, windows).join(by_merge(fits), ["chrom", "window_id", "i", "j"])
    return pairs.join(by_merge(found.drop("sites", "i", "j")), ["chrom", "left_pos", "right_pos"])


def window_table(windows: DataFrame, fits: DataFrame) -> DataFrame:
    """One row per window: its sites, reads, best tree and that tree's BIC."""
    one = fits.where("i = 0 and j = 1").select("chrom", "window_id", "n_reads", "best_tree", "best_bic", "groups", "parents")
    listed = windows.select("chrom", "component", "window_id", F.size("sites").alias("n_sites"), F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))
    return listed.join(one, ["chrom", "window_id"], "left")


def check_calls(calls: DataFrame) -> None:
    """Raises if a pair is called more than once, or otherwise than by its lowest BIC."""
    wrong = F.abs(F.element_at(F.map_from_arrays(F.array(*map(F.lit, RELATIONS)), _bics()), F.col("relation")) - F.array_min(_bics())) > 1e-7
    if calls.where(wrong | F.col("relation").isNull()).limit(1).count():
        raise ValueError("a pair is not called by its lowest BIC")
    if calls.groupBy("chrom", "left_pos", "right_pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a pair is called more than once")


def window_opinions(windows: DataFrame, fits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per eligible pair in more than one window: the windows, and how many call which relation."""
    called = fits.select("chrom", "window_id", "i", "j", called_relation().alias("relation"))
    slots = windows.select("chrom", "window_id", F.posexplode("sites").alias("i", "left_pos"), "sites").select(
        "chrom", "window_id", "i", "left_pos", F.posexplode("sites").alias("j", "right_pos")
    )
    votes = slots.join(by_merge(called), ["chrom", "window_id", "i", "j"]).join(by_merge(pairs.select("chrom", "left_pos", "right_pos")), ["chrom", "left_pos", "right_pos"])
    counted = votes.groupBy("chrom", "left_pos", "right_pos", "relation").agg(F.count(F.lit(1)).alias("n"), F.collect_set("window_id").alias("ids"))
    ids = F.array_sort(F.flatten(F.collect_list("ids"))).cast("array<string>")
    return counted.groupBy("chrom", "left_pos", "right_pos").agg(
        F.sum("n").alias("n_windows"),
        F.array_join(ids, ",").alias("window_ids"),
        F.count(F.lit(1)).alias("n_relations"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "n"))))).alias("relations"),
        (F.count(F.lit(1)) > 1).alias("conflict"),
    ).where("n_windows > 1")


def multiplicity(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many eligible pairs lie in how many windows, per chromosome."""
    keys = ["chrom", "left_pos", "right_pos"]
    held = covered_pairs(windows).join(by_merge(pairs.select(*keys)), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"))
    return held.groupBy("chrom", "n_windows").agg(F.count(F.lit(1)).alias("pairs"))


def _bics():
    return F.array(*(F.col(f"bic_{r}") for r in RELATIONS))


def called_relation():
    """The relation with the lowest BIC; the first of RELATIONS among equals."""
    names = F.array(*(F.lit(r) for r in RELATIONS))
    return F.get(names, (F.array_position(_bics(), F.array_min(_bics())) - 1).cast("int"))


def relationship_calls(results: DataFrame) -> DataFrame:
    """``results`` with the called relation, its BIC and its margin over the next."""
    return results.withColumn("relation", called_relation()).withColumn("best_score", F.array_min(_bics())).withColumn("reliability", margin(_bics()))


def proposals(calls: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Calls that pass the haplotype gate (only with ``labels``) and the read-support gate, as graph
    edges: timing edges point from the earlier to the later site, with counts to match."""
    calls = calls if "best_score" in calls.columns else calls.withColumn("best_score", F.lit(None).cast("double"))
    gated = same_haplotype_gate(calls, labels) if labels is not None else calls
    kept = gated.where(supports(F.col("relation")))
    swap = F.col("relation") == "right_before_left"
    rank = F.coalesce(*(F.when(F.col("relation") == r, F.lit(k)) for r, k in RELATION_RANK.items()))
    return kept.select(
        "chrom",
        F.when(swap, F.col("right_pos")).otherwise(F.col("left_pos")).alias("u"),
        F.when(swap, F.col("left_pos")).otherwise(F.col("right_pos")).alias("v"),
        F.when(F.col("relation").isin("left_before_right", "right_before_left"), "timing").otherwise(F.col("relation")).alias("relation"),
        "reliability",
        (-F.col("best_score")).alias("best_score"),
        F.col("reliability").alias("margin"),
        "alt_alt",
        F.when(swap, F.col("ref_alt")).otherwise(F.col("alt_ref")).alias("alt_ref"),
        F.when(swap, F.col("alt_ref")).otherwise(F.col("ref_alt")).alias("ref_alt"),
        "ref_ref",
        rank.alias("relation_rank"),
    )
