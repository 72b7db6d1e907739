"""Copy-number tracks: the best segment for a span, and the common segmentation of two tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.axis import with_next

BITS = 16
TRACKS = ("hp1", "hp2")


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def tracks(segments: DataFrame, owner: Column, chrom: Column) -> DataFrame:
    """``owner, chrom, hp, start, end, state, confidence``: both tracks of segments, 1-based and
    closed. Rows that make no interval are left out, repeated ones count once."""
    one = lambda hp: F.struct(F.lit(hp).alias("hp"), F.col(f"{hp}_state").alias("state"), F.col(f"{hp}_confidence").alias("confidence"))
    ok = segments.where("start_pos >= 0 and end_pos > start_pos").where(chrom.isNotNull())
    flat = ok.select(owner.alias("owner"), chrom.alias("chrom"), (F.col("start_pos") + 1).alias("start"), F.col("end_pos").alias("end"), F.explode(F.array(*map(one, TRACKS))).alias("t"))
    return flat.select("owner", "chrom", "start", "end", "t.hp", finite(F.col("t.state")).alias("state"), finite(F.col("t.confidence")).alias("confidence")).distinct()


def best_segment(spans: DataFrame, segments: DataFrame, keys: list[str], per: tuple[str, ...] = ()) -> DataFrame:
    """Of each span (``keys``, ``span``, ``first``, ``last``; closed) and track, the segment that
    overlaps it most; then by confidence (a missing one last), start, end. ``keys`` are columns of
    both sides; spans that no segment overlaps give no row. ``per`` are columns of the segments alone
    (say, whose profile it is): each span then has a best segment for each of their values.

    Both sides meet in bins of ``2**BITS`` positions, each pair in the first bin they share.
    """
    bins = lambda a, b: F.explode(F.sequence(F.shiftright(a, BITS), F.shiftright(b, BITS)))
    one = spans.withColumn("__bin", bins("first", "last"))
    two = segments.withColumn("__bin", bins("start", "end"))
    shared = F.shiftright(F.greatest("first", "start"), BITS) == F.col("__bin")
    met = one.join(two, [*keys, "__bin"]).where(shared & (F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first")))
    overlap = F.least("last", "end") - F.greatest("first", "start") + 1
    order = F.struct(
        (-overlap).alias("a"), (-F.coalesce("confidence", F.lit(float("-inf")))).alias("b"), F.col("start").alias("c"), F.col("end").alias("d"), F.coalesce("state", F.lit(-1.0)).alias("e")
    )
    pick = F.min_by(F.struct("state", "confidence", "start", "end", overlap.alias("overlap")), order).alias("s")
    return met.groupBy(*keys, *per, "span", "hp").agg(pick).select(*keys, *per, "span", "hp", "s.*")


def total_state(one: Column, two: Column) -> Column:
    """Sum of those states that are known; null if none is."""
    return F.when(one.isNotNull() | two.isNotNull(), F.coalesce(one, F.lit(0.0)) + F.coalesce(two, F.lit(0.0)))


def annotated_spans(spans: DataFrame, segments: DataFrame, keys: list[str], per: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``per``, ``span``, ``cn_hp1``, ``cn_hp2``, ``cn_total`` of spans that any track
    overlaps."""
    best = best_segment(spans, segments, keys, per)
    side = {hp: F.max(F.when(F.col("hp") == hp, F.col("state"))).alias(f"cn_{hp}") for hp in TRACKS}
    return best.groupBy(*keys, *per, "span").agg(*side.values()).withColumn("cn_total", total_state(F.col("cn_hp1"), F.col("cn_hp2")))


def common_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Both tracks cut at every border of either: ``keys``, ``start``, ``end`` and the best state of
    each track over each piece. Pieces that no segment covers are left out."""
    cuts = segments.select(*keys, F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("start")).distinct()
    pieces = with_next(cuts, keys, "start", "next").withColumn("end", F.col("next") - 1).where("end is not null")
    spans = pieces.select(*keys, F.struct("start", "end").alias("span"), F.col("start").alias("first"), F.col("end").alias("last"))
    return annotated_spans(spans, segments, keys).select(*keys, "span.start", "span.end", "cn_hp1", "cn_hp2", "cn_total")
