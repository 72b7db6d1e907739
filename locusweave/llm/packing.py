"""Packing texts into containers of fixed capacity: first-fit decreasing over a tournament tree.

Documents go to randomised groups of about ``GROUP_DOCS`` by a hash of their id; each group is
packed on its own, largest text first, into the first container with room for it. The tree holds
at each node the most room left below it, so the first container that fits is found in a walk from
the root. Texts of equal length are placed together: as many as fit go into that container at
once, which is what placing them one by one would do.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_DOCS = 20_000
SCHEMA = "container_id int, grp bigint, bin bigint, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint"


class TournamentTree:
    """Room left in containers that are opened on demand, all of one capacity."""

    def __init__(self, capacity: int, most: int) -> None:
        self.width = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def first_fit(self, size: int) -> int:
        at, room = 1, self.room
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        return at - self.width

    def take(self, container: int, size: int) -> None:
        at, room = container + self.width, self.room
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each size; ``sizes`` fall, and none is above ``capacity``."""
    tree = TournamentTree(capacity, max(1, len(sizes)))
    out: list[int] = []
    i, n = 0, len(sizes)
    while i < n:
        size, j = sizes[i], i
        while j < n and sizes[j] == size:
            j += 1
        while i < j:
            at = tree.first_fit(size)
            k = min(j - i, tree.room[at + tree.width] // size) if size else j - i
            tree.take(at, k * size)
            out += [at] * k
            i += k
    return out


def _pack_group(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    capacity = int(items["capacity"].iloc[0])
    items = items.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bins = first_fit_decreasing(items["n_tokens"].tolist(), capacity)
    return pd.DataFrame({"container_id": key[0], "grp": key[1], "bin": bins}).assign(
        **{c: items[c].to_numpy() for c in ("doc_id", "piece", "first_token", "n_tokens")}
    )


def pack(sizes: DataFrame, containers: DataFrame, group_docs: int = GROUP_DOCS, seed: int = 0) -> DataFrame:
    """One row per container kind and piece: the group, the container's number in it (``bin``), and
    the piece's place in its text.

    ``sizes`` has ``doc_id, n_tokens`` (written to a table first if it is costly to make: its rows
    are counted to set the number of groups). A text of up to the capacity is one piece; a longer one
    is cut into pieces of the capacity and a rest, in order. Texts without tokens, and null sizes,
    which count as none, take no room and lie in the first container. Null ids pack like others;
    capacities that are null or below 1 are left out; no documents give no rows. ``containers`` is
    a small table of capacities and is broadcast if Spark finds it small.
    """
    groups = max(1, math.ceil(sizes.count() / group_docs))
    kinds = containers.where("capacity_tokens >= 1").select(
        F.col("container_id").cast("int").alias("container_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")
    )
    offered = kinds.agg(F.collect_set(F.struct("container_id", "capacity")).alias("kinds"))
    n, capacity = F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)), F.col("kind.capacity")
    # Every text is packed once into each kind of container: the list of kinds rides along.
    items = (
        sizes.select("doc_id", n.alias("size"))
        .withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))
        .withColumn("kind", F.explode(offered.scalar()))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))))
        .select(
            F.col("kind.container_id").alias("container_id"),
            "grp",
            capacity.alias("capacity"),
            "doc_id",
            "piece",
            (F.col("piece") * capacity).alias("first_token"),
            F.least(capacity, F.col("size") - F.col("piece") * capacity).alias("n_tokens"),
        )
    )
    return items.groupBy("container_id", "grp").applyInPandas(_pack_group, SCHEMA)


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind of container: how many are used, the tokens in them, and the share of room used."""
    bins = packed.groupBy("container_id", "grp", "bin").agg(F.sum("n_tokens").alias("used"))
    totals = bins.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("n_tokens"))
    share = F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6)
    return totals.join(containers.select("container_id", "capacity_tokens"), "container_id").withColumn("share_filled", share)
