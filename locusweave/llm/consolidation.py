"""One group identifier for all records that pairwise links connect, directly or indirectly.

Random contraction: in each round every vertex hooks to that member of its closed neighbourhood
that comes first in an order drawn afresh by hashing, the edges are relabelled and made distinct,
and loops vanish. A round removes a constant share of the vertices on average, so the edges are
used up after a number of rounds that grows with the logarithm of the graph, whatever the length
of chains or the size of hubs. Each round's mapping is kept; afterwards the mappings are expanded
from the last to the first. All of it stays in written tables; only edge counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.session import release, settle

MOST_ROUNDS = 200


def _order(vertex: Column, seed: int) -> Column:
    return F.xxhash64(vertex, F.lit(seed))


def _contract(edges: DataFrame, scope: list[str], seed: int) -> DataFrame:
    """``scope, v, r, least``: the vertex each vertex hooks to. ``edges`` carry both directions."""
    # Which of two vertices with the same hash is taken makes no difference to the groups.
    hooked = edges.groupBy(*scope, F.col("a").alias("v")).agg(F.min_by("b", _order(F.col("b"), seed)).alias("n"))
    nearer = _order(F.col("n"), seed) < _order(F.col("v"), seed)
    return hooked.select(*scope, "v", F.when(nearer, F.col("n")).otherwise(F.col("v")).alias("r"))


def connected_groups(links: DataFrame, scope: list[str], u: str, v: str) -> DataFrame:
    """``scope, vertex, group``: each vertex of a link with the smallest vertex it is linked to.

    Links are undirected and hold only within equal ``scope`` columns. Links with a null in any of
    these columns are left out; a link of a vertex with itself makes a group of one; repeated and
    reversed links count once; an empty input gives no rows. Vertices may be numbers or strings.
    """
    usable = links.select(*scope, F.col(u).alias("a"), F.col(v).alias("b")).dropna()
    both = usable.select(*scope, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    both = both.select(*scope, "e.a", "e.b").distinct()
    edges = settle(both)
    mappings: list[DataFrame] = []
    while not edges.where("a <> b").isEmpty() or not mappings:
        if len(mappings) == MOST_ROUNDS:
            raise RuntimeError("contraction did not finish")
        hooks = settle(_contract(edges, scope, len(mappings)))
        mappings.append(hooks)
        left = edges.where("a <> b").join(hooks.withColumnsRenamed({"v": "a", "r": "ra"}), [*scope, "a"])
        right = left.join(hooks.withColumnsRenamed({"v": "b", "r": "rb"}), [*scope, "b"]).where("ra <> rb")
        contracted = settle(right.select(*scope, F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        release(edges)
        edges = contracted
    # Expand: a vertex belongs where the vertex it hooked to belongs.
    final, held = mappings[-1], [edges]
    for level, hooks in enumerate(reversed(mappings[:-1]), 1):
        upper = final.select(*scope, F.col("r").alias("top"), F.col("v").alias("r"))
        final = hooks.join(upper, [*scope, "r"], "left").select(*scope, "v", F.coalesce("top", "r").alias("r"))
        if level % 4 == 0:
            held.append(final := settle(final))
    final = settle(final)
    for done in [*mappings, *held]:
        release(done)
    least = final.groupBy(*scope, "r").agg(F.min("v").alias("group"))
    return final.join(least, [*scope, "r"]).select(*scope, F.col("v").alias("vertex"), "group")
