"""Which proposed edges a consistent phase graph accepts, in order of reliability.

Whether an edge is accepted depends only on edges of its own connected component of proposals, so
components are decided independently. Within one the decision is sequential by nature: each edge
is held against what was accepted before it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.operators.components import components

SCHEMA = "chrom string, component bigint, accept_order int, u bigint, v bigint, relation string, status string, reason string, cluster_u bigint, cluster_v bigint"
#: Columns that edges carry along if they have them.
CARRIED = ("hvaf_u", "hvaf_v", "hp_reads_u", "hp_reads_v", "best_score", "margin")
BEFORE, AFTER, APART = "before", "after", "apart"
_FLIP = {BEFORE: AFTER, AFTER: BEFORE, APART: APART}


def _places(bits: int) -> list[int]:
    """The places of the ones in ``bits``."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


class PhaseState:
    """Clusters of cooccurring sites, the timing order between them, and which ones diverge.

    Clusters are numbered, and sets of them are the bits of a number, so that a set is joined or
    met a machine word at a time. ``facing[a][b]`` is how cluster ``a`` stands to ``b`` by an
    accepted edge, ``apart`` holds those that diverge from one, and ``_above`` and ``_below`` all
    that come before and after one along timing edges.
    """

    def __init__(self) -> None:
        self.home: dict[int, int] = {}
        self.members: list[list[int]] = []
        self.names: list[int] = []
        self.facing: list[dict[int, str]] = []
        self.apart: list[int] = []
        self._above: list[int] = []
        self._below: list[int] = []
        self.pairs: dict[tuple[int, int], tuple[str, int]] = {}

    def cluster(self, site: int) -> int:
        if site not in self.home:
            self.home[site] = len(self.names)
            self.names.append(site)
            self.members.append([site])
            self.facing.append({})
            for sets in (self.apart, self._above, self._below):
                sets.append(0)
        return self.home[site]

    @property
    def below(self) -> list[set[int]]:
        """The clusters that come after each one, as sets."""
        return [set(_places(lower)) for lower in self._below]

    def name(self, site: int) -> int:
        """The site that a site's cluster is named by."""
        return self.names[self.home[site]] if site in self.home else site

    def offer(self, u: int, v: int, relation: str) -> tuple[str, str | None]:
        """``accepted``, ``rejected`` with the reason, or ``repeated``."""
        if u == v:
            return "rejected", "self_loop"
        a, b = self.cluster(u), self.cluster(v)
        key = (min(u, v), max(u, v))
        if key in self.pairs:
            known, source = self.pairs[key]
            if known != relation:
                return "rejected", "pair_type_conflict"
            return ("rejected", "pair_direction_conflict") if relation == "timing" and source != u else ("repeated", None)
        reason = {"cooccurring": self._joining, "timing": self._ordering, "divergent": self._parting}[relation](a, b)
        if reason:
            return "rejected", reason
        self.pairs[key] = (relation, u)
        if relation == "cooccurring":
            self._join(a, b)
        elif relation == "timing":
            self._put_before(a, b)
        else:
            self.facing[a][b] = self.facing[b][a] = APART
            self.apart[a] |= 1 << b
            self.apart[b] |= 1 << a
        return "accepted", None

    # What would contradict the accepted edges.

    def _upper(self, a: int) -> int:
        return self._above[a] | 1 << a

    def _lower(self, a: int) -> int:
        return self._below[a] | 1 << a

    def _shunned(self, upper: int) -> int:
        """The clusters that diverge from one of ``upper``."""
        return reduce(or_, (self.apart[c] for c in _places(upper)), 0)

    def _leads(self, starts: int, lower: int) -> bool:
        """Whether one of ``starts`` is in ``lower`` or comes before one of it. Of both sets the
        smaller one is gone through."""
        if not starts or starts & lower:
            return bool(starts)
        if starts.bit_count() <= lower.bit_count():
            return any(self._below[x] & lower for x in _places(starts))
        return any(self._above[x] & starts for x in _places(lower))

    def _joining(self, a: int, b: int) -> str | None:
        if a == b:
            return None
        if b in self.facing[a]:
            return "cluster_merge_noncooccurring"
        for x, how in self.facing[b].items():
            other = self.facing[a].get(x)
            if other is not None and other != how:
                return "cluster_merge_pair_relation_conflict" if APART in (how, other) else "cluster_merge_pair_timing_direction_conflict"
        if (self._below[a] >> b | self._below[b] >> a) & 1:
            return "cluster_merge_timing_cycle"
        if self._leads(self._shunned(self._upper(a)), self._lower(b)) or self._leads(self._shunned(self._upper(b)), self._lower(a)):
            return "cluster_merge_divergent_shared_timing_descendant_conflict"
        return None

    def _ordering(self, a: int, b: int) -> str | None:
        if a == b:
            return "cluster_internal_timing"
        how = self.facing[a].get(b)
        if how == APART:
            return "cluster_pair_relation_conflict"
        if how == AFTER:
            return "cluster_pair_timing_direction_conflict"
        if self._below[a] >> b & 1:
            # All of ``b``'s lower ones are below ``a``'s upper ones already.
            return None
        shunned, lower = self._shunned(self._upper(a)), self._lower(b)
        if shunned & lower:
            return "cluster_pair_timing_implies_divergent_transitive_conflict"
        if self._leads(shunned, lower):
            return "cluster_pair_divergent_shared_timing_descendant_conflict"
        return "timing_cycle" if self._below[b] >> a & 1 else None

    def _parting(self, a: int, b: int) -> str | None:
        if a == b:
            return "cluster_internal_divergent"
        if self.facing[a].get(b, APART) != APART:
            return "cluster_pair_relation_conflict"
        if (self._below[a] >> b | self._below[b] >> a) & 1:
            return "cluster_pair_divergent_timing_transitive_conflict"
        if self._below[a] & self._below[b]:
            return "cluster_pair_divergent_shared_timing_descendant_conflict"
        return None

    # Taking an edge in.

    def _put_before(self, a: int, b: int) -> None:
        self.facing[a][b], self.facing[b][a] = BEFORE, AFTER
        if self._below[a] >> b & 1:
            return
        upper, lower = self._upper(a), self._lower(b)
        # Those above ``b`` have all of its lower ones, and those below ``a`` all of its upper ones.
        over, under = _places(upper & ~self._above[b]), _places(lower & ~self._below[a])
        for c in over:
            self._below[c] |= lower
        for c in under:
            self._above[c] |= upper

    def _join(self, a: int, b: int) -> None:
        if a == b:
            return
        keep, gone = (b, a) if len(self.members[a]) < len(self.members[b]) else (a, b)
        for site in self.members[gone]:
            self.home[site] = keep
        self.members[keep] += self.members[gone]
        self.members[gone] = []
        for x, how in self.facing[gone].items():
            del self.facing[x][gone]
            if x not in self.facing[keep]:
                self.facing[keep][x] = how
                self.facing[x][keep] = _FLIP[how]
        self.facing[gone] = {}
        for x in _places(self.apart[gone]):
            self.apart[x] ^= 1 << gone | (1 << keep & ~self.apart[x])
        self.apart[keep] |= self.apart[gone]
        upper, lower = self._above[keep] | self._above[gone], self._below[keep] | self._below[gone]
        for sets, over, under in ((self._below, self._above, lower), (self._above, self._below, upper)):
            for c in _places(over[gone]):
                sets[c] = (sets[c] | under | 1 << keep) & ~(1 << gone)
            # The others had all of ``keep``'s.
            if under != sets[keep]:
                for c in _places(over[keep] & ~over[gone]):
                    sets[c] |= under
        self._above[keep], self._below[keep] = upper, lower
        self.apart[gone] = self._above[gone] = self._below[gone] = 0


def _decide(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    state = PhaseState()
    edges = edges.sort_values("accept_order")
    said = [state.offer(u, v, r) for u, v, r in zip(edges["u"].tolist(), edges["v"].tolist(), edges["relation"].tolist(), strict=True)]
    out = edges[["chrom", "component", "accept_order", "u", "v", "relation"]].copy()
    out["status"], out["reason"] = [s for s, _ in said], [r for _, r in said]
    out["cluster_u"] = [state.name(x) for x in out["u"].tolist()]
    out["cluster_v"] = [state.name(x) for x in out["v"].tolist()]
    return out


def ordered(edges: DataFrame) -> DataFrame:
    """``edges`` with their component of proposals and ``accept_order``, from 1 within it: by
    falling reliability, then relation rank, then falling informative reads, then position."""
    found = components(edges, ["chrom"], "u", "v").withColumnRenamed("vertex", "u")
    tagged = edges.join(found, ["chrom", "u"])
    order = Window.partitionBy("chrom", "component").orderBy(
        F.desc("reliability"), "relation_rank", F.desc(F.col("alt_alt") + F.col("alt_ref") + F.col("ref_alt")), F.least("u", "v"), F.greatest("u", "v"), "u"
    )
    return tagged.withColumn("accept_order", F.row_number().over(order))


def decide(ordered_edges: DataFrame) -> DataFrame:
    """Status, reason and final clusters of each edge of :func:`ordered`, with its other columns."""
    slim = ordered_edges.select("chrom", "component", "accept_order", "u", "v", "relation")
    decided = slim.groupBy("chrom", "component").applyInPandas(_decide, SCHEMA)
    return ordered_edges.join(decided.select("chrom", "component", "accept_order", "status", "reason", "cluster_u", "cluster_v"), ["chrom", "component", "accept_order"])


def clean_edges(edges: DataFrame, chrom: Column, relations: tuple[str, ...] = ("cooccurring", "timing", "divergent")) -> DataFrame:
    """Delivered edges put right: canonical chromosome, relation in lower case without blanks, the
    lower position first for undirected relations (two-sided columns exchanged along), the newest
    of repeated rows. Rows without an end, a chromosome or one of ``relations`` are left out; missing
    counts are 0, a missing reliability is 0, and haplotypes other than HP1, HP2, MIXED and UNKNOWN
    are null. The columns of :data:`CARRIED` are null where ``edges`` lack them."""
    relation = F.lower(F.regexp_replace("relation", r"^\s+|\s+$", ""))
    turn = (F.col("u") > F.col("v")) & (relation != "timing")
    two = lambda a, b, name: (F.when(turn, F.col(b)).otherwise(F.col(a))).alias(name)
    hap = lambda c: F.when(F.upper(F.trim(c)).isin("HP1", "HP2", "MIXED", "UNKNOWN"), F.upper(F.trim(c)))
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    own = {c: F.col(c) if c in edges.columns else F.lit(None) for c in CARRIED}
    kinds = {"hvaf_u": "double", "hvaf_v": "double", "hp_reads_u": "string", "hp_reads_v": "string", "best_score": "double", "margin": "double"}
    turned = {c: own[c[:-1] + ("v" if c[-1] == "u" else "u")] if c[-2] == "_" else own[c] for c in CARRIED}
    put = edges.select(
        chrom.alias("chrom"),
        two("u", "v", "u"),
        two("v", "u", "v"),
        relation.alias("relation"),
        F.coalesce(F.nanvl("reliability", F.lit(None)), F.lit(0.0)).alias("reliability"),
        count("alt_alt").alias("alt_alt"),
        F.when(turn, count("ref_alt")).otherwise(count("alt_ref")).alias("alt_ref"),
        F.when(turn, count("alt_ref")).otherwise(count("ref_alt")).alias("ref_alt"),
        count("ref_ref").alias("ref_ref"),
        two("vaf_u", "vaf_v", "vaf_u"),
        two("vaf_v", "vaf_u", "vaf_v"),
        hap(F.when(turn, F.col("hap_v")).otherwise(F.col("hap_u"))).alias("hap_u"),
        hap(F.when(turn, F.col("hap_u")).otherwise(F.col("hap_v"))).alias("hap_v"),
        *(F.when(turn, turned[c]).otherwise(own[c]).cast(kinds[c]).alias(c) for c in CARRIED),
        "loaded_at",
    )
    known = put.where(F.col("relation").isin(*relations)).dropna(subset=["chrom", "u", "v"])
    rest = ["reliability", "alt_alt", "alt_ref", "ref_alt", "ref_ref", "vaf_u", "vaf_v", "hap_u", "hap_v", *CARRIED]
    newest = known.groupBy("chrom", "u", "v", "relation").agg(F.max(F.struct("loaded_at", *rest)).alias("s"))
    rank = F.when(F.col("relation") == "cooccurring", 0).when(F.col("relation") == "divergent", 1).when(F.col("u") < F.col("v"), 2).otherwise(3)
    return newest.select("chrom", "u", "v", "relation", *(F.col(f"s.{c}").alias(c) for c in rest)).withColumn("relation_rank", rank)
