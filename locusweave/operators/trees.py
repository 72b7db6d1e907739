"""Small mutation trees: their enumeration as a table, and the fit of all trees to a window's reads.

The best tree and the lowest BIC per relation are minima over all trees. Trees whose lower bound
cannot improve any minimum are passed over, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from locusweave.operators.pairs import RELATIONS
from locusweave.session import by_merge

#: Fixed values of the model.
OUTLIER, ROUNDS, TOLERANCE = 0.01, 50, 1e-8
PSEUDO = 1e-6
MOST_SITES = 5
#: Trees fitted together.
BATCH = 256


def _set_partitions(n: int) -> list[list[list[int]]]:
    if n == 0:
        return [[]]
    out = []
    for blocks in _set_partitions(n - 1):
        out += [[*b[:k], [*b[k], n - 1], *b[k + 1 :]] for b in [blocks] for k in range(len(b))]
        out.append([*blocks, [n - 1]])
    return out


def _grown(last: tuple[int, ...], rest: frozenset[int]) -> Iterator[dict[int, int]]:
    """Parents of the nodes ``rest`` in every way that they can hang below the level ``last``: some of
    them make the next level, the others hang below that."""
    if not rest:
        yield {}
    for many in range(1, len(rest) + 1):
        for level in combinations(sorted(rest), many):
            for below in _grown(level, rest.difference(level)):
                for above in product(last, repeat=many):
                    yield dict(zip(level, above, strict=True)) | below


def _ordered(groups: list[list[int]], parents: tuple[int, ...]) -> tuple[tuple, tuple]:
    """The same tree with children in the order of their groups, numbered from the root down."""
    below: dict[int, list[int]] = {}
    for node, parent in enumerate(parents, 1):
        below.setdefault(parent, []).append(node)
    out_groups, out_parents, stack = [()], [-1], [(c, 0) for c in sorted(below.get(0, []), key=lambda c: groups[c - 1], reverse=True)]
    while stack:
        node, parent = stack.pop()
        out_groups.append(tuple(groups[node - 1]))
        out_parents.append(parent)
        place = len(out_groups) - 1
        stack += [(c, place) for c in sorted(below.get(node, []), key=lambda c: groups[c - 1], reverse=True)]
    return tuple(out_groups), tuple(out_parents)


@cache
def trees(n: int) -> list[tuple[tuple, tuple]]:
    """All trees over ``n`` sites in order: an empty root, and nodes that gain one or more sites."""
    found = set()
    for groups in _set_partitions(n):
        nodes = range(1, len(groups) + 1)
        found.update(_ordered(groups, tuple(parents[n] for n in nodes)) for parents in _grown((0,), frozenset(nodes)))
    return sorted(found, key=lambda t: (len(t[0]), t))


def node_masks(groups: tuple, parents: tuple) -> list[int]:
    """The sites each node carries, its ancestors' included, as bits."""
    masks: list[int] = []
    for group, parent in zip(groups, parents, strict=True):
        masks.append((masks[parent] if parent >= 0 else 0) | sum(1 << m for m in group))
    return masks


def relation_of(groups: tuple, masks: list[int], i: int, j: int) -> int:
    """Index into RELATIONS of sites ``i < j``: by which of them the other's node carries."""
    at = {m: node for node, group in enumerate(groups) for m in group}
    if at[i] == at[j]:
        return 0
    if masks[at[j]] >> i & 1:
        return 1
    return 2 if masks[at[i]] >> j & 1 else 3


@cache
def space(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all trees: which genotype (row) each tree (column) has a node for, numbers of nodes but
    the root, and relations of the pairs ``(0,1), (0,2), …``."""
    listed = trees(n)
    held = np.zeros((1 << n, len(listed)))
    relations = np.zeros((len(listed), n * (n - 1) // 2), np.int8)
    for t, (groups, parents) in enumerate(listed):
        m = node_masks(groups, parents)
        held[m, t] = 1
        relations[t] = [relation_of(groups, m, i, j) for i in range(n) for j in range(i + 1, n)]
    return held, held.sum(0).astype(int) - 1, relations


def read_likelihoods(alleles: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each read pattern under each of the 2**n genotypes, and under noise.

    Rows are patterns and columns sites; an allele of -1 is not covered."""
    n = alleles.shape[1]
    genotype = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    like = np.ones((len(alleles), 1 << n))
    for site in range(n):
        a, e = alleles[:, site, None], errors[:, site, None]
        like *= np.where(a < 0, 1.0, np.where(a == genotype[None, :, site], 1 - e, e))
    return like, 0.5 ** (alleles >= 0).sum(1)


def _fit(like: np.ndarray, noise: np.ndarray, weight: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Log-likelihoods of trees after expectation-maximisation over their nodes' shares.

    A node is known by its genotype, which no other node of its tree has; ``held`` says which tree
    (column) has which genotype (row), so that all trees are weighed by one matrix product.
    """
    like = (1 - OUTLIER) * like
    background = OUTLIER * noise[:, None]
    score = lambda of: weight @ np.log(like @ of + background)
    share = held / held.sum(0)
    live, last = np.arange(held.shape[1]), share
    for step in range(ROUNDS):
        now = share[:, live]
        new = now * (like.T @ (weight[:, None] / (like @ now + background))) + PSEUDO * held[:, live]
        new /= new.sum(0)
        share[:, live] = new
        # Whether the score has settled is asked only where the shares have.
        calm = np.flatnonzero(np.abs(new - now).max(0) < TOLERANCE) if step else np.zeros(0, int)
        still = np.zeros(len(live), bool)
        if len(calm):
            still[calm] = np.abs(score(now[:, calm]) - score(last[:, calm])) < TOLERANCE
        live, last = live[~still], now[:, ~still]
        if not len(live):
            break
    return score(share)


def _bounds(like: np.ndarray, noise: np.ndarray, weight: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What no log-likelihood of a tree can exceed: every read at its best node."""
    out = []
    for at in range(0, held.shape[1], BATCH):
        top = (like[:, :, None] * held[None, :, at : at + BATCH]).max(1)
        out.append(weight @ np.log((1 - OUTLIER) * top + OUTLIER * noise[:, None]))
    return np.concatenate(out)


def fit_window(alleles: np.ndarray, errors: np.ndarray, weight: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The best tree's number, each tree's BIC (infinite where it was passed over), and the lowest
    BIC of each pair and relation."""
    held, size, relations = space(alleles.shape[1])
    like, noise = read_likelihoods(alleles, errors)
    penalty = size * log(max(2, weight.sum()))
    # Trees that fit in one batch are fitted whatever their bound: it would spare one in two hundred.
    bound = penalty - 2 * _bounds(like, noise, weight, held) if len(size) > BATCH else penalty
    bic = np.full(len(size), np.inf)
    pair = np.arange(relations.shape[1])
    lowest = np.full((relations.shape[1], len(RELATIONS)), np.inf)
    order = np.argsort(bound, kind="stable")
    while len(order):
        batch, order = order[:BATCH], order[BATCH:]
        bic[batch] = -2 * _fit(like, noise, weight, held[:, batch]) + penalty[batch]
        for r in range(len(RELATIONS)):
            lowest[:, r] = np.minimum(lowest[:, r], np.where(relations[batch] == r, bic[batch, None], np.inf).min(0))
        # A tree is of use only if its bound does not exceed all the minima it could lower.
        order = order[(bound[order] <= lowest[pair[None], relations[order]].max(1) + 1e-9)]
    return int(np.argmin(bic)), bic, lowest


FIT_SCHEMA = pa.schema(
    [("chrom", pa.string()), ("window_id", pa.int64()), ("best_tree", pa.int32()), ("best_bic", pa.float64()), ("groups", pa.string()), ("parents", pa.string())]
    + [("n_reads", pa.int64()), ("i", pa.int32()), ("j", pa.int32())]
    + [(f"bic_{r}", pa.float64()) for r in RELATIONS]
)


def _fitted(chrom: str, window: int, n: int, alleles: np.ndarray, errors: np.ndarray, reads: np.ndarray) -> dict[str, list]:
    """The rows of one window: a row for each pair of its sites."""
    order = np.lexsort((*errors.T, *alleles.T))  # sums of floats are taken in one order always
    weight = reads[order]
    best, bic, lowest = fit_window(alleles[order], errors[order], weight)
    groups, parents = trees(n)[best]
    places = list(combinations(range(n), 2))
    many = len(places)
    named = (chrom, window, best, float(bic[best]), str([list(g) for g in groups]), str(list(parents)), int(weight.sum()))
    columns = [[value] * many for value in named] + [[i for i, _ in places], [j for _, j in places], *lowest.T.tolist()]
    return dict(zip(FIT_SCHEMA.names, columns, strict=True))


def _fit_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows lie one after the other; the last one of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = list(zip(rows["chrom"].to_pylist(), rows["window_id"].to_pylist(), strict=True))
        begun = next((k for k in range(len(keys) - 1, 0, -1) if keys[k] != keys[k - 1]), 0)
        if begun:
            yield _fit_table(rows.slice(0, begun))
            held = rows.slice(begun).to_batches()
    if held and sum(b.num_rows for b in held):
        yield _fit_table(pa.Table.from_batches(held))


def _fit_table(rows: pa.Table) -> pa.RecordBatch:
    chroms, windows, sizes = (rows[c].to_pylist() for c in ("chrom", "window_id", "n_sites"))
    alleles, errors = (np.stack([rows[f"{c}{k}"].to_numpy() for k in range(MOST_SITES)], 1) for c in "ae")
    reads = rows["reads"].to_numpy().astype(float)
    starts = [k for k in range(len(windows)) if k == 0 or (chroms[k], windows[k]) != (chroms[k - 1], windows[k - 1])]
    out: dict[str, list] = {name: [] for name in FIT_SCHEMA.names}
    for lo, hi in zip(starts, [*starts[1:], len(windows)], strict=True):
        n = sizes[lo]
        for name, values in _fitted(chroms[lo], windows[lo], n, alleles[lo:hi, :n], errors[lo:hi, :n], reads[lo:hi]).items():
            out[name] += values
    return pa.RecordBatch.from_pydict(out, schema=FIT_SCHEMA)


def fit_windows(windows: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per window and pair of its sites with the lowest BIC of each relation. Windows are
    independent of each other and bounded by their patterns; windows no read covers give no rows."""
    call = lambda k, f: F.get(F.filter("pattern", lambda c: c["i"] == k), F.lit(0))[f]
    flat = patterns.select(
        "chrom",
        "window_id",
        "reads",
        *(F.coalesce(call(k, "allele"), F.lit(-1)).alias(f"a{k}") for k in range(MOST_SITES)),
        *(F.coalesce(call(k, "err"), F.lit(0.5)).alias(f"e{k}") for k in range(MOST_SITES)),
    )
    sized = flat.join(by_merge(windows.select("chrom", "window_id", F.size("sites").alias("n_sites"))), ["chrom", "window_id"])
    # Little data but much work per window: the number is given so that no tasks are merged.
    tasks = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["chrom", "window_id"]
    return sized.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_fit_sorted, from_arrow_schema(FIT_SCHEMA))
