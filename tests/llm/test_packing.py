from collections import defaultdict

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from locusweave.llm.packing import fill, first_fit_decreasing, pack

KINDS = "container_id int, capacity_tokens int"


def brute(sizes, capacity):
    room, out = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= s
        out.append(at)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(20, 40))
def test_tournament_tree_is_first_fit(sizes, capacity):
    sizes.sort(reverse=True)
    assert first_fit_decreasing(sizes, capacity) == brute(sizes, capacity)


def test_every_token_has_its_place(spark):
    data = [(i, (i * 37) % 150) for i in range(300)] + [(None, 5), (1000, None), (1001, 0), (1002, 256), (1003, 1000)]
    sizes = spark.createDataFrame(data, "doc_id long, n_tokens long").selectExpr("*", "1 AS bin", "2 AS grp")
    kinds = spark.createDataFrame([(1, 128), (2, 64), (3, None), (4, 0)], KINDS)
    got = pack(sizes, kinds, group_docs=100)
    assert {k for (k,) in rows(got.select("container_id").distinct())} == {1, 2}
    used, pieces = defaultdict(int), defaultdict(list)
    for r in got.collect():
        used[r.container_id, r.grp, r.bin] += r.n_tokens
        pieces[r.container_id, r.doc_id].append((r.piece, r.first_token, r.n_tokens))
    capacity = {1: 128, 2: 64}
    assert all(n <= capacity[k[0]] for k, n in used.items())
    for doc, n in data:
        for kind, c in capacity.items():
            own = sorted(pieces[kind, doc])
            assert sum(x[2] for x in own) == (n or 0)
            assert [x[1] for x in own] == [k * c for k in range(len(own))]
            assert len(own) == max(1, -(-(n or 0) // c))  # never cut below the capacity
    share = {r.container_id: r.share_filled for r in fill(got, kinds).collect()}
    assert all(s > 0.9 for s in share.values())


def test_nothing_to_pack(spark):
    sizes = spark.createDataFrame([], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([(1, 8)], KINDS)
    assert pack(sizes, kinds).count() == 0
    one = spark.createDataFrame([(1, 3)], "doc_id long, n_tokens long")
    assert pack(one, kinds.limit(0)).count() == 0
