import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from locusweave.operators.intervals import IntervalMap, periods_and_gaps

SCHEMA = "owner long, chrom string, start_pos long, end_pos long"


def brute(intervals):
    """Periods by sweeping sorted intervals."""
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=40))
def test_map_keeps_disjoint_periods(pairs):
    held, change = IntervalMap(), 0
    for s, n in pairs:
        change += held.insert(s, s + n)
    expected = brute([(s, s + n) for s, n in pairs])
    assert list(zip(held.starts, held.ends, strict=True)) == expected
    assert change == len(expected)
    assert held.gaps() == [(a[1], b[0]) for a, b in zip(expected, expected[1:], strict=False)]


def expect(data):
    groups = {}
    for owner, chrom, s, e in data:
        if s is not None and e is not None and s >= 0 and e > s:
            groups.setdefault((owner, chrom), []).append((s, e))
    out = []
    for key, intervals in groups.items():
        found = brute(intervals)
        out += [(*key, "period", *p) for p in found]
        out += [(*key, "gap", a[1], b[0]) for a, b in zip(found, found[1:], strict=False)]
    return out


def test_periods_across_blocks_with_dirty_rows(spark):
    rng = random.Random(3)
    data = []
    for owner in (1, 2, None):
        for chrom in ("1", "X", None):
            for _ in range(60):
                s = rng.randrange(0, 600_000)
                data.append((owner, chrom, s, s + rng.choice([1, 50, 3000, 70_000, 200_000 if rng.random() < 0.1 else 10])))
    data += [(1, "1", 5, 5), (1, "1", 9, 2), (1, "1", -3, 8), (1, "1", None, 4), (1, "1", 4, None)] + data[:20]
    data += [(7, "2", 0, 65_536), (7, "2", 65_536, 65_537), (7, "2", 131_073, 131_080), (7, "2", 65_540, 131_072), (7, "2", 10, 20)]
    df = spark.createDataFrame(data, SCHEMA).withColumnRenamed("owner", "track").withColumnRenamed("track", "owner").selectExpr("*", "1 AS kind", "2 AS __block")
    assert sorted(map(str, rows(periods_and_gaps(df, ["owner", "chrom"], "start_pos", "end_pos")))) == sorted(map(str, expect(data)))


def test_empty(spark):
    got = periods_and_gaps(spark.createDataFrame([], SCHEMA), ["owner", "chrom"], "start_pos", "end_pos")
    assert got.columns == ["owner", "chrom", "kind", "start_pos", "end_pos"] and got.count() == 0


def test_streamed_periods_across_blocks(spark, tmp_path):
    from locusweave.streaming.intervals import join_batch, latest_periods, streamed_periods

    rng = random.Random(5)
    batches = [[(1, "1", 0, 65_536), (1, "1", 140_000, 140_010)], [(1, "1", 65_536, 65_540), (2, "X", 65_530, 65_540)], [(1, "1", 65_539, 135_000), (2, "X", 65_600, 300_000)]]
    for batch in batches:
        batch += [(None, "2", s, s + rng.choice([5, 3000, 70_000])) for s in (rng.randrange(0, 2_000_000) for _ in range(15))]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    write = streamed_periods(stream, ["owner", "chrom"], "start_pos", "end_pos").writeStream.outputMode("update")
    query = write.foreachBatch(join_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    name = lambda owner, chrom: f'{{"owner":{"null" if owner is None else owner},"chrom":"{chrom}"}}'
    expected = sorted((name(o, c), *rest) for o, c, *rest in expect([r for b in batches for r in b]))
    assert rows(latest_periods(spark, str(tmp_path / "out"))) == expected
    assert (name(1, "1"), "period", 0, 135_000) in expected and (name(1, "1"), "gap", 135_000, 140_000) in expected
