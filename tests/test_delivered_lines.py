import pyarrow as pa
import pytest
from conftest import SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from locusweave.session import table
from locusweave.sources import delivered_lines as dl

PILEUP = [
    ("chr1\t5\tA\t2\t.,\tII\tr1,r2", None),
    ("chr1\t5\tA\t0\t*\t*\t*", None),
    ("chr1\t5\tA\t3\t^I.$,+2ACG\tIII\tr1,r2,r3", None),
    ("chr1\t5\tA\t1\t^+.\tI\tr1\t0\t\t\t", None),
    ("chr1\t007\tA\t1\t*\tI\tr1", None),
    ("chr1\t5\tA\t2\t.,\tII", "columns"),
    ("chr1\t5\tA", "columns"),
    ("chr1\t0\tA\t2\t.,\tII\tr1,r2", "position"),
    ("chr1\t2147483648\tA\t2\t.,\tII\tr1,r2", "position"),
    ("chr1\t٣\tA\t2\t.,\tII\tr1,r2", "position"),
    ("chr1\t5\tA\t-1\t.,\tII\tr1,r2", "depth"),
    ("chr1\t5\tA\t2\t.\tII\tr1", "names"),
    ("chr1\t5\tA\t1\t..\tII\tr1\t1\t.\tI\tr1,r2", "names"),
    ("chr1\t5\tA\t2\t.\tII\tr1,r2", "bases"),
    ("chr1\t5\tA\t1\t.^\tI\tr1", "bases"),
    ("chr1\t5\tA\t1\t.+0\tI\tr1", "bases"),
    ("chr1\t5\tA\t1\t.+5AC\tI\tr1", "bases"),
    ("chr1\t5\tA\t1\t.+\tI\tr1", "bases"),
    ("chr1\t5\tA\t2\t.,\tI\tr1,r2", "quals"),
]
CN = [
    ("chr1\t1\t5\t2.0\t1\t0.5\t3\tNA\t0.1", None),
    (" chr1 \t 1\t5 \t2.0\t nan \t0.5\t3\t2.0\t0.1\tnote\tmore", None),
    ('"chr1"\t1\t5\t2.0\t1\t0.5\t3\t.\t0.1\t"a ""b""\tc"', None),
    ('chr1\t1\t5\t2.0\t1\t0.5\t3\t\t0.1\tflag 5" arm', None),
    ('chr1\t1\t5\t2.0\t1\t0.5\t3\t1\t0.1\t"open', "quoting"),
    ('"chr1"x\t1\t5\t2.0\t1\t0.5\t3\t1\t0.1', "quoting"),
    ("chr1\t1\t5\t2.0\t1\t0.5\t3\t1", "columns"),
    ('chr1\t1\t5\t"2.0\t1"\t0.5\t3\t1\t0.1', "columns"),
    ("  \t1\t5\t2.0\t1\t0.5\t3\t1\t0.1", "chrom"),
    ("chr1\t5\t5\t2.0\t1\t0.5\t3\t1\t0.1", "coordinates"),
    ("chr1\t-1\t5\t2.0\t1\t0.5\t3\t1\t0.1", "coordinates"),
    ("chr1\t1.0\t5\t2.0\t1\t0.5\t3\t1\t0.1", "coordinates"),
    ("chr1\t1\t5\t2.0\t1.\t0.5\t3\t1\t0.1", "state"),
    ("chr1\t1\t5\t2.0\t1\t0.5\t3\t-1\t0.1", "state"),
    ("chr1\t1\t5\t2.0\t1\t0.5\t3\t?\t0.1", "state"),
]


@pytest.mark.parametrize(("bulk", "strict", "packed", "cases"), [(dl.bulk_pileup, dl.strict_pileup, dl._PILEUP, PILEUP), (dl.bulk_cn, dl.strict_cn, dl._CN, CN)])
def test_blocks_agree_with_strict_reading(bulk, strict, packed, cases):
    lines = [line for line, _ in cases for _ in range(9)]
    reasons, read = dl.parse_block(pa.array(lines, pa.string()), bulk, strict, packed)
    assert reasons == [reason for _, reason in cases for _ in range(9)]
    assert read.to_pylist() == pa.array([strict(line)[1] for line in lines], packed).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["chr1", "1", "5", "", '"', '""', '"a"', "0.5", "NA", ".", " ", "+2", "^", "$", ".,", "r1,r2", "2", "II"]), min_size=1, max_size=12), max_size=12))
def test_any_fields(lines):
    lines = ["\t".join(x) for x in lines]
    for bulk, strict, packed in ((dl.bulk_pileup, dl.strict_pileup, dl._PILEUP), (dl.bulk_cn, dl.strict_cn, dl._CN)):
        reasons, read = dl.parse_block(pa.array(lines, pa.string()), bulk, strict, packed)
        expected = [strict(line) for line in lines]
        assert reasons == [r for r, _ in expected]
        assert read.to_pylist() == pa.array([row for _, row in expected], packed).to_pylist()


def test_blank_and_comment_lines_are_no_rows(spark):
    data = [(1, None), (2, ""), (3, " \t "), (4, "#chr"), (5, "x"), (None, "y"), (5, "x")]
    df = spark.createDataFrame(data, "line_id long, line string").selectExpr("*", "'z' AS reason", "1 AS row")
    assert rows(dl.parse_pileup(df), "line_id", "reason") == [(None, "columns"), (5, "columns"), (5, "columns")]
    assert dl.failures(df.limit(0), df.limit(0)).count() == 0


def test_long_line_is_read_whole(spark):
    n = 100_000
    line = f"chr1\t5\tA\t{n}\t{'.' * n}\t{'I' * n}\t{','.join(['r'] * n)}"
    df = spark.createDataFrame([(1, line)], "line_id long, line string")
    assert dl.parse_pileup(df).selectExpr("reason", "length(row.inputs[0].symbols)").first() == (None, n)


def test_valid_and_failing_lines_are_all_content_lines(spark):
    raw = table(spark, SMALL, "cn_profile_raw")
    content = raw.where(r"line rlike '\\S' and not startswith(line, '#')").count()
    parsed = dl.parse_copy_number(raw)
    assert parsed.count() == content
    assert parsed.where("(reason is null) = (row is null)").count() == 0
