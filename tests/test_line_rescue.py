import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.operators.line_rescue import bulk, diagnose, parse_array, parse_block, parse_header, rescue_lines, split_lines, split_strict

FMT = (",", 3, 1, 2)
CASES = [
    ("t,1.5,0", None),
    ('"t","1.5","1"', None),
    (' t , +2e3 ,1.0', None),
    ("t,.5,", None),
    ("t,5.,0.0\r", None),
    ('t," 1 ",0', None),
    ('"a ""b"" c",1,0', None),
    ('"a,b",1,0', None),
    ('"t,1,0', "quoting"),
    ('t,1"2,0', "quoting"),
    ('"t"x,1,0', "quoting"),
    ('t,1,0"', "quoting"),
    ("t,1", "column_count"),
    ("t,1,0,", "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    ("t;1;0", "column_count"),
    ("t,nan,0", "invalid_value"),
    ("t,1e999,0", "invalid_value"),
    ("t,0x1F,0", "invalid_value"),
    ("t,1_000,0", "invalid_value"),
    ("t,٣,0", "invalid_value"),
    ("t,−1,0", "invalid_value"),
    ("t,,0", "invalid_value"),
    ("t,1,2", "invalid_value"),
    ("t,1,true", "invalid_value"),
    ("t,1,0\r\r", "invalid_value"),
]


@pytest.mark.parametrize(("line", "reason"), CASES)
def test_diagnose(line, reason):
    assert diagnose(line, FMT)[2] == reason


@pytest.mark.parametrize(("line", "reason"), CASES)
def test_fast_path_takes_valid_lines_only(line, reason):
    done = bulk(pa.array([line], pa.string()), FMT)
    assert done is None or reason is None
    if done is not None:
        assert (done[0][0].as_py(), done[1][0].as_py()) == diagnose(line, FMT)[:2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='t1.0,;" \r\te+-x\n', max_size=12), max_size=40), st.integers(1, 9))
def test_blocks_equal_strict_lines(lines, leaf):
    values, flags, reasons = parse_block(lines, FMT, leaf)
    assert list(zip(values, flags, reasons)) == [diagnose(x, FMT) for x in lines]


def test_header():
    assert parse_header('"Timestamp";"VAL";"isAnomaly"\r') == (";", 3, 1, 2)
    assert parse_header("﻿ts\tvalue") == ("\t", 2, 1, -1)
    assert parse_header(None) is None
    assert split_strict("a\tb", "\t") == (["a", "b"], True)


def test_operator(spark):
    data = [(1, "f", 1, "ts,value,is_anomaly", 7), (2, "f", 2, "t,1,0", 7), (3, "f", 2, "t,1,0", 7), (4, "f", 3, "t,x,0", None), (5, "g", 2, "t,1,0", 7), (6, None, 1, "t,1,0", 7), (7, "f", None, "t,2,1", 7), (8, "f", 4, None, 7), (9, "f", 5, "t," + "9" * 300_000 + ",0", 7)]
    df = spark.createDataFrame(data, "line_id long, file_name string, line_no int, line string, reason int")
    got = {r["line_id"]: (r["value"], r["is_anomaly"], r["reason"]) for r in rescue_lines(df).collect()}
    assert got == {2: (1.0, 0, None), 3: (1.0, 0, None), 4: (None, None, "invalid_value"), 5: (None, None, "no_header"), 6: (None, None, "no_header"), 7: (2.0, 1, None), 8: (None, None, "column_count"), 9: (None, None, "invalid_value")}
    good, bad = split_lines(df)
    assert good.count() == 3 and bad.count() == 5
    assert rescue_lines(df.limit(0)).count() == 0


def test_bulk_takes_nearly_all_valid_lines(spark):
    """Over the table of lines: at least 90 % of the valid ones never meet the strict parser, and the whole is faster."""
    import time
    from collections import defaultdict

    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.1/csv_lines.parquet").to_pylist()
    heads = {r["file_name"]: parse_header(r["line"]) for r in rows if r["line_no"] == 1}
    groups = defaultdict(list)
    for r in rows:
        if r["line_no"] != 1 and heads.get(r["file_name"]):
            groups[heads[r["file_name"]]].append(r["line"])
    bulk_rows, valid, fast, slow = 0, 0, 0.0, 0.0
    for fmt, lines in groups.items():
        array = pa.array(lines, pa.string())
        began = time.perf_counter()
        got = parse_array(array, fmt)
        fast += time.perf_counter() - began
        began = time.perf_counter()
        want = [diagnose(x, fmt) for x in lines]
        slow += time.perf_counter() - began
        assert list(zip(*parse_block(lines, fmt))) == want
        valid += sum(r is None for _, _, r in want)
        bulk_rows += got[3]
    print(bulk_rows, valid, round(fast, 3), round(slow, 3))
    assert bulk_rows >= 0.9 * valid and fast < slow


def test_hot_file_and_files_without_header(spark):
    data = [(0, "hot", 1, "ts,value,is_anomaly")] + [(i, "hot", i + 1, f"t,{i},0") for i in range(1, 3000)] + [(5000 + i, "bare", i + 2, "t,1,0") for i in range(2000)]
    data += [(9000 + 2 * i + k, f"f{i}", k + 1, ("value;ts", "1;t")[k]) for i in range(50) for k in (0, 1)] + [(9900, None, 3, "t,1,0")]
    got = {r["line_id"]: (r["value"], r["reason"]) for r in rescue_lines(spark.createDataFrame(data, "line_id long, file_name string, line_no int, line string"), hot_share=0.01).collect()}
    assert len(got) == 2999 + 2000 + 50 + 1
    assert all(got[i] == (float(i), None) for i in range(1, 3000)) and all(got[5000 + i] == (None, "no_header") for i in range(2000))
    assert all(got[9001 + 2 * i] == (1.0, None) for i in range(50)) and got[9900] == (None, "no_header")
