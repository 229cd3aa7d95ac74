import pytest

from pulsegrid.operators.schema_drift import fuse, fused_schema, kind_of, profile_file, read_file, schema_changes, unify_rows


@pytest.mark.parametrize(("cell", "kind"), [("", None), ("  ", None), ("12", "integer"), ("-3", "integer"), ("1.0", "decimal"), ("1e5", "decimal"), (".5", "decimal"), ("true", "boolean"), ("No", "boolean"), ("2030-01-02", "datetime"), ("06.06.2030 05:25", "datetime"), ("2030-01-02T03:04:05Z", "datetime"), ("mill", "text"), ("1.2.3", "text")])
def test_kinds(cell, kind):
    assert kind_of(cell) == kind


def change(a, b):
    return sorted(fuse(profile_file(a), profile_file(b)))


def test_no_change_for_layout():
    a = "ts,value,is_anomaly\n1,2.5,true\n2,,false\n"
    b = '﻿"is_anomaly";"value";ts\r\nyes;2.5;1\r\nno;3.5;2\r\n'
    assert change(a, b) == []


def test_changes():
    a = "Timestamp,val,isAnomaly,site,trend\n1,2.5,0,mill,0.1\n2,3.5,1,dock,0.2\n"
    b = "ts,VAL,isAnomaly,site_tag,quality\n2030-01-01 00:00:00,2,0.0,dock,good\n2030-01-01 01:00:00,3,1.0,mill,bad\n"
    assert change(a, b) == [("added", "quality"), ("removed", "trend"), ("renamed", "VAL"), ("renamed", "site_tag"), ("renamed", "ts"), ("type_changed", "VAL"), ("type_changed", "isAnomaly"), ("type_changed", "ts")]


def test_empty_columns_have_no_type():
    assert change("a,b\n1,\n", "a,b\n1,x\n") == []


def test_read_file_edges():
    assert read_file(None) == ([], []) and read_file("") == ([], []) and read_file("\n\n") == ([], [])
    assert read_file("a,a\n1,2")[0] == ["a", "a#2"]
    names, rows = read_file('a;"b;c"\n"x;y";2\n')
    assert names == ["a", "b;c"] and rows == [["x;y", "2"]]
    assert profile_file("v\n" + "x" * 200_000)[0]["kind"] == "text"


FILES = [
    (1, "f", 1, "ts,val\n1,2.0\n", "extra"),
    (2, "f", 1, "ts,other\n1,2.0\n", None),
    (3, "f", 2, "ts,value\n2,3\n2,3\n", None),
    (4, "f", 300, "ts\n3\n", None),
    (5, "g", 1, None, None),
    (6, None, 1, "a\n1\n", None),
    (7, "g", None, "a\n1\n", None),
    (8, "g", 2, "a\n1\n", None),
]
SCHEMA = "file_id long, feed string, file_seq int, content string, change string"


def test_operator(spark):
    df = spark.createDataFrame(FILES, SCHEMA)
    got = sorted(tuple(r)[:3] for r in schema_changes(df, bucket=4).collect())
    assert got == [(3, "renamed", "value"), (3, "type_changed", "value"), (4, "removed", "value"), (8, "added", "a")]
    assert schema_changes(df.limit(0)).count() == 0
    assert fused_schema(df).where("feed = 'f' and path = 'value' and alternative = 'integer'").count() == 1


def test_rows(spark):
    rows = unify_rows(spark.createDataFrame(FILES, SCHEMA)).where("feed = 'f'").orderBy("file_id", "row_no").collect()
    assert [(r["file_id"], r["value"], r["value_integer"], r["value_decimal"]) for r in rows] == [(1, 2.0, None, 2.0), (3, 3.0, 3, None), (3, 3.0, 3, None), (4, None, None, None)]
    assert str(rows[0]["ts"]) == "1970-01-01 00:00:01"


def test_last_known_type_goes_on(spark):
    cells = ["1", "", "x", "", "2", "", "z"]
    df = spark.createDataFrame([(i, "f", i, f"t,c\n1,{c}\n", None) for i, c in enumerate(cells)], SCHEMA)
    want = [(2, "type_changed", "c", "integer", "text", True), (4, "type_changed", "c", "text", "integer", False), (6, "type_changed", "c", "integer", "text", False)]
    for bucket in (1, 2, 3, 4, 100):
        assert sorted(map(tuple, schema_changes(df, bucket=bucket).collect())) == want


def test_stretches_do_not_show(spark):
    """Whatever the stretches' length, the changes are those of one running fusion over the feed."""
    import random

    from pulsegrid.operators.schema_drift import advance, start

    rng = random.Random(3)
    names = [["site", "Site", "site_tag"], ["value", "val"], ["flag", "Flag "], ["note", "comment"]]
    kinds = [lambda: rng.choice(["", "mill", "dock", "kiln"]), lambda: rng.choice(["", "1", "2.5"]), lambda: rng.choice(["", "0", "true"]), lambda: ""]
    data, want = [], []
    for f in range(4):
        before, state = None, None
        for i in range(40):
            used = [(rng.choice(n), k) for n, k in zip(names, kinds) if rng.random() < 0.9] or [("value", kinds[1])]
            content = "\n".join([",".join(n for n, _ in used)] + [",".join(k() for _, k in used) for _ in range(2)])
            now = profile_file(content)
            if before is not None:
                changes, state = advance(state, before, now)
                want += [(100 * f + i, *c[:5]) for c in changes]
            else:
                state = start(now)
            before = now
            data.append((100 * f + i, f"f{f}", i, content, None))
    df = spark.createDataFrame(data, SCHEMA)
    for bucket in (1, 7, 1000):
        assert sorted(map(tuple, schema_changes(df, bucket=bucket).collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] == "type_changed" for w in want) > 20


def test_renames_by_content():
    assert change("t,humidity\n1,40.5\n2,41.5\n3,42.5\n", "t,moisture\n1,40.5\n2,41.5\n3,42.5\n") == [("renamed", "moisture")]
    assert change("t,humidity\n1,40.5\n2,41.5\n", "t,owner\n1,mill\n2,dock\n") == [("added", "owner"), ("removed", "humidity")]
    many = [f"w{i}" for i in range(300)]
    a, b = "t,site\n" + "".join(f"1,{w}\n" for w in many), "t,place\n" + "".join(f"1,{w}\n" for w in reversed(many))
    assert change(a, b) == [("renamed", "place")]


def test_redelivered_rows_without_feed_stay(spark):
    df = spark.createDataFrame([(1, None, 1, "a\n1\n", None), (2, None, 1, "a\n1\n", None), (3, "f", 1, "a\n1\n", None), (4, "f", 1, "a\n1\n", None)], SCHEMA)
    assert sorted(r["file_id"] for r in unify_rows(df).collect()) == [1, 2, 3]
