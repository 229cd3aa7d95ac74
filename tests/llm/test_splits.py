import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm.splits import components, deal, spanning_forest, torn_groups, tree_links


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def links(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 25)), st.one_of(st.none(), st.integers(0, 25))), max_size=30))
def test_random_graphs(spark, edges):
    nodes, forest = spanning_forest(links(spark, edges), "a", "b")
    want = brute(edges)
    assert dict(map(tuple, nodes.collect())) == want
    trees = [tuple(r) for r in forest.collect()]
    assert brute(trees) == want and len(trees) == len(want) - len(set(want.values()))


def test_chain_star_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(160, 900), (900, 160), (7, 7)]
    nodes, _ = spanning_forest(links(spark, edges), "a", "b")
    assert dict(map(tuple, nodes.collect())) == brute(edges)


def test_components_through_unlisted_ids(spark):
    entities = spark.createDataFrame([(5,), (5,), (9,), (3,), (None,)], "e long")
    got = dict(map(tuple, components(entities, "e", links(spark, [(9, 1), (1, 5), (None, 3)]), "a", "b").collect()))
    assert got == {5: 5, 9: 5, 3: 3}
    assert components(entities.limit(0), "e", links(spark, []), "a", "b").count() == 0


def test_torn(spark):
    df = spark.createDataFrame([(1, "gold"), (1, "gold"), (2, "gold"), (2, "test"), (3, None)], "root long, split string")
    assert [tuple(r) for r in torn_groups(df, "root", "split").collect()] == [(2, ["gold", "test"])]


@pytest.mark.parametrize("sizes", [[1] * 400, [300] + [1] * 700, list(range(1, 120)), [7]])
def test_deal(spark, sizes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "root long, n long").withColumn("split", F.lit("clash"))
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.1), ("test", 0.2), (None, 0.5)], "name string, share double")
    got = {r["root"]: r["split"] for r in deal(df, "root", "n", targets, "name", "share").collect()}
    assert len(got) == len(sizes) and set(got.values()) <= {"train", "validation", "test"}
    if len(sizes) > 1:
        total = sum(sizes)
        for name, share in (("train", 0.7), ("validation", 0.1), ("test", 0.2)):
            assert abs(sum(sizes[i] for i, s in got.items() if s == name) / total - share) < 0.02


def test_deal_empty_and_bad_targets(spark):
    df = spark.createDataFrame([], "root long, n long")
    targets = spark.createDataFrame([("train", 1.0)], "name string, share double")
    assert deal(df, "root", "n", targets, "name", "share").count() == 0
    with pytest.raises(ValueError):
        deal(df, "root", "n", targets.limit(0), "name", "share")


def test_too_many_splits_are_an_error(spark):
    sizes, targets = spark.sql("select 1 as r, 2 as n"), spark.range(101).selectExpr("string(id) as name", "0.01D as share")
    with pytest.raises(ValueError):
        deal(sizes, "r", "n", targets, "name", "share")


def test_rounds_on_the_cluster_and_in_one_task_give_one_forest(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000, 1000 + i) for i in range(1, 60)] + [(i, i + 1) for i in range(2000, 2040)]
    want = brute(edges)
    found = []
    for last in (0, 40, 65_536):
        nodes, forest = spanning_forest(links(spark, edges), "a", "b", last_edges=last)
        assert dict(map(tuple, nodes.collect())) == want
        found.append(sorted(map(tuple, forest.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(want) - len(set(want.values()))
    trees = tree_links(links(spark, edges), "a", "b").collect()
    assert all(want[r["u"]] == want[r["v"]] == r["root"] for r in trees) and len(trees) == len(found[0])


def test_many_large_groups_are_all_dealt(spark):
    """More than 256 groups that each weigh more than a 64th of the smallest share."""
    df = spark.createDataFrame([(i, 1000 - i) for i in range(600)], "root long, n long")
    targets = spark.createDataFrame([("train", 0.5), ("validation", 0.25), ("test", 0.25)], "name string, share double")
    rows = deal(df, "root", "n", targets, "name", "share").collect()
    total = sum(r["n"] for r in rows)
    assert len(rows) == 600
    for name, share in (("train", 0.5), ("validation", 0.25), ("test", 0.25)):
        assert abs(sum(r["n"] for r in rows if r["split"] == name) / total - share) < 0.005
