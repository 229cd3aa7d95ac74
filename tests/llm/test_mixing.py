import math

import pytest

from pulsegrid.llm import mixing as M


def src(name, target, repeats, tokens):
    return M.Source(name, target, repeats, tokens, 10)


def test_plan_meets_targets_and_limits():
    s = [src("a", 0.5, 1, 1000), src("b", 0.3, 4, 100), src("c", 0.2, 2, 5000), src("d", 0.0, 2, 10), src("e", 0.4, 2, 0)]
    w, total, b = M.plan_weights(s)
    assert b == 0 and w == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}) and total == pytest.approx(400 / 0.3)
    for s_ in s[:3]:
        assert w[s_.name] * total <= s_.max_repeats * s_.tokens + 1e-6
    w2, total2, b2 = M.plan_weights(s, 3000)
    assert 0 < b2 < 1 and total2 == 3000 and sum(w2.values()) == pytest.approx(1)
    assert max(w2[x.name] * total2 / (x.max_repeats * x.tokens) for x in s[:3]) == pytest.approx(1, abs=1e-6)
    assert M.plan_weights([]) == ({}, 0.0, 0.0)


def test_entropy():
    natural = [0.7, 0.2, 0.1]
    for h in (0.3, 0.8, 1.05):
        assert M.entropy(M.entropy_weights(natural, h)) == pytest.approx(h, abs=1e-6)
    assert M.entropy(M.entropy_weights(natural, 9.0)) == pytest.approx(math.log(3))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, ["big", "mid", "tiny"][(i % 20 > 12) + (i % 20 == 19)], "word " * (5 + i % 30), 1) for i in range(900)]
    rows += [(2000, None, "lost text", 1), (2001, "big", None, 1), (2002, "big", "", 1), (2003, "unlisted", "some text", 1), (5, "big", "word " * 10, 1)]
    return spark.createDataFrame(rows, "id long, source string, text string, copies int")


def test_mixture(spark, docs):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("tiny", 0.3, 4), ("none", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    for block in (512, 16):
        mixture, report = M.mix_sources(docs, "id", "source", "text", targets, block_docs=block)
        got = {r["source"]: r for r in report.collect()}
        assert got["none"]["actual_share"] == 0 and got["none"]["tokens"] == 0
        for s, share in (("big", 0.4), ("mid", 0.3), ("tiny", 0.3)):
            assert got[s]["actual_share"] == pytest.approx(share, abs=0.01) and got[s]["most_copies"] <= got[s]["max_repeats"]
        assert got["tiny"]["most_copies"] == 4
        rows = mixture.collect()
        assert {r["source"] for r in rows} == {"big", "mid", "tiny"} and all(r["copies"] >= 1 for r in rows)


def test_counts_are_the_tokenizers(spark, docs):
    encode = M.encoder().encode_ordinary
    texts = {r["id"]: r["text"] for r in docs.where("id < 20 and id <> 5").collect()}
    got = {r["id"]: r["n_tokens"] for r in M.count_tokens(docs.where("id < 20 and id <> 5"), "text", ("id",)).collect()}
    assert got == {i: len(encode(t)) for i, t in texts.items()}


def test_empty(spark, docs):
    targets = spark.createDataFrame([("big", None, None)], "source string, target_share double, max_repeats int")
    mixture, report = M.mix_sources(docs, "id", "source", "text", targets)
    assert mixture.count() == 0 and report.first()["actual_share"] == 0.0
    mixture, _ = M.mix_sources(docs.limit(0), "id", "source", "text", targets)
    assert mixture.count() == 0


def test_tempering_is_reached(spark, docs):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("tiny", 0.3, 4)], "source string, target_share double, max_repeats int")
    plain = {r["source"]: r for r in M.mix_sources(docs, "id", "source", "text", targets)[1].collect()}
    got = {r["source"]: r for r in M.mix_sources(docs, "id", "source", "text", targets, total="all")[1].collect()}
    held = M.count_tokens(docs.where("source <> 'unlisted'"), "text", ("id",)).agg({"n_tokens": "sum"}).first()[0]
    assert sum(r["tokens"] for r in got.values()) == pytest.approx(held, rel=0.01) and held > 1.2 * sum(r["tokens"] for r in plain.values())
    assert all(r["most_copies"] <= r["max_repeats"] for r in got.values()) and got["tiny"]["actual_share"] < 0.29
    even = M.mix_sources(docs, "id", "source", "text", None, target_entropy=1.0)[1].collect()
    assert len(even) == 4 and M.entropy([r["actual_share"] for r in even]) == pytest.approx(1.0, abs=0.03)
    with pytest.raises(ValueError):
        M.mix_sources(docs, "id", "source", "text", None)


def test_tempered_query(spark, sf):
    from pulsegrid.llm.queries import QUERIES

    count = lambda name: sum(r["tokens"] for r in QUERIES[name](spark, sf).collect())
    assert count("p9_tempered_shares") > count("p9_shares")


def test_shares_relative_to_targets_take_an_exponent():
    s = [src("a", 0.5, 1, 1000), src("b", 0.3, 4, 100), src("c", 0.2, 2, 5000)]
    w, _, e = M.plan_weights(s, 3000)
    natural = {x.name: x.tokens / 6100 for x in s}
    raw = {x.name: x.target * (natural[x.name] / x.target) ** e for x in s}
    assert w == pytest.approx({n: x / sum(raw.values()) for n, x in raw.items()})
    w, total, e = M.plan_weights(s, target_entropy="targets")
    assert M.entropy(list(w.values())) == pytest.approx(M.entropy([0.5, 0.3, 0.2]), abs=1e-6) and 0 < e < 1
    assert all(w[x.name] * total <= x.max_repeats * x.tokens + 1e-6 for x in s)


@pytest.mark.parametrize(("total", "h"), [(None, None), (3000.0, None), (1e9, None), (500.0, "targets")])
def test_many_sources_are_planned_alike(spark, total, h):
    s = [src("a", 0.5, 1, 1000), src("b", 0.3, 4, 100), src("c", 0.2, 2, 5000), src("d", 0.0, 2, 10), src("e", 0.4, 2, 0)]
    frame = spark.createDataFrame([(x.name, x.target, x.max_repeats, x.tokens) for x in s], "source string, target double, repeats int, tokens long")
    _, want, e = M.plan_weights(s, total, target_entropy=h)
    got = M.plan_distributed(spark, frame, total, h)
    assert got[0] == pytest.approx(e, abs=1e-6) and got[1] == pytest.approx(want, rel=1e-6)


def test_more_sources_than_the_driver_takes(spark, docs):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("tiny", 0.3, 4)], "source string, target_share double, max_repeats int")
    few, many = (sorted(map(tuple, M.mix_sources(docs, "id", "source", "text", targets, total="all", driver_sources=n)[0].collect())) for n in (10, 2))
    assert few == many


def test_sequence_permutes_every_pass(spark, docs):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("tiny", 0.3, 4)], "source string, target_share double, max_repeats int")
    mixture, report = M.mix_sources(docs.where("id <> 5"), "id", "source", "text", targets, total="all", block_docs=8)
    rows = sorted(M.in_sequence(mixture, "id").collect(), key=lambda r: r["place"])
    copies = {r["id"]: r["copies"] for r in mixture.collect()}
    assert sorted((r["id"], r["turn"]) for r in rows) == sorted((i, t) for i, n in copies.items() for t in range(n)) and max(copies.values()) > 1
    tiny = {t: [r["id"] for r in rows if r["source"] == "tiny" and r["turn"] == t] for t in (0, 1)}
    assert set(tiny[0]) >= set(tiny[1]) and tiny[0] != tiny[1]
    share = {r["source"]: r["actual_share"] for r in report.collect()}
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        whole = sum(r["n_tokens"] for r in part)
        for s, x in share.items():
            assert sum(r["n_tokens"] for r in part if r["source"] == s) / whole == pytest.approx(x, abs=0.03)
    assert all(0 < r["place"] < 1 for r in rows)
