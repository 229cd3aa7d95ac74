import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language as L

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", "text")
    pure = docs.where("lang in ('en', 'de') and length(text) > 500").orderBy("doc_id")
    en, de = (pure.where(f"lang = '{c}'").first()["text"] for c in ("en", "de"))
    rows = [(90001, "en", None), (90002, "en", ""), (90003, None, "123 456 …"), (90004, "de", "Der alte Garten neben dem Kanal gehört der neuen Bäckerei. " * 3000), (90005, "en", de), (90006, None, "The librarian painted the wooden gates and nobody complained about it. The night shift at the depot opened the signal box.\nDer Besitzer der Mühle öffnete wieder die alte Karte des Tals. Die neue Bäckerei verkaufte bald darauf die Boote im Hafen, weil das Dach undicht war."), (90007, "English", en), (90007, "English", en)]
    extra = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    return L.identify(docs.unionByName(extra).withColumn("confidence", F.lit("clash")), "doc_id", "lang", "text", train_docs=120).cache()


def test_held_out_accuracy(found):
    """Documents with one language and a label that is right for nine in ten of them."""
    rows = found.where("label_code is not null and lang is not null and size(languages) = 1").collect()
    assert np.mean([r["label_code"] == r["lang"] for r in rows]) > 0.9


def test_cases(found):
    by = {r["doc_id"]: r for r in found.where("doc_id > 90000").collect()}
    assert by[90001]["lang"] is None and by[90002]["lang"] is None and by[90003]["languages"] == []
    assert by[90004]["lang"] == "de" and by[90005]["lang"] == "de" and by[90007]["lang"] == "en"
    assert sorted(by[90006]["languages"]) == ["de", "en"]
    segments = by[90006]["segments"]
    assert [s["lang"] for s in segments] == ["en", "en", "de", "de"] and all(0 < s["confidence"] <= 1 for s in segments)
    cases = {(r["doc_id"], r["lang"]) for r in L.mislabelled(found, "doc_id").where("doc_id > 90000").collect()}
    assert (90005, "de") in cases and {(90006, "de"), (90006, "en")} <= cases and not any(d in (90001, 90003, 90004, 90007) for d, _ in cases)


def test_labels(spark):
    names = ["en", "EN", "en-GB", "en_US", " German ", "deu", "fra", "pt-BR", "русский", "xx", "und", "", None, "unknown", "Klingon", "nl-BE"]
    df = spark.createDataFrame([(n,) for n in names], "lang string")
    assert [r[0] for r in df.select(L.code_of(F.col("lang"))).collect()] == ["en", "en", "en", "en", "de", "de", "fr", "pt", "ru", None, None, None, None, None, None, "nl"]


def test_segments_cover_the_text():
    text = "First one. Second?  Third…\nFourth line\r\nz. B. hier bleibt es eins! Ende"
    s = L.segment([text, None, "", "x"])
    mine = [text[o : o + n] for d, o, n in zip(s.doc, s.offset, s.ends - s.starts) if d == 0]
    assert "".join(mine).rstrip("\n") == text and [m.strip() for m in mine if m.strip()][:4] == ["First one.", "Second?", "Third…", "Fourth line"]


def test_frequencies_by_brute_force(spark):
    texts = ["abc abd", "abc", "xyz", ""]
    df, n = L.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    want = np.zeros(L.DIM, int)
    for t in texts:
        want[np.unique(np.concatenate(L.ngrams(L.segment([t]).codes)))] += 1
    assert n == 4 and (df == want).all()


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    model = L.Ftrl(2)
    for _ in range(60):
        y = rng.integers(0, 2, 64)
        at = np.where(rng.random(64) < 0.9, y, 1 - y) + 10
        noise = rng.integers(1000, 60000, 64)
        model.step(np.r_[np.arange(64), np.arange(64)], np.r_[at, noise], np.ones(128), y)
    w = model.weights()
    assert w[10, 0] > w[10, 1] and w[11, 1] > w[11, 0] and (w == 0).mean() > 0.9


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], "d long, lang string, text string")
    assert L.identify(empty, "d", "lang", "text").count() == 0
    with pytest.raises(ValueError):
        L.identify(spark.createDataFrame([(1, None, "text")], "d long, lang string, text string"), "d", "lang", "text")


def test_sample_takes_repeated_rows_once(spark, monkeypatch):
    samples = []
    monkeypatch.setattr(L, "fit", lambda sample, *a, **k: samples.append(sample))
    rows = [(i, "de", f"Text {i}") for i in (1, 2) for _ in range(20)] + [(i, "ru", f"Text {i}") for i in (2, 3, 4)]
    L.identify(spark.createDataFrame(rows, "d long, lang string, text string"), "d", "lang", "text", train_docs=3)
    assert [tuple(r) for r in samples[0][["__id", "code"]].to_numpy()] == [(1, "de"), (2, "de"), (2, "ru"), (3, "ru"), (4, "ru")]


def test_held_out_wordings_are_whole():
    texts = [f"The {a} painted {i} boxes in {b}." for i, (a, b) in enumerate([("baker", "Rome"), ("smith", "Oslo"), ("cook", "Bonn"), ("clerk", "Lyon")] * 5)]
    texts += [f"Nobody in {b} heard about the {a} again." for a, b in [("storm", "Kiel"), ("fair", "Pisa"), ("flood", "Graz")]]
    s = L.segment(texts)
    out = L.held_out([s.codes[a:b] for a, b, n in zip(s.starts, s.ends, s.letters) if n])
    assert len(out) == len(texts) and len(set(out[20:].tolist())) == 1


def test_scripts_tell_languages():
    s = L.segment(["Ο παλμός μένει σταθερός.", "心拍数は安定しています。", "心率稳定。", "plain words only.", "Пульс стабилен.", "α decay", ""])
    code, share = L.by_script(s)
    first = {int(d): (L.ALL_CODES[c] if c >= 0 else None) for d, c in zip(s.doc[::-1], code[::-1])}
    assert [first[i] for i in range(6)] == ["el", "ja", "zh", None, None, None] and (share[code >= 0] > 0.5).all()
