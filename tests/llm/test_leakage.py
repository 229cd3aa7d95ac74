import random

import numpy as np
import pytest

from pulsegrid.llm import leakage as L

NAMES = ["".join(random.Random(i).sample(["bre", "cor", "dra", "fen", "gau", "hol", "jo", "ke", "li", "mo"], 3)) for i in range(400)]


def sentence(r):
    a, b, c, d = r.sample(NAMES, 4)
    return f"In the province of {a.title()}, a technician named {b.title()} {c.title()} counted {r.randint(1, 999)} amber crystals beside the {d.title()} turbine until minute {r.randint(1, 999)}."


def item(r):
    return "Read the passage and answer the question below.\n" + " ".join(sentence(r) for _ in range(3)) + f"\nHow many units remain for {r.choice(NAMES).title()}?"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    items = [(i, item(r)) for i in range(30)]
    plain = lambda: " ".join(r.choice(["The mill owner painted the gates.", "Our group moved 258 boxes of letters.", f"The choir of {r.choice(NAMES).title()} opened the orchard."]) for _ in range(20))
    docs, truth = [], set()
    for n in range(160):
        text = plain()
        if n % 4 == 0:
            i = r.randrange(30)
            s = items[i][1].split("\n")[1].split(". ")[r.randrange(3)]
            kind = n // 4 % 5
            if kind == 1:
                s = s.upper().replace(" ", "  ")
            elif kind == 2:
                s = s.replace(",", "").replace("crystals", "crsytals")
            elif kind == 3:
                s = " ".join(s.split(" ")[: int(len(s.split(" ")) * 0.75)]) + " …"
            elif kind == 4:
                s = "…" + " ".join(s.split(" ")[int(len(s.split(" ")) * 0.25) :])
            text = text + " " + s + " " + plain()
            truth.add((n, i))
        elif n % 4 == 1:
            text += " " + sentence(r) + " Read the passage and answer the question below."
        docs.append((n, text))
    docs += [(1000, None), (1001, ""), (1002, "x " * 100_000), (1003, docs[0][1])]
    truth |= {(1003, i) for n, i in truth if n == 0}
    items += [(90, None), (91, ""), (92, "Short.")]
    return (
        spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string").drop("item_id"),
        spark.createDataFrame(items, "item_id long, text string"),
        truth,
    )


def test_finds_all_and_only(corpus):
    docs, items, truth = corpus
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == truth


def test_small_rank_and_brute_force(corpus, spark):
    docs, items, truth = corpus
    test = L.collect_test_set(items, "item_id", "text")
    df, n = L.passage_frequencies(docs, "text", test.vocabulary)
    L.fit_latent(spark, test, df, n, 64)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    keys = sorted(texts)
    got = {(keys[d], i) for d, i, _ in L.search_block([texts[k] for k in keys], test)}
    brute = {(k, test.items[s]) for k in keys for s in range(len(test.sentences)) if k != 1002 and L.coverage(test, s, L.words(texts[k])) > 0}
    assert len(got & brute) >= 0.9 * len(brute) and got <= brute | truth


def test_basis_is_orthonormal_and_leading(spark):
    rng = np.random.default_rng(0)
    rows = [rng.choice(40, 6) for _ in range(60)]
    idf = rng.random(40) + 0.5
    q = L.randomized_basis(spark, rows, idf, 10, power=3)
    assert np.allclose(q.T @ q, np.eye(10), atol=1e-8)
    a = np.zeros((60, 40))
    for n, r in enumerate(rows):
        np.add.at(a[n], r, idf[r])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    exact = np.linalg.svd(a, compute_uv=False)[:10]
    assert np.linalg.norm(a @ q) ** 2 > 0.97 * (exact**2).sum()


def test_words_and_near():
    assert L.words("L’État, ÉTÉ\xa0x_1…") == ["l", "état", "été", "x", "1"] and L.words(None) == []
    assert L.near("recorded", "recroded") and L.near("orchard", "orchad") and not L.near("362", "363") and not L.near("cat", "cut")
    assert L.common_subsequence(["a", "b", "c"], ["a", "x", "c"]) == [0, 2]


def test_empty(corpus):
    docs, items, _ = corpus
    assert L.find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert L.leaked_items(L.find_leaks(docs, "doc_id", "text", items, "item_id", "text"), "item_id", "doc_id").count() > 0
