"""Problem 8: evaluation texts leaking into training text.

Latent semantic retrieval. Test items are cut into the sentences of their passages; the corpus is cut into overlapping
windows of words. Sentences and windows become TF-IDF vectors over the words of the test set; a word's weight falls with its
frequency among all corpus passages and with its frequency among the test sentences (words of a common template say little). A randomised SVD of the sentences' matrix (range finder with power iteration, its products
computed per partition) gives a latent basis; windows whose projection lies close to a sentence's (cosine, and share of the
sentence's length) are candidates. A candidate counts if the longest common subsequence of words covers most of the
sentence, by words and by their weight, words equal up to one edit or transposition, and if most of its specific words
(names and numbers: the answer check) are among them. The first line (instruction) and the last (question) are not passage.

The test set is a stated query set: it is collected in parts of bounded size, their basis is broadcast, and every corpus row is
searched whole. The corpus is read twice (frequencies, search) and never shuffled; only counts per word are.

Defined results
* NULL or empty texts contain nothing; items without a passage line are judged by their whole text; NULL item texts never
  leak. Repeated documents are reported one by one, a document and item once.
* Sentences of fewer than six words are searched together with their neighbours; a passage that is shorter as a whole has to
  be there with every word.
* Order and spelling of columns beyond the named ones do not matter.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.blocks import text_blocks

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text without regard to case, spacing, punctuation and compatibility forms."""
    if not isinstance(text, str):
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.casefold())


def passage_sentences(text: str | None, min_words: int = 6) -> list[list[str]]:
    """Sentences of the passage of a test item: the lines between the instruction and the question.

    Sentences of fewer than min_words words are searched together with their neighbours, as one."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    middle = lines[1:-1] if len(lines) >= 3 else lines
    out: list[list[str]] = []
    for s in (words(x) for line in middle for x in re.split(r"(?<=[.!?…])\s+", line)):
        if out and s and min(len(out[-1]), len(s)) < min_words:
            out[-1] = out[-1] + s
        elif s:
            out.append(s)
    return out


@dataclass
class TestSet:
    items: np.ndarray  # item of each sentence
    sentences: list[list[str]]
    vocabulary: dict[str, int]
    ids: list[np.ndarray] = field(default_factory=list)
    idf: np.ndarray | None = None
    specific: np.ndarray | None = None  # words of few sentences: names and numbers
    basis: np.ndarray | None = None  # [word, latent], rows scaled by idf
    latent: np.ndarray | None = None  # unit sentences
    length: np.ndarray | None = None  # latent lengths
    runs: dict[tuple[str, ...], object] = field(default_factory=dict)  # runs of words that only one item has

    __test__ = False


RUN = 5  #: words of a run that can give an item away


def collect_test_set(items: DataFrame, item_id: str, text: str) -> TestSet:
    rows = items.select(item_id, text).where(F.col(item_id).isNotNull()).orderBy(item_id).collect()
    owner, sentences, vocabulary = [], [], {}
    runs: dict[tuple[str, ...], object] = {}
    for i, t in rows:
        for s in passage_sentences(t):
            owner.append(i)
            sentences.append(s)
            for w in s:
                vocabulary.setdefault(w, len(vocabulary))
            for k in range(len(s) - RUN + 1):
                run = tuple(s[k : k + RUN])
                runs[run] = i if runs.get(run, i) == i else None
    out = TestSet(np.array(owner), sentences, vocabulary, runs={r: i for r, i in runs.items() if i is not None})
    out.ids = [np.array([vocabulary[w] for w in s]) for s in sentences]
    return out


def passage_frequencies(docs: DataFrame, text: str, vocabulary: dict[str, int], passage: int = 24) -> tuple[np.ndarray, int]:
    """In how many passages of `passage` words each word of the vocabulary occurs, over all documents; and their number."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        get, size = held.value.get, len(held.value)
        df, n = np.zeros(size, np.int64), 0
        for pdf in batches:
            texts = pdf[text].tolist()
            for start, end in text_blocks(texts):
                at, ids = [], []
                for t in texts[start:end]:
                    found = words(t)
                    ids.extend(get(w, -1) for w in found)
                    at.append(n + np.arange(len(found)) // passage)
                    n += -(-len(found) // passage)
                if ids:
                    ids, place = np.array(ids), np.concatenate(at)
                    known = ids >= 0
                    pairs = np.unique(place[known] * size + ids[known])
                    df += np.bincount(pairs % size, minlength=size)
        used = np.flatnonzero(df)
        yield pd.DataFrame({"w": np.append(used, -1), "n": np.append(df[used], n)})

    out, total = np.zeros(len(vocabulary), np.int64), 0
    for w, n in docs.select(text).mapInPandas(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect():
        if w < 0:
            total = n
        else:
            out[w] = n
    return out, total


def randomized_basis(spark, rows: list[np.ndarray], idf: np.ndarray, rank: int, over: int = 16, power: int = 1, seed: int = 5, slices: int = 4) -> np.ndarray:
    """Orthonormal [word, rank] basis of the right singular space of the TF-IDF matrix of rows of word ids.

    Each multiplication by the matrix and its transpose runs per partition of rows; what reaches the driver per partition
    and round is one [word, rank] product, bounded by the test set."""
    size = len(idf)
    rank = max(1, min(rank, len(rows), size))
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((size, min(rank + over, size)))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, ids array<int>").repartition(slices, "i")

    def sums(ids: list, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the matrix times m, word and weight of each entry, its row), without a dense row."""
        lengths = np.array([len(r) for r in ids])
        at = np.concatenate([np.asarray(r) for r in ids])
        row = np.repeat(np.arange(len(ids)), lengths)
        own = row * size + at
        names, count = np.unique(own, return_counts=True)
        row, at = names // size, names % size
        x = count * idf[at]
        x = x / np.maximum(np.sqrt(np.bincount(row, x * x, len(ids))), 1e-12)[row]
        return np.add.reduceat(x[:, None] * m[at], np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), axis=0), at, x, row

    for _ in range(power + 1):
        held = spark.sparkContext.broadcast(q)

        def product(batches, held=held):
            for pdf in batches:
                for start in range(0, len(pdf), 256):
                    proj, at, x, row = sums(pdf["ids"].iloc[start : start + 256].tolist(), held.value)
                    order = np.argsort(at, kind="stable")
                    at, part = at[order], (x[:, None] * proj[row])[order]
                    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    yield pd.DataFrame({"w": at[starts], "y": list(np.add.reduceat(part, starts, axis=0))})

        y = np.zeros_like(q)
        for r in frame.mapInPandas(product, "w int, y array<double>").toLocalIterator():
            y[r["w"]] += r["y"]
        q = np.linalg.qr(y)[0]
        held.destroy()
    # rotate onto the leading directions
    small = np.vstack([sums(rows[i : i + 1024], q)[0] for i in range(0, len(rows), 1024)])
    _, _, vt = np.linalg.svd(small, full_matrices=False)
    return q @ vt.T[:, :rank]


def fit_latent(spark, test: TestSet, df: np.ndarray, passages: int, rank: int = 256) -> TestSet:
    own = np.bincount(np.concatenate([np.unique(i) for i in test.ids]), minlength=len(test.vocabulary))
    rarity = np.log((len(test.ids) + 1) / (own + 1)) / np.log(len(test.ids) + 2) if len(test.ids) > 1 else np.ones(len(own))
    test.idf = np.log((passages + 1) / (df + 1)).clip(0) * rarity.clip(0) + 0.1
    test.specific = own <= max(2, len(test.ids) // 100)
    basis = randomized_basis(spark, test.ids, test.idf, rank)
    test.basis = np.vstack([basis * test.idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)  # last row: any other word
    latent = np.stack([test.basis[i].sum(axis=0) for i in test.ids])
    test.length = np.linalg.norm(latent, axis=1)
    test.latent = (latent / np.maximum(test.length, 1e-9)[:, None]).astype(np.float32)
    return test


def near(a: str, b: str) -> bool:
    """Equal up to one edit or one transposition, for words of at least four letters without digits."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return max(len(x), len(y)) <= 1 or (len(x) == 2 and x == y[::-1])


def common_subsequence(sentence: list[str], window: list[str], strange: list[int] | None = None) -> list[int]:
    """Places of the sentence in a longest common subsequence with the window, words equal up to near().

    strange: the places of the window at which a misspelt word may stand, by default all."""
    m, n = len(sentence), len(window)
    equal = np.zeros((m, n), bool)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(window):
        places.setdefault(w, []).append(j)
    odd = range(n) if strange is None else strange
    for i, w in enumerate(sentence):
        if w in places:
            equal[i, places[w]] = True
        else:
            for j in odd:
                if near(w, window[j]):
                    equal[i, j] = True
    table = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m - 1, -1, -1):
        best = np.where(equal[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < m and j < n:
        if equal[i, j] and table[i, j] == table[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def search_block(texts: list[str | None], test: TestSet, window: int = 28, stride: int = 9, min_cosine: float = 0.3, min_share: float = 0.4, cover: float = 0.5, margin: int = 14, at_once: int = 4096) -> list[tuple[int, object, float]]:
    """(place of the text, item, coverage) of each text and item found in a block of texts."""
    get, other = test.vocabulary.get, len(test.vocabulary)
    found = [words(t) for t in texts]
    sizes = np.array([len(f) for f in found])
    if not sizes.sum() or not len(test.sentences):
        return []
    ids = np.array([get(w, other) for f in found for w in f], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    energy = np.concatenate([[0.0], np.cumsum(np.append(test.idf, 0.0)[ids])])
    count = np.maximum(1, -(-np.maximum(sizes - window, 0) // stride) + 1)
    doc = np.repeat(np.arange(len(texts)), count)
    first = base[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * stride
    last = np.minimum(first + window, base[doc + 1])
    # the sum of the words' weights bounds a window's length and so its projection: a window in which it is below the least
    # share of every sentence cannot be a candidate
    kept = np.flatnonzero(energy[last] - energy[first] >= min_share * test.length.min())
    hits: dict[tuple[int, object], float] = {}
    padded = np.append(ids, [other] * window)
    for at in range(0, len(kept), 2048):
        part = kept[at : at + 2048]
        span = first[part][:, None] + np.arange(window)[None, :]
        grid = np.where(span < last[part][:, None], padded[span], other)
        vectors = np.zeros((len(part), test.basis.shape[1]), np.float32)
        for j in range(window):
            vectors += test.basis[grid[:, j]]
        norm = np.linalg.norm(vectors, axis=1)
        near = []
        for b in range(0, len(test.latent), at_once):
            dots = vectors @ test.latent[b : b + at_once].T
            r, c = np.nonzero((dots >= min_cosine * norm[:, None]) & (dots >= min_share * test.length[None, b : b + at_once]))
            near += zip(part[r], c + b)
        for k, s in near:
            key = (int(doc[k]), test.items[s])
            if hits.get(key, 0.0) >= 0.95:
                continue
            a, b = max(int(first[k]) - margin, int(base[doc[k]])), min(int(last[k]) + margin, int(base[doc[k] + 1]))
            strange = np.flatnonzero(ids[a:b] == other).tolist()
            score = coverage(test, int(s), found[doc[k]][a - base[doc[k]] : b - base[doc[k]]], cover, strange)
            if score > hits.get(key, 0.0):
                hits[key] = score
    return [(d, item, score) for (d, item), score in hits.items()]


def coverage(test: TestSet, s: int, window: list[str], cover: float = 0.5, strange: list[int] | None = None, short: int = 6) -> float:
    """Weighted share of the sentence that a window contains; 0 if it is not most of it or the answer check fails.

    The answer check asks for most of the specific words. A literal run that no other item has gives an item away even
    without them. Of a passage of fewer than `short` words every word has to be there."""
    sentence, at = test.sentences[s], test.ids[s]
    matched = common_subsequence(sentence, window, strange)
    if len(matched) <= cover * len(sentence) or (len(sentence) < short and len(matched) < len(sentence)):
        return 0.0
    weights, specific = test.idf[at], test.specific[at]
    share = weights[matched].sum() / weights.sum()
    if share > cover and specific[matched].sum() >= cover * specific.sum():
        return float(share)
    literal = _longest_literal(sentence, window)
    if literal[1] - literal[0] <= cover * len(sentence):
        return 0.0
    own = any(test.runs.get(tuple(sentence[k : k + RUN])) == test.items[s] for k in range(literal[0], literal[1] - RUN + 1))
    return float(share) if own else 0.0


def _longest_literal(sentence: list[str], window: list[str]) -> tuple[int, int]:
    """(start, end) in the sentence of its longest run of words that the window has as such."""
    best, last = (0, 0), [0] * (len(window) + 1)
    for i, w in enumerate(sentence):
        now = [0] * (len(window) + 1)
        for j, x in enumerate(window):
            if w == x:
                now[j + 1] = last[j] + 1
                if now[j + 1] > best[1] - best[0]:
                    best = (i + 1 - now[j + 1], i + 1)
        last = now
    return best


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, rank: int = 256, part_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, coverage) of each document with each test item of whose passage it contains most of a sentence.

    A test set of more than part_items items is searched in parts of about that size, so that what is collected and
    broadcast stays bounded; each part reads the corpus twice."""
    parts = max(1, -(-items.count() // part_items))
    found = None
    for p in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == p)
        one = _search_part(docs, doc_id, text, collect_test_set(mine, item_id, item_text), item_id, dict(items.dtypes)[item_id], rank)
        found = one if found is None else found.unionByName(one)
    return found


def _search_part(docs: DataFrame, doc_id: str, text: str, test: TestSet, item_id: str, kind: str, rank: int) -> DataFrame:
    spark = docs.sparkSession
    schema = f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, `{item_id}` {kind}, coverage double"
    if not test.sentences:
        return spark.createDataFrame([], schema)
    df, passages = passage_frequencies(docs, text, test.vocabulary)
    held = spark.sparkContext.broadcast(fit_latent(spark, test, df, passages, rank))

    def search(batches):
        for pdf in batches:
            names, texts, rows = pdf[doc_id].tolist(), pdf[text].tolist(), []
            for at, end in text_blocks(texts):
                rows += [(names[at + d], i, c) for d, i, c in search_block(texts[at:end], held.value)]
            yield pd.DataFrame(rows, columns=[doc_id, item_id, "coverage"])

    return docs.where(F.col(doc_id).isNotNull()).select(doc_id, text).mapInPandas(search, schema)


def leaked_items(leaks: DataFrame, item_id: str, doc_id: str) -> DataFrame:
    """(item_id, documents, best coverage) of each leaked test item."""
    return leaks.groupBy(item_id).agg(F.countDistinct(doc_id).alias("documents"), F.max("coverage").alias("coverage"))
