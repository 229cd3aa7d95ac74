"""Problem 10: missing or wrong document language labels.

Sparse multinomial logistic regression on TF-IDF character n-grams (n = 1 … 3, hashed), trained with
follow-the-regularised-leader (FTRL-proximal, elastic net) and calibrated by a temperature on held-out segments.

* Document frequencies cover all documents (one pass). The classifier is fitted on a bounded sample of labelled documents,
  at most `train_docs` of each language by hash of the id, texts of up to `train_chars` characters first; segments that contradict their label after a first fit are
  left out of the second, because labels may be wrong and texts mixed. Copies with broken charsets are added, so that
  garbled texts keep their language.
* Every text is judged whole: it is cut into segments at line ends and sentence ends, each segment gets a language and a
  confidence, and the document's main language is the one with most letters in whole sentences.

Defined results
* Languages are those of LANGUAGES and, told by their script, those of SCRIPTS. A text in another language gets the one it
  looks most like, with the confidence of a wording that training has not seen.
* NULL, empty or letterless texts have no language: lang and confidence are NULL, languages is empty.
* A document without any whole sentence takes the language of its whole text.
* Ties go to the language that comes first in LANGUAGES. Repeated rows are judged one by one.
* If no row has a usable label, no model can be fitted and a ValueError says so.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.blocks import text_blocks

#: ISO 639-1 codes with their other codes and names.
LANGUAGES = {
    "en": "eng english anglais englisch",
    "de": "deu ger german deutsch",
    "fr": "fra fre french français francais",
    "es": "spa esp spanish español espanol castellano castilian",
    "it": "ita italian italiano",
    "pt": "por portuguese português portugues brazilian",
    "nl": "nld dut dutch nederlands flemish vlaams",
    "pl": "pol polish polski",
    "ru": "rus russian русский",
}
CODES = tuple(LANGUAGES)
#: Languages that their script tells, with the first and last letters of its blocks; Chinese characters beside Japanese
#: syllables count as Japanese.
SCRIPTS = {
    "el": ("ell gre greek", (0x370, 0x3FF)),
    "he": ("heb hebrew", (0x590, 0x5FF)),
    "ar": ("ara arabic", (0x600, 0x6FF)),
    "hi": ("hin hindi", (0x900, 0x97F)),
    "th": ("tha thai", (0xE00, 0xE7F)),
    "ja": ("jpn japanese", (0x3040, 0x30FF)),
    "zh": ("zho chi chinese", (0x4E00, 0x9FFF)),
    "ko": ("kor korean", (0xAC00, 0xD7AF)),
}
ALL_CODES = (*CODES, *SCRIPTS)
BITS = 16
DIM = 1 << BITS
_MUL = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _lut() -> np.ndarray:
    out = np.arange(1 << 16, dtype=np.uint32)
    for cp in range(1 << 16):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
        elif cp < 0x80 or ch.isspace() or ch.isdigit():
            out[cp] = 32
    return out


def _letters() -> np.ndarray:
    return np.fromiter((chr(cp).isalpha() for cp in range(1 << 16)), bool, 1 << 16)


_TABLES: dict[str, np.ndarray] = {}


def tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["lut"], _TABLES["letter"] = _lut(), _letters()
    return _TABLES["lut"], _TABLES["letter"]


def code_of(lang: Column) -> Column:
    """ISO 639-1 code that a label names, of the languages that can be told; NULL if it names none of them."""
    text = F.lower(F.trim(lang))
    base = F.element_at(F.split(text, "[-_ ]"), 1)
    known = F.create_map(*[x for code, names in [*LANGUAGES.items(), *((c, n) for c, (n, _) in SCRIPTS.items())] for name in [code, *names.split()] for x in (F.lit(name), F.lit(code))])
    return F.coalesce(F.try_element_at(known, text), F.try_element_at(known, base))


@dataclass
class Segments:
    """Segments of a batch of texts: document, place in its text, letters, words, whether it ends like a sentence; codes
    are the batch's characters."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    offset: np.ndarray
    letters: np.ndarray
    words: np.ndarray
    closed: np.ndarray


def segment(texts: list[str | None]) -> Segments:
    lut, letter = tables()
    texts = [t if isinstance(t, str) else "" for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    # every text ends in a line end of its own, so no n-gram or sentence runs over the border
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(raw, 0xFFFF)
    codes, is_letter = np.where(raw < 0x10000, lut[small], raw), letter[small] & (raw < 0x10000)
    doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    line_end = (raw == 10) | (raw == 13)
    stop = (raw == 46) | (raw == 33) | (raw == 63) | (raw == 0x2026)
    blank = (codes == 32) & ~stop
    cut = line_end.copy()
    low = is_letter & (codes == raw)
    goes_on = np.append(low[2:], [False, False])  # a small letter after stop and blank: an abbreviation or a broken charset
    cut[:-1] |= stop[:-1] & blank[1:] & ~goes_on[:-1]
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    if not len(ends):
        empty = np.zeros(0, np.int64)
        return Segments(codes, *[empty] * 7)
    doc = np.searchsorted(doc_start, starts, "right") - 1
    n_letters = np.add.reduceat(is_letter.astype(np.int64), starts)
    first = is_letter.copy()
    first[1:] &= ~is_letter[:-1]
    n_words = np.add.reduceat(first.astype(np.int64), starts)
    ended = np.zeros(len(starts), bool)
    for back in range(1, 5):  # a closing quote or bracket may follow the stop
        at = ends - back
        ended |= (at >= starts) & stop[np.maximum(at, 0)]
    return Segments(codes, starts, ends, doc, starts - doc_start[doc], n_letters, n_words, ended)


def ngrams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams that start at each character, n = 1, 2, 3."""
    c = codes.astype(np.uint32)
    b = np.append(c[1:], np.uint32(32))
    a = np.append(b[1:], np.uint32(32))
    shift = np.uint32(32 - BITS)
    with np.errstate(over="ignore"):
        h1 = c * _MUL[0] + np.uint32(1)
        h2 = (h1 ^ (h1 >> np.uint32(15))) + b * _MUL[1]
        h3 = (h2 ^ (h2 >> np.uint32(13))) * _MUL[2] + a * _MUL[0]
        return [(h * _MUL[1]) >> shift for h in (h1, h2 * _MUL[0], h3)]


def document_frequencies(docs: DataFrame, text: str, block: int = 128) -> tuple[np.ndarray, int]:
    """In how many documents each hashed n-gram occurs, over all documents; and their number."""

    def count(batches):
        df = np.zeros(DIM, np.int64)
        n = 0
        seen = np.zeros((block, DIM), np.uint8)
        for pdf in batches:
            texts = pdf[text].tolist()
            for at, end in text_blocks(texts, block):
                part = [t if isinstance(t, str) else "" for t in texts[at:end]]
                s = segment(part)
                seen[:] = 0
                lengths = np.array([len(t) + 1 for t in part])
                row = np.repeat(np.arange(len(part)), lengths)
                for g in ngrams(s.codes):
                    seen[row, g] = 1
                df += seen[: len(part)].sum(axis=0, dtype=np.int64)
                n += len(part)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"g": np.append(at, -1), "n": np.append(df[at], n)})

    rows = docs.select(text).mapInPandas(count, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIM, np.int64)
    inner = rows[rows["g"] >= 0]
    out[inner["g"]] = inner["n"]
    return out, int(rows.loc[rows["g"] < 0, "n"].sum())


@dataclass
class Model:
    table: np.ndarray  # [n-gram, language weights x idf …, idf^2]
    bias: np.ndarray
    temperature: float

    def scores(self, s: Segments, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Logits per segment, and their unnormalised sums with the squared norm in the last column."""
        sums = np.zeros((len(s.starts), self.table.shape[1]), np.float64)
        grams = ngrams(s.codes)
        for at in range(0, len(s.codes), block):
            end = min(at + block, len(s.codes))
            acc = self.table[grams[0][at:end]]
            acc += self.table[grams[1][at:end]]
            acc += self.table[grams[2][at:end]]
            a, b = np.searchsorted(s.ends, at, "right"), np.searchsorted(s.starts, end, "left")
            cuts = np.maximum(s.starts[a:b], at) - at
            if len(cuts):
                sums[a:b] += np.add.reduceat(acc, cuts, axis=0)
        return self.logits(sums), sums

    def logits(self, sums: np.ndarray) -> np.ndarray:
        return (sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-9)) + self.bias) / self.temperature


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Multinomial FTRL-proximal with elastic net over hashed features."""

    def __init__(self, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3):
        self.z, self.n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, rows: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One batch: entries (row, feature, value) in the order of rows, feature DIM being the bias."""
        used, place = np.unique(at, return_inverse=True)
        w = self.weights(used)
        k = w.shape[1]
        logits = np.stack([np.bincount(rows, x * w[place, c], len(y)) for c in range(k)], axis=1)
        err = softmax(logits)
        err[np.arange(len(y)), y] -= 1.0
        g = np.stack([np.bincount(place, x * err[rows, c], len(used)) for c in range(k)], axis=1) / np.sqrt(len(y))
        sigma = (np.sqrt(self.n[used] + g**2) - np.sqrt(self.n[used])) / self.alpha
        self.z[used] += g - sigma * w
        self.n[used] += g**2


def _entries(codes: list[np.ndarray], idf: np.ndarray):
    """Sparse rows of normalised TF-IDF occurrences, and a bias feature per row."""
    lengths = np.array([len(c) for c in codes])
    flat = np.concatenate([np.append(c, np.uint32(32)) for c in codes])
    rows = np.repeat(np.arange(len(codes)), lengths + 1)
    grams = np.concatenate(ngrams(flat)).astype(np.int64)
    rows = np.tile(rows, 3)
    x = idf[grams]
    norm = np.sqrt(np.maximum(np.bincount(rows, x * x, len(codes)), 1e-9))
    every = np.arange(len(codes))
    return np.append(rows, every), np.append(grams, np.full(len(codes), DIM)), np.append(x / norm[rows], np.ones(len(codes)))


def _garbled(text: str, lang: str) -> list[str]:
    """The text as broken charset handling leaves it."""
    out = [text.encode("utf-8").decode("cp1252", "replace"), text.encode("utf-8").decode("latin-1")]
    single = {"pl": "iso-8859-2", "ru": "cp1251"}.get(lang, "cp1252")
    raw = text.encode(single, "ignore")
    out += [raw.decode("utf-8", "replace"), raw.decode("latin-1"), raw.decode({"ru": "koi8-r", "pl": "cp1250"}.get(lang, "iso-8859-2"), "replace")]
    return [t for t in out if t != text]


def held_out(codes: list[np.ndarray], share: int = 8, common: int = 3) -> np.ndarray:
    """Which segments are held out: about one in `share` wordings, with all segments of that wording.

    A wording is the sequence of a segment's common words (those of at least `common` segments), so that sentences which only
    differ in names and numbers are held out together, and confidence is measured on wordings that training has not seen."""
    words = ["".join(map(chr, c.tolist())).split() for c in codes]
    seen: dict[str, int] = {}
    for ws in words:
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    return np.array([zlib.crc32(" ".join(w for w in ws if seen[w] >= common).encode("utf-8", "surrogatepass")) % share == 0 for ws in words], bool)


def fit(sample: pd.DataFrame, df: np.ndarray, n_docs: int, text: str = "text", seed: int = 7, epochs: int = 2, batch: int = 256, garbled_share: float = 0.12) -> Model:
    """Fit on a bounded sample with columns text and code."""
    rng = np.random.default_rng(seed)
    idf = np.log((1 + n_docs) / (1 + df)) + 0.2
    s = segment(sample[text].tolist())
    code = {c: i for i, c in enumerate(CODES)}
    labels = sample["code"].map(code).to_numpy()
    good = np.flatnonzero((s.letters >= 15) & (s.words >= 3))
    codes, y = [s.codes[s.starts[i] : s.ends[i]] for i in good], labels[s.doc[good]]
    texts = sample[text].tolist()
    for i in good[rng.random(len(good)) < garbled_share]:
        d = s.doc[i]
        kinds = _garbled(texts[d][s.offset[i] : s.offset[i] + s.ends[i] - s.starts[i]], CODES[labels[d]])
        if kinds:
            t = segment([kinds[int(rng.integers(len(kinds)))].replace("\n", " ")])
            codes.append(t.codes)
            y = np.append(y, labels[d])
    fold = held_out(codes)
    keep = np.ones(len(codes), bool)

    def train(keep: np.ndarray) -> Ftrl:
        model = Ftrl(len(CODES))
        use = np.flatnonzero(keep & ~fold)
        for _ in range(epochs):
            use = rng.permutation(use)
            for at in range(0, len(use), batch):
                part = use[at : at + batch]
                model.step(*_entries([codes[i] for i in part], idf), y[part])
        return model

    def frozen(model: Ftrl, temperature: float = 1.0) -> Model:
        w = model.weights()
        return Model(np.column_stack([w[:DIM] * idf[:, None], idf**2]).astype(np.float32), w[DIM], temperature)

    def predict(model: Model, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), len(CODES)))
        for at in range(0, len(which), 4096):
            part = [codes[i] for i in which[at : at + 4096]]
            lengths = np.array([len(c) for c in part])
            ends = np.cumsum(lengths)
            out[at : at + len(part)] = model.scores(Segments(np.concatenate(part), ends - lengths, ends, *[np.zeros(len(part), np.int64)] * 5))[0]
        return out

    every = np.arange(len(codes))
    p = softmax(predict(frozen(train(keep)), every))
    keep = (p.argmax(axis=1) == y) | (p[every, y] > 0.3)
    model = train(keep)
    held = np.flatnonzero(fold & keep)
    z = predict(frozen(model), held)
    grid = np.geomspace(0.01, 5.0, 80)
    losses = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
    return frozen(model, float(grid[int(np.argmin(losses))]) if len(held) else 1.0)


RESULT = "lang string, confidence double, languages array<string>, segments array<struct<start:int,length:int,lang:string,confidence:double>>"


def by_script(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(place in ALL_CODES, share of the letters) of the script of each segment, -1 where it tells no language."""
    out, share = np.full(len(s.starts), -1), np.zeros(len(s.starts))
    if not len(s.starts) or not (s.codes >= 0x370).any() or s.codes.max() < 0x370:
        return out, share
    c = s.codes
    counts = np.stack([np.add.reduceat(((c >= a) & (c <= z)).astype(np.int64), s.starts) for _, (a, z) in SCRIPTS.values()], axis=1)
    names = list(SCRIPTS)
    ja, zh = names.index("ja"), names.index("zh")
    kana = counts[:, ja] > 0
    counts[kana, ja] += counts[kana, zh]
    counts[kana, zh] = 0
    best = counts.argmax(axis=1)
    most = counts[np.arange(len(best)), best]
    told = 2 * most > np.maximum(s.letters, most)
    out[told] = len(CODES) + best[told]
    share[told] = most[told] / np.maximum(s.letters, most)[told]
    return out, share


def judge(texts: list[str | None], model: Model, min_letters: int = 20, min_words: int = 4, min_confidence: float = 0.8, min_alone: float = 0.97):
    """Per text: (main language, confidence, languages in whole sentences, segments), languages as places in ALL_CODES."""
    s = segment(texts)
    n, k = len(texts), len(ALL_CODES)
    logits, sums = model.scores(s)
    p = softmax(logits) if len(logits) else logits
    best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
    conf = p[np.arange(len(p)), best] if len(p) else np.zeros(0)
    script, share = by_script(s)
    best, conf = np.where(script >= 0, script, best), np.where(script >= 0, share, conf)
    # a short one is a whole sentence if what comes before it has ended; else it is the rest of a broken line
    after = np.ones(len(s.starts), bool)
    after[1:] = s.closed[:-1] | (s.doc[1:] != s.doc[:-1])
    long = (s.letters >= min_letters) & (s.words >= min_words)
    whole = long | (s.letters >= min_letters // 2) & (s.words >= 2) & s.closed & after | (script >= 0) & (s.letters >= 4)
    mass, sure = np.zeros((n, k)), np.zeros((n, k))
    np.add.at(mass, (s.doc[whole], best[whole]), s.letters[whole] * conf[whole])
    safe = np.flatnonzero(whole & (s.closed | (script >= 0)) & (conf >= min_confidence))
    count = np.zeros((n, k), int)
    np.add.at(count, (s.doc[safe], best[safe]), 1)
    safe = safe[(count[s.doc[safe], best[safe]] > 1) | long[safe] & (conf[safe] >= min_alone) | (script[safe] >= 0)]
    np.add.at(sure, (s.doc[safe], best[safe]), s.letters[safe])
    total, letters = np.zeros((n, sums.shape[1])), np.zeros(n)
    np.add.at(total, s.doc, sums)
    np.add.at(letters, s.doc, s.letters)
    overall = softmax(model.logits(total)) if n else total
    has = mass.sum(axis=1) > 0
    main = np.where(has, mass.argmax(axis=1), overall.argmax(axis=1)) if n else np.zeros(0, int)
    judged = np.bincount(s.doc[whole], s.letters[whole], n)
    certainty = np.where(has, mass[np.arange(n), main] / np.maximum(judged, 1), overall.max(axis=1) if n else 0.0)
    return s, best, conf, main, certainty, sure, letters


def identify(docs: DataFrame, doc_id: str, label: str, text: str, train_docs: int = 200, train_chars: int = 20_000, seed: int = 7, with_segments: bool = True) -> DataFrame:
    """(doc_id, label_code, lang, confidence, languages[, segments]) of each document.

    label_code is the language that the given label names, NULL if none. Texts cross to Python twice, in Arrow batches,
    and are never shuffled but for the sample, which takes repeated rows once; the model (a few MB, of fixed size) is broadcast."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"), code_of(F.col(label)).alias("label_code"))
    df, n_docs = document_frequencies(rows, "text")
    ranked = rows.where(F.col("label_code").isin(*CODES) & F.col("text").isNotNull()).select("__id", "label_code", F.dense_rank().over(Window.partitionBy("label_code").orderBy(F.length("text") > train_chars, F.xxhash64("__id", F.lit(seed)), "__id")).alias("rank"))
    chosen = ranked.where(F.col("rank") <= train_docs).select("__id", "label_code").distinct()
    sample = rows.where(F.col("label_code").isin(*CODES) & F.col("text").isNotNull()).join(F.broadcast(chosen), ["__id", "label_code"], "left_semi")
    once = sample.groupBy("__id", F.col("label_code").alias("code")).agg(F.min_by("text", F.struct(F.length("text") > train_chars, "text")).alias("text"))
    sample = once.orderBy("code", "__id").toPandas()
    if sample.empty and n_docs:
        raise ValueError("no row has a usable language label")
    held = spark.sparkContext.broadcast(fit(sample, df, n_docs, seed=seed) if len(sample) else None)
    id_type = dict(docs.dtypes)[doc_id]
    schema = f"`{doc_id}` {id_type}, label_code string, " + (RESULT if with_segments else RESULT.split(", segments")[0])

    def run(batches):
        for pdf in batches:
            for at, end in text_blocks(pdf["text"].tolist()):
                part = pdf.iloc[at:end]
                s, best, conf, main, certainty, sure, letters = judge(part["text"].tolist(), held.value)
                names = np.array(ALL_CODES, object)
                known = letters > 0
                out = {doc_id: part["__id"].to_numpy(), "label_code": part["label_code"].to_numpy(), "lang": np.where(known, names[main], None), "confidence": np.where(known, certainty, np.nan)}
                out["languages"] = [[] if not known[i] else [ALL_CODES[main[i]], *[ALL_CODES[j] for j in np.flatnonzero(sure[i]) if j != main[i]]] for i in range(len(part))]
                if with_segments:
                    lists: list[list] = [[] for _ in range(len(part))]
                    for i in np.flatnonzero(s.letters > 0):
                        lists[s.doc[i]].append({"start": int(s.offset[i]), "length": int(s.ends[i] - s.starts[i]), "lang": ALL_CODES[best[i]], "confidence": float(conf[i])})
                    out["segments"] = lists
                frame = pd.DataFrame(out)
                frame["confidence"] = frame["confidence"].astype("Float64").mask(~known)
                yield frame

    return rows.mapInPandas(run, schema)


def mislabelled(found: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label is missing or wrong or whose text is mixed."""
    wrong = F.col("label_code").isNull() | (F.col("label_code") != F.col("lang")) | (F.size("languages") > 1)
    return found.where(F.col("lang").isNotNull() & wrong).select(doc_id, F.explode("languages").alias("lang"))
