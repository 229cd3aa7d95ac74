"""Problem 9: mixing sources to target weights.

Sizes are tokens of a public tokenizer over whole texts. Temperature mixing puts an exponent on the sources' token shares.
With targets the share counts relative to the target, w_s ~ target_s * (natural_s / target_s)^e: e = 0 meets the targets, and
the total is the largest at which no source repeats more than allowed; a larger total, if asked for, bisects e to the least
exponent that keeps within every limit. With a target entropy, w_s ~ natural_s^e, e bisected to that entropy. Weights become
token budgets per source, realised as block permutations: a pass over a source permutes its blocks of bounded size and the
documents inside them, anew in every pass; whole passes take every document, the last one takes documents in its own order
until the budget is spent.

Defined results
* Documents without a source, of a source without target, or without tokens stay out. Sources without documents lose their
  target share to the others in proportion. Repeated rows count each.
* NULL or non-positive shares count as 0, NULL max_repeats as 1; a limit below 1 excludes the source.
* The actual share of a source differs from its weight by at most half its longest document, as documents stay whole.
* No source at hand gives an empty mixture and a report with zero shares.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import materialize

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: the public byte-level BPE's pattern for pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(path: str = DEFAULT_RANKS):
    """The tokenizer behind a file of ranks, once per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, text: str, keep: tuple[str, ...], path: str = DEFAULT_RANKS, name: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of tokens of each whole text; NULL texts have none."""
    types = dict(docs.dtypes)

    def run(batches):
        encode = encoder(path).encode_ordinary
        for pdf in batches:
            yield pdf.drop(columns=text).assign(**{name: [len(encode(t)) if isinstance(t, str) else 0 for t in pdf[text]]})

    return docs.select(*keep, text).mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + f", {name} bigint")


@dataclass(frozen=True)
class Source:
    name: str
    target: float
    max_repeats: int
    tokens: int
    docs: int


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def temper(shares: list[float], exponent: float) -> list[float]:
    raw = [x**exponent if x > 0 else 0.0 for x in shares]
    total = sum(raw)
    return [x / total for x in raw] if total else raw


def bisect(holds: Callable[[float], bool], low: float, high: float, rounds: int = 60) -> float:
    """The least exponent in [low, high] from which `holds` is true, if it is true at high."""
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def entropy_exponent(natural: list[float], target: float, most: float = 64.0) -> float:
    """The exponent on the token shares that gives them the entropy (clipped to what exponents in [0, most] reach)."""
    return bisect(lambda e: entropy(temper(natural, e)) <= target, 0.0, most)  # entropy falls as the exponent grows


def entropy_weights(natural: list[float], target: float) -> list[float]:
    return temper(natural, entropy_exponent(natural, target))


def plan_weights(sources: list[Source], total: float | str | None = None, rounds: int = 60, target_entropy: float | str | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, total tokens, exponent).

    With targets: w ~ target * (natural / target)^e, at the largest total that the repetition limits allow with e = 0, or at
    the asked total ('all': the tokens at hand) with the least e that keeps within the limits; e = 1 are the natural shares.
    With a target entropy ('targets': that of the target shares): w ~ natural^e, at the asked total or the largest that the
    limits allow."""
    at_hand = [s for s in sources if s.tokens > 0 and s.target > 0 and s.max_repeats >= 1]
    if not at_hand:
        return {}, 0.0, 0.0
    goal = temper([s.target for s in at_hand], 1.0)
    natural = temper([float(s.tokens) for s in at_hand], 1.0)
    if total == "all":
        total = float(sum(s.tokens for s in at_hand))

    def room(w: list[float]) -> float:
        return min(s.max_repeats * s.tokens / x for s, x in zip(at_hand, w) if x > 0)

    if target_entropy is not None:
        e = entropy_exponent(natural, entropy(goal) if target_entropy == "targets" else target_entropy)
        w = temper(natural, e)
        total = room(w) if total is None else min(total, room(w))
        return {s.name: x for s, x in zip(at_hand, w)}, total, e

    def weights(e: float) -> list[float]:
        return temper([g * (n / g) ** e for g, n in zip(goal, natural)], 1.0)

    if total is None or total <= room(weights(0.0)):
        e, total = 0.0, room(weights(0.0)) if total is None else total
    elif total > room(weights(1.0)):
        e, total = 1.0, room(weights(1.0))
    else:
        e = bisect(lambda x: room(weights(x)) >= total, 0.0, 1.0, rounds)
    return {s.name: w for s, w in zip(at_hand, weights(e))}, total, e


def plan_distributed(spark, sources: DataFrame, total: float | str | None, target_entropy: float | str | None) -> tuple[float, float, float, float]:
    """(exponent, total, exponent of the targets, norm): what plan_weights finds, for a table (target, repeats, tokens) of any
    number of sources; each step of a bisection is one aggregation."""
    held = sources.where("tokens > 0 and target > 0 and repeats >= 1")
    n, tokens, targets = held.agg(F.count(F.lit(1)), F.sum("tokens"), F.sum("target")).first()
    if not n:
        return 0.0, 0.0, 1.0, 1.0
    natural, goal = F.col("tokens") / F.lit(float(tokens)), F.col("target") / F.lit(float(targets))
    pure = target_entropy is not None

    def raw(e: float):
        return natural ** F.lit(e) if pure else goal * (natural / goal) ** F.lit(e)

    def look(e: float) -> tuple[float, float, float]:
        """(norm, entropy, room)"""
        w = raw(e)
        norm, logs, least = held.agg(F.sum(w), F.sum(w * F.log(w)), F.min(F.col("repeats") * F.col("tokens") / w)).first()
        return float(norm), math.log(norm) - logs / norm, norm * least

    if total == "all":
        total = float(tokens)
    if pure:
        wanted = float(held.agg(F.sum(-goal * F.log(goal))).first()[0]) if target_entropy == "targets" else target_entropy
        e = bisect(lambda x: look(x)[1] <= wanted, 0.0, 64.0, 40)
        norm, _, room = look(e)
        return e, room if total is None else min(total, room), 0.0, norm
    room = look(0.0)[2]
    if total is None or total <= room:
        e, total = 0.0, room if total is None else total
    elif total > (room := look(1.0)[2]):
        e, total = 1.0, room
    else:
        e = bisect(lambda x: look(x)[2] >= total, 0.0, 1.0, 40)
    return e, total, 1.0, look(e)[0]


def mix_sources(
    docs: DataFrame,
    doc_id: str,
    source: str,
    text: str,
    targets: DataFrame | None,
    share: str = "target_share",
    max_repeats: str = "max_repeats",
    total: float | str | None = None,
    path: str = DEFAULT_RANKS,
    block_docs: int = 512,
    seed: int = 11,
    driver_sources: int = 10_000,
    target_entropy: float | str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: (doc_id, source, n_tokens, copies, block), one row per document taken; in_sequence() lays
    its copies out. report: per target source its share, weight and actual share, tokens, documents, greatest number of
    copies, and the exponent. total and target_entropy are those of plan_weights; without targets every source is taken, once
    at most, and an entropy must be given.

    Only sums per source (at most driver_sources of them; beyond, aggregations take the place of lists) reach the driver.
    Running totals go over blocks of about block_docs documents: one row per block in the window per source, the documents of
    a block in a window of their own."""
    spark = docs.sparkSession
    named = docs.where(F.col(source).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = materialize(count_tokens(named, "text", ("doc_id", "source"), path).where("n_tokens > 0"), "tokens")
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    if targets is not None:
        goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(share).alias("share"), F.coalesce(F.max(max_repeats), F.lit(1)).alias("repeats"))
        goals = goals.join(sums, "source", "left").withColumn("target", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)))
    elif target_entropy is not None:
        goals = sums.select("source", F.lit(None).cast("double").alias("share"), F.lit(1).alias("repeats"), "tokens", "docs", F.lit(1.0).alias("target"))
    else:
        raise ValueError("without targets an entropy is needed")
    goals = materialize(goals, "sources")
    rows = goals.limit(driver_sources + 1).collect()
    if len(rows) <= driver_sources:
        weights, total, e = plan_weights([Source(r["source"], r["target"], int(r["repeats"]), r["tokens"] or 0, r["docs"] or 0) for r in rows], total, target_entropy=target_entropy)
        planned = goals.join(spark.createDataFrame([*weights.items()], "source string, weight double"), "source", "left")
    else:
        e, total, of_targets, norm = plan_distributed(spark, goals, total, target_entropy)
        whole = goals.where("tokens > 0 and target > 0 and repeats >= 1").agg(F.sum("tokens").alias("n"), F.sum("target").alias("t"))
        natural, goal = F.col("tokens") / whole.select("n").scalar(), F.col("target") / whole.select("t").scalar()
        raw = goal * (natural / goal) ** F.lit(e) if of_targets else natural ** F.lit(e)
        planned = goals.withColumn("weight", F.when(F.expr("tokens > 0 and target > 0 and repeats >= 1"), raw / F.lit(norm)))
    passes = F.col("weight") * F.lit(float(total)) / F.col("tokens")
    full = F.floor(passes + F.lit(1e-9)).cast("int")
    rest = (passes - full) * F.col("tokens")
    halvings = F.ceil(F.log2(F.col("docs") / F.lit(float(block_docs)))).cast("int")
    budget = planned.where("weight > 0").select("source", full.alias("passes"), F.when(rest > 1e-6, rest).otherwise(0.0).alias("rest"), F.when(halvings > 0, F.pow(F.lit(2.0), halvings)).otherwise(1.0).cast("int").alias("blocks"))
    placed = sized.join(budget, "source").withColumn("block", F.floor((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 33) / float(1 << 31)) * F.col("blocks")).cast("int"))
    # whole passes take every document; the last one takes what fits of its own permutation of the source
    blocks = placed.groupBy("source", "block", "passes").agg(F.sum("n_tokens").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("source").orderBy(*_turn("block", "passes", seed)).rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy(*_turn("doc_id", "passes", seed)).rowsBetween(Window.unboundedPreceding, -1))
    running = placed.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(starts, (F.col("source") == F.col("__s")) & (F.col("block") == F.col("__b")))
    middle = F.col("__before") + F.col("__inside") + F.col("n_tokens") / 2
    copies = (F.col("passes") + F.when((F.col("rest") > 0) & (middle <= F.col("rest")), 1).otherwise(0)).cast("int")
    mixture = running.withColumn("copies", copies).where("copies > 0").select(F.col("doc_id").alias(doc_id), "source", "n_tokens", "copies", "block")
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("__all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = (
        planned.select("source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "weight")
        .join(got, "source", "left")
        .withColumn("__all", whole.scalar())
        .select("source", "target_share", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(F.col("tokens") / F.col("__all"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("documents"), "max_repeats", zero("most_copies"), F.lit(e).alias("exponent"))
    )
    return mixture, report


def _turn(what: str, turn: str, seed: int) -> tuple:
    """The order of a permutation of blocks or documents, another one for each pass."""
    return F.xxhash64(what, turn, F.lit(seed)), F.col(what)


def in_sequence(mixture: DataFrame, doc_id: str, seed: int = 11) -> DataFrame:
    """(doc_id, source, n_tokens, turn, block, place): a row per copy of a mixture of mix_sources.

    A source is laid out pass by pass, each pass a permutation of its blocks and of the documents inside them; place, from 0
    to 1, is how much of the source's tokens comes before the middle of the copy. In the order of places the sources take
    turns, and every stretch of the mixture has about the shares of the whole."""
    copies = mixture.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    blocks = copies.groupBy("source", "turn", "block").agg(F.sum("n_tokens").alias("__n"))
    by_block = Window.partitionBy("source").orderBy("turn", *_turn("block", "turn", seed))
    starts = blocks.select(
        F.col("source").alias("__s"),
        F.col("turn").alias("__t"),
        F.col("block").alias("__b"),
        F.coalesce(F.sum("__n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy("source")).alias("__all"),
    )
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "turn", "block").orderBy(*_turn(doc_id, "turn", seed)).rowsBetween(Window.unboundedPreceding, -1))
    met = copies.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(starts, (F.col("source") == F.col("__s")) & (F.col("turn") == F.col("__t")) & (F.col("block") == F.col("__b")))
    return met.select(doc_id, "source", "n_tokens", "turn", "block", ((F.col("__before") + F.col("__inside") + F.col("n_tokens") / 2) / F.col("__all")).alias("place"))
