"""Windows to view outputs: views, prompts, calls through a pluggable model with cache, retry and trace, and parsing."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.parse import parse_answers
from pulsegrid.registry import view_name
from pulsegrid.session import materialize
from pulsegrid.sources.llm_cache import DEFAULT_MODEL, append_new, cache_key, first_entries, misses, probe

#: Own wording; {classes} and {summary} are filled in.
TEMPLATES = {
    ("multi", "narrow"): "Pick the one class that fits this recording. Classes: {classes}.\n{summary}\nAnswer with JSON holding label (int) and confidence (0 to 1).",
    ("multi", "standard"): "You sort monitoring windows. Read the digest of each channel, then choose one class. Classes: {classes}.\n{summary}\nAnswer with JSON holding label (int), confidence (0 to 1) and rationale.",
    ("multi", "wide"): "The digest below describes one monitoring window. Leads may be absent; judge by those that are present, weigh every class and say briefly why. Classes: {classes}.\n{summary}\nAnswer with JSON holding label (int), confidence (0 to 1), rationale and runner_up (int or null).",
    ("binary", "narrow"): "Is this alarm genuine? Classes: {classes}.\n{summary}\nAnswer with JSON holding label (int) and confidence (0 to 1).",
    ("binary", "standard"): "A bedside alarm went off. Decide from the digest whether it is genuine or an artefact. Classes: {classes}.\n{summary}\nAnswer with JSON holding label (int), confidence (0 to 1) and rationale.",
    ("binary", "wide"): "A bedside alarm went off in the window below. Look for artefacts, flat lines and disagreement between leads before you decide. Classes: {classes}.\n{summary}\nAnswer with JSON holding label (int), confidence (0 to 1), rationale and runner_up (int or null).",
}

FALLBACK = '{"label": 0, "confidence": 0.5}'


def class_list(classes: Sequence[str]) -> str:
    return ", ".join(f"{i}={c}" for i, c in enumerate(classes))


def template_kind(classes: Sequence[str]) -> str:
    return "binary" if any("true_alarm" in c or "false_alarm" in c for c in classes) else "multi"


def view_name_col(variant: Column, temperature: Column) -> Column:
    """variant_T<temperature with at least one decimal>."""
    return F.concat(variant, F.lit("_T"), temperature.cast("double").cast("string"))


def with_views(items: DataFrame, views: Sequence[tuple[int, str, float]]) -> DataFrame:
    """Every item under every view, by exploding a literal array: no join."""
    rows = F.array(*[F.struct(F.lit(i).cast("int").alias("view_idx"), F.lit(v).alias("prompt_variant"), F.lit(float(t)).alias("temperature"), F.lit(view_name(v, t)).alias("view")) for i, v, t in views])
    return items.select("*", F.inline(rows))


def prompts(viewed: DataFrame, classes: Sequence[str], summary: str = "summary") -> DataFrame:
    """viewed with the prompt of each row's variant; unknown variants get the standard wording."""
    kind = template_kind(classes)
    filled = {v: TEMPLATES[kind, v].replace("{classes}", class_list(classes)) for v in ("narrow", "standard", "wide")}
    template = F.when(F.col("prompt_variant") == "narrow", filled["narrow"]).when(F.col("prompt_variant") == "wide", filled["wide"]).otherwise(filled["standard"])
    return viewed.withColumn("prompt", F.replace(template, F.lit("{summary}"), F.col(summary)))


class QuotaError(RuntimeError):
    """The endpoint will not answer any more; calls fail fast."""


TRACE = "model string, temperature double, prompt_tokens bigint, completion_tokens bigint, elapsed_s double, attempt int, prompt string, response string, error string, ts double"


class Answer(str):
    """An answer with the token counts that its endpoint reported."""

    prompt_tokens: int | None = None
    completion_tokens: int | None = None

    def __new__(cls, text: str, prompt_tokens: int | None = None, completion_tokens: int | None = None):
        out = super().__new__(cls, text)
        out.prompt_tokens, out.completion_tokens = prompt_tokens, completion_tokens
        return out


def _wait(attempt: int) -> float:
    return float(min(2 + attempt, 4))


def one_call(llm: Callable[[str, float], str], prompt: str, temperature: float, attempts: int = 3, wait: Callable[[int], float] = _wait, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(prompt tokens, completion tokens, seconds, tries, answer or None, error or None) of one call.

    Token counts are those the answer brings; for one that brings none, a quarter of the characters."""
    began, answer, error, tries = time.time(), None, None, 0
    while answer is None and tries < attempts:
        tries += 1
        try:
            answer, error = llm(prompt, temperature), None
        except QuotaError as e:
            error = f"quota: {e}"
            break
        except Exception as e:  # noqa: BLE001 - whatever the endpoint raises counts as a failed try
            error = f"{type(e).__name__}: {e}"
            if tries < attempts:
                sleep(wait(tries))
    asked, given = getattr(answer, "prompt_tokens", None), getattr(answer, "completion_tokens", None)
    return len(prompt) // 4 if asked is None else asked, len(answer or "") // 4 if given is None else given, time.time() - began, tries, None if answer is None else str(answer), error


def call_model(calls: DataFrame, llm: Callable[[str, float], str], model: str = DEFAULT_MODEL, attempts: int = 3, wait: Callable[[int], float] = _wait, sleep: Callable[[float], None] = time.sleep, threads: int = 8) -> DataFrame:
    """A trace row per call of (k, prompt, temperature): up to `attempts` tries, failing fast on QuotaError; a call that
    never succeeds has a NULL response and its error. llm is pickled to the workers and called once per row, `threads` calls of
    a task at a time."""

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(max(1, threads)) as pool:
            for pdf in batches:
                done = pool.map(lambda c: one_call(llm, c[0], c[1], attempts, wait, sleep), zip(pdf["prompt"], pdf["temperature"]))
                rows = [(k, model, t, *r[:4], p, *r[4:], time.time()) for k, p, t, r in zip(pdf["k"], pdf["prompt"], pdf["temperature"], done)]
                yield pd.DataFrame(rows, columns=["k", *[c.split(" ")[0] for c in TRACE.split(", ")]])

    return calls.select("k", "prompt", "temperature").mapInPandas(run, "k string, " + TRACE)


def label_windows(summaries: DataFrame, views: Sequence[tuple[int, str, float]], classes: Sequence[str], llm: Callable[[str, float], str], cache: DataFrame | None = None, model: str = DEFAULT_MODEL, nonce: str | None = None, threads: int = 8):
    """(view outputs, cache with the new answers, trace). Each distinct call is made once: calls with the same key share an
    answer, the cache is asked first, and what was called is written down before anything reads it, so that retried tasks
    downstream call nothing again."""
    spark = summaries.sparkSession
    asked = prompts(with_views(summaries, views), classes)
    asked = asked.withColumn("k", cache_key(F.lit(model), F.col("temperature"), F.col("prompt"), F.col(nonce) if nonce else None))
    cache = cache if cache is not None else spark.createDataFrame([], "k string, r string")
    todo = misses(asked.select("k", "prompt", "temperature").dropDuplicates(["k"]), cache)
    trace = materialize(call_model(todo, llm, model, threads=threads), "trace")
    known = append_new(cache, first_entries(trace.select("k", F.col("response").alias("r"), "ts"), F.col("ts")))
    answered = probe(asked, known).withColumn("raw", F.coalesce("r", F.lit(FALLBACK)))
    keys = [c for c in summaries.columns if c != "summary"]
    outputs = parse_answers(answered.select(*keys, "view_idx", "view", "raw"), "raw", len(classes))
    return outputs, known, trace


class RuleModel:
    """A deterministic stand-in for an endpoint: the label is a checksum of the prompt's summary, noisier with temperature."""

    def __init__(self, classes: int):
        self.classes = classes

    def __call__(self, prompt: str, temperature: float) -> str:
        import zlib

        body = prompt.split("\n", 1)[-1]
        base = zlib.crc32(body.encode()) % self.classes
        noise = zlib.crc32(f"{prompt}|{temperature}".encode()) % 100
        label = (base + 1) % self.classes if noise < 100 * 0.3 * temperature else base
        return f'{{"label": {label}, "confidence": {0.5 + (noise % 50) / 100:.2f}}}'


class DemoModel:
    """A deterministic stand-in that follows demonstrations: it answers the label of the first one, without any the first
    number of the prompt's last line times seven plus ten times the temperature, modulo the classes."""

    def __init__(self, classes: int):
        self.classes = classes

    def __call__(self, prompt: str, temperature: float) -> str:
        import re

        shown = re.search(r"Example 1: label (\d+)", prompt)
        item = int(re.search(r"recording (\d+)", prompt).group(1))
        label = int(shown.group(1)) if shown else (7 * item + round(10 * temperature)) % self.classes
        return f'{{"label": {label}, "confidence": {0.5 + (item * 7 % 50) / 100:.2f}}}'


class ClientPool:
    """Open connections to one endpoint, shared by the threads of a worker process; a broken one is dropped, never reused."""

    def __init__(self, base_url: str, timeout_s: float):
        import queue
        import urllib.parse

        self.url, self.timeout = urllib.parse.urlsplit(base_url), timeout_s
        self.idle: queue.SimpleQueue = queue.SimpleQueue()
        self.opened = 0

    def post(self, path: str, body: bytes, headers: dict[str, str]) -> tuple[int, bytes]:
        import http.client
        import queue

        try:
            client = self.idle.get_nowait()
        except queue.Empty:
            kind = http.client.HTTPSConnection if self.url.scheme == "https" else http.client.HTTPConnection
            client = kind(self.url.netloc, timeout=self.timeout)
            self.opened += 1
        try:
            client.request("POST", self.url.path.rstrip("/") + path, body, headers)
            reply = client.getresponse()
            out = reply.status, reply.read()
        except BaseException:
            client.close()
            raise
        self.idle.put(client)
        return out


_POOLS: dict[tuple[str, float], ClientPool] = {}


def client_pool(base_url: str, timeout_s: float) -> ClientPool:
    """The pool of this process."""
    return _POOLS.setdefault((base_url, timeout_s), ClientPool(base_url, timeout_s))


def endpoint(base_url: str, api_key: str, model: str, timeout_s: float = 30.0, max_tokens: int = 600) -> Callable[[str, float], str]:
    """A caller of a chat endpoint over the standard library; quota refusals raise QuotaError. Answers carry the token counts of
    the reply, connections stay open between calls."""

    def call(prompt: str, temperature: float) -> str:
        import json

        body = {"model": model, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]}
        status, raw = client_pool(base_url, timeout_s).post("/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
        if status != 200:
            text = raw.decode("utf-8", "replace")
            if status in (402, 429) and "quota" in text.lower():
                raise QuotaError(text[:200])
            raise RuntimeError(f"HTTP {status}: {text[:200]}")
        reply = json.loads(raw)
        used = reply.get("usage") or {}
        return Answer(reply["choices"][0]["message"]["content"], used.get("prompt_tokens"), used.get("completion_tokens"))

    return call


def hint_column(proba: Column, classes: Sequence[str]) -> Column:
    """The hint line of a predictor's probabilities: the most likely class and the runner-up, of equal ones the later first."""
    ranked = F.reverse(F.array_sort(F.transform(proba, lambda p, i: F.struct(p.alias("p"), i.alias("i")))))
    names = F.array(*[F.lit(c) for c in classes])
    first = F.get(ranked, F.lit(0))
    second = F.coalesce(F.get(ranked, F.lit(1)), first)
    return F.format_string("  ml_hint: top=%s (p=%.2f), runner_up=%s (p=%.2f)", F.get(names, first["i"]), first["p"], F.get(names, second["i"]), second["p"])
