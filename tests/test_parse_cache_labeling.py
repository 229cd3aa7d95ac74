import gzip
import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.parse import parse_answers, strip_fence
from pulsegrid.operators import labeling
from pulsegrid.plans import engine
from pulsegrid.sources import llm_cache

CASES = [
    (None, 0, 0.5),
    ('{"label": 3, "confidence": 0.8}', 3, 0.8),
    ('Sure: {"label": 3, "confidence": 0.8} done', 3, 0.8),
    ('{"label": 9, "confidence": 1.7}', 4, 1.0),
    ('{"label": -2, "confidence": -0.1}', 0, 0.0),
    ('{"label": "2", "confidence": "0.4"}', 2, 0.4),
    ('{"label": 3.7}', 3, 0.5),
    ("{}", 0, 0.5),
    ('{"label": null, "confidence": 0.9}', 0, 0.5),
    ('{"label": 2, "confidence": null}', 2, 0.5),
    ('{"label": 2, "confidence": 0.9, "rationale": "trunc', 2, 0.9),
    ('{"label": 1}{"label": 2}', 1, 0.5),
    ('"label": 2, "confidence": 1.2.3', 2, 0.5),
    ('```json\n{"label": 2, "confidence": 0.7}', 2, 0.7),
    ('```json\n{"label": 2, "confidence": 0.7}\n```', 0, 0.5),
    ("the answer is three", 0, 0.5),
    ('{"label": Infinity}', 0, 0.5),
    ("[1, 2]", 0, 0.5),
    ('{"label": 2, "confidence": NaN}', 2, None),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    for r in parse_answers(df, "raw", 5).orderBy("i").collect():
        want = CASES[r["i"]]
        assert r["label"] == want[1], want
        if want[2] is not None:
            assert r["confidence"] == pytest.approx(want[2]), want
    fenced = parse_answers(df.where("i = 14"), "raw", 5, fence="repair").first()
    assert (fenced["label"], fenced["confidence"]) == (2, 0.7)
    assert strip_fence("plain") == "plain"


def test_cache(spark, tmp_path):
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"k": "a", "r": "1"}\nnot json\n{"r": "2"}\n{"k": "a", "r": "3"}\n{"k": "b", "r": null}\n')
    cache = llm_cache.read_cache(spark, str(tmp_path / "c.jsonl.gz"))
    assert [tuple(r) for r in cache.collect()] == [("a", "3")]
    fresh = spark.createDataFrame([("a", "9", 1), ("b", "1", 2), ("b", "2", 1), ("c", None, 1)], "k string, r string, o int")
    got = dict(map(tuple, llm_cache.append_new(cache, llm_cache.first_entries(fresh, F.col("o"))).collect()))
    assert got == {"a": "3", "b": "2"}


def test_key(spark):
    import hashlib

    want = hashlib.sha256("m|0.7000|straße".encode()).hexdigest()[:16]
    assert spark.range(1).select(llm_cache.cache_key(F.lit("m"), F.lit(0.7), F.lit("straße"))).first()[0] == want


def test_prefill_and_usage(spark):
    rows = [(1, None, None, None, "p", "r", None), (2, 2.0, "m", 0.5, "p", "r2", None), (3, 3.0, "m", 0.5, "p", None, "boom"), (4, 4.0, "m", 0.5, None, "x", None), (5, 5.0, None, 0.0, "p", "again", None)]
    trace = spark.createDataFrame([(*r, 10, 5) for r in rows], "trace_id long, ts double, model string, temperature double, prompt string, response string, error string, prompt_tokens long, completion_tokens long")
    cache, counts = llm_cache.prefill(trace, spark.createDataFrame([], "k string, r string"), F.col("trace_id"))
    assert tuple(counts.first()) == (2, 1, 2) and cache.count() == 2
    u = llm_cache.usage(trace).first()
    assert (u["calls_ok"], u["calls_failed"], u["prompt_tokens"]) == (4, 1, 40)


def flaky_model():
    def flaky(prompt, temperature):
        if "stay 1" in prompt:
            raise labeling.QuotaError("out")
        if "stay 2" in prompt:
            raise TimeoutError("slow")
        return json.dumps({"label": 1, "confidence": 0.9})

    return flaky


def test_label_windows(spark):
    items = spark.createDataFrame([(1, "stay 1"), (2, "stay 2"), (3, "stay 3"), (4, "stay 3")], "window_id long, summary string")
    views = [(0, "narrow", 0.0), (1, "wide", 1.0)]
    out, cache, trace = labeling.label_windows(items, views, ("a", "b"), labeling.RuleModel(2))
    assert out.count() == 8 and trace.count() == 6 and cache.count() == 6
    again, _, calls = labeling.label_windows(items, views, ("a", "b"), flaky_model(), cache)
    assert calls.count() == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_retries_and_quota(spark):
    calls = spark.createDataFrame([("a", "stay 1", 0.0), ("b", "stay 2", 0.0), ("c", "stay 3", 0.0)], "k string, prompt string, temperature double")
    got = {r["k"]: r for r in labeling.call_model(calls, flaky_model(), sleep=print).collect()}
    assert (got["a"]["attempt"], got["a"]["response"]) == (1, None) and got["a"]["error"].startswith("quota")
    assert (got["b"]["attempt"], got["b"]["error"]) == (3, "TimeoutError: slow") and got["c"]["error"] is None


def test_prompt_wording():
    assert labeling.template_kind(("false_alarm", "true_alarm")) == "binary" and labeling.template_kind(("normal",)) == "multi"
    assert labeling.class_list(("a", "b")) == "0=a, 1=b"


def test_cache_of_the_whole_trace(spark, sf):
    trace = spark.read.parquet(f"{sf}/raw_trace.parquet").where("prompt is not null and response is not null")
    keys = trace.select(llm_cache.cache_key(F.coalesce("model", F.lit(llm_cache.DEFAULT_MODEL)), F.coalesce("temperature", F.lit(llm_cache.DEFAULT_TEMPERATURE)), F.col("prompt")).alias("k"), "view_id")
    want = {r["k"] for r in keys.collect()}
    got = {r["k"] for r in engine.QUERIES["q_s13_cache_whole"](spark, sf).collect()}
    assert got == want and len(want) > len({r["k"] for r in keys.where("view_id < 6").collect()})


def test_calls_run_side_by_side_and_keep_their_tokens(spark):
    import time

    def slow(prompt, temperature):
        time.sleep(0.2)
        return labeling.Answer('{"label": 1}', 11, 3) if prompt != "p3" else '{"label": 2}'

    calls = spark.createDataFrame([(f"k{i}", f"p{i}", 0.0) for i in range(16)], "k string, prompt string, temperature double").coalesce(1)
    began = time.time()
    got = {r["k"]: r for r in labeling.call_model(calls, slow, threads=16).collect()}
    assert (got["k0"]["prompt_tokens"], got["k0"]["completion_tokens"], got["k3"]["prompt_tokens"]) == (11, 3, 0)
    assert all(got[f"k{i}"]["prompt"] == f"p{i}" for i in range(16)) and time.time() - began < 16 * 0.2 + 10
    assert sum(r["elapsed_s"] for r in got.values()) >= 16 * 0.2


def test_endpoint_shares_connections_and_reports_usage():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][0]["content"]
            status, body = (429, b"quota used up") if text == "quota" else (500, b"broken") if text == "bad" else (200, json.dumps({"choices": [{"message": {"content": text.upper()}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode())
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    call = labeling.endpoint(url, "key", "m")
    answers = [call("hello", 0.0) for _ in range(5)]
    assert answers[0] == "HELLO" and (answers[0].prompt_tokens, answers[0].completion_tokens) == (7, 2)
    assert labeling.client_pool(url, 30.0).opened == 1
    with pytest.raises(labeling.QuotaError):
        call("quota", 0.0)
    with pytest.raises(RuntimeError):
        call("bad", 0.0)
    server.shutdown()


def test_hint_column(spark):
    from pulsegrid.functions.dsp import hint_line

    rows = [[0.2, 0.5, 0.3], [0.4, 0.4, 0.2], [1 / 3] * 3]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<double>").orderBy("i").select(labeling.hint_column(F.col("p"), ["a", "b", "c"])).collect()]
    assert got == [hint_line(r, ["a", "b", "c"]) for r in rows]
