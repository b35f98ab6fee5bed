"""Streams over files give what the batch operators give on the same input."""

import pytest
from pyspark.sql import functions as F

from samples import CLAUDE, CODEX, write_log
from spanloom.functions.secrets import Detector
from spanloom.operators.pricing import default_prices, resolve_prices
from spanloom.streaming import streams as R


def run(spark, df, name, mode="append", tmp=None):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    d = tmp_path_factory.mktemp("stream")
    for i, p in enumerate(CLAUDE):
        write_log(d / "in", f"a{i}.jsonl", [p])
    write_log(d / "in", "b.jsonl", CODEX)
    return d


def test_calls_and_live_steps(spark, logs):
    calls = R.stream_calls(R.read_pair_stream(spark, str(logs / "in")))
    got = run(spark, calls.select("provider", "ts", "usage.prompt_tokens"), "live_calls", tmp=logs)
    assert sorted(r.provider for r in got.collect()) == ["claude", "claude", "claude", "codex"]
    steps = run(spark, R.live_steps(calls), "live_steps", tmp=logs).where("session_id like 'claude:%'")
    rows = [(r.step_index, r.kind, r.text) for r in steps.collect()]
    assert rows == [
        (1, "user", "list files"), (2, "agent", "on it"), (2, "result", "a.txt\n[image]"), (3, "agent", "done"),
        (3, "result", "error: denied") if rows[4][1] == "result" else (4, "user", "thanks"),
        (4, "user", "thanks") if rows[4][1] == "result" else (3, "result", "error: denied"),
    ]


def test_running_spend_equals_batch(spark, logs):
    calls = R.stream_calls(R.read_pair_stream(spark, str(logs / "in")))
    models = spark.createDataFrame([("claude-opus-4-x",), ("gpt-5.1",)], "model string")
    rates = resolve_prices(models, default_prices(spark)).selectExpr(
        "model", "struct(input, output, cache_write, cache_read) as rates")
    out = run(spark, R.running_spend(calls, rates), "live_spend", mode="complete", tmp=logs)
    by_model = {r.model: r for r in out.collect()}
    assert by_model["claude-opus-4-x"].calls == 2
    assert by_model["claude-opus-4-x"].cost_usd == pytest.approx(2 * (10 * 15 + 20 * 75 + 5 * 18.75 + 7 * 1.5) / 1e6)


def test_duplicates_and_alerts(spark, logs):
    calls = R.without_resent(R.stream_calls(R.read_pair_stream(spark, str(logs / "in"))))
    assert run(spark, calls.select("session_id"), "live_dedup", tmp=logs).count() == 4
    d = logs / "txt"
    d.mkdir()
    (d / "t.txt").write_text("x sk-" + "a" * 24 + "\nnothing\ny sk-" + "a" * 24 + "\n")
    texts = spark.readStream.text(str(d)).select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("event_time"), F.col("value").alias("text"))
    out = run(spark, R.secret_alerts(texts, detectors=[Detector("k", r"\bsk-[a-z]{20,}\b")]), "live_alerts", mode="complete", tmp=logs)
    assert [r.hits for r in out.collect()] == [2]


def test_hook_matching(spark, logs):
    h = logs / "hooks"
    c = logs / "hcalls"
    h.mkdir()
    c.mkdir()
    (h / "h.json").write_text('{"client_session_id":"u","event_time":"2024-01-01T00:00:00Z","hook":"near"}\n'
                              '{"client_session_id":"u","event_time":"2024-01-01T00:09:00Z","hook":"far"}\n')
    (c / "c.json").write_text('{"client_session_id":"u","event_time":"2024-01-01T00:01:30Z","seq":1}\n')
    hooks = spark.readStream.schema("client_session_id string, event_time timestamp, hook string").json(str(h))
    calls = spark.readStream.schema("client_session_id string, event_time timestamp, seq int").json(str(c))
    out = run(spark, R.match_hooks(calls, hooks).select("seq", "hook"), "live_hooks", tmp=logs)
    assert [(r.seq, r.hook) for r in out.collect()] == [(1, "near")]
