"""Run diff, table writers and the spend line."""

import json

import pytest

from samples import TURN1, message_stream, messages_pair, write_log
from spanloom.operators import diff as D, trajectory as T
from spanloom.operators.normalize import normalize_pairs
from spanloom.operators.pricing import default_prices
from spanloom.operators.usage import spend_line
from spanloom.session import written
from spanloom.sources import pairs as P, sinks


def test_run_diff(spark, tmp_path):
    tool = lambda n, d: {"name": n, "description": d}
    a = write_log(tmp_path, "a.jsonl", [messages_pair(1.0, TURN1, message_stream("x"), system="one\ntwo", tools=[tool("Read", "r"), tool("Old", "o"), tool("Same", "s")])])
    b = write_log(tmp_path, "b.jsonl", [messages_pair(1.0, TURN1, message_stream("x"), system="one\nthree", model="claude-opus-4-y", tools=[tool("Read", "R"), tool("New", "n"), {"description": "s", "name": "Same"}])])
    calls = written(normalize_pairs(P.read_pairs(spark, [str(a), str(b)])), "calls")
    profile = written(D.run_profile(calls, T.build_steps(calls)), "profile")
    runs = sorted(r.run for r in profile.collect())
    out = D.diff_runs(profile, *runs)
    m = out["models"].first()
    assert (m.a, m.b, m.changed) == (["claude-opus-4-x"], ["claude-opus-4-y"], True)
    p = out["prompt"].first()
    assert (p.added, p.removed) == (1, 1)
    assert {r.tool: r.change for r in out["tools"].collect()} == {"Read": "changed", "Old": "removed", "New": "added", "Same": "unchanged"}
    assert all(r.delta == 0 for r in out["shape"].collect())
    assert [r.agent for r in profile.collect()] == ["claude", "claude"] and not any(r.model_swap for r in profile.collect())


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "source_path string, v int")
    sinks.overwrite_sources(df, str(tmp_path / "t"))
    sinks.overwrite_sources(spark.createDataFrame([("b", 2)], "source_path string, v int"), str(tmp_path / "t"))
    assert sorted((r.source_path, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("b", 2)]
    sinks.write_stats(df, df.groupBy().sum("v"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "trajectories")).count() == 2
    docs = spark.createDataFrame([('{"x":1}',)], "document string")
    sinks.write_documents(docs, str(tmp_path / "d"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "d")).collect()] == [{"x": 1}]
    pairs = spark.createDataFrame([("s1", "v")], "session_id string, value string")
    sinks.write_pairs(pairs, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).first().session_id == "s1"


def test_spend_line_zone_and_fallback(spark):
    rows = [("s", 1704067199.0, "gpt-5", 1_000_000, None), ("s", 1704067201.0, "none", 1, 5.0), ("s", 1704067300.0, "none", 1, None)]
    ev = spark.createDataFrame(rows, "session_id string, ts double, model string, prompt_tokens bigint, cost_usd double").selectExpr(
        "*", "0L as completion_tokens", "0L as cache_creation", "0L as cache_read")
    utc = spend_line(ev, default_prices(spark), as_of=1704070000).first()
    assert (utc.today_usd, utc.month_usd, utc.has_unpriced) == (5.0, 5.0, True)
    tokyo = spend_line(ev, default_prices(spark), as_of=1704070000, zone="Asia/Tokyo").first()
    assert tokyo.today_usd == pytest.approx(6.25)
