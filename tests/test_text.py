"""Titles, secrets, search text, headers, prices, hooks and other row functions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import secrets as S
from spanloom.functions.stemming import stem
from spanloom.functions.titles import session_titles
from spanloom.operators import audit, hooks as H, search as Q
from spanloom.operators.diff import with_line_diff
from spanloom.operators.pricing import default_prices, merge_prices, resolve_prices
from spanloom.operators.usage import bucket, parse_when
from spanloom.sources import compactions, hooks as HS
from spanloom.sources.prices import convert_prices


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_titles(spark):
    wordy = "word " * 40
    sessions = {
        "a": ["<system-reminder>x", "Note: file", '{"Bash":"out"}', '{"user":"fix the bug"}'],
        "b": ["The user sent a new message while you were working: proud of you! This is how Claude Code surfaces it"],
        "c": ["You are a reviewer of code. Then much more text follows here."],
        "d": [wordy], "e": ['{"Bash":"x"} {"user":"y"}', "Called the Read tool with input"],
        "f": ["<session>real ask</session>\nwrite a title"], "g": ["Learning output style is active. Remember"],
        "h": ["You are " + "x" * 90 + " y"],
    }
    rows = [(s, i, "user", m) for s, ms in sessions.items() for i, m in enumerate(ms)]
    got = {r.session_id: r.title for r in session_titles(spark.createDataFrame(rows, "session_id string, step_index int, role string, message string")).collect()}
    assert got["a"] == "fix the bug" and got["b"] == "proud of you!" and got["c"] == "You are a reviewer of code."
    assert got["d"] == ("word " * 23 + "word") + "…" and got["e"] == "" and got["f"] == "real ask" and got["g"] == ""
    assert got["h"] == ("You are " + "x" * 56) + "…"


SECRETS = [
    ("key sk-proj-" + "a1" * 12 + " end", "openai_key"), ("ghp_" + "A" * 24, "github_token"), ("xoxb-1234567890ab", "slack_token"),
    ("AKIA" + "ABCDEFGH12345678", "aws_access_key_id"), ("eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "jwt"),
    ("Authorization: Bearer abcdefghij0123456789", "bearer_token"),
]
CLEAN = ["Bearer token authentication", "commit 3f786850e387550fdab836ed7e6dc881de23001b", "sk-short", ""]


def test_detect_and_redact(spark):
    texts = [t for t, _ in SECRETS] + CLEAN
    found = col(spark, texts, lambda c: S.find(c))
    assert [[f.kind for f in x] for x in found] == [[k] for _, k in SECRETS] + [[]] * len(CLEAN)
    once = col(spark, texts, lambda c: S.redact(c))
    assert once[0] == "key [REDACTED:openai_key] end" and once[5] == "Authorization: Bearer [REDACTED:bearer_token]"
    assert col(spark, once, lambda c: S.redact(c)) == once and once[6:] == CLEAN
    assert [x for x in col(spark, once, lambda c: S.count_redactions(c))] == [1] * 6 + [0] * 4
    assert all(f == [] for f in col(spark, once, lambda c: S.find(c, "strict")))


def test_strict_gates(spark):
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    texts = [f"v {aws} w", "a" * 40, "API_KEY=aaaaaaaaaaaaaaaa", 'MY_SECRET = "q8Zt3LkP0xWv9Rb"', "DB_PASSWORD=q8Zt3LkP0xWv9Rb; x"]
    assert col(spark, texts, lambda c: S.redact(c, "strict")) == [
        "v [REDACTED:aws_secret_access_key] w", "a" * 40, "API_KEY=aaaaaaaaaaaaaaaa", 'MY_SECRET="[REDACTED:env_secret]"',
        "DB_PASSWORD=[REDACTED:env_secret]; x"]
    assert col(spark, texts, lambda c: S.redact(c)) == texts
    assert col(spark, ["aabb", "", "aaaa"], S.entropy) == [1.0, 0.0, 0.0]


def test_audit_walks_bodies(spark):
    key = "sk-" + "b" * 24
    body = json.dumps({"system": "x", "messages": [{"role": "user", "content": [{"type": "text", "text": f"line\n{key}"}]}], "k": key})
    rows = [("f", 0, 0, (5.0, body), (None, f"raw {key}"))]
    df = spark.createDataFrame(rows, "source_path string, block_start bigint, row_id bigint, request struct<timestamp double, body string>, response struct<body string, body_raw string>")
    f = audit.scan(audit.payloads(df))
    assert sorted((r.direction, r.location) for r in f.collect()) == [("egress", "k"), ("egress", "messages[0] (user)"), ("response", "response")]
    g = audit.group_findings(f).first()
    assert (g.egress, g.response, g.locations, g.files, g.first_ts, g.last4, g.token_length) == (2, 1, 3, 1, 5.0, "bbbb", 27)
    assert audit.finding_places(f).count() == 3
    t = audit.audit_totals(f, audit.payloads(df, "strict")).first()
    assert (t.egress, t.response, t.standard_masked, t.strict_masked) == (2, 1, 3, 3)


def test_header_masking(spark):
    df = spark.createDataFrame([({"Authorization": "Bearer abcdefghijklmnop", "X-Api-Key": "abcdefgh", "Cookie": "abc", "Accept": "json"},)], "h map<string,string>")
    assert df.select(S.mask_headers(F.col("h"))).first()[0] == {
        "Authorization": "Bearer abc...mnop", "X-Api-Key": "ab...gh", "Cookie": "[REDACTED]", "Accept": "json"}


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
             "sing": "sing", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic",
             "hopeful": "hope", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "generalization": "gener"}
    assert {w: stem(w) for w in words} == words


def test_search_and_snippets(spark):
    rows = [("s1", 1, "user", "Running the file-system tests for café", "", "Bash Read", "", "", False),
            ("s1", 2, "agent", "", "", "Read", "", "tests run; system file", True), ("s2", 1, "user", "nothing here", "", "", "", "", False)]
    steps = spark.createDataFrame(rows, "session_id string, step_index int, role string, message string, reasoning string, tool_name string, tool_input string, observation string, errored boolean")
    ses = spark.createDataFrame([("s1", "claude", "m-big", "/p", 1.0, 2.0), ("s2", "codex", "m", "/q", 1.0, None)], "session_id string, agent string, model string, project string, started_at double, cost_usd double")
    posts = Q.postings(steps)
    find = lambda q, **k: [(r.session_id, r.step_index) for r in Q.search(steps, ses, posts, q, **k).collect()]
    assert sorted(find("run tests")) == [("s1", 1), ("s1", 2)]
    assert find("file-system") == [("s1", 1)] and find("cafe") == [("s1", 1)]
    assert find("tests", field="tool-output") == [("s1", 2)] and find("tests", errored=True) == [("s1", 2)]
    assert find("tests", tool="Bash") == [("s1", 1)] and find("tests", model="zzz") == [] and find("tests", min_cost=1.0) != []
    snip = col(spark, ["a" * 100 + " needle " + "b" * 200], lambda c: Q.snippet(c, "needle"))[0]
    assert snip == "…" + "a" * 59 + " [needle] " + "b" * 113 + "…"


def test_prices(spark):
    raw = json.dumps({"sample_spec": {"input_cost_per_token": 1, "output_cost_per_token": 1},
                      "x/m-1": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "m-1": {"input_cost_per_token": 3e-6, "output_cost_per_token": 4e-6, "cache_read_input_token_cost": 5e-7},
                      "y/m-2": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "bad": {"input_cost_per_token": 0, "output_cost_per_token": 0}})
    t = {r.model: r for r in convert_prices(spark.createDataFrame([(raw,)], "value string")).collect()}
    assert sorted(t) == ["m-1", "m-2"] and t["m-1"].input == pytest.approx(3) and t["m-1"].cache_read == pytest.approx(0.5) and t["m-2"].cache_write == pytest.approx(1)
    models = spark.createDataFrame([("claude-opus-4-20250514",), ("GPT-4O-MINI-x",), ("none",), ("gpt-5",)], "model string")
    got = {r.model: r.input for r in resolve_prices(models, default_prices(spark)).collect()}
    assert got == {"claude-opus-4-20250514": 15.0, "GPT-4O-MINI-x": 0.15, "gpt-5": 1.25}
    over = spark.createDataFrame([("gpt-5", 9.0, 9.0, 9.0, 9.0)], "model string, input double, output double, cache_write double, cache_read double")
    assert {r.model: r.input for r in merge_prices(default_prices(spark), over).collect()}["gpt-5"] == 9.0


def test_time(spark):
    assert parse_when("2024-01-05") == 1704412800 and parse_when("2024-01-05", end_of_day=True) == 1704499199
    assert parse_when("2d", today=dt.date(2024, 1, 7)) == 1704412800 and parse_when("1700000000") == 1700000000
    with pytest.raises(ValueError):
        parse_when("soon")
    day = dt.datetime(2027, 1, 1, 12, tzinfo=dt.timezone.utc).timestamp()
    assert col(spark, [day, 0.0], lambda c: bucket(c, "weekly"), "double") == ["2026-W53", "unknown"]


def test_hook_sources(spark):
    lines = [json.dumps({"v": 1, "ts": "2024-01-01T00:00:01.500Z", "session_id": "u", "event": "PreCompact", "stdin_preview": {"cwd": "/p", "trigger": "auto"}, "decision": "x"}),
             json.dumps({"v": 1, "ts": "bad", "session_id": "", "event": "E"}), "torn {", json.dumps({"v": 1, "ts": "", "session_id": "u", "event": "Stop", "stdout_preview": {"observeOnly": True}})]
    df = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(lines)], "source_path string, block_start bigint, row_id bigint, value string")
    rows = HS.parse_hooks(df).orderBy("row_id").collect()
    assert [(r.event, r.ts, r.cwd, r.trigger, r.decision, r.observe_only) for r in rows] == [
        ("PreCompact", 1704067201.5, "/p", "auto", None, False), ("Stop", 0.0, "", None, None, True)]
    raw = json.dumps({"session_id": "u", "cwd": "/p", "secret": "no", "tool_input": {"command": "c" * 300, "x": 1}, "prompt": "p" * 200})
    prev = json.loads(col(spark, [raw], HS.stdin_preview)[0])
    assert prev["cwd"] == "/p" and "secret" not in prev and prev["prompt_chars"] == 200 and prev["prompt_preview"] == "p" * 120 + "…"
    assert prev["tool_input"] == {"command": "c" * 200 + "…"}
    out = json.loads(col(spark, ['{"decision":"block","reason":"r"}'], lambda c: HS.stdout_preview(c, F.lit(True)))[0])
    assert out["parsed"] is True and out["decision"] == "block" and out["returned"] == {"decision": "block", "reason": "r"}
    assert col(spark, ["  "], lambda c: HS.stdout_preview(c, F.lit(False))) == ['{"chars":0,"empty":true,"observeOnly":true}']
    assert col(spark, ['{"decision":"allow"}', ""], lambda c: HS.decision(c, F.lit(2))) == ["allow", "block"]
    assert col(spark, [0, 1, 2], lambda c: HS.outcome(F.lit(None).cast("string"), c), "int") == ["ok", "error", "blocked"]


def test_recorded_compactions(spark):
    rec = lambda pre, post, ts="2024-01-01T00:00:00Z": json.dumps({"subtype": "compact_boundary", "sessionId": "u", "timestamp": ts, "compactMetadata": {"trigger": "auto", "preTokens": pre, "postTokens": post, "preservedMessages": {"uuids": ["a", "b"]}}})
    lines = [("a", rec(100, 10)), ("b", rec(100, 20)), ("b", rec(50, None)), ("b", '{"subtype":"other"}'), ("b", rec(90, 9, "2024-01-01T01:00:00Z"))]
    r = compactions.parse_compactions(spark.createDataFrame(lines, "source_path string, value string"))
    d = compactions.distinct_compactions(r)
    assert sorted((x.pre_tokens, x.post_tokens, x.dropped_tokens, x.preserved) for x in d.collect()) == [(90, 9, 81, 2), (100, 20, 80, 2)]
    ses = spark.createDataFrame([("s", "u")], "session_id string, client_session_id string")
    req = spark.createDataFrame([("s", True)], "session_id string, is_subagent boolean")
    k = compactions.recorded_for_sessions(r, ses, req)
    assert all(x.subagent_only for x in k.collect())
    assert [(x.trigger, x.compactions, x.dropped_tokens) for x in compactions.by_trigger(k).collect()] == [("auto", 2, 161)]


def test_turn_text(spark):
    assert col(spark, ['{"path":"a","command":"ls"}', '{"x":1}', "plain", ""], H.tool_argument) == ["a", "", "plain", ""]
    assert col(spark, ['{"user":"hi"}', '{"Bash":"out"}', "<command-name>/m</command-name>", "<block>no"], H.step_text) == ["hi", "Bash out", "/m", ""]


def test_line_diff(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nc\nd")], "a string, b string")
    r = with_line_diff(df, "a", "b").first()
    assert [(o.op, o.line) for o in r.ops] == [("context", "a"), ("del", "b"), ("context", "c"), ("add", "d")] and (r.added, r.removed) == (1, 1)


def test_line_diff_is_shortest_and_keeps_order():
    import random

    from spanloom.operators.diff import _line_ops

    r = random.Random(6)
    for _ in range(200):
        a = [r.choice("abcd") for _ in range(r.randrange(12))]
        b = [r.choice("abcd") for _ in range(r.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        ops = _line_ops(a, b)
        assert [s for o, s in ops if o != "add"] == a and [s for o, s in ops if o != "del"] == b
        assert sum(o == "context" for o, _ in ops) == best[-1][-1]


def test_long_texts_are_compared_in_little_memory():
    import tracemalloc

    from spanloom.operators.diff import _line_ops

    a = [f"line {k % 9000}" for k in range(20_000)]
    b = [f"line {k % 7000}" for k in range(20_000)]
    tracemalloc.start()
    ops = _line_ops(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ops) >= 20_000 and peak < 300 << 20


def test_secrets_and_filters_take_any_character(spark):
    from spanloom.functions.secrets import Detector, redact
    from spanloom.functions.text import like_any

    own = Detector("own", r"pw (\S+)", group=1, min_entropy=0.1)
    df = spark.createDataFrame([(r"pw a\Eb$1[x](c end pw q\Q.* x",), (r"C:\Users\me",)], "t string")
    got = [r[0] for r in df.select(redact(F.col("t"), "strict", [own])).collect()]
    assert "[REDACTED:own]" in got[0] and r"a\Eb" not in got[0] and got[1] == r"C:\Users\me"
    assert df.where(like_any(F.col("t"), r"c:\users")).count() == 1


def test_merged_prompt_uses_count_a_session_once(spark):
    from spanloom.operators.prompts import merge_registry, registry, session_uses

    df = spark.createDataFrame([("p", "s", 1.0), ("p", "t", 2.0)], "prompt_hash string, session_id string, ts double")
    again = spark.createDataFrame([("p", "s", 3.0)], "prompt_hash string, session_id string, ts double")
    r = registry(merge_registry(session_uses(df), session_uses(again))).first()
    assert (r.requests, r.sessions, r.last_seen) == (3, 2, 3.0)


def test_a_query_without_words_finds_nothing(spark):
    from spanloom.operators import search

    steps = spark.createDataFrame([("s", 1, "some text")], "session_id string, step_index bigint, message string")
    posts = search.postings(steps, columns=["message"])
    assert search.match(posts, "  ?! ").count() == 0 and search.score(posts, "").count() == 0


def test_a_session_in_two_logs_counts_as_its_last_capture(spark):
    from spanloom.operators.sessions import session_rollup

    rows = [("a", "s", 1.0, 10), ("b", "s", 1.0, 10), ("b", "s", 5.0, 7), ("a", "t", 2.0, 3)]
    steps = spark.createDataFrame(rows, "source_path string, session_id string, ts double, prompt_tokens bigint").selectExpr(
        "*", "0L as completion_tokens", "0L as cache_read", "0L as cache_creation", "0L as reasoning_tokens", "'agent' as role",
        "cast(array() as array<string>) as tool_names")
    got = {r.session_id: (r.source_path, r.prompt_tokens, r.turns) for r in session_rollup(steps).collect()}
    assert got == {"s": ("b", 17, 2), "t": ("a", 3, 1)}


def test_an_empty_passage_stands_in_every_text(spark, tmp_path):
    from spanloom.plans.catalog_text import passages

    spark.createDataFrame([(1, "a text of some words"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, ""), (8, "text of some"), (9, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, passages(spark, str(tmp_path)).collect())) == [(1, 7), (1, 8), (2, 7)]


def test_passages_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from spanloom.plans.catalog import ORACLES, QUERIES

    rows = {"documents": ([(1, "a text of some words"), (2, ""), (3, None), (4, "text of some")], "doc_id long, text string"),
            "benchmark": ([(7, ""), (8, "text of some"), (9, None), (10, "")], "item_id long, text string")}
    con = duckdb.connect()
    for t, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES["documents_holding_passages"]).fetchall()
    got = QUERIES["documents_holding_passages"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 8


def test_line_diff_takes_small_batches():
    from pyspark.util import PythonEvalType

    from spanloom.operators.diff import line_diff

    assert line_diff.evalType == PythonEvalType.SQL_BATCHED_UDF  # not an Arrow batch of whole texts


def test_stems_are_made_word_by_word():
    from pyspark.sql import types as T

    from spanloom.functions.stemming import stem_words

    assert stem_words.returnType == T.StringType()  # a batch holds words, not whole texts
