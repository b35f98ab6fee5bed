"""Hand-written pairs through sources, normalisation and trajectory building."""

import json
import random

import pytest
from pyspark.sql import functions as F

from samples import CLAUDE, CODEX, CODEX_TORN, DEVIN, GEMINI, TURN1, UUID, message_stream, messages_pair, write_log
from spanloom.operators import export, trajectory as T, xray as X
from spanloom.operators.normalize import normalize_pairs
from spanloom.operators.pricing import default_prices
from spanloom.session import written
from spanloom.sources import pairs as P


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    trace = root / "proj" / ".claude-trace"
    probe = messages_pair(90.0, TURN1, message_stream("x"), url="https://h/v1/messages/count_tokens")
    write_log(trace, "a.jsonl", [*CLAUDE, *CODEX, *CODEX_TORN, *GEMINI, *DEVIN, probe], extra='\nnot json\n{"request": {"timest')
    write_log(root / "node_modules" / ".claude-trace", "no.jsonl", CLAUDE)
    write_log(root / ".hidden" / ".codex-trace", "no.jsonl", CLAUDE)
    write_log(root / "proj", "outside.jsonl", CLAUDE)
    return root


@pytest.fixture(scope="module")
def calls(spark, log):
    return written(normalize_pairs(P.read_pairs(spark, P.discover(spark, [str(log)]))), "calls")


@pytest.fixture(scope="module")
def steps(calls):
    return written(T.build_steps(calls), "steps")


def of(rows, provider):
    return [r for r in rows if r.provider == provider]


def test_discovery_and_rejects(spark, log):
    found = P.discover(spark, [str(log), str(log / "proj" / "outside.jsonl")])
    assert [f.rsplit("/", 2)[-2:] for f in found] == [["proj", "outside.jsonl"], ["proj", ".claude-trace"]]
    lines = P.read_lines(spark, P.discover(spark, [str(log)]))
    assert P.rejected_lines(lines).count() == 2
    keep = P.parse_pairs(lines, keep=F.col("request.timestamp") > 105)
    assert keep.count() == 3
    path = spark.createDataFrame([("file:/a/b/.codex-trace/x.jsonl",), ("/a/b/x.jsonl",)], "p string")
    assert [r[0] for r in path.select(P.project_of(F.col("p"))).collect()] == ["/a/b", "/a/b"]


def test_items_and_usage_of_each_shape(calls):
    rows = calls.orderBy("ts").collect()
    assert [r.provider for r in rows] == ["claude"] * 3 + ["codex", "gemini", "devin", "codex"] or len(rows) == 7
    c = of(rows, "claude")
    assert len({r.session_id for r in c}) == 1
    assert [i.kind for i in c[1].req_items] == ["message", "message", "tool_call", "tool_result"]
    assert c[1].req_items[3].text == "a.txt\n[image]"
    assert c[0].resp_items[1].args == '{"cmd":"ls"}' and c[0].stop_reason == "tool_use"
    assert c[0].usage.asDict() == dict(prompt_tokens=10, completion_tokens=20, cache_creation=5, cache_read=7, reasoning_tokens=None)
    assert c[2].usage is None and not c[2].answered
    full, torn = sorted(of(rows, "codex"), key=lambda r: r.ts)
    assert full.session_id == "codex:k:K" and full.prompt_text == "sysB" and full.resp_model == "gpt-5.1"
    assert [(i.kind, i.text) for i in full.resp_items] == [("reasoning", "think"), ("message", "ans")]
    assert full.req_items[1].args == '{"cmd":"ls"}' and full.req_items[2].text == "done"
    assert full.usage.cache_read == 2 and full.usage.reasoning_tokens == 1
    assert [(i.kind, i.text, i.args) for i in torn.resp_items] == [("message", "partial", None), ("tool_call", None, '{"a":1}')]
    g = of(rows, "gemini")[0]
    assert g.req_model == "gemini-2.5-pro" and g.resp_model == "gv" and g.stop_reason == "STOP"
    assert [(i.kind, i.text) for i in g.resp_items] == [("message", "ab"), ("reasoning", "t")]
    assert g.usage.completion_tokens == 3 and g.usage.reasoning_tokens == 1 and g.req_items[2].text == "files"
    d = of(rows, "devin")[0]
    assert d.session_id == "devin:S" and d.prompt_text == "Today's date: [DATE]\nfoo" and d.usage.cache_creation == 4


def test_steps_stitch_results_and_skip_resent(steps):
    rows = steps.where("session_id like 'claude:%'").orderBy("step_index").collect()
    assert [(r.step_index, r.role, r.message) for r in rows] == [
        (1, "user", "list files"), (2, "agent", "on it"), (3, "agent", "done"), (4, "user", "thanks")]
    assert rows[1].observation == "a.txt\n[image]" and not rows[1].errored
    # A result with an unknown call id falls to the latest agent step.
    assert rows[2].observation == "error: denied" and rows[2].errored
    assert rows[1].tool_names == ["Bash"] and rows[1].tool_inputs == ['{"cmd":"ls"}']


def test_requests_sessions_and_usage(spark, calls, steps):
    n = T.number_calls(calls)
    r = T.build_requests(calls, n, steps).where("provider = 'claude'").orderBy("seq").collect()
    assert [(x.seq, x.status, x.duration_ms, x.ttft_ms, x.errored, x.agent_step_index) for x in r] == [
        (0, 200, 1500, 500, False, 2), (1, 200, 1500, 500, False, 3), (2, None, None, None, True, None)]
    assert T.client_ids(calls, n).collect()[0].client_session_id == UUID
    heads = {h.agent: h.model for h in T.session_heads(calls, n).collect()}
    assert heads["claude"] == "claude-opus-4-x" and heads["gemini"] == "gemini-2.5-pro"
    e = T.build_usage_events(steps, T.session_heads(calls, n), default_prices(spark)).where("agent = 'claude'")
    cost = (10 * 15 + 20 * 75 + 5 * 18.75 + 7 * 1.5) / 1e6
    assert [x.cost_usd for x in e.collect()] == pytest.approx([cost, cost])
    # Tokens are conserved from answers to steps.
    total = steps.agg(F.sum("prompt_tokens")).first()[0]
    assert total == calls.agg(F.sum("usage.prompt_tokens")).first()[0]


def test_random_transcripts_match_sequential_walk(spark):
    """The cursor rule over counts equals a walk over each call in turn."""
    rnd = random.Random(3)
    pairs, want = [], {}
    for s in range(12):
        history, users, results, steps, by_id, agent = [], 0, 0, [], {}, None
        for c in range(rnd.randrange(1, 7)):
            for _ in range(rnd.randrange(3)):
                if rnd.random() < 0.5:
                    history.append(("u", rnd.choice(["hi", "  ", f"q{len(history)}"]), None))
                else:
                    history.append(("r", f"res{len(history)}", rnd.choice(["x", "y", "z"])))
            if rnd.random() < 0.2:
                history = history[rnd.randrange(len(history) + 1):]
            call_id = rnd.choice(["x", "y", None])
            seen_u = seen_r = 0
            for kind, text, ref in history:
                if kind == "u":
                    seen_u += 1
                    if seen_u > users and text.strip():
                        steps.append(["user", text, []])
                else:
                    seen_r += 1
                    if seen_r > results:
                        at = by_id.get(ref) or agent
                        if at:
                            at[2].append(text)
            users, results = max(users, seen_u), max(results, seen_r)
            agent = ["agent", f"a{c}", []]
            steps.append(agent)
            if call_id:
                by_id[call_id] = agent
            turns = [{"role": "user", "content": t} if k == "u" else {"role": "tool", "content": t, "tool_call_id": ref} for k, t, ref in history]
            msg = {"role": "assistant", "content": f"a{c}"}
            if call_id:
                msg["tool_calls"] = [{"id": call_id, "name": "n", "arguments": {}}]
            pairs.append((f"/f{s % 3}.jsonl", s, c, json.dumps({
                "request": {"timestamp": 1.0, "url": "u", "body": {"provider": "devin", "session_id": str(s), "transcript": turns}},
                "response": {"status_code": 200, "body": {"message": msg, "usage": {"input_tokens": 1}}}})))
        want[f"devin:{s}"] = [(r, m, "\n".join(o)) for r, m, o in steps]
    # Blocks of two calls, so that cursors are carried between chunks.
    rows = [(f, 2 * (c // 2), s * 10 + c, v) for f, s, c, v in pairs]
    lines = spark.createDataFrame(rows, "source_path string, block_start bigint, row_id bigint, value string").repartition(3, "source_path").sortWithinPartitions("row_id")
    c = written(normalize_pairs(P.parse_pairs(lines)), "calls")
    got = {}
    for r in T.build_steps(c).orderBy("session_id", "step_index").collect():
        got.setdefault(r.session_id, []).append((r.role, r.message, r.observation))
    assert got == want


def test_registry_toolsets_and_segments(spark, tmp_path):
    tools = [{"name": "Write", "input_schema": {}, "cache_control": {"type": "e"}}, {"name": "Read", "d": "é"}]
    other = [dict(tools[1]), {"name": "Write", "input_schema": {}}]
    sys = [{"type": "text", "text": "base cch=ab1;"}, {"type": "text", "text": "see SKILL.md"}]
    p = write_log(tmp_path, "t.jsonl", [
        messages_pair(10.0, TURN1, message_stream("a"), system=sys, tools=tools),
        messages_pair(20.0, [{"role": "user", "content": "new"}], message_stream("b"), system=[{"type": "text", "text": "base cch=ff;"}, sys[1]], tools=other)])
    c = written(normalize_pairs(P.read_pairs(spark, str(p))), "calls")
    reg = T.prompt_registry(c).collect()
    assert [(r.content, r.requests, r.first_seen, r.last_seen) for r in reg] == [("base cch=[HASH];\n\nsee SKILL.md", 2, 10.0, 20.0)]
    placed = c.join(T.number_calls(c).select(*T.CALL, "seq"), T.CALL)
    declared = X.declared_tools(placed)
    assert declared.select("toolset_hash").distinct().count() == 1
    first = declared.where("seq = 0").first()
    assert [(t.name, t.chars) for t in first.per_tool] == [
        (t["name"], len(json.dumps(t, ensure_ascii=False, separators=(",", ":")))) for t in tools]
    segs = X.segments(placed)
    assert [s.bucket for s in segs.where("seq = 0").orderBy("pos").collect()] == ["system", "skills", "tools", "tools", "user"]
    counts = X.change_counts(X.diff_calls(segs)).first()
    assert (counts.new, counts.carried, counts.dropped) == (3, 2, 3)


def test_export_document(calls, steps):
    heads = T.session_heads(calls, T.number_calls(calls))
    docs = {r.session_id.split(":")[0]: json.loads(r.document) for r in export.export_documents(steps, heads, calls).collect()
            if not r.session_id.startswith("codex:h")}
    d = docs["claude"]
    assert d["schema_version"].startswith("ATIF") and d["session_id"] == d["trajectory_id"]
    assert [s["step_id"] for s in d["steps"]] == [1, 2, 3, 4] and d["final_metrics"]["total_prompt_tokens"] == 20
    assert d["steps"][1]["tool_calls"] == [{"tool_call_id": "t1", "function_name": "Bash", "arguments": {"cmd": "ls"}}]
    assert d["steps"][1]["observation"]["results"][0]["source_call_id"] == "t1"
    assert d["steps"][0]["timestamp"] == "1970-01-01T00:01:40.000Z" and "metrics" not in d["steps"][0]
    split = export.export_documents(steps, heads, per_part=2).where("session_id like 'claude:%'").orderBy("part").collect()
    assert [len(json.loads(r.document)["steps"]) for r in split] == [2, 2]


def test_incremental_sources(spark, tmp_path):
    write_log(tmp_path, "a.jsonl", CLAUDE)
    b = write_log(tmp_path, "b.jsonl", CODEX)
    before = written(P.file_versions(spark, str(tmp_path), hash_bytes=True), "files")
    assert P.changed_files(P.file_versions(spark, str(tmp_path), hash_bytes=True), before).count() == 0
    b.write_text(b.read_text() + "\n")
    changed = P.changed_files(P.file_versions(spark, str(tmp_path), hash_bytes=True), before)
    assert [r.source_path.endswith("b.jsonl") for r in changed.collect()] == [True]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "source_path string, v int")
    new = spark.createDataFrame([("b", 2)], "source_path string, v int")
    assert sorted(map(tuple, P.replace_sources(old, new, new).collect())) == [("a", 1), ("b", 2)]


def test_digest_keeps_head_and_tail(spark):
    data = [("s", "x", i, "user", f"{i:05d} " + "w" * 200) for i in range(1, 200)]
    s = spark.createDataFrame(data, "source_path string, session_id string, step_index bigint, role string, message string")
    s = s.selectExpr("*", "cast(null as array<struct<id string, name string, args string>>) as tool_calls",
                     "cast(null as array<struct<at bigint, ordinal int, call_id string, text string>>) as results")
    heads = spark.createDataFrame([("s", "x", "claude", "m")], "source_path string, session_id string, agent string, model string")
    text = "\n".join(["## Session — claude (m)"] + [f"USER: {m}" for *_, m in data])
    want = text[:9600] + "\n\n…[trajectory truncated]…\n\n" + text[-5600:]
    cut = T.digest(s, heads, step_chars=600, chars=16000, head_chars=9600, tail_chars=5600)
    assert cut.first().digest == want
    assert T.digest(s, heads).first().digest == text
