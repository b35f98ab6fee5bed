"""Identity, context, forests and claims on small cases, against plain walks."""

import json
import random

from samples import messages_pair, write_log
from spanloom.operators import context as C, export as E, forest as R, hooks as H, identity as N
from spanloom.operators.normalize import normalize_pairs
from spanloom.session import written
from spanloom.sources import pairs as P


def test_subagents_take_the_longest_matching_prompt(spark, tmp_path):
    spawn = lambda i, d, p: {"type": "tool_use", "id": i, "name": "Task", "input": {"description": d, "subagent_type": "general", "prompt": p}}
    pre = "Survey the design documents of the project and report, "
    parent = messages_pair(1.0, [
        {"role": "user", "content": "go"},
        {"role": "assistant", "content": [spawn("1", "part 1", pre + "part 1"), spawn("2", "part 10", pre + "part  10"), spawn("3", "tiny", "ab")]}])
    mark = "x-anthropic-billing-header: cc_version=1; cc_is_subagent=true; cch=aa;\nYou help."
    child = lambda ts, t: messages_pair(ts, [{"role": "user", "content": [{"type": "text", "text": "<system-reminder>x</system-reminder>"}, {"type": "text", "text": t}]}], system=mark)
    p = write_log(tmp_path, "a.jsonl", [parent, child(2.0, pre + "part 10"), child(3.0, pre + "part 1 please"), child(4.0, "none"), child(5.0, "xxabx")])
    c = written(normalize_pairs(P.read_pairs(spark, str(p))), "calls")
    rows = N.name_subagents(N.opened(c)).orderBy("row_id").collect()
    assert [(r.is_subagent, r.agent_label, r.agent_type) for r in rows] == [
        (False, None, None), (True, "part 10", "general"), (True, "part 1", "general"), (True, None, None), (True, "tiny", "general")]


def test_contains_join_is_exact(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab é😀") for _ in range(n))
    texts = [(i, word(r.randrange(1, 220))) for i in range(60)]
    needles = []
    for j in range(60):
        t = r.choice(texts)[1]
        i, n = r.randrange(len(t)), r.choice([1, 2, 3, 5, 11, 12, 13, 30, 47, 48, 49, 90])
        needles.append((j, t[i:i + n]))
    got = N.contains_join(
        spark.createDataFrame(texts, "tid int, t string"), spark.createDataFrame(needles, "nid int, n string"), [], "t", "n", ["tid"], ["nid"])
    want = sorted((a, b) for a, t in texts for b, n in needles if n in t)
    assert sorted((x.tid, x.nid) for x in got.collect()) == want


def test_regrow_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 4)
    monkeypatch.setattr(C, "LEVELS", 5)
    r = random.Random(9)
    sizes = [(s, i, r.randrange(1000)) for s in "ab" for i in range(300)]
    targets = [(s, r.randrange(300), r.randrange(1100)) for s in "ab" for _ in range(40)]
    got = {(x.session_id, x.seq, x.calls_to_regrow) for x in C.calls_to_regrow(
        spark.createDataFrame(sizes, "session_id string, seq bigint, size bigint"),
        spark.createDataFrame({(s, q): (s, q, t) for s, q, t in targets}.values(), "session_id string, seq bigint, target bigint")).collect()}
    by = {(s, i): v for s, i, v in sizes}
    want = set()
    for s, q, t in {(s, q): (s, q, t) for s, q, t in targets}.values():
        j = next((j for j in range(q + 1, 300) if by[s, j] >= t), None)
        if j is not None:
            want.add((s, q, j - q))
    assert got == want


def request_rows(spark, rows):
    full = [(s, q, ts, dur, p, 0, 0, items, err) for s, q, ts, dur, p, items, err in rows]
    return spark.createDataFrame(full, "session_id string, seq bigint, ts double, duration_ms bigint, prompt_tokens bigint, cache_read bigint, cache_creation bigint, transcript_items bigint, errored boolean")


def test_compactions_need_a_real_drop_without_overlap(spark):
    r = request_rows(spark, [
        ("a", 0, 10.0, 100, 9000, 10, False), ("a", 1, 20.0, 100, 1000, 2, False),       # real
        ("a", 2, 30.0, 60000, 9000, 10, False), ("a", 3, 40.0, 100, 1000, 2, False),     # overlaps
        ("a", 4, 100.0, 100, 9000, 10, False), ("a", 5, 110.0, 100, 8000, 2, False)])    # too little
    assert [x.seq for x in C.find_compactions(r).collect()] == [1]
    assert C.efficacy(r).first().verdict == "marginal"


def test_lanes_are_first_fit(spark):
    r = request_rows(spark, [("a", i, t, d, 1, 1, False) for i, (t, d) in enumerate([(0.0, 5000), (1.0, 1000), (2.0, 1000), (3.0, 9000), (4.0, 500), (20.0, 100)])])
    assert [x.lane for x in C.assign_lanes(r).orderBy("seq").collect()] == [0, 1, 1, 1, 2, 0]
    assert C.max_in_flight(r).first().max_in_flight == 3


def test_hooks_are_claimed_once(spark):
    comps = spark.createDataFrame([("s", 1, 100.0), ("s", 2, 110.0), ("s", 3, 5000.0)], "session_id string, seq bigint, ts double")
    hooks = spark.createDataFrame([("s", 7, 99.0, "auto"), ("s", 8, 50.0, "manual"), ("s", 9, 4000.0, "x")], "session_id string, hook_id bigint, ts double, trigger string")
    got = sorted((x.seq, x.hook_id, x.kind) for x in C.compaction_triggers(comps, hooks).collect())
    assert got == [(1, 7, "auto"), (2, 8, "manual")]


def test_time_join_fences_and_withholds(spark):
    ses = spark.createDataFrame([("a", "/p/", None, 1000.0, 2000.0), ("b", "", None, 0.0, 0.0), ("c", "/q", None, 1000.0, 1000.0)], "session_id string, project string, client_session_id string, started_at double, ended_at double")
    hk = spark.createDataFrame([(1, "h1", 500.0, "/p", "x"), (2, "h2", 2600.0, "", "y"), (3, "h1", 1500.0, "/z", "z"), (4, "h1", 399.0, "/p", "w")], "hook_id int, hook_session string, ts double, cwd string, payload string")
    got = sorted((x.session_id, x.hook_id, x.payload) for x in H.hooks_by_time(ses, hk).collect())
    assert got == [("a", 1, None), ("a", 2, None), ("b", 1, None), ("b", 2, None), ("b", 3, None), ("b", 4, None)]


def test_forest_chain_cycle_and_leaf(spark):
    msg = lambda role, t, **k: json.dumps({"role": role, "content": t, **k})
    nodes = [("s", 1, None, msg("system", "sys"), 1000), ("s", 2, 1, msg("user", "q"), 2000),
             ("s", 3, 2, msg("assistant", "a", tool_calls=[{"id": "c", "name": "n", "arguments": {"x": 1}}]), 3000),
             ("s", 4, 3, msg("tool", "out", tool_call_id="c"), 4000), ("s", 5, 4, msg("assistant", "b"), 5000), ("s", 6, 5, msg("user", "tail"), 6000),
             ("s", 9, 2, msg("assistant", "old"), 100), ("s", 10, 2, "not json", 1),
             ("loop", 1, 2, msg("user", "x"), 1), ("loop", 2, 1, msg("user", "y"), 1), ("far", 5, 77, msg("user", "z"), 1)]
    n = R.readable_nodes(spark.createDataFrame(nodes, "session_id string, node_id bigint, parent_node_id bigint, chat_message string, created_at bigint"))
    ses = spark.createDataFrame([("s", None, "m"), ("loop", 1, "m"), ("far", 99, "m")], "session_id string, main_chain_id bigint, model string")
    chain = written(R.active_chain(n, R.leaf_of(n, ses)), "chain")
    ids = {s: [x.node_id for x in chain.where(f"session_id = '{s}'").orderBy("position").collect()] for s in ("s", "loop", "far")}
    assert ids == {"s": [1, 2, 3, 4, 5, 6], "loop": [2, 1], "far": [5]}
    steps = R.chain_steps(n, chain).where("session_id = 's'").orderBy("step_index").collect()
    assert [(x.role, x.message, x.observation) for x in steps] == [("user", "q", None), ("agent", "a", "out"), ("agent", "b", None), ("user", "tail", None)]
    assert R.system_text(n, chain).first().system == "sys"


def test_forest_as_pairs_gives_its_steps(spark, monkeypatch, tmp_path):
    """Pairs made of a chain, written as a log, parsed again and walked like a capture."""
    from spanloom.operators import trajectory as T
    from spanloom.operators.normalize import normalize_pairs
    from spanloom.sources.pairs import parse_pairs, read_lines
    from spanloom.sources.sinks import write_pair_logs

    monkeypatch.setattr(R, "BLOCK_MESSAGES", 2)
    msg = lambda role, t, **k: json.dumps({"role": role, "content": t, **k})
    meta = lambda k: {"metadata": {"generation_model": f"g{k % 2}", "created_at": f"2024-01-01T00:00:0{k}Z", "metrics": {"input_tokens": k, "output_tokens": 2, "ttft_ms": 250}}}
    chat = [msg("system", "be \"kind\""), msg("user", "q\n1"), msg("assistant", "a1", tool_calls=[{"id": "c1", "name": "n", "arguments": {"x": [1, "é"]}}], **meta(1)),
            msg("tool", "out1", tool_call_id="c1"), msg("assistant", "a2", tool_calls=[{"id": "c2", "name": "m", "arguments": {}}], **meta(2)),
            msg("user", "q2"), msg("assistant", "a3", **meta(3)), msg("user", "tail"), msg("tool", "late", tool_call_id="c2")]
    nodes = [("s", k, k - 1 or None, c, 1000 * k) for k, c in enumerate(chat, 1)] + [("mute", 1, None, msg("user", "hi"), 5)]
    n = R.readable_nodes(spark.createDataFrame(nodes, "session_id string, node_id bigint, parent_node_id bigint, chat_message string, created_at bigint"))
    ses = spark.createDataFrame([("s", None, "m", 7), ("mute", None, "m", 7)], "session_id string, main_chain_id bigint, model string, created_at bigint")
    chain = written(R.active_chain(n, R.leaf_of(n, ses)), "chain")
    pairs, messages = (written(x, "made") for x in R.chain_pairs(n, chain, ses))
    assert [(r.session_id, r.seq, r.upto) for r in pairs.orderBy("seq").collect()] == [("s", 0, 1), ("s", 1, 3), ("s", 2, 5), ("s", 3, 8)]
    assert sum(len(r.bodies) for r in messages.where("session_id = 's'").collect()) == 8
    write_pair_logs(R.pair_lines(pairs, messages), str(tmp_path / "logs"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "logs/session_id=s")).collect()]
    assert [len(x["request"]["body"]["transcript"]) for x in lines] == [1, 3, 5, 8]
    assert lines[0]["request"]["body"]["system"] == 'be "kind"' and lines[1]["request"]["body"]["transcript"][1]["tool_calls"][0]["arguments"] == {"x": [1, "é"]}
    assert lines[1]["response"]["first_byte_timestamp"] == lines[1]["request"]["timestamp"] + 0.25 and "message" not in lines[3]["response"]["body"]
    log = tmp_path / "s.jsonl"
    log.write_text("".join(json.dumps(x) + "\n" for x in lines))
    calls = written(normalize_pairs(parse_pairs(read_lines(spark, str(log)))), "calls")
    steps = T.build_steps(calls, T.number_calls(calls)).orderBy("step_index").collect()
    want = R.chain_steps(n, chain).where("session_id = 's'").orderBy("step_index").collect()
    assert [(x.role, x.message, x.observation or "", x.prompt_tokens) for x in steps] == [(x.role, x.message, x.observation or "", x.prompt_tokens) for x in want]
    assert len(want) == 6 and [x.observation for x in want if x.message == "a2"] == ["late"]


def test_children_are_used_once(spark):
    tasks = [("f", "p", 0, "c0", "do the thing"), ("f", "p", 1, "c1", "do the thing"), ("f", "p", 2, "c2", "unknown"), ("g", "p", 0, "x", "t"), ("g", "q", 1, "y", "t")]
    kids = [("f", 0, "k0", "other"), ("f", 1, "k1", "please do the thing now"), ("f", 2, "k2", "do the")]
    got = E.nest_children(
        spark.createDataFrame(tasks, "source_path string, parent_id string, task_no int, call_id string, prompt string"),
        spark.createDataFrame(kids, "source_path string, child_no int, child_id string, first_user string"))
    assert sorted((x.task_no, x.child_id) for x in got.collect()) == [(0, "k1"), (1, "k2")]
