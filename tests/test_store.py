"""Ingest and secret scans that follow the logs, against doing everything anew."""

import json
import os

import pytest
from pyspark.sql import functions as F

from samples import CLAUDE, CODEX, GEMINI, messages_pair, message_stream, write_log
from spanloom.operators.audit import audit_totals, group_findings, payloads, scan
from spanloom.sources import pairs as P
from spanloom.sources import store as S

KEY = "AKIA" + "Q7RT2M5XK9WB3CJD"
OTHER = "AKIA" + "ZZ34MNPQ56TUVW78"


def leaking(ts, *secrets):
    text = " and ".join(f"key {s}" for s in secrets)
    return messages_pair(ts, [{"role": "user", "content": text}], message_stream(f"saw {text}"))


@pytest.fixture
def folder(tmp_path):
    logs = tmp_path / "work" / "deep" / ".claude-trace"
    write_log(logs, "a.jsonl", CLAUDE)
    write_log(logs, "b.jsonl", CODEX, extra='{"torn": ')
    write_log(logs, "empty.jsonl", [])
    write_log(tmp_path / "work" / "node_modules" / ".claude-trace", "never.jsonl", GEMINI)
    write_log(tmp_path / "work" / ".hidden" / ".claude-trace", "never.jsonl", GEMINI)
    write_log(tmp_path / "work" / "plain", "never.jsonl", GEMINI)
    return logs


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "store"))


def bodies(df):
    return sorted((r.source_path.rsplit("/")[-1], r.request.body) for r in df.collect())


def states(done):
    return {r.source_path.rsplit("/")[-1]: r.state for r in done.files.collect()}


def touch(path, seconds):
    os.utime(path, (path.stat().st_atime, path.stat().st_mtime + seconds))


def opened(spark, store):
    """Logs of the last run's byte ranges: what it opened."""
    runs = sorted((os.path.getmtime(f"{store.path}/listed/{r}"), r) for r in os.listdir(f"{store.path}/listed"))
    return sorted(r.source_path.rsplit("/")[-1] for r in spark.read.parquet(f"{store.path}/listed/{runs[-1][1]}").collect())


def test_folders_are_found_at_any_depth(spark, folder, tmp_path):
    assert P.trace_folders(spark, str(tmp_path)) == [str(folder)]
    assert P.trace_folders(spark, str(tmp_path), max_depth=1) == []
    assert P.trace_folders(spark, str(folder)) == [str(folder)]
    assert P.trace_folders(spark, str(tmp_path / "absent")) == []


def test_ingest_reads_changed_logs_only(spark, store, folder, tmp_path):
    def run():
        return S.ingest(store, S.list_logs(spark, [str(tmp_path / "work")]), derive={
            "calls": lambda pairs: pairs.groupBy("source_path").agg(F.count(F.lit(1)).alias("calls"))}, range_bytes=500)

    first = run()
    assert states(first) == {"a.jsonl": "indexed", "b.jsonl": "indexed", "empty.jsonl": "indexed"}
    whole = bodies(P.read_pairs(spark, str(folder)))
    assert len(whole) == 4 and bodies(S.stored(store, "pairs")) == whole
    again = run()
    assert set(states(again).values()) == {"skipped"} and opened(spark, store) == []
    assert bodies(S.stored(store, "pairs")) == whole

    write_log(folder, "a.jsonl", CLAUDE[:1])
    touch(folder / "a.jsonl", 5)
    write_log(folder, "c.jsonl", GEMINI)
    third = run()
    assert states(third) == {"a.jsonl": "indexed", "b.jsonl": "skipped", "c.jsonl": "indexed", "empty.jsonl": "skipped"}
    assert opened(spark, store) == ["a.jsonl", "c.jsonl"]
    assert bodies(S.stored(store, "pairs")) == bodies(P.read_pairs(spark, str(folder)))
    assert sorted(r.calls for r in S.stored(store, "calls").collect()) == [1, 1, 1]
    S.compact(store, ["pairs", "calls"])
    assert bodies(S.stored(store, "pairs")) == bodies(P.read_pairs(spark, str(folder)))
    assert set(states(run()).values()) == {"skipped"}
    assert S.ingest(store, S.list_logs(spark, [str(folder)]), rules="2").files.where("state = 'indexed'").count() == 4


def test_a_broken_log_is_named_and_the_rest_is_stored(spark, store, folder):
    files = S.list_logs(spark, [str(folder)])
    gone = files.limit(1).select(F.lit(str(folder / "gone.jsonl")).alias("source_path"), F.lit(10).cast("bigint").alias("size"), "modified_at")
    done = S.ingest(store, files.union(gone))
    assert states(done)["gone.jsonl"] == "failed"
    fault = done.failures.collect()
    assert [r.source_path.rsplit("/")[-1] for r in fault] == ["gone.jsonl"] and "FileNotFoundError" in fault[0].error
    assert bodies(S.stored(store, "pairs")) == bodies(P.read_pairs(spark, str(folder)))
    write_log(folder, "gone.jsonl", GEMINI)
    assert states(S.ingest(store, S.list_logs(spark, [str(folder)])))["gone.jsonl"] == "indexed"


def test_a_log_that_breaks_keeps_what_was_stored(spark, store, folder):
    S.ingest(store, S.list_logs(spark, [str(folder)]))
    before = bodies(S.stored(store, "pairs"))
    listed = spark.createDataFrame(
        [tuple(r) for r in S.list_logs(spark, [str(folder)]).withColumn("size", F.col("size") + 1).collect()],
        "source_path string, size bigint, modified_at timestamp")
    (folder / "a.jsonl").rename(folder / "a.moved")
    done = S.ingest(store, listed)
    assert states(done)["a.jsonl"] == "failed" and bodies(S.stored(store, "pairs")) == before


def test_a_run_without_commit_is_not_seen(spark, store, folder):
    S.ingest(store, S.list_logs(spark, [str(folder)]))
    before = bodies(S.stored(store, "pairs"))
    store.append("pairs", S.stored(store, "pairs"), "dead")
    os.makedirs(f"{store.path}/pairs.index/snapshot=2")  # began, never finished
    assert bodies(S.stored(store, "pairs")) == before
    store.commit("pairs", store.index("pairs"))
    assert sorted(store._snapshots("pairs").items()) == [(1, True), (2, False), (3, True)]


def test_long_lines_meet_every_range(spark, store, tmp_path):
    long = messages_pair(1.0, [{"role": "user", "content": "x" * 5000}], message_stream("y"))
    logs = tmp_path / ".claude-trace"
    write_log(logs, "a.jsonl", [CLAUDE[0], long, CLAUDE[1]], extra=json.dumps(CODEX[0]))
    S.ingest(store, S.list_logs(spark, [str(logs)]), range_bytes=97)
    assert bodies(S.stored(store, "pairs")) == bodies(P.read_pairs(spark, str(logs)))
    order = [r.request.timestamp for r in S.stored(store, "pairs").orderBy("block_start", "row_id").collect()]
    assert order == [100.0, 1.0, 103.0, 104.0]


def anew(store, mode):
    pairs = S.stored(store, "pairs")
    found = scan(payloads(pairs, mode), mode)
    return found, payloads(pairs, "strict")


def same(got, want):
    return sorted(map(tuple, got.select(sorted(want.columns)).collect())) == sorted(map(tuple, want.select(sorted(want.columns)).collect()))


def test_scans_are_kept_and_folded(spark, store, tmp_path):
    logs = tmp_path / ".claude-trace"
    write_log(logs, "a.jsonl", [leaking(1.0, KEY), leaking(2.0, KEY, OTHER)])
    write_log(logs, "b.jsonl", [leaking(3.0, OTHER)])
    write_log(logs, "clean.jsonl", CLAUDE)

    def bring():
        S.ingest(store, S.list_logs(spark, [str(logs)]))
        return sorted(r.source_path.rsplit("/")[-1] for r in S.scan_changed(store).collect())

    def check():
        found, texts = anew(store, "standard")
        secrets, totals = S.audit_report(store)
        assert same(secrets, group_findings(found))
        assert same(totals.select("egress", "response", "secrets", "standard_masked", "strict_masked"), audit_totals(found, texts))
        return secrets.count()

    assert bring() == ["a.jsonl", "b.jsonl", "clean.jsonl"]
    assert check() == 2
    assert bring() == [] and check() == 2
    write_log(logs, "a.jsonl", CLAUDE[:1])
    touch(logs / "a.jsonl", 5)
    assert bring() == ["a.jsonl"]
    assert check() == 1
    strict = S.scan_changed(store, "strict", redact_check=False).count()
    assert strict == 3 and check() == 1
    secrets, totals = S.audit_report(store, "strict", redact_check=False)
    assert same(secrets, group_findings(anew(store, "strict")[0])) and totals.first().files == 3


def calls_of(pairs):
    from spanloom.operators.normalize import normalize_pairs
    from spanloom.operators.trajectory import number_calls

    calls = normalize_pairs(pairs)
    return number_calls(calls).select("source_path", "block_start", "row_id", "session_id", "seq")


def test_one_conversation_by_id(spark, store, tmp_path):
    logs = tmp_path / ".claude-trace"
    write_log(logs, "a.jsonl", CODEX + CLAUDE)
    write_log(logs, "b.jsonl", GEMINI)
    S.ingest(store, S.list_logs(spark, [str(logs)]), derive={"calls": calls_of})
    every = S.stored(store, "calls").collect()
    claude = next(r.session_id for r in every if r.session_id.startswith("claude"))
    assert "bucket" not in every[0].asDict() and len(every) == 5
    key = lambda rows: sorted((r.source_path, r.row_id) for r in rows)
    got = S.conversation(store, "calls", claude)
    assert key(got.collect()) == key(r for r in every if r.session_id == claude)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert [r.seq for r in S.conversation(store, "calls", claude, 1).collect()] == [1]
    assert S.conversation(store, "calls", claude, 99).count() == 0 and S.conversation(store, "calls", "nobody").count() == 0
    log = next(r.source_path for r in every if r.source_path.endswith("a.jsonl"))
    first = S.trajectory(store, "calls", "nobody", log).collect()
    assert {r.session_id.split(":")[0] for r in first} == {"codex"} and {r.source_path for r in first} == {log}
    assert key(S.trajectory(store, "calls", claude, log).collect()) == key(got.collect())
    S.compact(store, ["pairs", "calls"])
    assert key(S.conversation(store, "calls", claude).collect()) == key(r for r in every if r.session_id == claude)
