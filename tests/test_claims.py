"""Streamed hook matches against the same rules applied to all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.context import compaction_triggers
from spanloom.operators.hooks import norm_cwd
from spanloom.streaming.claims import claim_hooks, hooks_near_sessions


class Feed:
    """Rows that arrive in parts as files of a stream."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        folder.mkdir()

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.folder)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)


@pytest.fixture
def fed(spark, tmp_path):
    queries = []

    def start(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
        queries.append(q)
        return q

    yield start
    for q in queries:
        q.stop()


def test_claims_are_those_of_the_batch(spark, tmp_path, fed):
    rnd = random.Random(5)
    comps, hooks = [], []
    for s in ("a", "b"):
        at = 1000.0
        for k in range(40):
            at += rnd.choice([3, 20, 60, 130, 400])
            comps.append((s, k, at))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                hooks.append((s, len(hooks), at - rnd.uniform(-4, 110), rnd.choice(["manual", "auto", None])))
    c = Feed(spark, tmp_path / "c", "session_id string, seq bigint, ts double")
    h = Feed(spark, tmp_path / "h", "session_id string, hook_id bigint, ts double, trigger string")
    q = fed(claim_hooks(c.stream(), h.stream(), delay="0 seconds"), "claims")
    last = max(t for *_, t in comps)
    for lo in range(0, int(last) + 400, 1500):  # in time order, so that nothing is late
        c.add([x for x in comps if lo <= x[2] < lo + 1500] + [("clock", lo, float(lo))])
        h.add([x for x in hooks if lo <= x[2] < lo + 1500] + [("clock", -lo, float(lo), None)])
        q.processAllAvailable()
    c.add([("clock", 1, last + 5000)])
    h.add([("clock", 1, last + 5000, None)])
    q.processAllAvailable()
    got = spark.table("claims").where("session_id <> 'clock'")
    want = compaction_triggers(
        spark.createDataFrame(comps, c.schema), spark.createDataFrame(hooks, h.schema))
    assert want.count() > 30
    key = ["session_id", "seq", "hook_id", "hook_ts", "kind"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_hooks_within_ten_minutes(spark, tmp_path, fed):
    rnd = random.Random(3)
    calls, hooks = [], []
    for k in range(60):
        calls.append((rnd.choice("stu"), rnd.choice([None, None, "x"]), rnd.choice(["/p", "/q/", "", None]), rnd.uniform(0, 20000)))
        hooks.append((k, rnd.choice(["/p/", "/q", "", None]), rnd.uniform(0, 20000)))
    calls.append(("edge", None, "", 50000.0))
    hooks += [(100, "", 49400.0), (101, "", 49399.0), (102, "", 50600.0), (103, "", 50601.0)]
    c = Feed(spark, tmp_path / "c", "session_id string, client_session_id string, project string, ts double")
    h = Feed(spark, tmp_path / "h", "hook_id bigint, cwd string, ts double")
    at = F.timestamp_seconds("ts").alias("event_time")
    q = fed(hooks_near_sessions(c.stream().select("*", at), h.stream().select("*", at), delay="30 minutes"), "near")
    for lo in range(0, 52000, 6000):
        c.add([x for x in calls if lo <= x[3] < lo + 6000] + [("clock", "y", None, float(lo))])
        h.add([x for x in hooks if lo <= x[2] < lo + 6000] + [(-1, "/none", float(lo))])
        q.processAllAvailable()
    all_c = spark.createDataFrame(calls, c.schema).select(
        "session_id", norm_cwd(F.col("project")).alias("p"), F.col("ts").alias("t"), "client_session_id").collect()
    all_h = spark.createDataFrame(hooks, h.schema).select("hook_id", norm_cwd(F.col("cwd")).alias("w"), F.col("ts").alias("t")).collect()
    want = {(a.session_id, b.hook_id) for a in all_c for b in all_h
            if a.client_session_id is None and abs(a.t - b.t) <= 600 and ("" in (a.p, b.w) or a.p == b.w)}
    got = [(r.session_id, r.hook_id) for r in spark.table("near").where("hook_id >= 0").collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want
