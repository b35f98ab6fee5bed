"""Two-level running columns, halos and interval joins against brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions.intervals import stab_join, with_wide_blocks
from spanloom.functions.scan import halo, running


def rows(seed, n=400):
    r = random.Random(seed)
    # One key holds most rows; times repeat and cross chunk borders.
    return [(r.choice("aaaab"), r.randrange(60), i, r.choice([None, 1, 5, 9])) for i in range(n)]


def test_running_equals_plain_walk(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, t int, i int, v int")
    out = running(
        df, ["k"], F.floor(F.col("t") / 7), ["t", "i"], number="n",
        sums={"s": F.coalesce("v", F.lit(0))}, prev_max={"m": F.col("v")}, last={"l": F.col("v")}, lag={"pi": F.col("i"), "pv": F.col("v")},
    )
    want = {}
    for k in "ab":
        n, s, m, last, prev = 0, 0, None, None, (None, None)
        for _, t, i, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2])):
            before = m
            s += v or 0
            last = v if v is not None else last
            want[i] = (n, s, before, last, *prev)
            m = v if m is None else (m if v is None else max(m, v))
            prev, n = (i, v), n + 1
    got = {r.i: (r.n, r.s, r.m, r.l, r.pi, r.pv) for r in out.collect()}
    assert got == want


def test_halo_frames_cross_chunk_borders(spark):
    df = spark.createDataFrame([(k, i, i * i % 17) for k in "xy" for i in range(95)], "k string, pos bigint, v bigint")
    h = halo(df, F.col("pos"), 3, 2, rows=10)
    w = Window.partitionBy("k", "_chunk").orderBy("pos").rowsBetween(-3, 2)
    got = h.withColumn("s", F.sum("v").over(w)).where("_home").select("k", "pos", "s")
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("pos").rowsBetween(-3, 2))).select("k", "pos", "s")
    assert sorted(got.collect()) == sorted(plain.collect())


def test_stab_join_equals_nested_loops(spark):
    r = random.Random(5)
    points = [("k%d" % r.randrange(2), i, r.choice([0.0, 63.9, 64.0, 1e9, r.random() * 5000, r.random() * 2e9])) for i in range(120)]
    spans = []
    for i in range(60):
        lo = r.choice([0.0, 64.0, r.random() * 5000, r.random() * 2e9])
        spans.append(("k%d" % r.randrange(2), i, lo, lo + r.choice([0.0, 10.0, 64.0, 5000.0, 3e9])))
    p = spark.createDataFrame(points, "k string, pid int, t double")
    s = spark.createDataFrame(spans, "k string, sid int, lo double, hi double")
    for closed in (True, False):
        want = sorted(
            (a[1], b[1]) for a in points for b in spans
            if a[0] == b[0] and b[2] <= a[2] and (a[2] <= b[3] if closed else a[2] < b[3])
        )
        got = sorted((x.pid, x.sid) for x in stab_join(p, s, ["k"], "t", "lo", "hi", closed=closed).collect())
        assert got == want


def test_blocks_of_intervals_are_not_broadcast(spark, tmp_path):
    """Their explode makes many rows of one, which Spark's estimate leaves out."""
    spark.range(1000).selectExpr("id % 7 as k", "id as pid", "id * 10.0D as t").write.parquet(str(tmp_path / "p"))
    spark.range(1000).selectExpr("id % 7 as k", "id as sid", "id * 10.0D as lo", "id * 11.0D as hi").write.parquet(str(tmp_path / "s"))
    p, s = spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "s"))
    for tiles in (False, True):
        plan = stab_join(p, s, ["k"], "t", "lo", "hi", tiles=tiles)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_wide_blocks_are_few_and_join_the_same(spark):
    r = random.Random(6)
    points = [(i, r.choice([0.0, 64.0, -70.0, 4096.0, r.random() * 5000, r.random() * 2e9])) for i in range(150)]
    spans = [(i, lo, lo + d) for i, (lo, d) in enumerate(
        (r.choice([0.0, -64.0, 64.0, r.random() * 5000, r.random() * 2e9]), r.choice([-5.0, 0.0, 63.9, 64.0, 512.0, 36000.0, 3e9, 9e9]))
        for _ in range(80))]
    p, s = spark.createDataFrame(points, "pid int, t double"), spark.createDataFrame(spans, "sid int, lo double, hi double")
    p, s = p.withColumn("k", F.lit(1)), s.withColumn("k", F.lit(1))
    want = sorted((a[0], b[0]) for a in points for b in spans if b[1] <= a[1] <= b[2])
    assert sorted((x.pid, x.sid) for x in stab_join(p, s, ["k"], "t", "lo", "hi", tiles=True).collect()) == want
    assert with_wide_blocks(s, "lo", "hi").groupBy("sid").count().agg(F.max("count")).first()[0] <= 9
