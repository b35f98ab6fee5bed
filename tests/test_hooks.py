"""Hooks shown under sessions and turns, against plain loops over all pairs."""

import random

import pytest

from spanloom.operators import hooks as H

SESSIONS = "session_id string, project string, client_session_id string, started_at double, ended_at double"
HOOKS = "hook_id bigint, hook_session string, ts double, cwd string, payload string"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    sessions, requests = [], []
    for k in range(40):
        at = rnd.choice([0.0, float(rnd.randrange(1000, 40000))])
        sessions.append((f"s{k}", rnd.choice(["", "/p", "/p/", "/q"]), rnd.choice([None, None, f"c{k // 3}"]), at, at and at + rnd.randrange(9000)))
        for n in range(rnd.randrange(9)):
            t = rnd.choice([0.0, at + rnd.randrange(9000), at - 700.0, at + 9600.0])
            requests.append((f"s{k}", n, t, rnd.choice([None, 500, 900000]), rnd.random() < 0.3, ["Read"] * rnd.randrange(3)))
    hooks = [
        (i, rnd.choice([None, "s3", "s4", "x", "x", "x", "c1", "c2", "c5"]), rnd.choice([float(rnd.randrange(50000)), sessions[i % 40][3] - 600, None]),
         rnd.choice(["/p", "/p/", "/q", "/z", "", None]), f"p{i}") for i in range(300)
    ]
    return sessions, requests, hooks


@pytest.fixture(scope="module")
def frames(spark, tables):
    s, r, h = tables
    return (spark.createDataFrame(s, SESSIONS).cache(), spark.createDataFrame(
        r, "session_id string, seq bigint, ts double, duration_ms bigint, is_subagent boolean, tool_names array<string>").cache(),
        spark.createDataFrame(h, HOOKS).cache())


def bare(path):
    return (path or "").rstrip("/")


def shown(sessions, requests, hooks):
    main = {}
    for r in requests:
        main[r[0]] = main.get(r[0], 0) + (not r[4])
    owner, keyed = {}, {h[1] for h in hooks}
    for s in sessions:
        if s[2] is not None:
            rank = (-main.get(s[0], 0), s[3], s[0])
            owner[s[2]] = min(owner.get(s[2], (rank, s[0])), (rank, s[0]))
    out = []
    for sid, project, client, lo, hi in sessions:
        fits = lambda h: bare(project) == "" or bare(h[3]) in ("", bare(project))
        if sid in keyed or client is not None:
            key = sid if sid in keyed else client if owner[client][1] == sid else None
            out += [(sid, h[0], h[2], h[4]) for h in hooks if key is not None and h[1] == key and fits(h)]
        else:
            a, b = max(lo - 600, 0.0) if lo > 0 else 0.0, hi + 600 if hi > 0 else 4e9
            hit = [h for h in hooks if h[2] is not None and a <= h[2] <= b and fits(h)]
            one = len({h[1] for h in hit} - {None}) == 1
            out += [(sid, h[0], h[2], h[4] if one else None) for h in hit]
    return out


def test_shown_hooks_and_their_counts(spark, tables, frames):
    want = shown(*tables)
    key = lambda r: (r[0], r[1], r[2] or "")
    got = [(r.session_id, r.hook_id, r.payload) for r in H.session_hooks(*frames).collect()]
    assert sorted(got, key=key) == sorted([(s, i, p) for s, i, _, p in want], key=key) and len(got) > 500
    counts = {r.session_id: r.shown for r in H.shown_counts(H.hook_places(*frames), frames[2]).collect()}
    assert counts == {s: sum(w[0] == s for w in want) for s in {w[0] for w in want}}


def test_hooks_in_turns_and_their_counts(spark, tables, frames):
    sessions, requests, _ = tables
    by_session, want = {}, []
    for sid, i, t, _ in shown(*tables):
        by_session.setdefault(sid, []).append((i, t))
    for sid, n, t, ms, *_ in requests:
        following = next((r[2] for r in requests if r[0] == sid and r[1] == n + 1), t + (ms or 0) / 1000)
        want += [(sid, n, i) for i, at in by_session.get(sid, []) if at is not None and t <= at < following]
    places = H.hook_places(*frames)
    got = sorted(map(tuple, H.shown_turn_hooks(places, frames[1], frames[2]).collect()))
    assert got == sorted(want) and len(got) > 200
    counts = {(r.session_id, r.seq): r.n for r in H.shown_turn_counts(places, frames[1], frames[2]).collect()}
    assert counts == {k: sum(w[:2] == k for w in want) for k in {w[:2] for w in want}}
    totals = {r.session_id: r.orphan for r in H.orphan_hooks(
        frames[1], H.shown_counts(places, frames[2]), H.shown_turn_counts(places, frames[1], frames[2])).collect()}
    assert all(totals[s] == len(by_session[s]) - sum(w[0] == s for w in want) for s in totals) and totals


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_of_turn_hooks_stay_small(spark):
    """Driver memory follows the plan: sessions and turns are not derived again for each use."""
    from spanloom.plans.catalog import QUERIES

    assert plan(QUERIES["turn_hooks"](spark, "/root/testdata/sf0.001")).count("Relation [") <= 8


def test_plans_of_insights_stay_small(spark):
    from spanloom.plans.catalog import QUERIES

    assert plan(QUERIES["session_insights"](spark, "/root/testdata/sf0.001")).count("Relation [") <= 14


def test_hooks_and_sessions_are_paired_once(spark):
    from spanloom.plans.catalog import QUERIES

    assert plan(QUERIES["session_hooks"](spark, "/root/testdata/sf0.001")).count("inline(aggregate") == 1


def test_availability_counts_without_pairs(spark):
    from spanloom.plans.catalog import QUERIES

    assert "_level" not in plan(QUERIES["hook_availability"](spark, "/root/testdata/sf0.001"))


def test_plans_of_flow_edges_stay_small(spark):
    from spanloom.plans.catalog import QUERIES

    assert plan(QUERIES["flow_edges"](spark, "/root/testdata/sf0.001")).count("Relation [") <= 4
