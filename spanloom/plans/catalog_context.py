"""Context growth, compaction, hook and turn queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as C, hooks as H, sessions as S
from ..session import written
from . import driver_views as V
from .catalog_usage import money
from .oracle_base import sql
from .registry import query


def _seq(spark, sf):
    return V.with_seq(V.requests(spark, sf))


@query("context_timeline", sql(
    """SELECT session_id, seq, ts, model, ctx AS context_tokens, ctx AS approx_tokens, ctx * 4 AS approx_chars,
      transcript_items, errored FROM reqseq""", "reqseq"))
def context_timeline(spark, sf):
    return C.timeline(_seq(spark, sf)).select(
        "session_id", "seq", "ts", "model", "context_tokens", "approx_tokens", "approx_chars", "transcript_items", "errored"
    )


@query("context_peaks", sql(
    """, o AS (SELECT session_id, count(*) FILTER (ts < p) AS oo FROM
        (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY seq) p FROM reqseq) GROUP BY 1)
    SELECT r.session_id, count(*) AS calls, max(ctx) AS peak_context, max(ctx) AS peak_approx,
      (SELECT count(*) FROM comps c WHERE c.session_id = r.session_id) AS compactions, any_value(oo) AS out_of_order
    FROM reqseq r JOIN o USING (session_id) GROUP BY r.session_id""", "reqseq", "comps"))
def context_peaks(spark, sf):
    return C.timeline_peaks(_seq(spark, sf))


@query("compactions_strict", sql(
    """SELECT session_id, seq, p_seq, p_items AS from_items, transcript_items AS to_items, p_ctx - ctx AS freed FROM comps""", "comps"))
def compactions_strict(spark, sf):
    return C.find_compactions(_seq(spark, sf)).select(
        "session_id", "seq", "p_seq", F.col("p_items").alias("from_items"), F.col("transcript_items").alias("to_items"),
        (F.col("p_ctx") - F.col("ctx")).alias("freed"),
    )


@query("out_of_order_calls", sql(
    """SELECT session_id, count(*) FILTER (ts < p) AS out_of_order FROM
    (SELECT session_id, ts, lag(ts) OVER (PARTITION BY session_id ORDER BY seq) p FROM reqseq) GROUP BY 1""", "reqseq"))
def out_of_order(spark, sf):
    return C.out_of_order(_seq(spark, sf))


_COSTS = """, f AS (SELECT r.*, c.seq IS NOT NULL AS is_comp FROM reqseq r LEFT JOIN (SELECT session_id, seq FROM comps) c USING (session_id, seq)),
  b AS (SELECT session_id, seq, errored, cache_creation, cache_read,
      list_sort(list_filter(list(CASE WHEN NOT is_comp AND NOT errored THEN cache_creation END) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW), lambda x: x IS NOT NULL)) AS s,
      list_filter(list(CASE WHEN NOT errored THEN cache_creation END) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), lambda x: x IS NOT NULL)[1] AS good FROM f),
  costs AS (SELECT session_id, seq, CAST(CASE WHEN coalesce(len(s), 0) = 0 THEN 0 WHEN len(s) % 2 = 1 THEN s[len(s) // 2 + 1]
      ELSE floor((s[len(s) // 2] + s[len(s) // 2 + 1]) / 2 + 0.5) END AS BIGINT) AS cache_baseline,
    CASE WHEN errored AND cache_creation = 0 AND cache_read = 0 THEN coalesce(good, cache_creation) ELSE cache_creation END AS rebuild_cost FROM b)"""


@query("cache_baseline_and_rebuild", sql(
    _COSTS + " SELECT session_id, seq, cache_baseline, rebuild_cost FROM costs", "reqseq", "comps"))
def cache_costs(spark, sf):
    r = _seq(spark, sf)
    return C.cache_costs(r, C.find_compactions(r).select("session_id", "seq"))


@query("calls_to_regrow", sql(
    """SELECT c.session_id, c.seq, min(r.seq) - c.seq AS calls_to_regrow FROM comps c JOIN reqseq r
      ON r.session_id = c.session_id AND r.seq > c.seq AND r.ctx >= c.p_ctx GROUP BY 1, 2""", "comps", "reqseq"))
def regrow(spark, sf):
    r = _seq(spark, sf)
    c = C.find_compactions(r).select("session_id", "seq", F.col("p_ctx").alias("target"))
    return C.calls_to_regrow(r.select("session_id", "seq", C.context_tokens().alias("size")), c)


@query("compaction_efficacy", sql(
    _COSTS + """, g AS (SELECT c.session_id, c.seq, min(r.seq) - c.seq AS regrow FROM comps c JOIN reqseq r
      ON r.session_id = c.session_id AND r.seq > c.seq AND r.ctx >= c.p_ctx GROUP BY 1, 2),
    x AS (SELECT c.*, k.cache_baseline, k.rebuild_cost, g.regrow, greatest(0, p_ctx - ctx) AS reclaimed,
        greatest(0, rebuild_cost - cache_baseline) AS attributable
      FROM comps c LEFT JOIN costs k USING (session_id, seq) LEFT JOIN g USING (session_id, seq))
    SELECT session_id, seq, ts, p_items AS from_items, transcript_items AS to_items, p_ctx - ctx AS dropped_tokens,
      p_ctx AS pre_tokens, ctx AS post_tokens, reclaimed,
      CASE WHEN p_ctx > 0 THEN floor(reclaimed / p_ctx * 1000 + 0.5) / 10 ELSE 0 END AS reclaimed_pct,
      cache_creation AS cache_rebuild, p_cache_read AS cache_read_before, cache_read AS cache_read_after,
      cache_baseline, rebuild_cost, regrow AS calls_to_regrow,
      CASE WHEN reclaimed * 1.2::DOUBLE < attributable THEN 'negative' WHEN reclaimed < 500 THEN 'negative'
        WHEN reclaimed < attributable THEN 'marginal' WHEN regrow <= 5 THEN 'marginal' ELSE 'positive' END AS verdict FROM x""",
    "reqseq", "comps"))
def efficacy(spark, sf):
    return C.efficacy(written(_seq(spark, sf), "requests"))


@query("calls_in_flight", sql(
    """SELECT session_id, CAST(max(o) AS BIGINT) AS max_in_flight FROM (SELECT session_id, sum(d) OVER (PARTITION BY session_id ORDER BY t, d
        ROWS UNBOUNDED PRECEDING) AS o FROM (SELECT session_id, ts * 1000 AS t, 1 AS d FROM reqs WHERE duration_ms > 0
        UNION ALL SELECT session_id, ts * 1000 + duration_ms, -1 FROM reqs WHERE duration_ms > 0)) GROUP BY 1""", "reqs"))
def in_flight(spark, sf):
    return C.max_in_flight(V.requests(spark, sf))


@query("lane_count", sql(
    """SELECT session_id, CAST(max(o) AS BIGINT) AS lanes FROM (SELECT session_id, sum(d) OVER (PARTITION BY session_id ORDER BY t, d
        ROWS UNBOUNDED PRECEDING) AS o FROM (SELECT session_id, ts * 1000 AS t, 1 AS d FROM reqs WHERE duration_ms > 0
        UNION ALL SELECT session_id, ts * 1000 + duration_ms, -1 FROM reqs WHERE duration_ms > 0)) GROUP BY 1""", "reqs"))
def lanes(spark, sf):
    lanes = C.assign_lanes(_seq(spark, sf).where("duration_ms > 0"))
    return lanes.groupBy("session_id").agg((F.max("lane") + 1).cast("bigint").alias("lanes"))


@query("session_extremes", sql(
    """, d AS (SELECT *, ctx - lag(ctx) OVER (PARTITION BY session_id ORDER BY seq) AS jump FROM reqseq)
    SELECT session_id, first(seq ORDER BY coalesce(duration_ms, 0) DESC, seq) AS slowest_seq, max(coalesce(duration_ms, 0)) AS slowest_ms,
      first(seq ORDER BY ctx DESC, seq) AS peak_seq, max(ctx) AS peak_context,
      first(seq ORDER BY jump DESC NULLS LAST, seq) FILTER (jump IS NOT NULL) AS jump_seq, max(jump) AS jump_tokens
    FROM d GROUP BY session_id""", "reqseq"))
def extremes(spark, sf):
    return C.session_extremes(_seq(spark, sf))


# -- hooks -------------------------------------------------------------------

_OWNER = """, owner AS (SELECT client_session_id, first(session_id ORDER BY n DESC, started_at, session_id) AS session_id FROM (
    SELECT s.*, (SELECT count(*) FROM reqs r WHERE r.session_id = s.session_id AND NOT is_subagent) AS n
    FROM sess s WHERE client_session_id IS NOT NULL) GROUP BY 1)"""
_SHOWN = _OWNER + """, byid AS (SELECT o.session_id, h.* FROM hooks h JOIN owner o ON h.hook_session = o.client_session_id JOIN sess s ON s.session_id = o.session_id
    WHERE s.project = '' OR h.cwd = s.project),
  bt AS (SELECT s.session_id, h.* FROM sess s JOIN hooks h ON h.ts BETWEEN s.started_at - 600 AND s.ended_at + 600
    AND (s.project = '' OR h.cwd = s.project) WHERE s.client_session_id IS NULL),
  bytime AS (SELECT * EXCLUDE payload, CASE WHEN (SELECT count(DISTINCT hook_session) FROM bt b WHERE b.session_id = bt.session_id) = 1 THEN payload END AS payload FROM bt),
  shown AS (SELECT session_id, hook_id, ts, payload FROM byid UNION ALL SELECT session_id, hook_id, ts, payload FROM bytime)"""


@query("hook_owner_election", sql(_OWNER + " SELECT client_session_id, session_id FROM owner", "sess", "reqs"))
def owner(spark, sf):
    return H.hook_owner(V.session_spans(spark, sf), V.requests(spark, sf))


@query("session_hooks", sql(_SHOWN + " SELECT session_id, hook_id, payload FROM shown", "sess", "reqs", "hooks"))
def session_hooks(spark, sf):
    h = V.shown_hooks(spark, sf)
    return h.select("session_id", "hook_id", "payload")


@query("conversation_hooks", sql(
    """SELECT s.session_id, h.hook_id FROM sess s JOIN hooks h ON h.hook_session = s.client_session_id
      AND h.ts BETWEEN s.started_at - 600 AND s.ended_at + 600 WHERE s.project = '' OR h.cwd = s.project""", "sess", "hooks"))
def conversation_hooks(spark, sf):
    return H.conversation_hooks(V.session_spans(spark, sf), V.hooks(spark, sf)).select("session_id", "hook_id")


@query("hook_availability", sql(
    _SHOWN + """, m AS (SELECT s.session_id, s.client_session_id, (SELECT count(*) FROM hooks h WHERE h.hook_session = s.client_session_id) AS n,
       o.session_id AS owner, (SELECT count(*) FROM shown x WHERE x.session_id = s.session_id) AS shown_n
      FROM sess s LEFT JOIN owner o USING (client_session_id))
    SELECT session_id, client_session_id, CASE WHEN n > 0 THEN owner END AS owner_id, n AS conversation_hooks, shown_n AS shown,
      CASE WHEN shown_n > 0 THEN 'shown' WHEN (SELECT count(*) FROM hooks) = 0 THEN 'none indexed'
        WHEN n > 0 AND owner <> session_id THEN 'listed on owner' WHEN client_session_id IS NULL THEN 'no client id'
        WHEN n > 0 THEN 'other project' ELSE 'none for this conversation' END AS reason FROM m""", "sess", "reqs", "hooks"))
def availability(spark, sf):
    return H.hooks_meta(V.session_spans(spark, sf), V.requests(spark, sf), V.hooks(spark, sf))


@query("signal_hooks", sql("SELECT hook_id, event FROM hooks WHERE NOT observe_only", "hooks"))
def signal(spark, sf):
    return H.signal_hooks(V.hooks(spark, sf)).select("hook_id", "event")


@query("prunable_hooks", sql("SELECT count(*) FILTER (observe_only) AS matched FROM hooks", "hooks"))
def prunable(spark, sf):
    return H.prune_observe_only(V.hooks(spark, sf), dry_run=True)


_TURNS = """, turns AS (SELECT session_id, seq, ts AS t_lo, coalesce(lead(ts) OVER (PARTITION BY session_id ORDER BY seq),
      ts + greatest(0, coalesce(duration_ms, 0)) / 1000) AS t_hi FROM reqseq),
  th AS (SELECT t.session_id, t.seq, h.hook_id FROM shown h JOIN turns t ON h.session_id = t.session_id AND h.ts >= t_lo AND h.ts < t_hi)"""


@query("turn_hooks", sql(_SHOWN + _TURNS + " SELECT * FROM th", "sess", "reqs", "hooks", "reqseq"))
def turn_hooks(spark, sf):
    r = written(_seq(spark, sf).select("session_id", "seq", "ts", "duration_ms"), "requests")
    return H.shown_turn_hooks(V.hook_places(spark, sf), r, V.hooks(spark, sf))


@query("turns_with_compaction_in_window", sql(
    """SELECT session_id, seq FROM reqseq r WHERE ts * 1000 + greatest(0, coalesce(duration_ms, 0)) >= 1704412800000
      AND ts * 1000 <= 1705276800000 AND EXISTS (SELECT 1 FROM comps c WHERE c.session_id = r.session_id AND c.seq = r.seq)""",
    "reqseq", "comps"))
def turn_filter(spark, sf):
    r = _seq(spark, sf)
    ev = C.find_compactions(r).select("session_id", "seq", F.lit("compaction").alias("kind"))
    return H.filter_turns(r, ev, ["compaction"], (1704412800000.0, 1705276800000.0)).select("session_id", "seq")


@query("session_insights", sql(
    _SHOWN + _TURNS + """, ev AS (SELECT session_id, seq, count(*) AS n FROM (SELECT session_id, seq FROM th
        UNION ALL SELECT session_id, seq FROM comps UNION ALL SELECT session_id, unnest(list_transform(tool_names, lambda x: seq)) FROM reqseq) GROUP BY 1, 2),
    d AS (SELECT *, ctx - lag(ctx) OVER (PARTITION BY session_id ORDER BY seq) AS jump FROM reqseq),
    med AS (SELECT session_id, count(*) n, list_sort(list(duration_ms))[count(*) // 2 + 1] AS m FROM reqs WHERE duration_ms > 0 GROUP BY 1)
    SELECT session_id, 'compaction' AS rule, min(seq) AS seq, CAST(sum(p_items - transcript_items) AS DOUBLE) AS value FROM comps GROUP BY 1
    UNION ALL SELECT session_id, 'error', min(seq), count(*) FROM reqseq WHERE errored GROUP BY 1
    UNION ALL SELECT session_id, 'cache', min(seq), sum(cache_creation) FROM reqseq WHERE ctx > 20000 AND cache_creation / ctx > 0.5 GROUP BY 1
    UNION ALL SELECT session_id, 'slow', first(seq ORDER BY coalesce(duration_ms, 0) DESC, seq), max(duration_ms) FROM reqseq JOIN med USING (session_id)
      GROUP BY session_id, n, m HAVING n > 4 AND m > 0 AND max(duration_ms) > 3 * m
    UNION ALL SELECT session_id, 'growth', first(seq ORDER BY jump DESC, seq) FILTER (jump IS NOT NULL), max(jump) FROM d GROUP BY 1 HAVING max(jump) > 20000
    UNION ALL SELECT session_id, 'peak', first(seq ORDER BY ctx DESC, seq), max(ctx) FROM reqseq GROUP BY 1
    UNION ALL SELECT session_id, 'busy', first(seq ORDER BY n DESC, seq), max(n) FROM ev GROUP BY 1 HAVING max(n) >= 5
    UNION ALL SELECT session_id, 'hooks', l, n - p FROM (SELECT s.session_id, count(*) AS n, any_value((SELECT max(seq) FROM reqseq r WHERE r.session_id = s.session_id)) AS l,
        any_value((SELECT count(*) FROM th WHERE th.session_id = s.session_id)) AS p FROM shown s GROUP BY 1) WHERE n - p > 0""",
    "sess", "reqs", "hooks", "reqseq", "comps").replace("bytime AS (SELECT * EXCLUDE", "bytime2 AS (SELECT * EXCLUDE").replace("payload FROM bytime)", "payload FROM bytime2)"))
def session_insights(spark, sf):
    # Ten rules read the calls, two of them the hooks in each turn: both are written once.
    r = written(_seq(spark, sf), "requests")
    h, places = V.hooks(spark, sf), V.hook_places(spark, sf)
    n = written(H.shown_turn_counts(places, r, h), "turn_hooks")
    busiest = written(H.busiest_turn(H.turn_event_counts(r, n, C.find_compactions(r))), "busiest")
    orphans = written(H.orphan_hooks(r, H.shown_counts(places, h), n), "orphans")
    return C.session_insights(r, busiest, orphans)


@query("turn_prompts", sql(
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS step_index,
      last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations"""))
def turn_prompts(spark, sf):
    steps = V.table(spark, sf, "conversations").selectExpr(
        "cast(conv_id as string) as session_id", "turn + 1 as step_index", "role", "text as message"
    )
    return H.turn_prompts(steps).select("session_id", "step_index", "prompt")


@query("compaction_triggers")
def triggers(spark, sf):
    r = _seq(spark, sf)
    comps = C.find_compactions(r, by="seq").select("session_id", "seq", "ts")
    h = H.conversation_hooks(V.session_spans(spark, sf), V.hooks(spark, sf)).where("event = 'PreCompact'")
    return C.compaction_triggers(comps, h.select("session_id", "hook_id", "ts", "trigger"))


# -- session list ------------------------------------------------------------

def _steps(spark, sf):
    """Answered calls as agent steps; every eleventh one failed its tool."""
    return V.usage_events(spark, sf).select(
        "session_id", "line_no", F.lit("agent").alias("role"), "tool_names", (F.col("line_no") % 11 == 0).alias("errored")
    )


@query("sessions_by_text_filters", sql(
    """SELECT session_id, agent, model, project FROM sess WHERE lower(model) LIKE '%gpt%' AND lower(project) LIKE '%/p1%'
      AND started_at BETWEEN 1704067200 AND 1705276800 AND cost_usd >= 0.01""", "sess"))
def by_text(spark, sf):
    s = S.filter_sessions(V.sessions(spark, sf), model="GPT", project="/P1", since=1704067200, until=1705276800, min_cost=0.01)
    return s.select("session_id", "agent", "model", "project")


@query("sessions_calling_tool_with_errors", sql(
    """SELECT session_id FROM sess s WHERE EXISTS (SELECT 1 FROM usage u WHERE u.session_id = s.session_id AND list_contains(tool_names, 'Task'))
      AND EXISTS (SELECT 1 FROM usage u WHERE u.session_id = s.session_id AND line_no % 11 = 0) AND lower(agent) = 'codex'""", "sess", "usage"))
def by_tool(spark, sf):
    return S.filter_sessions(
        V.sessions(spark, sf), tool="Task", errored=True, agent_exact="Codex", steps=_steps(spark, sf)
    ).select("session_id")


@query("sessions_by_agent_or_subagent", sql(
    """SELECT session_id FROM sess s WHERE lower(agent) LIKE '%part 3%' OR EXISTS (SELECT 1 FROM reqs r WHERE r.session_id = s.session_id
      AND (lower(coalesce(agent_label, '')) LIKE '%part 3%' OR lower(coalesce(agent_type, '')) LIKE '%part 3%'))""", "sess", "reqs"))
def by_agent_name(spark, sf):
    return S.filter_sessions(V.sessions(spark, sf), agent="part 3", requests=V.requests(spark, sf)).select("session_id")


@query("recent_main_thread_sessions", sql(
    """SELECT session_id, started_at FROM sess s WHERE NOT (EXISTS (SELECT 1 FROM reqs r WHERE r.session_id = s.session_id)
      AND NOT EXISTS (SELECT 1 FROM reqs r WHERE r.session_id = s.session_id AND NOT is_subagent))
      ORDER BY started_at DESC, session_id LIMIT 6""", "sess", "reqs"))
def recent(spark, sf):
    s = S.filter_sessions(V.sessions(spark, sf), thread="main", requests=V.requests(spark, sf))
    return S.sort_sessions(s, limit=6).select("session_id", "started_at")


@query("session_list", sql(
    """SELECT session_id, agent, model, round(cost_usd, 9) AS cost_usd, turns AS turn_count,
      (SELECT count(*) FROM usage u WHERE u.session_id = s.session_id AND line_no % 11 = 0) AS error_count,
      (SELECT count(*) FROM reqs r WHERE r.session_id = s.session_id AND is_subagent AND coalesce(agent_label, '') = '') AS unnamed_agent_calls
    FROM sess s ORDER BY total_out_tokens DESC, session_id LIMIT 50""", "sess", "usage", "reqs"))
def session_list(spark, sf):
    s = S.list_sessions(
        V.sessions(spark, sf), _steps(spark, sf), V.requests(spark, sf), sort="total_out_tokens", order="desc", limit=50
    )
    return money(s.select("session_id", "agent", "model", "cost_usd", "turn_count", "error_count", "unnamed_agent_calls"))


@query("instant_session_filter", sql(
    """SELECT session_id FROM sess s WHERE contains(lower(concat_ws(' ', agent, model, project, session_id,
      (SELECT coalesce(string_agg(tool, ' ' ORDER BY tool), '') FROM toolcalls t WHERE t.session_id = s.session_id))), 'codex')""", "sess", "toolcalls"))
def instant(spark, sf):
    return S.instant_filter(V.sessions(spark, sf), "CODEX").select("session_id")


@query("agent_cast", sql(
    """SELECT session_id, nullif(trim(coalesce(agent_label, '')), '') AS label,
      CASE WHEN trim(coalesce(agent_label, '')) <> '' THEN agent_type END AS type, count(*) AS calls
    FROM reqs WHERE is_subagent GROUP BY 1, 2, 3""", "reqs"))
def cast(spark, sf):
    return S.agent_cast(V.requests(spark, sf))


@query("session_conversations", sql(
    """SELECT session_id, CASE WHEN NOT is_subagent THEN 'main' ELSE coalesce(nullif(trim(agent_label), ''), 'unnamed') END AS conversation,
      count(*) AS calls, CAST(sum(ctx) AS BIGINT) AS context_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
      min(ts) FILTER (ts > 0) AS first_ts, max(ts) FILTER (ts > 0) AS last_ts FROM reqs GROUP BY 1, 2""", "reqs"))
def conversations(spark, sf):
    return S.running_conversations(V.requests(spark, sf))


@query("sessions_of_same_log", sql(
    """SELECT a.session_id, b.session_id AS sibling_id, b.started_at FROM sess a JOIN sess b USING (source_path)
    WHERE a.session_id <> b.session_id""", "sess"))
def siblings(spark, sf):
    return S.same_source(V.sessions(spark, sf))


@query("majority_model", sql(
    """, c AS (SELECT session_id, model, count(*) n, min(seq) f FROM reqseq GROUP BY 1, 2)
    SELECT session_id, first(model ORDER BY n DESC, f) AS model FROM c GROUP BY 1""", "reqseq"))
def majority(spark, sf):
    return S.majority(_seq(spark, sf), ["session_id"], "model", ["seq"])


@query("latest_call_wins", sql(
    "SELECT session_id, prompt_hash, max(line_no) AS line_no FROM reqs GROUP BY 1, 2", "reqs"))
def latest(spark, sf):
    r = V.requests(spark, sf).select("session_id", "prompt_hash", "line_no")
    return S.latest_wins(r, ["session_id", "prompt_hash"], ["line_no"])


@query("session_transcript", sql(
    "SELECT session_id, seq, stop_reason, status FROM reqseq WHERE session_id = 's7' ORDER BY seq", "reqseq"))
def transcript(spark, sf):
    return S.read_requests(_seq(spark, sf), "s7").select("session_id", "seq", "stop_reason", "status")
