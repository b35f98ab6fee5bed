"""Spend, token and session reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet, sessions as S, usage as U
from . import driver_views as V
from .oracle_base import sql
from .registry import query

_SUMS = """CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation,
  CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, round(coalesce(sum(cost), 0), 9) AS cost_usd,
  bool_or(cost IS NULL) AS has_unpriced, count(*) AS events, count(DISTINCT session_id) AS sessions"""


def _label(fmt: str, shift: str = "") -> str:
    return f"CASE WHEN ts > 0 THEN strftime(make_timestamp(CAST(round(ts * 1e6) AS BIGINT)){shift}, '{fmt}') ELSE 'unknown' END"


def money(df, *cols):
    for c in cols or ("cost_usd",):
        df = df.withColumn(c, F.round(c, 9))
    return df


def _usage(granularity, breakdown=False, zone="UTC"):
    def run(spark, sf):
        rep = U.usage_report(V.usage_events(spark, sf), V.prices(spark), granularity, breakdown=breakdown, zone=zone)
        return money(rep.withColumnRenamed("group", "grp"))

    return run


_AGENTS = "array_to_string(list_sort(list(DISTINCT agent)), ',') AS grp"
query("usage_daily_by_model", sql(
    f"SELECT {_label('%Y-%m-%d')} AS bucket, model AS grp, {_SUMS} FROM usage GROUP BY 1, 2", "usage"
))(_usage("daily", True))
query("usage_weekly_by_agents", sql(
    f"SELECT {_label('%G-W%V')} AS bucket, {_AGENTS}, {_SUMS} FROM usage GROUP BY 1", "usage"
))(_usage("weekly"))
query("usage_monthly_by_model", sql(
    f"SELECT {_label('%Y-%m')} AS bucket, model AS grp, {_SUMS} FROM usage GROUP BY 1, 2", "usage"
))(_usage("monthly", True))
query("usage_total_bucket", sql(
    f"SELECT 'total' AS bucket, {_AGENTS}, {_SUMS} FROM usage", "usage"
))(_usage("total"))
query("usage_daily_tokyo", sql(
    f"SELECT {_label('%Y-%m-%d', ' + INTERVAL 9 HOUR')} AS bucket, {_AGENTS}, {_SUMS} FROM usage GROUP BY 1", "usage"
))(_usage("daily", zone="Asia/Tokyo"))


@query("usage_totals", sql(f"SELECT {_SUMS} FROM usage", "usage"))
def usage_totals(spark, sf):
    return money(U.usage_totals(V.usage_events(spark, sf), V.prices(spark)))


@query("usage_unpriced_models", sql("SELECT DISTINCT model FROM usage WHERE cost IS NULL", "usage"))
def usage_unpriced(spark, sf):
    return U.unpriced_models(V.usage_events(spark, sf), V.prices(spark))


@query("usage_filtered_events", sql(
    """SELECT session_id, line_no, ts, model, project, prompt_tokens FROM usage
       WHERE ts >= 1704412800 AND ts <= 1705276799 AND lower(agent) = 'codex'
         AND lower(model) LIKE '%gpt%' AND lower(project) LIKE '%/p%'""", "usage"))
def usage_filtered(spark, sf):
    ev = U.filter_events(
        V.usage_events(spark, sf),
        since=U.parse_when("2024-01-05"), until=U.parse_when("2024-01-14", end_of_day=True),
        agent="Codex", model="GPT", project="/P",
    )
    return ev.select("session_id", "line_no", "ts", "model", "project", "prompt_tokens")


@query("spend_today_and_month", sql(
    """SELECT round(coalesce(sum(CASE WHEN ts >= 1705622400 AND ts < 1705708800 THEN cost END), 0), 9) AS today_usd,
         round(coalesce(sum(cost), 0), 9) AS month_usd, coalesce(bool_or(cost IS NULL), false) AS has_unpriced
       FROM usage WHERE ts >= 1704067200 AND ts < 1706745600""", "usage"))
def spend(spark, sf):
    line = U.spend_line(V.usage_events(spark, sf), V.prices(spark), as_of=1705666666)
    return money(line, "today_usd", "month_usd")


# -- sessions ----------------------------------------------------------------

_HIST = """(SELECT array_to_string(list(tool || '=' || calls ORDER BY tool), ',') FROM toolcalls t
            WHERE t.session_id = s.session_id)"""


def _hist_text(c="tool_histogram"):
    e = F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return F.when(F.col(c).isNotNull(), F.array_join(e, ","))


@query("session_stats", sql(
    f"""SELECT session_id, agent, model, project, source_path, client_session_id, started_at, ended_at,
      round(CASE WHEN ended_at > started_at THEN (ended_at - started_at) * 1000 ELSE 0 END, 3) AS duration_ms,
      total_in_tokens, total_out_tokens, cache_read, cache_creation, reasoning_tokens, round(cost_usd, 9) AS cost_usd,
      round(cache_read / (total_in_tokens + cache_read + cache_creation), 9) AS cache_hit_rate, turns, tool_calls,
      {_HIST} AS tools FROM sess s""", "sess", "toolcalls"))
def session_stats(spark, sf):
    s = V.sessions(spark, sf).withColumn("tools", _hist_text()).drop("tool_histogram")
    return money(s, "cost_usd", "cache_hit_rate").withColumn("duration_ms", F.round("duration_ms", 3))


@query("log_rollup", sql(
    """SELECT source_path, count(*) AS trajectories, CAST(sum(total_in_tokens) AS BIGINT) AS total_in_tokens,
      CAST(sum(total_out_tokens) AS BIGINT) AS total_out_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read,
      CAST(sum(cache_creation) AS BIGINT) AS cache_creation, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
      CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(tool_calls) AS BIGINT) AS tool_calls,
      round(sum(cost_usd), 9) AS cost_usd,
      round(sum(cache_read) / sum(total_in_tokens + cache_read + cache_creation), 9) AS cache_hit_rate,
      array_to_string(list_sort(list(DISTINCT model)), ',') AS models,
      coalesce(array_to_string(list_sort(list(DISTINCT model) FILTER (cost_usd IS NULL)), ','), '') AS unknown_models
    FROM sess GROUP BY source_path""", "sess"))
def log_rollup(spark, sf):
    return money(fleet.rollup_logs(V.sessions(spark, sf)), "cost_usd", "cache_hit_rate")


@query("log_counts", sql(
    """SELECT (SELECT count(*) FROM reqs) AS pairs, count(*) AS trajectories,
      CAST(sum(total_in_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(total_out_tokens) AS BIGINT) AS completion_tokens,
      CAST(sum(cache_creation) AS BIGINT) AS cache_creation, CAST(sum(cache_read) AS BIGINT) AS cache_read,
      CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens FROM sess""", "sess", "reqs"))
def log_counts(spark, sf):
    return fleet.log_counts(V.requests(spark, sf), V.sessions(spark, sf))


@query("index_counts", sql(
    """SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT count(*) FROM reqs) AS requests,
      (SELECT count(DISTINCT prompt_hash) FROM reqs WHERE prompt_hash <> '') AS prompts,
      (SELECT count(*) FROM usage) AS events""", "sess", "reqs", "usage"))
def index_counts(spark, sf):
    r = V.requests(spark, sf)
    return fleet.index_counts(V.sessions(spark, sf), r, V.usage_events(spark, sf))


# -- fleet -------------------------------------------------------------------

@query("fleet_totals", sql(
    """SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT count(*) FROM reqs) AS requests,
      (SELECT count(*) FROM reqs WHERE errored) AS errored_requests, count(*) AS events,
      round(coalesce(sum(cost), 0), 9) AS cost_usd, bool_or(cost IS NULL) AS has_unpriced,
      CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
      CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation,
      round(sum(cache_read) / sum(prompt_tokens + cache_read + cache_creation), 9) AS cache_hit_rate
    FROM usage""", "sess", "reqs", "usage"))
def fleet_totals(spark, sf):
    t = fleet.totals(V.sessions(spark, sf), V.requests(spark, sf), V.usage_events(spark, sf), V.prices(spark))
    return money(t, "cost_usd", "cache_hit_rate")


@query("spend_by_agent", sql(
    """SELECT agent, count(DISTINCT session_id) AS sessions, round(coalesce(sum(cost), 0), 9) AS cost_usd,
      CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
    FROM usage GROUP BY agent""", "usage"))
def by_agent(spark, sf):
    return money(fleet.per_agent(V.usage_events(spark, sf), V.prices(spark)))


@query("spend_by_project", sql(
    """SELECT CASE WHEN project = '' THEN '(unknown)' ELSE project END AS project, count(DISTINCT session_id) AS sessions,
      round(coalesce(sum(cost), 0), 9) AS cost_usd, count(*) AS events,
      CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM usage GROUP BY 1""", "usage"))
def by_project(spark, sf):
    return money(fleet.per_project(V.usage_events(spark, sf), V.prices(spark)))


@query("daily_trend", sql(
    """SELECT strftime(make_timestamp(CAST(round(ts * 1e6) AS BIGINT)), '%Y-%m-%d') AS date,
      round(coalesce(sum(cost), 0), 9) AS cost_usd, count(*) AS events
    FROM usage WHERE ts > 0 GROUP BY 1 ORDER BY 1 DESC""", "usage"))
def daily_trend(spark, sf):
    return money(fleet.daily_trend(V.usage_events(spark, sf), V.prices(spark)))


_QS = [("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)]
_PCT = ", ".join(f"quantile_disc(ttft_ms, {q}) AS ttft_{n}" for n, q in _QS)


@query("model_wire_metrics", sql(
    f"""SELECT model, count(*) AS requests, count(*) FILTER (errored) AS errored,
      round(count(*) FILTER (errored) / count(*), 9) AS error_rate, count(ttft_ms) AS ttft_n, {_PCT},
      quantile_disc(duration_ms, 0.5) AS duration_p50, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
    FROM reqs GROUP BY model""", "reqs"))
def model_wire(spark, sf):
    return money(fleet.per_model(V.requests(spark, sf)), "error_rate")


@query("spend_by_named_agent", sql(
    """SELECT CASE WHEN NOT is_subagent THEN 'main thread' ELSE coalesce(nullif(agent_label, ''), 'unnamed subagents') END AS label,
      is_subagent AND coalesce(agent_label, '') <> '' AS named,
      arg_min(CASE WHEN is_subagent THEN coalesce(agent_type, '') ELSE '' END, {'s': session_id, 't': ts, 'k': CASE WHEN is_subagent THEN coalesce(agent_type, '') ELSE '' END}) AS type, count(*) AS calls, count(DISTINCT session_id) AS sessions,
      round(coalesce(sum(cost), 0), 9) AS cost_usd, CAST(sum(ctx) AS BIGINT) AS prompt_tokens,
      CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM reqcost GROUP BY 1, 2""", "reqcost"))
def by_named_agent(spark, sf):
    return money(fleet.per_named_agent(V.requests(spark, sf), V.prices(spark)))


@query("named_agents_ranked", sql(
    """, a AS (SELECT CASE WHEN NOT is_subagent THEN 'main thread' ELSE coalesce(nullif(agent_label, ''), 'unnamed subagents') END AS label,
      count(*) AS calls, coalesce(sum(cost), 0) AS cost FROM reqcost GROUP BY 1, is_subagent AND coalesce(agent_label, '') <> ''),
    k AS (SELECT *, row_number() OVER (ORDER BY label = 'main thread' DESC, cost DESC, label) AS n FROM a)
    SELECT CAST(least(n, 3) AS INTEGER) AS rank, CASE WHEN n <= 2 THEN label ELSE 'others' END AS label,
      CAST(sum(calls) AS BIGINT) AS calls, round(sum(cost), 9) AS cost_usd FROM k GROUP BY 1, 2""", "reqcost"))
def ranked_agents(spark, sf):
    return money(fleet.rank_named_agents(fleet.per_named_agent(V.requests(spark, sf), V.prices(spark)), rows=2))


@query("top_tools", sql(
    """SELECT tool, CAST(sum(calls) AS BIGINT) AS calls, (SELECT count(DISTINCT tool) FROM toolcalls) AS tools_total
    FROM toolcalls GROUP BY tool ORDER BY 2 DESC, 1 LIMIT 20""", "toolcalls"))
def top_tools(spark, sf):
    return fleet.top_tools(V.sessions(spark, sf))


@query("compactions_simple", sql(
    """SELECT count(*) AS compactions, count(DISTINCT session_id) AS sessions FROM (
      SELECT session_id, transcript_items - lag(transcript_items) OVER w AS di, ctx - lag(ctx) OVER w AS dc
      FROM reqseq WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)) WHERE di < 0 AND dc < 0""", "reqseq"))
def compactions_simple(spark, sf):
    return fleet.compactions_simple(V.with_seq(V.requests(spark, sf)))


@query("top_sessions_by_cost", sql(
    """SELECT session_id, agent, model, project, started_at, round(cost_usd, 9) AS cost_usd, turns
    FROM sess ORDER BY coalesce(cost_usd, 0) DESC, session_id LIMIT 8""", "sess"))
def top_sessions(spark, sf):
    t = fleet.top_sessions(V.sessions(spark, sf))
    return money(t.select("session_id", "agent", "model", "project", "started_at", "cost_usd", "turns"))


@query("daily_activity_filled", sql(
    """, d AS (SELECT CAST(make_timestamp(CAST(round(started_at * 1e6) AS BIGINT)) + INTERVAL 9 HOUR AS DATE) AS day,
        count(*) AS sessions, coalesce(sum(cost_usd), 0) AS cost, count(DISTINCT agent) AS agents
      FROM sess WHERE started_at > 0 GROUP BY 1),
      g AS (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d)
    SELECT strftime(g.day, '%Y-%m-%d') AS date, coalesce(d.sessions, 0) AS sessions, round(coalesce(d.cost, 0), 9) AS cost_usd,
      coalesce(d.agents, 0) AS agents, g.day > (SELECT max(day) FROM d) - 7 AS in_default_window
    FROM g LEFT JOIN d USING (day)""", "sess"))
def daily_activity(spark, sf):
    return money(fleet.daily_activity(V.sessions(spark, sf), zone="Asia/Tokyo"))


@query("scoped_requests", sql(
    """SELECT r.session_id, r.line_no FROM reqs r JOIN sess s USING (session_id)
    WHERE coalesce(nullif(r.ts, 0), s.started_at) BETWEEN 1704412800 AND 1705276799 AND lower(s.agent) = 'gemini'""",
    "reqs", "sess"))
def scoped_requests(spark, sf):
    r = fleet.scope_requests(
        V.requests(spark, sf).drop("agent"), V.sessions(spark, sf).select("session_id", "agent", "started_at"),
        since=1704412800, until=1705276799, agent="gemini",
    )
    return r.select("session_id", "line_no")


@query("events_with_session_project", sql(
    """SELECT r.session_id, r.line_no, coalesce(s.project, '') AS project_cwd
    FROM reqs r LEFT JOIN (SELECT * FROM sess WHERE agent <> 'devin') s USING (session_id)""", "reqs", "sess"))
def events_project(spark, sf):
    s = V.sessions(spark, sf).where("agent <> 'devin'").select("session_id", F.col("project").alias("p"))
    r = V.requests(spark, sf).select("session_id", "line_no")
    return r.join(s, "session_id", "left").select("session_id", "line_no", F.coalesce("p", F.lit("")).alias("project_cwd"))


_INSIGHT = """, t AS (SELECT sum(coalesce(cost,0)) cost, sum(prompt_tokens) p, sum(cache_read) cr, sum(cache_creation) cc FROM usage),
  pm AS (SELECT model, count(*) n, count(*) FILTER (errored) e, count(ttft_ms) tn, quantile_disc(ttft_ms, 0.5) p50, quantile_disc(ttft_ms, 0.95) p95
         FROM reqs GROUP BY model),
  pj AS (SELECT CASE WHEN project='' THEN '(unknown)' ELSE project END project, sum(coalesce(cost,0)) c FROM usage GROUP BY 1),
  cp AS (SELECT count(*) n, count(DISTINCT session_id) s FROM (SELECT session_id, transcript_items - lag(transcript_items) OVER w di, ctx - lag(ctx) OVER w dc
         FROM reqseq WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)) WHERE di<0 AND dc<0),
  tt AS (SELECT tool, sum(calls) n FROM toolcalls GROUP BY tool ORDER BY n DESC, tool LIMIT 1)"""


@query("fleet_insights", sql(
    _INSIGHT + """ SELECT * FROM (
    SELECT 'unpriced' AS rule, CAST(count(DISTINCT session_id) AS VARCHAR) AS subject, CAST(count(*) AS DOUBLE) AS value, 'warn' AS severity
      FROM usage WHERE cost IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'cache_writes', '', round(cc / (cr + cc), 9), CASE WHEN cc / (cr + cc) > 0.25 THEN 'warn' ELSE 'info' END FROM t
    UNION ALL SELECT 'worst_model', model, round(e / n, 9), 'bad' FROM (SELECT * FROM pm WHERE n >= 20 ORDER BY e / n DESC, model LIMIT 1) WHERE e / n > 0.01
    UNION ALL SELECT 'slow_tail', model, round(p95 / p50, 9), 'info' FROM (SELECT * FROM pm WHERE tn >= 20 ORDER BY p95 DESC, model LIMIT 1) WHERE p50 > 0 AND p95 > 2.5 * p50
    UNION ALL (SELECT 'top_project', project, round(c / (SELECT cost FROM t), 9), 'info' FROM pj ORDER BY c DESC, project LIMIT 1)
    UNION ALL SELECT 'compactions', CAST(s AS VARCHAR), CAST(n AS DOUBLE), 'warn' FROM cp WHERE n > 0
    UNION ALL SELECT 'busiest_tool', tool, CAST(n AS DOUBLE), 'info' FROM tt)""", "usage", "reqs", "reqseq", "toolcalls"))
def fleet_insights(spark, sf):
    out = fleet.insights(
        V.sessions(spark, sf), V.with_seq(V.requests(spark, sf)), V.usage_events(spark, sf), V.prices(spark)
    )
    return money(out, "value")
