"""Queries over captured pairs in the four wire shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.titles import session_titles
from ..operators import diff as D, export as E, sessions as S, trajectory as T, xray as X
from ..session import written
from ..sources.pairs import project_of
from . import driver_views as V
from .catalog_usage import money
from .oracle_base import sql
from .registry import query


def _key(path="source_path"):
    return F.regexp_extract(path, r"/(\d+)\.jsonl", 1).cast("bigint").alias("key")


def _built(spark, sf):
    # Every step below joins the numbers of the calls: narrow, and written once.
    c = V.calls(spark, sf)
    n = written(T.number_calls(c), "numbered")
    return c, n, T.build_steps(c, n)


@query("trace_steps", sql(
    """SELECT key, seq, step_index, CASE role WHEN 'assistant' THEN 'agent' ELSE 'user' END AS role, text AS message,
      CASE role WHEN 'assistant' THEN 'Read' ELSE '' END AS tool_name,
      CASE role WHEN 'assistant' THEN '{"path":"f' || turn || '"}' ELSE '' END AS tool_input,
      CASE WHEN role = 'assistant' AND turn < last_turn THEN 'ok ' || turn ELSE '' END AS observation,
      CASE role WHEN 'assistant' THEN tin END AS prompt_tokens, CASE role WHEN 'assistant' THEN tout END AS completion_tokens,
      CASE role WHEN 'assistant' THEN tcr END AS cache_read, CASE role WHEN 'assistant' THEN tcc END AS cache_creation
    FROM said""", "said"))
def trace_steps(spark, sf):
    _, _, steps = _built(spark, sf)
    return steps.select(
        _key(), "seq", "step_index", "role", "message", F.array_join("tool_names", " ").alias("tool_name"),
        F.array_join("tool_inputs", "\n").alias("tool_input"), "observation",
        "prompt_tokens", "completion_tokens", "cache_read", "cache_creation",
    )


@query("trace_requests", sql(
    """SELECT key, seq, model, CASE WHEN ok THEN 200 END AS status, CASE WHEN ok THEN 2500 END AS duration_ms,
      CASE WHEN ok THEN 250 END AS ttft_ms, CASE WHEN ok THEN tin ELSE 0 END AS prompt_tokens,
      CASE WHEN ok THEN tout ELSE 0 END AS completion_tokens, CASE WHEN ok THEN tcr ELSE 0 END AS cache_read,
      CASE WHEN ok THEN tcc ELSE 0 END AS cache_creation,
      CASE WHEN ok THEN (['tool_use','completed','STOP','stop'])[shape + 1] ELSE '' END AS stop_reason, NOT ok AS errored,
      items_before + CASE WHEN ok THEN 0 ELSE 1 END AS transcript_items, CASE WHEN ok THEN step_index END AS agent_step_index
    FROM callrows""", "callrows"))
def trace_requests(spark, sf):
    c, n, steps = _built(spark, sf)
    return T.build_requests(c, n, steps).select(
        _key(), "seq", "model", "status", "duration_ms", "ttft_ms", "prompt_tokens", "completion_tokens", "cache_read",
        "cache_creation", "stop_reason", "errored", "transcript_items", "agent_step_index",
    )


@query("trace_usage_events", sql(
    """SELECT key, step_index, agent, s.model, tin AS prompt_tokens, round((tin*p.pin + tout*p.pout + tcc*p.pcw + tcr*p.pcr) / 1e6, 9) AS cost_usd
    FROM said s LEFT JOIN (SELECT model, arg_max(pin, length(pmodel)) pin, arg_max(pout, length(pmodel)) pout, arg_max(pcw, length(pmodel)) pcw,
        arg_max(pcr, length(pmodel)) pcr FROM (SELECT DISTINCT model FROM said) JOIN prices ON starts_with(lower(model), pmodel) GROUP BY 1) p USING (model)
    WHERE role = 'assistant'""", "said", "prices"))
def trace_usage(spark, sf):
    c, n, steps = _built(spark, sf)
    e = T.build_usage_events(steps, T.session_heads(c, n), V.prices(spark))
    return money(e.select(_key(), "step_index", "agent", "model", "prompt_tokens", "cost_usd"))


@query("trace_sessions", sql(
    """SELECT key, any_value(agent) AS agent, any_value(model) AS model, '/work/w' || (key % 50) AS project, count(*) FILTER (role = 'assistant') AS turns,
      count(*) FILTER (role = 'assistant') AS tool_calls, CAST(coalesce(sum(tin) FILTER (role = 'assistant'), 0) AS BIGINT) AS total_in_tokens,
      CAST(coalesce(sum(tout) FILTER (role = 'assistant'), 0) AS BIGINT) AS total_out_tokens
    FROM said GROUP BY key""", "said"))
def trace_sessions(spark, sf):
    c, n, steps = _built(spark, sf)
    dims = T.session_heads(c, n).withColumn("project", project_of(F.col("source_path")))
    rows = S.session_rows(S.session_rollup(steps), dims, V.prices(spark))
    return rows.select(_key(), "agent", "model", "project", "turns", "tool_calls", "total_in_tokens", "total_out_tokens")


@query("trace_titles", sql(
    """, f AS (SELECT key, regexp_replace(trim(first(text ORDER BY turn)), '\\s+', ' ', 'g') AS t FROM said WHERE role = 'user' GROUP BY key),
    c AS (SELECT key, t, left(t, 120) AS cut, 120 - instr(reverse(left(t, 120)), ' ') AS gap FROM f)
    SELECT key, CASE WHEN length(t) <= 120 THEN t WHEN contains(cut, ' ') AND gap > 72 THEN left(cut, gap) || '…' ELSE cut || '…' END AS title FROM c""", "said"))
def trace_titles(spark, sf):
    _, _, steps = _built(spark, sf)
    return session_titles(steps, ["source_path"]).select(_key(), "title")


@query("trace_prompts", sql(
    """, p AS (SELECT key, 'conv ' || key || ': ' || coalesce(max(text) FILTER (role = 'system'), '') AS content FROM conv GROUP BY key)
    SELECT sha256(p.content) AS prompt_hash, any_value(agent) AS agent, min(ts)::DOUBLE AS first_seen, max(ts)::DOUBLE AS last_seen,
      count(*) AS requests, 1 AS sessions, length(p.content) AS chars FROM callrows JOIN p USING (key) GROUP BY p.content""", "callrows"))
def trace_prompts(spark, sf):
    return T.prompt_registry(V.calls(spark, sf)).withColumn("chars", F.length("content")).drop("content")


@query("trace_digests", sql(
    """, l AS (SELECT key, step_index, any_value(agent) OVER (PARTITION BY key) AS agent, any_value(model) OVER (PARTITION BY key) AS model,
        CASE role WHEN 'user' THEN 'USER: ' ELSE 'AGENT: ' END || flat
        || CASE WHEN role = 'assistant' THEN chr(10) || '  TOOL Read({"path":"f' || turn || '"})' || CASE WHEN turn < last_turn THEN chr(10) || '    -> ok ' || turn ELSE '' END ELSE '' END AS part
      FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM said))
    SELECT key, '## Session — ' || any_value(agent) || ' (' || any_value(model) || ')' || chr(10) || string_agg(part, chr(10) ORDER BY step_index) AS digest FROM l GROUP BY key""", "said"))
def trace_digests(spark, sf):
    c, n, steps = _built(spark, sf)
    return T.digest(steps, T.session_heads(c, n)).select(_key(), "digest")


@query("trace_run_shapes", sql(
    """SELECT key, 1 AS trajectories, count(*) AS steps, count(*) FILTER (role = 'user') AS user_steps, count(*) FILTER (role = 'assistant') AS agent_steps,
      count(*) FILTER (role = 'assistant') AS tool_calls, CAST(coalesce(sum(tcr) FILTER (role = 'assistant'), 0) AS BIGINT) AS cache_read FROM said GROUP BY key""", "said"))
def run_shapes(spark, sf):
    _, _, steps = _built(spark, sf)
    return D.run_shape(steps).select(
        _key("run"), "trajectories", "steps", "user_steps", "agent_steps", "tool_calls", "cache_read"
    )


def _segments(spark, sf):
    c = V.calls(spark, sf)
    placed = c.join(T.number_calls(c).select(*T.CALL, "seq"), T.CALL)
    return X.segments(placed)


_SEGS = """, seg AS (
    SELECT key, seq, 'system' AS bucket, 1 AS n FROM callrows WHERE shape IN (0, 1, 3)
    UNION ALL SELECT key, seq, 'tools', 2 FROM callrows WHERE shape = 0
    UNION ALL SELECT c.key, c.seq, b.bucket, b.n FROM callrows c JOIN said h ON h.key = c.key AND (h.turn < c.turn OR (NOT c.ok AND h.turn = c.turn))
      JOIN (VALUES (0, 'assistant', 'assistant', 2), (0, 'assistant', 'tool_result', 1), (0, 'user', 'user', 1), (1, 'assistant', 'assistant', 1), (1, 'user', 'user', 1),
        (2, 'assistant', 'assistant', 2), (2, 'assistant', 'user', 1), (2, 'user', 'user', 1)) b(shape, role, bucket, n) ON b.shape = c.shape AND b.role = h.role)"""


@query("xray_buckets", sql(
    _SEGS + " SELECT key, seq, bucket, CAST(sum(n) AS BIGINT) AS segments FROM seg GROUP BY 1, 2, 3", "callrows"))
def xray_buckets(spark, sf):
    return X.bucket_sizes(_segments(spark, sf)).select(_key(), "seq", "bucket", "segments")


@query("xray_changes", sql(
    _SEGS + """, t AS (SELECT key, seq, sum(n) AS n FROM seg GROUP BY 1, 2)
    SELECT key, seq, CAST(n - p AS BIGINT) AS "new", CAST(p AS BIGINT) AS carried, 0 AS dropped
    FROM (SELECT *, lag(n) OVER (PARTITION BY key ORDER BY seq) AS p FROM t) WHERE seq > 0""", "callrows"))
def xray_changes(spark, sf):
    return X.change_counts(X.diff_calls(_segments(spark, sf))).select(_key(), "seq", "new", "carried", "dropped")


@query("xray_windows", sql(
    _SEGS + """, t AS (SELECT key, seq, CAST(sum(n) AS BIGINT) AS n FROM seg GROUP BY 1, 2),
    d AS (SELECT key, seq, n, n - lag(n) OVER (PARTITION BY key ORDER BY seq) AS "new", lag(n) OVER (PARTITION BY key ORDER BY seq) AS carried FROM t)
    SELECT c.key, c.seq AS center, d.seq, d.n AS segments, d."new", d.carried, CASE WHEN d.carried IS NOT NULL THEN 0 END AS dropped
    FROM d c JOIN d ON d.key = c.key AND d.seq BETWEEN c.seq - 1 AND c.seq + 1""", "callrows"))
def xray_windows(spark, sf):
    segs = written(_segments(spark, sf).select(*X.KEY, "segment_id"), "segments")
    counts = written(X.counts_of_calls(segs), "counts")
    return X.call_windows(counts, 1).select(_key(), "center", "seq", "segments", "new", "carried", "dropped")


@query("xray_bucket_changes", sql(
    _SEGS + """, b AS (SELECT key, seq, bucket, sum(n) AS n FROM seg GROUP BY 1, 2, 3), k AS (SELECT DISTINCT key, seq FROM b)
    SELECT key, seq, bucket, CAST(n AS BIGINT) AS segments FROM b
    UNION ALL SELECT b.key, b.seq + 1, b.bucket, 0 FROM b JOIN k ON k.key = b.key AND k.seq = b.seq + 1
      WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.key = b.key AND x.seq = b.seq + 1 AND x.bucket = b.bucket)""", "callrows"))
def xray_bucket_changes(spark, sf):
    return X.bucket_changes(X.bucket_sizes(_segments(spark, sf))).select(_key(), "seq", "bucket", "segments")


@query("export_documents", sql(
    """SELECT key, CAST(count(*) AS BIGINT) AS total_steps, CAST(coalesce(sum(tin) FILTER (role = 'assistant'), 0) AS BIGINT) AS total_prompt_tokens,
      CAST(coalesce(sum(tcr + tcc) FILTER (role = 'assistant'), 0) AS BIGINT) AS total_cached_tokens, any_value(agent) AS agent,
      first(text ORDER BY turn) AS first_message FROM said GROUP BY key""", "said"))
def export_documents(spark, sf):
    c, n, steps = _built(spark, sf)
    steps = written(steps, "steps")  # for the documents and for their totals
    docs = E.export_documents(steps, T.session_heads(c, n), c)
    g = lambda p: F.get_json_object("document", p)
    return docs.select(
        _key(), g("$.final_metrics.total_steps").cast("bigint").alias("total_steps"),
        g("$.final_metrics.total_prompt_tokens").cast("bigint").alias("total_prompt_tokens"),
        g("$.final_metrics.total_cached_tokens").cast("bigint").alias("total_cached_tokens"),
        g("$.agent.name").alias("agent"), g("$.steps[0].message").alias("first_message"),
    )
