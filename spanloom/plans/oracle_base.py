"""SQL statements of the driver views, joined into WITH clauses by name."""

from __future__ import annotations

from ..operators.pricing import DEFAULT_PRICES

_prices = ", ".join(f"('{m}',{i},{o},{w},{r})" for m, i, o, w, r in DEFAULT_PRICES)
_model = "(['claude-sonnet-4-5-20250929','claude-3-5-haiku-latest','GPT-5.1-codex','gpt-4o-mini','mystery-1'])"
_agent = "(['claude','codex','gemini','devin'])"
_tools = (
    "CASE event_id % 7 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['Bash'] WHEN 2 THEN ['Read','Bash'] "
    "WHEN 3 THEN ['mcp__git__status'] WHEN 4 THEN ['Task'] WHEN 5 THEN ['Read'] ELSE ['mcp__db__query','Read'] END"
)
_project = "CASE WHEN user_id % 13 = 0 THEN '' ELSE '/work/p' || (user_id // 10) END"

CTES: dict[str, tuple[list[str], str]] = {
    "prices": ([], f"SELECT * FROM (VALUES {_prices}) v(pmodel, pin, pout, pcw, pcr)"),
    "reqs": ([], f"""
        SELECT 's' || user_id AS session_id, '/logs/f' || (user_id // 4) || '.jsonl' AS source_path,
          event_id AS line_no,
          CASE WHEN event_id % 211 = 0 THEN 0.0
               ELSE epoch_us(ts) / 1e6 - CASE WHEN event_id % 50 = 0 THEN 86400.0 ELSE 0.0 END END::DOUBLE AS ts,
          {_agent}[user_id % 4 + 1] AS agent, {_model}[event_id % 5 + 1] AS model,
          CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN NULL
               WHEN event_type = 'error' THEN 529 ELSE 200 END AS status,
          event_type = 'error' AS errored,
          CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN NULL
               ELSE CAST(floor(value * 100 + 0.5) AS BIGINT) END AS duration_ms,
          CASE WHEN event_type <> 'error' AND event_id % 3 <> 0
               THEN CAST(floor(CAST(floor(value * 100 + 0.5) AS BIGINT) / 4) AS BIGINT) END AS ttft_ms,
          (event_id * 37) % 900 + 100 AS prompt_tokens,
          CASE WHEN event_type = 'error' THEN 0 ELSE (event_id * 53) % 700 + 20 END AS completion_tokens,
          CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 0 ELSE (event_id * 97) % 40000 END AS cache_read,
          CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 0 ELSE (event_id * 29) % 3000 END AS cache_creation,
          CASE WHEN event_id % 5 = 2 THEN (event_id * 7) % 300 ELSE 0 END AS reasoning_tokens,
          CASE WHEN event_type = 'error' THEN ''
               ELSE (['end_turn','tool_use','max_tokens'])[event_id % 3 + 1] END AS stop_reason,
          (event_id * 31) % 40 + 1 AS transcript_items,
          CASE WHEN event_id % 17 = 0 THEN '' ELSE 'p' || ((user_id * 7 + event_id % 3) % 23) END AS prompt_hash,
          CASE WHEN event_id % 19 <> 0 THEN 't' || ((user_id + event_id % 2) % 6) END AS toolset_hash,
          event_id % 7 = 3 AS is_subagent,
          CASE WHEN event_id % 14 = 3 THEN 'review part ' || (event_id % 5) END AS agent_label,
          CASE WHEN event_id % 7 = 3 THEN (['general-purpose','code-reviewer'])[event_id % 2 + 1] END AS agent_type,
          CASE WHEN event_type = 'error' THEN CAST([] AS VARCHAR[]) ELSE {_tools} END AS tool_names,
          prompt_tokens + cache_read + cache_creation AS ctx, user_id
        FROM events"""),
    "reqseq": (["reqs"], "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) - 1 AS seq FROM reqs"),
    "usage": (["reqs", "resolved"], f"""
        SELECT r.session_id, line_no, r.ts, r.agent, {_model}[user_id % 5 + 1] AS model, {_project} AS project,
          prompt_tokens, completion_tokens, cache_read, cache_creation, reasoning_tokens, tool_names,
          (prompt_tokens*p.pin + completion_tokens*p.pout + cache_creation*p.pcw + cache_read*p.pcr) / 1e6 AS cost
        FROM reqs r LEFT JOIN resolved p ON p.model = {_model}[user_id % 5 + 1] WHERE NOT errored"""),
    "reqcost": (["reqs", "resolved"], """
        SELECT r.*, (prompt_tokens*p.pin + completion_tokens*p.pout + cache_creation*p.pcw + cache_read*p.pcr) / 1e6 AS cost
        FROM reqs r LEFT JOIN resolved p USING (model)"""),
    "resolved": (["prices"], f"""
        SELECT model, arg_max(pin, length(pmodel)) AS pin, arg_max(pout, length(pmodel)) AS pout,
               arg_max(pcw, length(pmodel)) AS pcw, arg_max(pcr, length(pmodel)) AS pcr
        FROM (SELECT unnest({_model}) AS model) m JOIN prices ON starts_with(lower(model), pmodel) GROUP BY model"""),
    "sess": (["usage"], f"""
        SELECT session_id, any_value(agent) AS agent, any_value(model) AS model, any_value(project) AS project,
          '/logs/f' || (CAST(substr(session_id, 2) AS BIGINT) // 4) || '.jsonl' AS source_path,
          CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 10 <> 0
               THEN 'c' || (CAST(substr(session_id, 2) AS BIGINT) // 3) END AS client_session_id,
          coalesce(min(CASE WHEN ts > 0 THEN ts END), 0) AS started_at,
          coalesce(max(CASE WHEN ts > 0 THEN ts END), 0) AS ended_at,
          CAST(sum(prompt_tokens) AS BIGINT) AS total_in_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_out_tokens,
          CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation,
          CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens,
          sum(cost) AS cost_usd, count(*) AS turns, CAST(sum(len(tool_names)) AS BIGINT) AS tool_calls
        FROM usage GROUP BY session_id"""),
    "toolcalls": (["usage"], """
        SELECT session_id, tool, count(*) AS calls
        FROM (SELECT session_id, unnest(tool_names) AS tool FROM usage) GROUP BY ALL"""),
    "bytime": (["reqseq"], """
        SELECT *, ts * 1000 + greatest(0, coalesce(duration_ms, 0)) AS end_ms, lag(seq) OVER w AS p_seq, lag(ts) OVER w AS p_ts,
          lag(transcript_items) OVER w AS p_items, lag(ctx) OVER w AS p_ctx, lag(cache_read) OVER w AS p_cache_read,
          lag(ts * 1000 + greatest(0, coalesce(duration_ms, 0))) OVER w AS p_end
        FROM reqseq WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)"""),
    "comps": (["bytime"], """
        SELECT * FROM bytime WHERE p_items > 0 AND transcript_items < p_items AND p_ctx - ctx >= 2000
          AND NOT (ts * 1000 < p_end AND p_ts * 1000 < end_ms)"""),
    "conv": ([], """
        SELECT conv_id, conv_id * 1000 AS key, turn, role, text, conv_id % 4 AS shape FROM conversations"""),
    "said": (["conv"], """
        SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn) AS step_index, max(turn) OVER (PARTITION BY key) AS last_turn,
          coalesce(sum(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY key ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq,
          coalesce(sum(CASE WHEN role = 'assistant' THEN 3 ELSE 1 END) OVER (PARTITION BY key ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS items_before,
          (key * 7 + turn) % 500 + 1 AS tin, (key * 3 + turn) % 90 + 1 AS tout, (key * 11 + turn) % 3000 AS tcr,
          CASE WHEN shape IN (0, 3) THEN (key * 5 + turn) % 400 ELSE 0 END AS tcc,
          (['claude-sonnet-4-5','gpt-5.1-codex','gemini-2.5-pro','claude-opus-4-1'])[shape + 1] AS model,
          (['claude','codex','gemini','devin'])[shape + 1] AS agent, 1704067200 + key * 100 + turn AS ts
        FROM conv WHERE role <> 'system'"""),
    "callrows": (["said"], """
        SELECT *, role = 'assistant' AS ok FROM said s WHERE role = 'assistant' OR turn = last_turn"""),
    "hooks": ([], """
        SELECT event_id AS hook_id,
          CASE WHEN user_id % 10 = 0 THEN 'x' || (user_id // 10) ELSE 'c' || (user_id // 3) END AS hook_session,
          epoch_us(ts) / 1e6 AS ts,
          (['PreToolUse','PostToolUse','PreCompact','Stop'])[event_id % 4 + 1] AS event,
          CASE WHEN (user_id // 10) % 2 = 1 AND user_id % 10 <> 0 THEN '/tmp/h' || user_id
               ELSE '/work/p' || (user_id // 10) END AS cwd,
          CASE event_id % 6 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS decision,
          CASE WHEN event_id % 6 = 0 THEN 'blocked' ELSE 'ok' END AS outcome,
          CASE event_id % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'auto' END AS trigger,
          event_id % 4 = 1 AS observe_only, 'payload ' || event_id AS payload
        FROM events WHERE event_type = 'signup'"""),
}


def sql(body: str, *names: str) -> str:
    """Prefix ``body`` with the named statements and whatever they need, in order."""
    done: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0]:
            add(d)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} AS ({CTES[n][1].strip()})" for n in done)
    return f"WITH {ctes} {body.strip()}" if ctes else body.strip()
