"""The trace tables derived from the driver's parquet files.

Integer arithmetic on ids stands in for wire metrics, so that the oracle can
state the same tables in SQL (``oracle_base``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scan import running, time_chunk
from ..operators import pricing, sessions as sess
from ..operators.normalize import normalize_pairs
from ..session import written
from ..sources.pairs import parse_pairs

MODELS = ["claude-sonnet-4-5-20250929", "claude-3-5-haiku-latest", "GPT-5.1-codex", "gpt-4o-mini", "mystery-1"]
AGENTS = ["claude", "codex", "gemini", "devin"]
TOOLS = [[], ["Bash"], ["Read", "Bash"], ["mcp__git__status"], ["Task"], ["Read"], ["mcp__db__query", "Read"]]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_MODEL = "element_at(array({}), cast({{}} % 5 + 1 as int))".format(", ".join(f"'{m}'" for m in MODELS))
_AGENT = "element_at(array({}), cast(user_id % 4 + 1 as int))".format(", ".join(f"'{a}'" for a in AGENTS))
_PROJECT = "if(user_id % 13 = 0, '', concat('/work/p', user_id div 10))"
_SOURCE = "concat('/logs/f', user_id div 4, '.jsonl')"
_TS = "unix_micros(cast(ts as timestamp)) / 1e6D"
_TOOLS = "case event_id % 7 {} end".format(
    " ".join(
        "when {} then {}".format(k, "array({})".format(", ".join(f"'{n}'" for n in names)) if names else "cast(array() as array<string>)")
        for k, names in enumerate(TOOLS)
    )
)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One wire request per event; ``line_no`` is the capture order."""
    base = table(spark, sf, "events").selectExpr(
        "*", "event_id as i", "event_type = 'error' as err",
        "event_type = 'error' and event_id % 2 = 1 as lost",
        "event_type = 'error' and event_id % 4 = 0 as idle",
        "cast(floor(value * 100 + 0.5D) as bigint) as ms",
    )
    return base.selectExpr(
        "concat('s', user_id) as session_id",
        f"{_SOURCE} as source_path",
        "i as line_no",
        f"if(i % 211 = 0, 0.0D, {_TS} - if(i % 50 = 0, 86400.0D, 0.0D)) as ts",
        f"{_AGENT} as agent",
        f"{_MODEL.format('i')} as model",
        "if(lost, null, if(err, 529, 200)) as status",
        "err as errored",
        "if(lost, null, ms) as duration_ms",
        "if(not err and i % 3 <> 0, cast(floor(ms / 4) as bigint), null) as ttft_ms",
        "(i * 37) % 900 + 100 as prompt_tokens",
        "if(err, 0L, (i * 53) % 700 + 20) as completion_tokens",
        "if(idle, 0L, (i * 97) % 40000) as cache_read",
        "if(idle, 0L, (i * 29) % 3000) as cache_creation",
        "if(i % 5 = 2, (i * 7) % 300, 0L) as reasoning_tokens",
        "if(err, '', element_at(array('end_turn', 'tool_use', 'max_tokens'), cast(i % 3 + 1 as int))) as stop_reason",
        "(i * 31) % 40 + 1 as transcript_items",
        "if(i % 17 = 0, '', concat('p', (user_id * 7 + i % 3) % 23)) as prompt_hash",
        "if(i % 19 <> 0, concat('t', (user_id + i % 2) % 6), null) as toolset_hash",
        "i % 7 = 3 as is_subagent",
        "if(i % 14 = 3, concat('review part ', i % 5), null) as agent_label",
        "if(i % 7 = 3, element_at(array('general-purpose', 'code-reviewer'), cast(i % 2 + 1 as int)), null) as agent_type",
        f"if(err, cast(array() as array<string>), {_TOOLS}) as tool_names",
        "user_id",
    )


def with_seq(req: DataFrame) -> DataFrame:
    """Capture order within the session, dense from 0."""
    return running(
        req, ["session_id"], F.floor(F.col("line_no") / F.lit(1 << 20)), ["line_no"], number="seq"
    )


def session_dims(spark: SparkSession, sf: str) -> DataFrame:
    """Session attributes that do not come from its requests."""
    return table(spark, sf, "events").select("user_id").distinct().selectExpr(
        "concat('s', user_id) as session_id",
        f"{_AGENT} as agent",
        f"{_MODEL.format('user_id')} as model",
        f"{_PROJECT} as project",
        f"{_SOURCE} as source_path",
        "if(user_id % 10 <> 0, concat('c', user_id div 3), null) as client_session_id",
    )


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of answered calls, under the session's model and project."""
    return requests(spark, sf).where("not errored").selectExpr(
        "session_id", "line_no", "ts", "agent",
        f"{_MODEL.format('user_id')} as model",
        f"{_PROJECT} as project",
        "prompt_tokens", "completion_tokens", "cache_read", "cache_creation", "reasoning_tokens", "tool_names",
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session rows rolled up from the answered calls."""
    steps = usage_events(spark, sf).select(
        "session_id", "ts", F.lit("agent").alias("role"), "tool_names",
        "prompt_tokens", "completion_tokens", "cache_read", "cache_creation", "reasoning_tokens",
    )
    rolled = sess.session_rollup(steps)
    return sess.session_rows(rolled, session_dims(spark, sf), pricing.default_prices(spark))


def session_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with what hook attribution needs, from one aggregate."""
    u = requests(spark, sf).where("not errored").groupBy("user_id").agg(
        F.expr("coalesce(min(if(ts > 0, ts, null)), 0.0D)").alias("started_at"),
        F.expr("coalesce(max(if(ts > 0, ts, null)), 0.0D)").alias("ended_at"),
    )
    return u.selectExpr(
        "concat('s', user_id) as session_id", f"{_PROJECT} as project", "started_at", "ended_at",
        "if(user_id % 10 <> 0, concat('c', user_id div 3), null) as client_session_id",
    )


def shown_hooks(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.hooks import session_hooks

    return session_hooks(session_spans(spark, sf), requests(spark, sf), hooks(spark, sf))


def hook_places(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.hooks import hook_places

    return hook_places(session_spans(spark, sf), requests(spark, sf), hooks(spark, sf))


def hooks(spark: SparkSession, sf: str) -> DataFrame:
    """Hook events from sign-ups, keyed by the client session id of the user."""
    return table(spark, sf, "events").where("event_type = 'signup'").selectExpr(
        "event_id as hook_id",
        "if(user_id % 10 = 0, concat('x', user_id div 10), concat('c', user_id div 3)) as hook_session",
        f"{_TS} as ts",
        "element_at(array('PreToolUse', 'PostToolUse', 'PreCompact', 'Stop'), cast(event_id % 4 + 1 as int)) as event",
        "concat(if(user_id div 10 % 2 = 1 and user_id % 10 <> 0, concat('/tmp/h', user_id), "
        "concat('/work/p', user_id div 10)), if(event_id % 3 = 0, '/', '')) as cwd",
        "case event_id % 6 when 0 then 'block' when 1 then 'allow' end as decision",
        "if(event_id % 6 = 0, 'blocked', 'ok') as outcome",
        "case event_id % 5 when 0 then 'manual' when 1 then 'auto' end as trigger",
        "event_id % 4 = 1 as observe_only",
        "concat('payload ', event_id) as payload",
    )


def prices(spark: SparkSession) -> DataFrame:
    return pricing.default_prices(spark)


def time_chunk_of(ts: str = "ts", seq: str | None = None) -> Column:
    return time_chunk(F.col(ts), F.col(seq) if seq else None)


# -- captured pairs from the conversations table -------------------------------


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns; a conversation is one captured session."""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "conv_id * 1000 as key", "turn", "role", "text", "conv_id % 4 as shape"
    )


def pair_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Captured lines in the four wire shapes, each resending its transcript.

    Every assistant turn is a call; a turn of its tool ``Read`` follows it in later
    transcripts.  Turns after the last assistant turn form a call without answer.
    """
    t = turns(spark, sf)
    w = Window.partitionBy("key").orderBy("turn")
    t = t.withColumn("sys", F.max(F.expr("if(role = 'system', text, '')")).over(Window.partitionBy("key")))
    t = t.withColumn("last_asst", F.max(F.expr("if(role = 'assistant', turn, -1)")).over(Window.partitionBy("key")))
    t = t.withColumn("last_turn", F.max("turn").over(Window.partitionBy("key")))
    # Every call resends its conversation, so a line is as long as that is.
    t = t.withColumn(
        "hist", F.collect_list(F.expr("if(role <> 'system', struct(turn, role, text), null)")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    t = t.where("role = 'assistant' or (role <> 'system' and turn = last_turn and last_asst < turn)")
    asst = "role = 'assistant'"
    q = t.selectExpr(
        "*", f"if({asst}, filter(hist, h -> h.turn < turn), hist) as h",
        "1704067200D + key * 100 + turn as ts", f"{asst} as ok",
        "concat('conv ', key, ': ', sys) as sysp",
        "(key * 7 + turn) % 500 + 1 as tin", "(key * 3 + turn) % 90 + 1 as tout",
        "(key * 11 + turn) % 3000 as tcr", "(key * 5 + turn) % 400 as tcc",
        "concat('c', key, '-', turn) as cid", "concat('{\"path\":\"f', turn, '\"}') as args",
    )
    call = "concat('c', key, '-', x.turn)"
    arg = "concat('f', x.turn)"
    # The tool result of an assistant turn is sent right before what comes after it.
    a = (
        "transform(h, x -> if(x.role = 'assistant', "
        f"concat('{{\"role\":\"assistant\",\"content\":', to_json(array(named_struct('type', 'text', 'text', x.text))), '}},"
        f"{{\"role\":\"assistant\",\"content\":[{{\"type\":\"tool_use\",\"id\":\"', {call}, '\",\"name\":\"Read\",\"input\":{{\"path\":\"', {arg}, '\"}}}}]}},"
        f"{{\"role\":\"user\",\"content\":[{{\"type\":\"tool_result\",\"tool_use_id\":\"', {call}, '\",\"content\":\"ok ', x.turn, '\"}}]}}'), "
        "to_json(named_struct('role', 'user', 'content', x.text))))"
    )
    b = (
        "transform(h, x -> if(x.role = 'assistant', "
        "concat(to_json(named_struct('type', 'message', 'role', 'assistant', 'content', array(named_struct('type', 'output_text', 'text', x.text)))), "
        f"',{{\"type\":\"function_call\",\"call_id\":\"', {call}, '\",\"name\":\"Read\",\"arguments\":\"{{\\\\\"path\\\\\": \\\\\"', {arg}, '\\\\\"}}\"}},"
        f"{{\"type\":\"function_call_output\",\"call_id\":\"', {call}, '\",\"output\":\"ok ', x.turn, '\"}}'), "
        "to_json(named_struct('type', 'message', 'role', 'user', 'content', array(named_struct('type', 'input_text', 'text', x.text))))))"
    )
    c = (
        "transform(h, x -> if(x.role = 'assistant', "
        "concat('{\"role\":\"model\",\"parts\":[', to_json(named_struct('text', x.text)), "
        f"',{{\"functionCall\":{{\"id\":\"', {call}, '\",\"name\":\"Read\",\"args\":{{\"path\":\"', {arg}, '\"}}}}}}]}},"
        f"{{\"role\":\"user\",\"parts\":[{{\"functionResponse\":{{\"id\":\"', {call}, '\",\"name\":\"Read\",\"response\":{{\"output\":\"ok ', x.turn, '\"}}}}}}]}}'), "
        "concat('{\"role\":\"user\",\"parts\":[', to_json(named_struct('text', x.text)), ']}')))"
    )
    d = (
        "transform(h, x -> if(x.role = 'assistant', "
        "concat('{\"role\":\"assistant\",\"content\":', to_json(x.text), "
        f"',\"tool_calls\":[{{\"id\":\"', {call}, '\",\"name\":\"Read\",\"arguments\":{{\"path\":\"', {arg}, '\"}}}}]}},"
        f"{{\"role\":\"tool\",\"tool_call_id\":\"', {call}, '\",\"content\":\"ok ', x.turn, '\"}}'), "
        "to_json(named_struct('role', 'user', 'content', x.text))))"
    ).replace("to_json(x.text)", "substring(to_json(named_struct('t', x.text)), 6, length(to_json(named_struct('t', x.text))) - 6)")
    model = "element_at(array('claude-sonnet-4-5', 'gpt-5.1-codex', 'gemini-2.5-pro', 'claude-opus-4-1'), cast(shape + 1 as int))"
    tools = (
        "'[{\"name\":\"Read\",\"description\":\"read a file\",\"input_schema\":{\"type\":\"object\"}},"
        "{\"name\":\"Write\",\"description\":\"write a file\",\"input_schema\":{}}]'"
    )
    js = lambda e: f"substring(to_json(named_struct('t', {e})), 6, length(to_json(named_struct('t', {e}))) - 6)"
    body = (
        "case shape "
        f"when 0 then concat('{{\"model\":\"', {model}, '\",\"system\":', {js('sysp')}, ',\"tools\":', {tools}, ',\"messages\":[', array_join({a}, ','), ']}}') "
        f"when 1 then concat('{{\"model\":\"', {model}, '\",\"prompt_cache_key\":\"k', key, '\",\"instructions\":', {js('sysp')}, ',\"input\":[', array_join({b}, ','), ']}}') "
        f"when 2 then concat('{{\"systemInstruction\":{{\"parts\":[{{\"text\":', {js('sysp')}, '}}]}},\"contents\":[', array_join({c}, ','), ']}}') "
        f"else concat('{{\"provider\":\"devin\",\"session_id\":\"', key, '\",\"model\":\"', {model}, '\",\"system\":', {js('sysp')}, ',\"transcript\":[', array_join({d}, ','), ']}}') end"
    )
    half = "cast(length(text) / 2 as int)"
    first, rest = f"substring(text, 1, {half})", f"substring(text, {half} + 1, length(text))"
    ev = lambda s: f"concat('data: ', {s}, '\\n\\n')"
    sse_a = "concat(" + ", ".join([
        ev(f"concat('{{\"type\":\"message_start\",\"message\":{{\"model\":\"', {model}, '\",\"usage\":{{\"input_tokens\":', tin, ',\"cache_creation_input_tokens\":', tcc, ',\"cache_read_input_tokens\":', tcr, ',\"output_tokens\":1}}}}}}')"),
        ev("'{\"type\":\"content_block_start\",\"index\":0,\"content_block\":{\"type\":\"text\",\"text\":\"\"}}'"),
        ev(f"concat('{{\"type\":\"content_block_delta\",\"index\":0,\"delta\":{{\"type\":\"text_delta\",\"text\":', {js(first)}, '}}}}')"),
        ev(f"concat('{{\"type\":\"content_block_delta\",\"index\":0,\"delta\":{{\"type\":\"text_delta\",\"text\":', {js(rest)}, '}}}}')"),
        ev("concat('{\"type\":\"content_block_start\",\"index\":1,\"content_block\":{\"type\":\"tool_use\",\"id\":\"', cid, '\",\"name\":\"Read\",\"input\":{}}}')"),
        ev("concat('{\"type\":\"content_block_delta\",\"index\":1,\"delta\":{\"type\":\"input_json_delta\",\"partial_json\":\"{\\\\\"path\\\\\": \\\\\"f', turn, '\\\\\"}\"}}')"),
        ev("concat('{\"type\":\"message_delta\",\"delta\":{\"stop_reason\":\"tool_use\"},\"usage\":{\"output_tokens\":', tout, '}}')"),
    ]) + ")"
    out_b = f"concat('[{{\"type\":\"message\",\"role\":\"assistant\",\"content\":[{{\"type\":\"output_text\",\"text\":', {js('text')}, '}}]}},{{\"type\":\"function_call\",\"call_id\":\"', cid, '\",\"name\":\"Read\",\"arguments\":', {js('args')}, '}}]')"
    sse_b = (
        f"concat('event: response.completed\\ndata: {{\"type\":\"response.completed\",\"response\":{{\"model\":\"', {model}, '\",\"status\":\"completed\",\"output\":', {out_b}, "
        "',\"usage\":{\"input_tokens\":', tin, ',\"output_tokens\":', tout, ',\"input_tokens_details\":{\"cached_tokens\":', tcr, '}}}}\\n\\n')"
    )
    body_c = (
        f"concat('[{{\"candidates\":[{{\"content\":{{\"parts\":[{{\"text\":', {js(first)}, '}}]}}}}]}},{{\"candidates\":[{{\"finishReason\":\"STOP\",\"content\":{{\"parts\":[{{\"text\":', {js(rest)}, "
        "'},{\"functionCall\":{\"id\":\"', cid, '\",\"name\":\"Read\",\"args\":', args, '}}]}}],\"usageMetadata\":{\"promptTokenCount\":', tin, ',\"candidatesTokenCount\":', tout, ',\"cachedContentTokenCount\":', tcr, '}}]')"
    )
    body_d = (
        f"concat('{{\"provider\":\"devin\",\"model\":\"', {model}, '\",\"finish_reason\":\"stop\",\"message\":{{\"role\":\"assistant\",\"content\":', {js('text')}, "
        "',\"tool_calls\":[{\"id\":\"', cid, '\",\"name\":\"Read\",\"arguments\":', args, '}]},\"usage\":{\"input_tokens\":', tin, ',\"output_tokens\":', tout, ',\"cache_read_tokens\":', tcr, ',\"cache_creation_tokens\":', tcc, '}}')"
    )
    response = (
        "if(not ok, 'null', concat('{\"timestamp\":', ts + 2.5D, ',\"first_byte_timestamp\":', ts + 0.25D, ',\"status_code\":200,\"headers\":{},', "
        f"case shape when 0 then concat('\"body_raw\":', {js(sse_a)}) when 1 then concat('\"body_raw\":', {js(sse_b)}) "
        f"when 2 then concat('\"body\":', {body_c}) else concat('\"body\":', {body_d}) end, '}}'))"
    )
    url = "element_at(array('https://a/v1/messages', 'https://b/v1/responses', 'https://c/v1beta/models/gemini-2.5-pro:streamGenerateContent', 'devin://session'), cast(shape + 1 as int))"
    q = q.withColumn("body_text", F.expr(body)).withColumn("resp_text", F.expr(response))
    line = (
        f"concat('{{\"request\":{{\"timestamp\":', ts, ',\"method\":\"POST\",\"url\":\"', {url}, '\",\"headers\":{{}},\"body\":', body_text, '}},\"response\":', resp_text, '}}')"
    )
    return q.selectExpr(
        f"{line} as value", "concat('/work/w', key % 50, '/.claude-trace/', key, '.jsonl') as source_path",
        "0L as block_start", "turn as row_id",
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """The calls table, written once as the ingest does; later branches read columns of it."""
    lines = pair_lines(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_path")
    lines = lines.sortWithinPartitions("source_path", "block_start", "row_id")
    return written(normalize_pairs(parse_pairs(lines)), "calls")
