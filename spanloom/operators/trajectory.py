"""Conversations and steps rebuilt from calls that resend their whole transcript.

Input is the frame of ``normalize_pairs`` (best read from a table it was written
to, as several branches use it).  A call contributes only the user messages and
tool results beyond those its session has shown before.  That comparison needs the
counts alone, so the ordered work runs on narrow rows; texts are shuffled once,
after the resent ones are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import CHUNK_ROWS, running
from ..functions.text import half_up, sha
from .pricing import with_cost

CALL = ["source_path", "block_start", "row_id"]
SESSION = ["source_path", "session_id"]

# Fixed value: words that mark a failed tool result.
ERROR_WORDS = (
    r"(?i)\b(error|errors|errored|exception|traceback|failed|failure|fatal|not found|no such file|"
    r"permission denied|denied|timed out|timeout|ENOENT|EACCES|ECONNREFUSED|ETIMEDOUT|stderr)\b"
)


def looks_errored(text: Column) -> Column:
    return (F.length(text) > 0) & text.rlike(ERROR_WORDS)


def _seq_chunk() -> Column:
    return F.floor(F.col("seq") / F.lit(CHUNK_ROWS))


def number_calls(calls: DataFrame) -> DataFrame:
    """Per call: seq within its session, and what earlier calls had already shown.

    user_cursor / result_cursor  user messages and tool results seen before
    agent_seq                    latest earlier call that produced an agent step
    """
    narrow = calls.selectExpr(
        *CALL, "session_id",
        "size(filter(req_items, x -> x.kind = 'message' and x.role = 'user')) as n_user",
        "size(filter(req_items, x -> x.kind = 'tool_result')) as n_result",
        "size(resp_items) > 0 or usage is not null as produced",
    )
    r = running(narrow, SESSION, F.col("block_start"), ["row_id"], number="seq")
    r = running(
        r, SESSION, _seq_chunk(), ["seq"],
        prev_max={
            "user_cursor": F.col("n_user"), "result_cursor": F.col("n_result"),
            "agent_seq": F.when(F.col("produced"), F.col("seq")),
        },
    )
    zero = F.lit(0)
    return r.withColumn("user_cursor", F.coalesce("user_cursor", zero)).withColumn(
        "result_cursor", F.coalesce("result_cursor", zero)
    )


def _drop_resent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out items an earlier call of the same partition has shown.

    A partial, map-side form of the cursor rule: rows arrive in file order, so the
    rule applied to a part of the log never drops a first showing.
    """
    state: dict[tuple, list] = {}  # (file, session, kind) -> [call, shown before it, shown by it]
    for b in batches:
        cols = [b.column(c).to_pylist() for c in (*SESSION, "block_start", "row_id", "is_result", "ordinal")]
        mask = []
        for src, ses, block, row, kind, n in zip(*cols):
            s = state.setdefault((src, ses, kind), [None, 0, 0])
            call = (block, row)
            if s[0] is None or call > s[0]:
                s[0], s[1], s[2] = call, max(s[1], s[2]), 0
            if call == s[0]:
                s[2] = max(s[2], n)
                mask.append(n > s[1])
            else:  # out of file order: leave it to the full rule
                mask.append(True)
        yield b.filter(pa.array(mask))


def new_items(calls: DataFrame, numbered: DataFrame) -> DataFrame:
    """First showings of user messages and tool results, with the seq showing them."""
    items = calls.selectExpr(
        *CALL, "session_id",
        "explode(concat("
        "transform(filter(req_items, x -> x.kind = 'message' and x.role = 'user'), "
        "(x, i) -> struct(false as is_result, i + 1 as ordinal, x.text as text, x.call_id as call_id)), "
        "transform(filter(req_items, x -> x.kind = 'tool_result'), "
        "(x, i) -> struct(true as is_result, i + 1 as ordinal, x.text as text, x.call_id as call_id)))) as it",
    ).select(*CALL, "session_id", "it.*")
    items = items.mapInArrow(_drop_resent, items.schema)
    place = numbered.select(*CALL, "seq", "user_cursor", "result_cursor", "agent_seq")
    cursor = F.when(F.col("is_result"), F.col("result_cursor")).otherwise(F.col("user_cursor"))
    return items.join(place, CALL).where(F.col("ordinal") > cursor)


def agent_steps(calls: DataFrame, numbered: DataFrame) -> DataFrame:
    """One agent step per call whose answer has items or usage."""
    said = "filter(resp_items, x -> x.kind = '{}'{})"
    a = calls.where("size(resp_items) > 0 or usage is not null").selectExpr(
        *CALL, "session_id", "ts",
        "array_join(transform({}, x -> x.text), '') as message".format(said.format("message", " and x.role = 'assistant'")),
        "array_join(transform({}, x -> x.text), '') as reasoning".format(said.format("reasoning", "")),
        "{} as tool_calls".format(
            f"transform({said.format('tool_call', '')}, x -> named_struct('id', x.call_id, 'name', x.name, 'args', x.args))"
        ),
        "usage",
    )
    return a.join(numbered.select(*CALL, "seq"), CALL).drop("block_start", "row_id")


def stitch_results(results: DataFrame, agents: DataFrame) -> DataFrame:
    """The step each result belongs to: the latest earlier one that issued its call
    id, else the latest earlier agent step; a result before any is dropped."""
    issued = agents.select(*SESSION, "seq", F.explode("tool_calls").alias("c")).where("c.id <> ''").select(
        *SESSION, "seq", F.col("c.id").alias("call_id"), F.lit(1).alias("is_call"), F.lit(0).alias("ordinal"),
    )
    got = results.select(
        *SESSION, "seq", F.coalesce("call_id", F.lit("")).alias("call_id"), F.lit(0).alias("is_call"),
        "ordinal", "text", "agent_seq",
    )
    u = got.unionByName(issued, allowMissingColumns=True)
    # A call is known only to results of later calls, hence results first at one seq.
    u = running(
        u, [*SESSION, "call_id"], _seq_chunk(), ["seq", "is_call", "ordinal"],
        last={"issued_seq": F.when(F.col("is_call") == 1, F.col("seq"))},
    )
    target = F.coalesce(F.when(F.col("call_id") != "", F.col("issued_seq")), F.col("agent_seq"))
    return u.where("is_call = 0").withColumn("step_seq", target).where("step_seq is not null").select(
        *SESSION, "step_seq", "seq", "ordinal", "call_id", "text"
    )


def build_steps(calls: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """All steps of all sessions, numbered from 1 in the order they came about."""
    numbered = number_calls(calls) if numbered is None else numbered
    items = new_items(calls, numbered)
    users = items.where("not is_result").where(F.col("text").rlike(r"(?U)\S"))
    ts = calls.select(*CALL, "ts")
    users = users.join(ts, CALL).select(
        *SESSION, "seq", F.lit(0).alias("is_agent"), "ordinal", F.lit("user").alias("role"),
        F.col("text").alias("message"), "ts",
    )
    agents = agent_steps(calls, numbered)
    placed = stitch_results(items.where("is_result"), agents)
    observed = placed.groupBy(*SESSION, F.col("step_seq").alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("seq").alias("at"), "ordinal", "call_id", "text"))).alias("results")
    )
    agents = agents.join(observed, [*SESSION, "seq"], "left").select(
        *SESSION, "seq", F.lit(1).alias("is_agent"), F.lit(0).alias("ordinal"), F.lit("agent").alias("role"),
        "message", "reasoning", "tool_calls", "usage", "results", "ts",
    )
    steps = users.unionByName(agents, allowMissingColumns=True)
    steps = running(steps, SESSION, _seq_chunk(), ["seq", "is_agent", "ordinal"], number="_n")
    observation = "array_join(transform(filter(results, x -> x.text <> ''), x -> x.text), '\\n')"
    return steps.selectExpr(
        *SESSION, "seq", "cast(_n + 1 as bigint) as step_index", "role", "coalesce(message, '') as message",
        "coalesce(reasoning, '') as reasoning", "tool_calls",
        "coalesce(transform(filter(tool_calls, x -> x.name <> ''), x -> x.name), cast(array() as array<string>)) as tool_names",
        "coalesce(transform(filter(tool_calls, x -> x.args <> ''), x -> x.args), cast(array() as array<string>)) as tool_inputs",
        "results", f"coalesce({observation}, '') as observation", "usage is not null as has_usage", "usage.*", "ts",
    ).withColumn("errored", looks_errored(F.col("observation")))


def step_texts(steps: DataFrame) -> DataFrame:
    """The searchable text row of each step, lists joined as they are shown."""
    return steps.select(
        *SESSION, "step_index", "role", "message", "reasoning",
        F.array_join("tool_names", " ").alias("tool_name"), F.array_join("tool_inputs", "\n").alias("tool_input"),
        "observation", "errored",
    )


# Fixed value: header that carries the client's own session id.
CLIENT_HEADER = "x-claude-code-session-id"


def client_ids(calls: DataFrame, numbered: DataFrame) -> DataFrame:
    """Client session id per session: carried by most calls, ties to the first seen."""
    ids = calls.select(
        *CALL, "session_id",
        F.explode(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == CLIENT_HEADER))).alias("v"),
    ).select(*CALL, "session_id", F.trim("v").alias("client_session_id"))
    ids = ids.where(F.col("client_session_id").rlike("^[0-9a-fA-F-]{36}$")).join(numbered.select(*CALL, "seq"), CALL)
    n = ids.groupBy(*SESSION, "client_session_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return n.groupBy(*SESSION).agg(
        F.max_by("client_session_id", F.struct("n", -F.col("first"))).alias("client_session_id")
    )


def build_requests(calls: DataFrame, numbered: DataFrame, steps: DataFrame) -> DataFrame:
    """One wire-metrics row per call, linked to the agent step it produced."""
    made = steps.where("role = 'agent'").select(*SESSION, "seq", F.col("step_index").alias("agent_step_index"), "tool_names")
    ms = lambda end: F.when(
        end.isNotNull() & (F.col("ts") > 0) & (end >= F.col("ts")), half_up((end - F.col("ts")) * 1000)
    )
    status = F.when(F.col("answered"), F.coalesce("status_code", F.lit(0)))
    z = lambda f: F.coalesce(F.col("usage")[f], F.lit(0)).alias(f)
    r = calls.select(
        *CALL, "session_id", "provider", "ts", "req_model", "headers",
        F.coalesce("resp_model", "req_model").alias("model"), status.alias("status"),
        ms(F.col("resp_ts")).alias("duration_ms"), ms(F.col("first_byte_ts")).alias("ttft_ms"),
        z("prompt_tokens"), z("completion_tokens"), z("cache_read"), z("cache_creation"), z("reasoning_tokens"),
        F.coalesce("stop_reason", F.lit("")).alias("stop_reason"),
        (~F.col("answered") | (status >= 400)).alias("errored"),
        F.size("req_items").cast("bigint").alias("transcript_items"),
        F.coalesce(sha(F.col("prompt_text")), F.lit("")).alias("prompt_hash"),
    )
    r = r.join(numbered.select(*CALL, "seq"), CALL)
    return r.join(made, [*SESSION, "seq"], "left").withColumn(
        "tool_names", F.coalesce("tool_names", F.array().cast("array<string>"))
    )


def session_heads(calls: DataFrame, numbered: DataFrame) -> DataFrame:
    """Agent and model per session: those of its last call's request."""
    c = calls.select(*CALL, "session_id", "provider", "req_model").join(numbered.select(*CALL, "seq"), CALL)
    return c.groupBy(*SESSION).agg(
        F.max_by("provider", "seq").alias("agent"), F.max_by("req_model", "seq").alias("model")
    )


def build_usage_events(steps: DataFrame, heads: DataFrame, prices: DataFrame) -> DataFrame:
    """One event per agent step with usage, priced by the session's model."""
    e = steps.where("role = 'agent' and has_usage").join(heads, SESSION)
    return with_cost(e, prices).select(
        F.when(F.col("ts") > 0, F.col("ts")).alias("ts"), *SESSION, "step_index", "agent", "model",
        "prompt_tokens", "completion_tokens", "cache_read", "cache_creation",
        F.coalesce("reasoning_tokens", F.lit(0)).alias("reasoning_tokens"), F.col("cost").alias("cost_usd"),
    )


def prompt_registry(calls: DataFrame) -> DataFrame:
    """Distinct system prompts with first and last known use and use counts."""
    known = F.when(F.col("ts") > 0, F.col("ts"))
    return calls.where("prompt_text is not null").groupBy(sha(F.col("prompt_text")).alias("prompt_hash")).agg(
        F.min_by("provider", F.struct("source_path", "block_start", "row_id")).alias("agent"),
        F.any_value("prompt_text").alias("content"),
        F.min(known).alias("first_seen"), F.max(known).alias("last_seen"),
        F.count(F.lit(1)).alias("requests"), F.countDistinct("session_id").alias("sessions"),
    )


# -- digest ------------------------------------------------------------------

CUT_MARK = "\n\n…[trajectory truncated]…\n\n"


def _short(x: str, n: int | None) -> str:
    flat = f"trim(regexp_replace({x}, '(?U)\\\\s+', ' '))"
    return flat if n is None else f"if(length({flat}) <= {n}, {flat}, concat(substring({flat}, 1, {n}), '…'))"


def digest(
    steps: DataFrame, heads: DataFrame, *, step_chars: int | None = None, arg_chars: int | None = None,
    result_chars: int | None = None, chars: int | None = None, head_chars: int = 0, tail_chars: int = 0,
) -> DataFrame:
    """Plain-text digest per session.

    Whole by default.  ``step_chars``, ``arg_chars`` and ``result_chars`` shorten its
    lines; beyond ``chars`` it is its first ``head_chars`` and last ``tail_chars``
    around a mark, and only steps that reach into these are brought together.
    """
    msg = _short("message", step_chars)
    none = "cast(array() as array<string>)"
    args, result = _short("coalesce(t.args, '{}')", arg_chars), _short("r.text", result_chars)
    lines = (
        f"case role when 'user' then if({msg} = '', {none}, array(concat('USER: ', {msg}))) "
        f"when 'agent' then concat(if({msg} = '', {none}, array(concat('AGENT: ', {msg}))), "
        f"coalesce(transform(tool_calls, t -> concat('  TOOL ', t.name, '(', {args}, ')')), {none}), "
        f"coalesce(transform(filter(results, r -> {result} <> ''), r -> concat('    -> ', {result})), {none})) "
        f"else {none} end"
    )
    s = steps.selectExpr(*SESSION, "step_index", f"array_join({lines}, '\\n') as part").where("part <> ''")
    head = heads.withColumn("head", F.concat(F.lit("## Session — "), "agent", F.lit(" ("), "model", F.lit(")")))
    joined = lambda keep: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("step_index", "part")))), lambda x: x["part"]), "\n"
    )
    if chars is None:
        whole = s.groupBy(*SESSION).agg(joined(F.lit(True)).alias("body"))
        return head.join(whole, SESSION, "left").select(*SESSION, F.concat_ws("\n", "head", "body").alias("digest"))
    s = s.withColumn("n", F.length("part") + 1)
    s = running(s, SESSION, F.floor(F.col("step_index") / F.lit(CHUNK_ROWS)), ["step_index"], sums={"upto": F.col("n")})
    total = s.groupBy(*SESSION).agg(F.sum("n").alias("body_chars"))
    s = s.join(total, SESSION)
    fits = F.col("body_chars") <= chars
    opens, ends = F.col("upto") - F.col("n") < head_chars, F.col("upto") > F.col("body_chars") - tail_chars - 1
    texts = s.where(fits | opens | ends).groupBy(*SESSION).agg(
        F.max("body_chars").alias("body_chars"), joined(fits | opens).alias("first"), joined(fits | ends).alias("end"),
    )
    d = head.join(texts, SESSION, "left")
    size = F.length("head") + F.coalesce("body_chars", F.lit(0))
    whole = F.concat_ws("\n", "head", "first")
    cut = F.concat(F.left(whole, F.lit(head_chars)), F.lit(CUT_MARK), F.right("end", F.lit(tail_chars)))
    # Between the limits of body and whole the whole text is at hand in ``first``.
    in_hand = F.coalesce("body_chars", F.lit(0)) <= chars
    tail_whole = F.concat(F.left(whole, F.lit(head_chars)), F.lit(CUT_MARK), F.right(whole, F.lit(tail_chars)))
    text = F.when(size <= chars, whole).when(in_hand, tail_whole).otherwise(cut)
    return d.select(*SESSION, text.alias("digest"))
