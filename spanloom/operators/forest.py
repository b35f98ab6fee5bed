"""Imported sessions: message trees, their active chain, and the steps on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import CHUNK_ROWS, running
from ..session import cut_lineage
from .sessions import majority


def ms_to_sec(c: Column) -> Column:
    """Whole milliseconds (or already seconds) to seconds; 0 when absent."""
    v = F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(v <= 0, F.lit(0.0)).when(v > 1e11, v / 1000).otherwise(v)


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that are not hidden, most recently active first."""
    s = sessions.where(F.coalesce("hidden", F.lit(0)) == 0)
    return s.withColumn("created_at", ms_to_sec(F.col("created_at"))).withColumn(
        "last_activity_at", ms_to_sec(F.col("last_activity_at"))
    ).orderBy(F.desc("last_activity_at"))


def readable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose message parses, opened into columns."""
    msg = (
        "role string, content string, tool_call_id string, "
        "tool_calls array<struct<id string, name string, arguments string>>, "
        "metadata struct<generation_model string, finish_reason string, created_at string, started_generation_at string, "
        "metrics struct<input_tokens double, output_tokens double, cache_read_tokens double, cache_creation_tokens double, ttft_ms double>>"
    )
    n = nodes.where(F.try_parse_json("chat_message").isNotNull()).withColumn("m", F.from_json("chat_message", msg))
    return n.select(
        "session_id", "node_id", "parent_node_id", ms_to_sec(F.col("created_at")).alias("created_at"),
        "m.*", F.from_json("chat_message", "content array<string>")["content"].alias("content_parts"),
    )


def fallback_leaf(nodes: DataFrame) -> DataFrame:
    """Newest childless node per session, ties by id; without one the highest id."""
    parents = nodes.where("parent_node_id is not null").select("session_id", F.col("parent_node_id").alias("node_id")).distinct()
    leaves = nodes.join(parents, ["session_id", "node_id"], "left_anti")
    newest = leaves.groupBy("session_id").agg(F.max_by("node_id", F.struct("created_at", "node_id")).alias("leaf"))
    top = nodes.groupBy("session_id").agg(F.max("node_id").alias("top"))
    return top.join(newest, "session_id", "left").select("session_id", F.coalesce("leaf", "top").alias("leaf"))


def leaf_of(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """The session's main leaf when it exists, else the fallback leaf."""
    main = sessions.select("session_id", F.col("main_chain_id").alias("node_id")).join(
        nodes.select("session_id", "node_id"), ["session_id", "node_id"]
    ).withColumnRenamed("node_id", "main")
    return fallback_leaf(nodes).join(main, "session_id", "left").select("session_id", F.coalesce("main", "leaf").alias("leaf"))


def active_chain(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Ancestors of each leaf, root first, as (session_id, node_id, position).

    Each round joins every node with the ancestor twice as far, so a chain of n
    nodes takes log2(n) rounds whatever its session's size.  A node met again is
    kept at its first distance, which also ends cycles.
    """
    ids = nodes.select("session_id", "node_id").distinct()
    up = nodes.where("parent_node_id is not null").select("session_id", "node_id", F.col("parent_node_id").alias("up"))
    # A parent outside the session ends the chain.
    up = up.join(ids.withColumnRenamed("node_id", "up"), ["session_id", "up"], "left_semi")
    reach = cut_lineage(leaves.select("session_id", F.col("leaf").alias("node_id"), F.lit(0).cast("bigint").alias("dist")))
    jump, step, size = cut_lineage(up), 1, reach.count()
    while True:
        further = reach.join(jump, ["session_id", "node_id"]).select(
            "session_id", F.col("up").alias("node_id"), (F.col("dist") + step).alias("dist")
        )
        reach = cut_lineage(
            reach.unionByName(further).groupBy("session_id", "node_id").agg(F.min("dist").alias("dist"))
        )
        grown = reach.count()
        if grown == size:
            break
        size, step = grown, step * 2
        far = jump.select("session_id", F.col("node_id").alias("up"), F.col("up").alias("up2"))
        jump = cut_lineage(jump.join(far, ["session_id", "up"]).select("session_id", "node_id", F.col("up2").alias("up")))
    length = reach.groupBy("session_id").agg(F.max("dist").alias("_far"))
    return reach.join(length, "session_id").select(
        "session_id", "node_id", (F.col("_far") - F.col("dist")).alias("position")
    )


def chain_steps(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """Steps along the chain: user turns, and assistant turns with the tool results
    that follow.  System nodes form the prompt and are not steps; rows after the
    last assistant turn are kept."""
    n = nodes.join(chain, ["session_id", "node_id"]).where("role <> 'system'")
    at = F.floor(F.col("position") / F.lit(CHUNK_ROWS))
    issued = F.when(F.col("role") == "assistant", F.col("position"))
    n = running(n, ["session_id"], at, ["position"], last={"asst_at": issued})
    results = n.where("role = 'tool' and asst_at is not null")
    # A result belongs to the latest earlier turn that issued its call id, else to
    # the latest earlier assistant turn.
    calls = n.where("role = 'assistant'").select("session_id", F.col("position"), F.explode("tool_calls").alias("c")).select(
        "session_id", F.col("c.id").alias("tool_call_id"), "position", F.lit(0).alias("is_result")
    )
    u = results.select(
        "session_id", F.coalesce("tool_call_id", F.lit("")).alias("tool_call_id"), "position", F.lit(1).alias("is_result"), "asst_at", "content"
    ).unionByName(calls, allowMissingColumns=True)
    u = running(u, ["session_id", "tool_call_id"], at, ["position", "is_result"], last={"issued": F.when(F.col("is_result") == 0, F.col("position"))})
    obs = u.where("is_result = 1").groupBy("session_id", F.coalesce("issued", "asst_at").alias("position")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("position").alias("at"), "content"))).alias("results")
    )
    s = n.where("(role = 'user' and trim(content) <> '') or role = 'assistant'").join(obs, ["session_id", "position"], "left")
    s = running(s, ["session_id"], at, ["position"], number="_n")
    m = F.col("metadata.metrics")
    tok = lambda f: F.when(F.col("role") == "assistant", F.coalesce(m[f], F.lit(0)).cast("bigint"))
    return s.select(
        "session_id", (F.col("_n") + 1).alias("step_index"),
        F.when(F.col("role") == "assistant", "agent").otherwise("user").alias("role"),
        F.coalesce("content", F.lit("")).alias("message"), "tool_calls",
        F.array_join(F.transform("results", lambda r: r["content"]), "\n").alias("observation"),
        tok("input_tokens").alias("prompt_tokens"), tok("output_tokens").alias("completion_tokens"),
        tok("cache_read_tokens").alias("cache_read"), tok("cache_creation_tokens").alias("cache_creation"),
        F.col("created_at").alias("ts"),
    )


def dominant_model(nodes: DataFrame, chain: DataFrame, sessions: DataFrame) -> DataFrame:
    """Most used model of the assistant turns, first seen on ties, else the session's."""
    n = nodes.join(chain, ["session_id", "node_id"]).where("role = 'assistant'").select(
        "session_id", "position", F.nullif(F.col("metadata.generation_model"), F.lit("")).alias("m")
    )
    top = majority(n, ["session_id"], "m", ["position"])
    return sessions.select("session_id", F.col("model").alias("own")).join(top, "session_id", "left").select(
        "session_id", F.coalesce("m", F.nullif("own", F.lit("")), F.lit("unknown")).alias("model")
    )


def system_text(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """System messages of the chain joined, per session (few by nature)."""
    s = nodes.join(chain, ["session_id", "node_id"]).where("role = 'system' and trim(content) <> ''")
    parts = F.array_sort(F.collect_list(F.struct("position", "content")))
    return s.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("system"))


# -- imported sessions as captured pairs ------------------------------------------

BLOCK_MESSAGES = 256


def _seconds(iso: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(F.col(iso))) / 1e6


def chain_pairs(nodes: DataFrame, chain: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, messages) of imported sessions: what a capture of them would have held.

    ``sessions`` has session_id, model and created_at.  ``messages`` (session_id, block,
    n_first, bodies) are the wire messages of the chain, each once, ``BLOCK_MESSAGES`` to a
    row; ``pairs`` has one row for each assistant turn, which names by ``upto`` how many
    messages its request resends.  What follows the last assistant turn comes as one more
    pair with an empty response.  Both grow with the chain and not with its square; sessions
    without an assistant turn have none.
    """
    n = nodes.join(chain, ["session_id", "node_id"]).where("role in ('user', 'assistant', 'tool')")
    at = F.floor(F.col("position") / F.lit(CHUNK_ROWS))
    n = running(n, ["session_id"], at, ["position"], number="upto", sums={"seq": F.when(F.col("role") == "assistant", 1).otherwise(0)},
                last={"last_at": F.when(F.col("created_at") > 0, F.col("created_at"))})
    content = F.coalesce("content", F.lit(""))
    call = "transform(tool_calls, c -> named_struct('id', c.id, 'name', c.name, 'arguments', coalesce(try_parse_json(c.arguments), parse_json('{}'))))"
    body = F.when(F.col("role") == "assistant", F.to_json(F.struct(
        F.lit("assistant").alias("role"), content.alias("content"), F.expr(f"if(size(tool_calls) > 0, {call}, null)").alias("tool_calls"),
    ))).otherwise(F.to_json(F.struct("role", content.alias("content"), F.when(F.col("role") == "tool", F.col("tool_call_id")).alias("tool_call_id"))))
    n = n.withColumn("body", body)
    blocks = n.groupBy("session_id", F.floor(F.col("upto") / BLOCK_MESSAGES).alias("block")).agg(
        F.min("upto").alias("n_first"), F.transform(F.array_sort(F.collect_list(F.struct("upto", "body"))), lambda x: x["body"]).alias("bodies"))

    own = sessions.select("session_id", ms_to_sec(F.col("created_at")).alias("session_at"))
    named = dominant_model(nodes, chain, sessions).join(own, "session_id").join(system_text(nodes, chain), "session_id", "left")
    made = n.where("role = 'assistant'").join(named, "session_id")
    m = F.col("metadata.metrics")
    known = F.when(F.col("created_at") > 0, F.col("created_at"))
    req = F.coalesce(_seconds("metadata.started_generation_at"), _seconds("metadata.created_at"), known, "session_at")
    resp = F.coalesce(_seconds("metadata.created_at"), known, req)
    usage = F.struct(*[F.coalesce(m[c], F.lit(0)).cast("bigint").alias(c) for c in (
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    turns = made.select(
        "session_id", (F.col("seq") - 1).alias("seq"), "upto", "model", "system", req.alias("request_at"), resp.alias("response_at"),
        (req + m["ttft_ms"] / 1000).alias("first_byte_at"),
        F.coalesce(F.nullif(F.col("metadata.generation_model"), F.lit("")), "model").alias("answer_model"),
        F.col("metadata.finish_reason").alias("finish_reason"), F.col("body").alias("message"), F.to_json(usage).alias("usage"))
    ends = n.groupBy("session_id").agg(
        F.max("seq").alias("seq"), (F.max("upto") + 1).alias("upto"), F.max_by("role", "upto").alias("role"), F.max_by("last_at", "upto").alias("last_at"))
    tail = ends.where("role <> 'assistant' and seq > 0").join(named, "session_id")
    last = F.coalesce("last_at", "session_at")
    tail = tail.select("session_id", "seq", "upto", "model", "system", last.alias("request_at"), last.alias("response_at"), F.col("model").alias("answer_model"))
    return turns.unionByName(tail, allowMissingColumns=True), blocks


def pair_lines(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, seq, value): each pair as the JSON line of a log, its transcript written out."""
    lead = pairs.select("session_id", "seq", "upto", F.explode(F.sequence(
        F.lit(0), F.greatest(F.floor((F.col("upto") - 1) / BLOCK_MESSAGES), F.lit(0)).cast("int"))).alias("block"))
    parts = lead.join(messages, ["session_id", "block"]).select(
        "session_id", "seq", "block", F.array_join(F.slice("bodies", F.lit(1), F.greatest(F.col("upto") - F.col("n_first"), F.lit(0)).cast("int")), ",").alias("part"))
    said = parts.where("part <> ''").groupBy("session_id", "seq").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), ",").alias("said"))
    p = pairs.join(said, ["session_id", "seq"], "left")
    text = lambda c: F.coalesce(F.expr(f"to_json(array({c}))").substr(F.lit(2), F.expr(f"length(to_json(array({c}))) - 2")), F.lit("null"))
    given = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f',"{name}":'), value)).otherwise(F.lit(""))
    number = lambda c: F.col(c).cast("decimal(20, 6)").cast("string")
    stamp = F.concat(F.lit('"'), F.date_format(F.timestamp_micros((F.col("response_at") * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    request = F.concat(
        F.lit('{"request":{"timestamp":'), number("request_at"), F.lit(',"method":"POST","url":'), text("concat('devin://session/', session_id)"),
        F.lit(',"headers":{},"body":{"provider":"devin","session_id":'), text("session_id"), F.lit(',"model":'), text("model"),
        given("system", F.when(F.col("system") != "", text("system"))), F.lit(',"transcript":['), F.coalesce("said", F.lit("")), F.lit("]}}"))
    response = F.concat(
        F.lit(',"response":{"timestamp":'), number("response_at"), given("first_byte_timestamp", number("first_byte_at")),
        F.lit(',"status_code":200,"headers":{},"body":{"provider":"devin","model":'), text("answer_model"),
        given("finish_reason", F.when(F.col("finish_reason").isNotNull(), text("finish_reason"))),
        given("message", F.col("message")), given("usage", F.col("usage")), F.lit('}},"logged_at":'), stamp, F.lit("}"))
    return p.select("session_id", "seq", F.concat(request, response).alias("value"))
