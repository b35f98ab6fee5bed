"""Flow graph of a session: its steps, calls, tools and hooks in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import stab_join
from ..functions.scan import CHUNK_ROWS, running
from ..functions.text import preview

# Fixed value: tools that open a branch.
BRANCH_TOOLS = r"(?i)^(Task|Agent|BestOfNRunner|best-of-n)"
LABEL_CHARS = 72
_AFTER_ALL = 1 << 40
NODE = ["session_id", "step_index", "stage", "part", "sub"]


def _hook_places(requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """The step each hook stands before: the first whose call started no earlier.

    Only calls later than all before them can be that step; their spans from the
    latest earlier call do not overlap.
    """
    r = requests.where("ts > 0 and agent_step_index is not null").select("session_id", "ts", F.col("agent_step_index").alias("at"))
    r = running(r, ["session_id"], F.floor(F.col("at") / F.lit(CHUNK_ROWS)), ["at"], prev_max={"hi_before": F.col("ts")})
    r = r.withColumn("lo", F.coalesce("hi_before", F.lit(0.0))).where("ts > lo").select(
        "session_id", "at", "lo", F.col("ts").alias("hi")
    )
    h = hooks.select("session_id", "hook_id", F.col("ts").alias("h_ts"))
    placed = stab_join(h, r, ["session_id"], "h_ts", "lo", "hi").where("h_ts > lo").select("session_id", "hook_id", "at")
    return hooks.join(placed, ["session_id", "hook_id"], "left").withColumn("at", F.coalesce("at", F.lit(_AFTER_ALL)))


def flow_nodes(steps: DataFrame, requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """Nodes with the order they follow each other in.

    ``steps`` (session_id, step_index, role, message, reasoning, tool_names,
    tool_inputs, observation, errored), ``requests`` (session_id, seq, ts, model,
    agent_step_index, errored), ``hooks`` (session_id, hook_id, ts, event, ...).
    """
    s = steps
    said = F.col("role").isin("user", "system")
    zero = F.lit(0)

    def node(df, stage, node_id, kind, label, part=zero, sub=zero, errored=F.lit(False)):
        return df.select(
            "session_id", F.col("step_index").cast("bigint").alias("step_index"), F.lit(stage).alias("stage"),
            part.cast("double").alias("part"), sub.cast("bigint").alias("sub"), node_id.alias("node_id"),
            kind.alias("kind"), label.alias("label"), errored.alias("errored"),
        )

    at = F.col("step_index").cast("string")
    spoken = s.where(said)
    nodes = node(
        spoken, 1, F.concat(F.lit("step-"), at), F.when(F.col("role") == "system", "assistant").otherwise("user"),
        preview(F.coalesce(F.nullif("message", F.lit("")), "role"), LABEL_CHARS),
    )
    a = s.where(~said)
    nodes = nodes.unionByName(node(
        a.where("reasoning <> ''"), 1, F.concat(F.lit("think-"), at), F.lit("thinking"), preview(F.col("reasoning"), LABEL_CHARS)
    ))
    nodes = nodes.unionByName(node(
        a.where("message <> ''"), 2, F.concat(F.lit("asst-"), at), F.lit("assistant"),
        preview(F.col("message"), LABEL_CHARS), errored=F.col("errored"),
    ))
    calls = requests.where("agent_step_index is not null").withColumn("step_index", F.col("agent_step_index"))
    nodes = nodes.unionByName(node(
        calls, 3, F.concat(F.lit("api-"), F.col("seq").cast("string")), F.lit("api_call"),
        F.concat(F.lit("API #"), F.col("seq").cast("string"), F.lit(" · "), F.coalesce(F.nullif("model", F.lit("")), F.lit("model"))),
        errored=F.col("errored"),
    ))
    t = a.select("session_id", "step_index", "tool_inputs", "observation", "errored", F.posexplode("tool_names").alias("i", "tool"))
    branch = F.col("tool").rlike(BRANCH_TOOLS)
    i = F.col("i")
    arg = preview(F.coalesce(F.get("tool_inputs", i), F.lit("")), LABEL_CHARS)
    tail = F.concat(at, F.lit("-"), i.cast("string"))
    nodes = nodes.unionByName(node(
        t, 4, F.concat(F.lit("tool-"), tail), F.when(branch, "branch").otherwise("tool_call"),
        F.concat("tool", F.when(arg != "", F.concat(F.lit(" · "), arg)).otherwise(F.lit(""))), part=i,
    ))
    line = F.coalesce(F.nullif(F.get(F.split("observation", "\n"), i), F.lit("")), F.when(i == 0, F.col("observation")), F.lit(""))
    seen = t.withColumn("obs", line).where("obs <> ''")
    nodes = nodes.unionByName(node(
        seen, 4, F.concat(F.lit("result-"), tail), F.lit("tool_result"), preview(F.col("obs"), LABEL_CHARS),
        part=i, sub=F.lit(1), errored=F.col("errored"),
    ))
    h = _hook_places(requests, hooks).withColumn("step_index", F.col("at"))
    bad = (F.coalesce("outcome", F.lit("")) == "error") | (F.coalesce("decision", F.lit("")) == "block")
    return nodes.unionByName(node(
        h, 0, F.concat(F.lit("hook-"), F.col("hook_id").cast("string")), F.lit("hook"), F.col("event"),
        part=F.col("ts"), sub=F.col("hook_id"), errored=bad,
    ))


def flow_graph(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent, the kind of the edge from it, and their lane.

    Every node hangs on the one before it; a tool result follows its own call.
    Branch calls count up the lanes.
    """
    chunk = F.floor(F.col("step_index") / F.lit(CHUNK_ROWS))
    is_branch = F.when(F.col("kind") == "branch", 1).otherwise(0)
    g = running(
        nodes, ["session_id"], chunk, NODE[1:], lag={"parent_id": F.col("node_id"), "p_kind": F.col("kind")},
        sums={"n_branch": is_branch},
    )
    edge = (
        F.when(F.col("parent_id").isNull(), F.lit(None)).when(F.col("kind") == "hook", "hook")
        .when(F.col("kind") == "branch", "branch").when(F.col("kind").isin("tool_call", "tool_result"), "tool")
        .otherwise("sequence")
    )
    on_branch = (F.col("kind") == "branch") | ((F.col("kind") == "tool_result") & (F.col("p_kind") == "branch"))
    return g.withColumn("edge", edge).withColumn("lane", F.when(on_branch, F.col("n_branch")).otherwise(F.lit(0))).drop(
        "p_kind", "n_branch"
    )


def flow_edges(graph: DataFrame) -> DataFrame:
    return graph.where("parent_id is not null").select(
        "session_id", F.col("parent_id").alias("from_id"), F.col("node_id").alias("to_id"), F.col("edge").alias("kind")
    )
