"""Session rows, the session list with its filters, and plain reads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_any
from .pricing import cache_hit_rate, with_cost

TOKENS = ["prompt_tokens", "completion_tokens", "cache_read", "cache_creation", "reasoning_tokens"]
SORTABLE = {
    "started_at", "ended_at", "duration_ms", "total_in_tokens", "total_out_tokens",
    "cost_usd", "agent", "model", "project",
}


def tool_counts(steps: DataFrame, keys: Iterable[str] = ("session_id",)) -> DataFrame:
    """Calls per key and tool; a call without a name counts as ``(unnamed)``."""
    calls = steps.select(*keys, F.explode("tool_names").alias("tool"))
    name = F.when(F.col("tool") == "", F.lit("(unnamed)")).otherwise(F.col("tool"))
    return calls.groupBy(*keys, name.alias("tool")).agg(F.count(F.lit(1)).alias("calls"))


def histogram(counts: DataFrame, keys: Iterable[str] = ("session_id",)) -> DataFrame:
    """One map tool -> calls per key.  Its size is the number of distinct tools."""
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "calls")))).alias("tool_histogram")
    )


def of_latest_log(rows: DataFrame, at: str = "ts") -> DataFrame:
    """Rows of each session from the log that captured it last, of several by path.

    Rows without a ``source_path`` are of one capture and stay as they are.
    """
    if "source_path" not in rows.columns:
        return rows
    logs = rows.groupBy("session_id", "source_path").agg(F.max(at).alias("_last"))
    owner = logs.groupBy("session_id").agg(F.max_by("source_path", F.struct("_last", "source_path")).alias("source_path"))
    return rows.join(owner, ["session_id", "source_path"], "left_semi")


def session_rollup(steps: DataFrame) -> DataFrame:
    """Token totals, turns, tool calls and known time span per session.

    A session captured in several logs counts as its last capture has it.
    """
    steps = of_latest_log(steps)
    if "source_path" in steps.columns:
        owner = steps.groupBy("session_id").agg(F.any_value("source_path").alias("source_path"))
        return _rollup(steps).join(owner, "session_id")
    return _rollup(steps)


def _rollup(steps: DataFrame) -> DataFrame:
    ts = F.when(F.col("ts") > 0, F.col("ts"))
    agent = F.col("role") == "agent"
    totals = steps.groupBy("session_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS[:4]],
        F.sum("reasoning_tokens").alias("reasoning_tokens"),
        F.coalesce(F.min(ts), F.lit(0.0)).alias("started_at"),
        F.coalesce(F.max(ts), F.lit(0.0)).alias("ended_at"),
        F.count(F.when(agent, 1)).alias("turns"),
        F.sum(F.coalesce(F.size("tool_names"), F.lit(0))).alias("tool_calls"),
    )
    return totals.join(histogram(tool_counts(steps)), "session_id", "left")


def session_rows(rolled: DataFrame, dims: DataFrame, prices: DataFrame) -> DataFrame:
    """The sessions table: dimensions, totals, cost and cache hit rate."""
    joined = dims.join(rolled, [c for c in ("session_id", "source_path") if c in rolled.columns and c in dims.columns])
    span = F.when(F.col("ended_at") > F.col("started_at"), (F.col("ended_at") - F.col("started_at")) * 1000)
    priced = with_cost(joined, prices)
    return priced.select(
        *dims.columns,
        "started_at", "ended_at", F.coalesce(span, F.lit(0.0)).alias("duration_ms"),
        F.col("prompt_tokens").alias("total_in_tokens"),
        F.col("completion_tokens").alias("total_out_tokens"),
        "cache_read", "cache_creation", "reasoning_tokens",
        F.col("cost").alias("cost_usd"),
        cache_hit_rate(F.col("prompt_tokens"), F.col("cache_creation"), F.col("cache_read")).alias("cache_hit_rate"),
        "turns", "tool_calls", "tool_histogram",
    )


# -- filters -----------------------------------------------------------------

def step_semi(sessions: DataFrame, steps: DataFrame, *, tool: str | None = None, errored: bool = False) -> DataFrame:
    """Sessions with a step that calls the tool, and with a failed step."""
    if tool:
        sessions = sessions.join(
            steps.where(F.array_contains("tool_names", tool)).select("session_id"), "session_id", "left_semi"
        )
    if errored:
        sessions = sessions.join(steps.where("errored").select("session_id"), "session_id", "left_semi")
    return sessions


def thread_kind(requests: DataFrame) -> DataFrame:
    """Per session: does it hold only sub-agent calls?"""
    return requests.groupBy("session_id").agg(F.min("is_subagent").alias("subagent_only"))


def filter_sessions(
    sessions: DataFrame,
    *,
    session_id: str | None = None,
    agent: str | None = None,
    agent_exact: str | None = None,
    model: str | None = None,
    project: str | None = None,
    since: float | None = None,
    until: float | None = None,
    min_cost: float | None = None,
    tool: str | None = None,
    errored: bool = False,
    thread: str | None = None,
    steps: DataFrame | None = None,
    requests: DataFrame | None = None,
    matches: DataFrame | None = None,
) -> DataFrame:
    """Every filter of the session list.  ``steps``, ``requests`` and ``matches``
    are needed only by the filters that look into them."""
    s = sessions
    if session_id:
        s = s.where(F.col("session_id") == session_id)
    if since is not None:
        s = s.where(F.col("started_at") >= since)
    if until is not None:
        s = s.where(F.col("started_at") <= until)
    if model:
        s = s.where(like_any(F.col("model"), model))
    if project:
        s = s.where(like_any(F.col("project"), project))
    if min_cost is not None:
        s = s.where(F.col("cost_usd") >= min_cost)
    if agent_exact:
        s = s.where(F.lower("agent") == agent_exact.lower())
    if agent:
        named = like_any(F.coalesce("agent_label", F.lit("")), agent) | like_any(
            F.coalesce("agent_type", F.lit("")), agent
        )
        hit = requests.where(named).select("session_id").distinct().withColumn("_named", F.lit(True))
        s = s.join(hit, "session_id", "left").where(
            like_any(F.col("agent"), agent) | F.coalesce("_named", F.lit(False))
        ).drop("_named")
    if tool or errored:
        s = step_semi(s, steps, tool=tool, errored=errored)
    if thread in ("main", "subagent"):
        kind = thread_kind(requests)
        s = s.join(kind, "session_id", "left")
        only = F.coalesce("subagent_only", F.lit(False))
        s = s.where(only if thread == "subagent" else ~only).drop("subagent_only")
    if matches is not None:
        s = s.join(matches.select("session_id"), "session_id", "left_semi")
    return s


def sort_sessions(sessions: DataFrame, sort: str = "started_at", order: str = "desc", limit: int | None = None) -> DataFrame:
    """Whitelisted sort column, then session id; optional limit."""
    c = F.col(sort if sort in SORTABLE else "started_at")
    # NULL sorts as the smallest value, in either direction.
    key = c.asc_nulls_first() if order == "asc" else c.desc_nulls_last()
    out = sessions.orderBy(key, "session_id")
    return out if limit is None else out.limit(max(1, int(limit)))


def instant_filter(sessions: DataFrame, text: str) -> DataFrame:
    """Substring over agent, model, project, id and tool names together."""
    hay = F.lower(
        F.concat_ws(
            " ", "agent", "model", "project", "session_id",
            F.array_join(F.coalesce(F.map_keys("tool_histogram"), F.array()), " "),
        )
    )
    return sessions.where(hay.contains(text.lower()))


# -- counts and lists --------------------------------------------------------

def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session_id").agg(
        F.count(F.when(F.col("role") == "agent", 1)).alias("turns"),
        F.count(F.when(F.col("errored"), 1)).alias("error_count"),
    )


def agent_cast(requests: DataFrame) -> DataFrame:
    """Calls per session, label and type of sub-agents; unnamed ones have no label."""
    label = F.trim(F.coalesce("agent_label", F.lit("")))
    named = requests.where("is_subagent").withColumn("label", F.when(label != "", label))
    return named.groupBy(
        "session_id", "label", F.when(F.col("label").isNotNull(), F.col("agent_type")).alias("type")
    ).agg(F.count(F.lit(1)).alias("calls"))


def list_sessions(
    sessions: DataFrame, steps: DataFrame, requests: DataFrame, *,
    sort: str = "started_at", order: str = "desc", limit: int | None = None, **filters,
) -> DataFrame:
    """The session list: filtered, with turn and error counts and unnamed calls."""
    rows = filter_sessions(sessions, steps=steps, requests=requests, **filters)
    if limit is not None:
        rows = sort_sessions(rows, sort, order, limit)
    counts = step_counts(steps).select("session_id", F.col("turns").alias("turn_count"), "error_count")
    unnamed = (
        agent_cast(requests).where("label is null")
        .groupBy("session_id").agg(F.sum("calls").alias("unnamed_agent_calls"))
    )
    zero = F.lit(0)
    counted = (
        rows.join(counts, "session_id", "left").join(unnamed, "session_id", "left")
        .withColumn("turn_count", F.coalesce("turn_count", zero))
        .withColumn("error_count", F.coalesce("error_count", zero))
        .withColumn("unnamed_agent_calls", F.coalesce("unnamed_agent_calls", zero))
    )
    return sort_sessions(counted, sort, order)  # a join keeps no order


def same_source(sessions: DataFrame) -> DataFrame:
    """Sibling sessions of one log, as (session, sibling) with the sibling's start.

    The answer is a list per session; ask for chosen sessions with
    ``siblings_of`` where a log holds very many.
    """
    a = sessions.select("source_path", "session_id")
    return siblings_of(a, sessions)


def siblings_of(chosen: DataFrame, sessions: DataFrame) -> DataFrame:
    b = sessions.select("source_path", F.col("session_id").alias("sibling_id"), "started_at")
    return (
        chosen.select("source_path", "session_id").join(b, "source_path")
        .where(F.col("session_id") != F.col("sibling_id"))
        .select("session_id", "sibling_id", "started_at")
    )


def majority(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Most frequent non-null value per key; ties go to the first seen."""
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    )
    # Largest count, then smallest first position: one pass with a partial aggregate.
    best = F.max(F.struct(F.col("_n"))).alias("_n")
    top = counted.groupBy(*keys).agg(best).select(*keys, F.col("_n._n").alias("_n"))
    return (
        counted.join(top, [*keys, "_n"]).groupBy(*keys)
        .agg(F.min_by(value, "_first").alias(value))
    )


def read_steps(steps: DataFrame, session_id: str) -> DataFrame:
    return steps.where(F.col("session_id") == session_id).orderBy("step_index")


def read_requests(requests: DataFrame, session_id: str) -> DataFrame:
    return requests.where(F.col("session_id") == session_id).orderBy("seq")


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in ``order``; the whole row is carried by one aggregate."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(whole, F.struct(*order)).alias("_row")
    ).select("_row.*")


def running_conversations(requests: DataFrame) -> DataFrame:
    """Calls, context, output and span per agent inside each session."""
    bucket = F.when(~F.col("is_subagent"), F.lit("main")).otherwise(
        F.coalesce(F.when(F.trim("agent_label") != "", F.trim("agent_label")), F.lit("unnamed"))
    )
    ts = F.when(F.col("ts") > 0, F.col("ts"))
    return requests.groupBy("session_id", bucket.alias("conversation")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("prompt_tokens") + F.col("cache_read") + F.col("cache_creation")).alias("context_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )
