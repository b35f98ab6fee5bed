"""What declared but never called tools cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pricing import with_rates


def toolset_usage(requests: DataFrame, sessions: DataFrame, toolsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usage per (session, toolset) and the calls made under it.

    ``toolsets`` (toolset_hash, tool, approx_tokens) lists each declared tool.
    """
    r = requests.where("toolset_hash is not null")
    usage = r.groupBy("session_id", "toolset_hash").agg(F.count(F.lit(1)).alias("request_count"))
    usage = usage.join(toolsets.select("toolset_hash").distinct(), "toolset_hash", "left_semi")
    usage = usage.join(sessions.select("session_id", "agent", "model", "project"), "session_id")
    calls = r.select("session_id", "toolset_hash", F.explode("tool_names").alias("tool")).where("tool <> ''")
    calls = calls.groupBy("session_id", "toolset_hash", "tool").agg(F.count(F.lit(1)).alias("calls"))
    return usage, calls


def tool_rows(usage: DataFrame, calls: DataFrame, toolsets: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per (session, toolset, declared tool) with calls and cumulative size."""
    u = with_rates(usage, prices).withColumn("cache_rate", F.col("rates.cache_read")).drop("rates")
    t = u.join(toolsets, "toolset_hash").join(calls, ["session_id", "toolset_hash", "tool"], "left")
    t = t.withColumn("calls", F.coalesce("calls", F.lit(0))).withColumn("dead", F.col("calls") == 0)
    return t.withColumn("cumulative", F.col("approx_tokens") * F.col("request_count")).withColumn(
        "dead_cost", F.when(F.col("dead"), F.col("cumulative") * F.col("cache_rate") / 1_000_000)
    )


def dead_tools(rows: DataFrame) -> DataFrame:
    """Declared minus called, per session and toolset."""
    return rows.where("dead").select("session_id", "toolset_hash", "tool", "approx_tokens", "cumulative")


def _dead(c: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("dead"), F.col(c))), F.lit(0))


def toolset_tax(rows: DataFrame) -> DataFrame:
    """Per (session, toolset): declared, called and dead tools and their cost."""
    t = rows.groupBy("session_id", "toolset_hash").agg(
        F.max("request_count").alias("request_count"), F.max("cache_rate").alias("cache_rate"),
        F.count(F.lit(1)).alias("declared"), F.count(F.when(~F.col("dead"), 1)).alias("called"),
        F.count(F.when(F.col("dead"), 1)).alias("dead"),
        _dead("approx_tokens").alias("dead_per_request"), _dead("cumulative").alias("dead_cumulative"),
        F.sum("cumulative").alias("cumulative"),
    )
    return t.withColumn("dead_cost_usd", F.col("dead_cumulative") * F.col("cache_rate") / 1_000_000).drop("cache_rate")


def tax_by_session(rows: DataFrame) -> DataFrame:
    """Per session; declared and dead counts are those of its most used toolset."""
    t = toolset_tax(rows)
    lead = F.struct("request_count", "toolset_hash")
    pick = lambda c: F.max_by(c, lead).alias(c)
    return t.groupBy("session_id").agg(
        F.sum("request_count").alias("request_count"), pick("declared"), pick("called"), pick("dead"),
        pick("dead_per_request"), F.sum("dead_cumulative").alias("dead_cumulative"),
        F.sum("cumulative").alias("cumulative"), F.sum("dead_cost_usd").alias("dead_cost_usd"),
    )


def tax_by_tool(rows: DataFrame) -> DataFrame:
    """Per tool over the fleet.

    Calls keep one toolset per session, the one with the fewest requests, as the
    figure of a session replaces the one before in order of requests.
    """
    last = rows.groupBy("tool", "session_id").agg(
        F.min_by("calls", F.struct("request_count", F.col("toolset_hash"))).alias("kept_calls"),
        F.max("calls").alias("any_calls"), F.max("approx_tokens").alias("approx_tokens"),
        F.sum("cumulative").alias("cumulative"), _dead("cumulative").alias("dead_cumulative"),
        F.sum("dead_cost").alias("dead_cost"),
        F.max(F.col("dead") & F.col("cache_rate").isNull()).alias("unpriced"),
    )
    return last.groupBy("tool").agg(
        F.max("approx_tokens").alias("approx_tokens"), F.count(F.lit(1)).alias("sessions_declared"),
        F.count(F.when(F.col("any_calls") > 0, 1)).alias("sessions_called"), F.sum("kept_calls").alias("calls"),
        F.sum("cumulative").alias("cumulative"), F.sum("dead_cumulative").alias("dead_cumulative"),
        F.sum("dead_cost").alias("dead_cost_usd"), F.max("unpriced").alias("has_unpriced"),
    )


def tax_totals(rows: DataFrame) -> DataFrame:
    t = toolset_tax(rows)
    n = rows.agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("tool").alias("tools"))
    s = t.agg(
        F.sum("cumulative").alias("cumulative"), F.sum("dead_cumulative").alias("dead_cumulative"),
        F.sum("dead_cost_usd").alias("dead_cost_usd"),
        F.max(F.col("dead_cost_usd").isNull() & (F.col("dead_cumulative") > 0)).alias("has_unpriced"),
    )
    one = F.lit(1)
    out = n.withColumn("_one", one).join(s.withColumn("_one", one), "_one").drop("_one")
    share = F.when(F.col("cumulative") > 0, F.col("dead_cumulative") / F.col("cumulative")).otherwise(F.lit(0.0))
    return out.withColumn("dead_share", share)


def provider(tool: str = "tool") -> Column:
    """Struct(kind, key) of the integration a tool name belongs to."""
    t = F.col(tool)
    server = F.split(F.substring(t, 6, 1 << 20), "__")[0]
    plugin = F.split(F.substring(server, 8, 1 << 20), "_")[0]
    kind = (
        F.when(~t.startswith("mcp__"), "builtin").when(server.startswith("plugin_"), "plugin")
        .when(server.startswith("claude_ai_"), "connector").otherwise("mcp")
    )
    key = (
        F.when(kind == "builtin", "built-in").when(kind == "plugin", plugin)
        .when(kind == "connector", F.substring(server, 11, 1 << 20)).otherwise(server)
    )
    return F.struct(kind.alias("kind"), key.alias("key"))


def tax_by_provider(rows: DataFrame) -> DataFrame:
    """Per session, toolset and provider: size, share, calls, and whether the
    provider is a connector of nothing but sign-in stubs."""
    stub = F.element_at(F.split("tool", "__"), -1).isin("authenticate", "complete_authentication")
    g = rows.withColumn("p", provider()).groupBy("session_id", "toolset_hash", F.col("p.key").alias("provider")).agg(
        F.min("p.kind").alias("kind"), F.count(F.lit(1)).alias("tools"), F.sum("approx_tokens").alias("approx_tokens"),
        F.sum("cumulative").alias("cumulative"), F.sum("calls").alias("calls"),
        _dead("approx_tokens").alias("dead_tokens"), F.min(stub).alias("_stubs"),
    )
    total = rows.groupBy("session_id", "toolset_hash").agg(F.sum("approx_tokens").alias("_total"))
    g = g.join(total, ["session_id", "toolset_hash"])
    return g.withColumn("share", F.col("approx_tokens") / F.greatest(F.col("_total"), F.lit(1))).withColumn(
        "deferred", (F.col("kind") == "connector") & F.col("_stubs")
    ).drop("_stubs", "_total")
