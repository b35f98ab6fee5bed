"""Fleet-wide rollups over sessions, requests and usage events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import running, time_chunk
from .pricing import cache_hit_rate, with_cost
from .usage import local_date

QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
DEFAULT_SCOPE_DAYS = 7


def _usd() -> Column:
    return F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_usd")


def scope_requests(
    requests: DataFrame, sessions: DataFrame, *, since: float | None = None, until: float | None = None,
    agent: str | None = None,
) -> DataFrame:
    """Requests in scope; one with an unknown time counts at its session's start."""
    r = requests.join(sessions.select("session_id", "agent", "started_at"), "session_id")
    ts = F.coalesce(F.nullif("ts", F.lit(0.0)), F.col("started_at"))
    if since is not None:
        r = r.where(ts >= since)
    if until is not None:
        r = r.where(ts <= until)
    if agent:
        r = r.where(F.lower("agent") == agent.lower())
    return r


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles of a whole-number measure per key.

    Values are counted first, so a key of any size shrinks to its distinct values
    before it is ordered; the running count is taken in two levels.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    n = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    upto = running(counts, list(keys), F.floor(F.col("_v") / 4096), ["_v"], sums={"_upto": F.col("_c")})
    ranked = upto.join(n, list(keys))
    picks = [
        F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * q)), F.col("_v"))).alias(name)
        for name, q in quantiles.items()
    ]
    return ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)


def totals(sessions: DataFrame, requests: DataFrame, events: DataFrame, prices: DataFrame) -> DataFrame:
    e = with_cost(events, prices).agg(
        F.count(F.lit(1)).alias("events"), _usd(), F.max(F.col("cost").isNull()).alias("has_unpriced"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cache_read", "cache_creation")],
    )
    r = requests.agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("errored"), 1)).alias("errored_requests")
    )
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    rate = cache_hit_rate(F.col("prompt_tokens"), F.col("cache_creation"), F.col("cache_read"))
    # Three one-row frames side by side.
    one = F.lit(1).alias("_one")
    out = s.select("*", one).join(r.select("*", one), "_one").join(e.select("*", one), "_one").drop("_one")
    return out.withColumn("cache_hit_rate", rate)


def per_agent(events: DataFrame, prices: DataFrame) -> DataFrame:
    return with_cost(events, prices).groupBy("agent").agg(
        F.countDistinct("session_id").alias("sessions"), _usd(),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )


def per_project(events: DataFrame, prices: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif("project", F.lit("")), F.lit("(unknown)"))
    return with_cost(events, prices).groupBy(name.alias("project")).agg(
        F.countDistinct("session_id").alias("sessions"), _usd(),
        F.count(F.lit(1)).alias("events"), F.sum("completion_tokens").alias("completion_tokens"),
    )


def daily_trend(events: DataFrame, prices: DataFrame, days: int | None = None) -> DataFrame:
    """UTC days with activity, oldest first; the newest ``days`` of them where given."""
    known = with_cost(events.where(F.col("ts") > 0), prices)
    by_day = known.groupBy(F.date_format(local_date(F.col("ts")), "yyyy-MM-dd").alias("date")).agg(
        _usd(), F.count(F.lit(1)).alias("events")
    )
    if days is not None:
        by_day = by_day.orderBy(F.desc("date")).limit(days)
    return by_day.orderBy("date")


def per_model(requests: DataFrame) -> DataFrame:
    """Wire metrics per response model, percentiles by nearest rank."""
    name = F.coalesce(F.nullif("model", F.lit("")), F.lit("(unknown)"))
    r = requests.withColumn("model", name)
    base = r.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("errored"), 1)).alias("errored"),
        F.count("ttft_ms").alias("ttft_n"), F.sum("completion_tokens").alias("completion_tokens"),
    )
    ttft = nearest_rank(r, ["model"], "ttft_ms", QUANTILES).drop("_n")
    ttft = ttft.select("model", *[F.col(q).alias(f"ttft_{q}") for q in QUANTILES])
    dur = nearest_rank(r, ["model"], "duration_ms", {"duration_p50": 0.5}).drop("_n")
    out = base.join(ttft, "model", "left").join(dur, "model", "left")
    return out.withColumn("error_rate", F.col("errored") / F.col("requests"))


def per_named_agent(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Main thread, each named sub-agent, and unnamed sub-agents; by row price."""
    label = F.coalesce(F.nullif("agent_label", F.lit("")), F.lit("unnamed subagents"))
    sub = F.col("is_subagent")
    r = with_cost(requests, prices).withColumn("label", F.when(sub, label).otherwise(F.lit("main thread")))
    named = sub & (F.coalesce("agent_label", F.lit("")) != "")
    # The type shown is that of the group's first call, of several at once the first by name.
    kind = F.when(sub, F.coalesce("agent_type", F.lit(""))).otherwise(F.lit(""))
    return r.groupBy("label", named.alias("named")).agg(
        F.min_by(kind, F.struct("session_id", "ts", kind)).alias("type"),
        F.count(F.lit(1)).alias("calls"), F.countDistinct("session_id").alias("sessions"), _usd(),
        F.sum(F.col("prompt_tokens") + F.col("cache_read") + F.col("cache_creation")).alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def rank_named_agents(named: DataFrame, rows: int) -> DataFrame:
    """Main thread first, then by cost; beyond ``rows`` one remainder row."""
    w = Window.orderBy((F.col("label") == "main thread").desc(), F.desc("cost_usd"), "label")
    # The input is one row per agent name, already aggregated.
    r = named.withColumn("rank", F.row_number().over(w))
    shown = F.col("rank") <= rows
    return r.groupBy(
        F.when(shown, F.col("rank")).otherwise(rows + 1).alias("rank"),
        F.when(shown, F.col("label")).otherwise(F.lit("others")).alias("label"),
    ).agg(F.sum("calls").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def top_tools(sessions: DataFrame, n: int = 20) -> DataFrame:
    calls = sessions.select(F.explode("tool_histogram").alias("tool", "calls"))
    counts = calls.groupBy("tool").agg(F.sum("calls").alias("calls"))
    total = counts.agg(F.count(F.lit(1)).alias("tools_total")).withColumn("_one", F.lit(1))
    top = counts.orderBy(F.desc("calls"), "tool").limit(n).withColumn("_one", F.lit(1))
    return top.join(total, "_one").drop("_one")


def context_tokens() -> Column:
    return F.col("prompt_tokens") + F.col("cache_read") + F.col("cache_creation")


def compactions_simple(requests: DataFrame) -> DataFrame:
    """Fleet count: items and context both fell from the call before in time."""
    r = requests.select("session_id", "ts", "seq", "transcript_items", context_tokens().alias("ctx"))
    d = running(
        r, ["session_id"], time_chunk(F.col("ts"), F.col("seq")), ["ts", "seq"],
        lag={"p_items": F.col("transcript_items"), "p_ctx": F.col("ctx")},
    )
    fell = d.where((F.col("transcript_items") < F.col("p_items")) & (F.col("ctx") < F.col("p_ctx")))
    return fell.agg(F.count(F.lit(1)).alias("compactions"), F.countDistinct("session_id").alias("sessions"))


def top_sessions(sessions: DataFrame, n: int = 8) -> DataFrame:
    return sessions.orderBy(F.coalesce("cost_usd", F.lit(0.0)).desc(), "session_id").limit(n)


def daily_activity(
    sessions: DataFrame, zone: str = "UTC", agent: str | None = None, max_days: int | None = None,
) -> DataFrame:
    """Sessions, cost and agents per local day, every day of the span present.

    At most ``max_days`` days back from the newest where given; the last
    ``DEFAULT_SCOPE_DAYS`` of them are marked as the opening window.
    """
    s = sessions.where(F.col("started_at") > 0)
    if agent:
        s = s.where(F.lower("agent") == agent.lower())
    by_day = s.groupBy(local_date(F.col("started_at"), zone).alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.countDistinct("agent").alias("agents"),
    )
    span = by_day.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    lo = F.col("lo") if max_days is None else F.greatest("lo", F.date_sub("hi", max_days - 1))
    days = span.select("hi", F.explode(F.sequence(lo, F.col("hi"))).alias("day"))
    zero = F.lit(0)
    return days.join(by_day, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.coalesce("sessions", zero).alias("sessions"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("agents", zero).alias("agents"),
        (F.col("day") > F.date_sub("hi", DEFAULT_SCOPE_DAYS)).alias("in_default_window"),
    )


def rollup_logs(sessions: DataFrame) -> DataFrame:
    """Per source log; cost is NULL only when no session is priced.

    The two lists hold distinct model names, a domain that does not grow with the log.
    """
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = sessions.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("trajectories"),
        *[F.sum(c).alias(c) for c in (
            "total_in_tokens", "total_out_tokens", "cache_read", "cache_creation", "reasoning_tokens",
            "turns", "tool_calls", "cost_usd")],
        names("model").alias("models"),
        names(F.when(F.col("cost_usd").isNull(), F.col("model"))).alias("unknown_models"),
    )
    return out.withColumn(
        "cache_hit_rate", cache_hit_rate(F.col("total_in_tokens"), F.col("cache_creation"), F.col("cache_read"))
    )


def log_counts(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    one = F.lit(1).alias("_one")
    p = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    s = sessions.agg(
        F.count(F.lit(1)).alias("trajectories"),
        F.sum("total_in_tokens").alias("prompt_tokens"), F.sum("total_out_tokens").alias("completion_tokens"),
        F.sum("cache_creation").alias("cache_creation"), F.sum("cache_read").alias("cache_read"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"),
    )
    return p.select("*", one).join(s.select("*", one), "_one").drop("_one")


def index_counts(sessions: DataFrame, requests: DataFrame, events: DataFrame) -> DataFrame:
    r = requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.countDistinct(F.nullif("prompt_hash", F.lit(""))).alias("prompts"),
    )
    frames = [sessions.agg(F.count(F.lit(1)).alias("sessions")), r, events.agg(F.count(F.lit(1)).alias("events"))]
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def insights(sessions: DataFrame, requests: DataFrame, events: DataFrame, prices: DataFrame) -> DataFrame:
    """Rule rows (rule, subject, value, severity); each checkable against a rollup."""
    e = with_cost(events, prices)
    s = lambda x: F.lit(x).alias("severity")
    rule = lambda x: F.lit(x).alias("rule")
    dbl = lambda c: F.col(c).cast("double").alias("value")
    unpriced = (
        e.where("cost is null").agg(F.countDistinct("session_id").alias("n"), F.count(F.lit(1)).alias("c"))
        .where("c > 0").select(rule("unpriced"), F.col("n").cast("string").alias("subject"), dbl("c"), s("warn"))
    )
    share = F.col("cc") / (F.col("cc") + F.col("cr"))
    writes = (
        e.agg(F.sum("cache_creation").alias("cc"), F.sum("cache_read").alias("cr")).where("cc + cr > 0")
        .select(rule("cache_writes"), F.lit("").alias("subject"), share.alias("value"),
                F.when(share > 0.25, "warn").otherwise("info").alias("severity"))
    )
    pm = per_model(requests)
    worst = (
        pm.where("requests >= 20").orderBy(F.desc("error_rate"), "model").limit(1).where("error_rate > 0.01")
        .select(rule("worst_model"), F.col("model").alias("subject"), dbl("error_rate"), s("bad"))
    )
    slow = (
        pm.where("ttft_n >= 20").orderBy(F.desc("ttft_p95"), "model").limit(1)
        .where("ttft_p50 > 0 and ttft_p95 > 2.5 * ttft_p50")
        .select(rule("slow_tail"), F.col("model").alias("subject"),
                (F.col("ttft_p95") / F.col("ttft_p50")).alias("value"), s("info"))
    )
    pp = per_project(events, prices)
    total = pp.agg(F.sum("cost_usd").alias("total")).withColumn("_one", F.lit(1))
    top = (
        pp.orderBy(F.desc("cost_usd"), "project").limit(1).withColumn("_one", F.lit(1)).join(total, "_one")
        .where("total > 0").select(rule("top_project"), F.col("project").alias("subject"),
                                   (F.col("cost_usd") / F.col("total")).alias("value"), s("info"))
    )
    comp = compactions_simple(requests).where("compactions > 0").select(
        rule("compactions"), F.col("sessions").cast("string").alias("subject"), dbl("compactions"), s("warn")
    )
    tool = top_tools(sessions, 1).select(rule("busiest_tool"), F.col("tool").alias("subject"), dbl("calls"), s("info"))
    out = unpriced
    for f in (writes, worst, slow, top, comp, tool):
        out = out.unionByName(f)
    return out
