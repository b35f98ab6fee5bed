"""Context growth: timelines, compactions and what they bought.

``requests`` needs session_id, seq (dense from 0), ts, duration_ms, token counts,
transcript_items and errored.  Detection follows time order, series follow seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import CHUNK_ROWS, halo, running, time_chunk
from ..functions.text import half_up
from ..session import written

# Detection floor, baseline window, trivial reclaim, short life,
# tolerance of the reclaim estimate.
MIN_COMPACTION_TOKENS = 2000
BASELINE_WINDOW = 5
TRIVIAL_RECLAIM_TOKENS = 500
SHORT_LIVED_CALLS = 5
RECLAIM_TOLERANCE = 0.2
# A hook may precede its compaction by 120 s and follow by 5 s.
HOOK_WINDOW_SEC = 120
HOOK_SLACK_SEC = 5


def context_tokens() -> Column:
    return F.col("prompt_tokens") + F.col("cache_read") + F.col("cache_creation")


def span_end_ms() -> Column:
    return F.col("ts") * 1000 + F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0)))


def _seq_chunk() -> Column:
    return F.floor(F.col("seq") / F.lit(CHUNK_ROWS))


def with_previous(requests: DataFrame, *, by: str = "time") -> DataFrame:
    """Add the previous call's fields (``p_*``), in time or in seq order."""
    r = requests.withColumn("ctx", context_tokens()).withColumn("end_ms", span_end_ms())
    lag = {
        "p_seq": F.col("seq"), "p_ts": F.col("ts"), "p_items": F.col("transcript_items"),
        "p_ctx": F.col("ctx"), "p_end_ms": F.col("end_ms"), "p_cache_read": F.col("cache_read"),
    }
    if by == "seq":
        return running(r, ["session_id"], _seq_chunk(), ["seq"], lag=lag)
    return running(r, ["session_id"], time_chunk(F.col("ts"), F.col("seq")), ["ts", "seq"], lag=lag)


def find_compactions(requests: DataFrame, *, by: str = "time") -> DataFrame:
    """Calls whose transcript and context both shrank, not in flight together."""
    d = with_previous(requests, by=by)
    overlap = (F.col("ts") * 1000 < F.col("p_end_ms")) & (F.col("p_ts") * 1000 < F.col("end_ms"))
    return d.where(
        (F.col("p_items") > 0)
        & (F.col("transcript_items") < F.col("p_items"))
        & (F.col("p_ctx") - F.col("ctx") >= MIN_COMPACTION_TOKENS)
        & ~overlap
    )


def out_of_order(requests: DataFrame) -> DataFrame:
    """Per session: neighbours by seq that run backwards in time."""
    d = running(requests, ["session_id"], _seq_chunk(), ["seq"], lag={"p_ts": F.col("ts")})
    return d.groupBy("session_id").agg(F.count(F.when(F.col("ts") < F.col("p_ts"), 1)).alias("out_of_order"))


def timeline(requests: DataFrame, composition: DataFrame | None = None) -> DataFrame:
    """One point per call with its approximate size.

    ``composition`` (session_id, seq, total_chars, total_tokens) is the size of the
    request body; a call without it falls back to its wire context.
    """
    r = requests.withColumn("context_tokens", context_tokens())
    if composition is not None:
        r = r.join(composition.select("session_id", "seq", "total_chars", "total_tokens"), ["session_id", "seq"], "left")
    else:
        r = r.withColumn("total_chars", F.lit(None).cast("bigint")).withColumn("total_tokens", F.lit(None).cast("bigint"))
    return r.withColumn("approx_tokens", F.coalesce("total_tokens", "context_tokens")).withColumn(
        "approx_chars",
        F.when(F.col("total_tokens").isNotNull(), F.col("total_chars")).otherwise(F.col("context_tokens") * 4),
    ).drop("total_chars", "total_tokens")


def timeline_peaks(requests: DataFrame, composition: DataFrame | None = None) -> DataFrame:
    points = timeline(requests, composition).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.max("context_tokens").alias("peak_context"),
        F.max("approx_tokens").alias("peak_approx"),
    )
    comp = find_compactions(requests).groupBy("session_id").agg(F.count(F.lit(1)).alias("compactions"))
    return (
        points.join(comp, "session_id", "left").join(out_of_order(requests), "session_id", "left")
        .withColumn("compactions", F.coalesce("compactions", F.lit(0)))
    )


def cache_costs(requests: DataFrame, compactions: DataFrame) -> DataFrame:
    """Per call: median cache write of the calls around it, and the rebuild cost.

    The baseline skips the call itself, compactions and failures.  A failed call
    that did no work is charged with the first good call of the next five.
    """
    r = requests.select("session_id", "seq", "cache_creation", "cache_read", "errored").join(
        compactions.select("session_id", "seq", F.lit(True).alias("is_comp")), ["session_id", "seq"], "left"
    )
    r = halo(r, F.col("seq"), BASELINE_WINDOW, BASELINE_WINDOW)
    w = Window.partitionBy("session_id", "_chunk").orderBy("seq")
    usable = F.when(F.col("is_comp").isNull() & ~F.col("errored"), F.col("cache_creation"))
    around = F.concat(
        F.collect_list(usable).over(w.rowsBetween(-BASELINE_WINDOW, -1)),
        F.collect_list(usable).over(w.rowsBetween(1, BASELINE_WINDOW)),
    )
    good = F.first(F.when(~F.col("errored"), F.col("cache_creation")), ignorenulls=True).over(
        w.rowsBetween(1, BASELINE_WINDOW)
    )
    r = r.select("*", F.sort_array(around).alias("_s"), good.alias("_good")).where("_home")
    n = F.size("_s")
    mid = F.floor(n / 2).cast("int")
    odd = F.get("_s", mid)
    even = half_up((F.get("_s", mid - 1) + F.get("_s", mid)) / 2)
    idle = F.col("errored") & (F.col("cache_creation") == 0) & (F.col("cache_read") == 0)
    return r.select(
        "session_id", "seq",
        F.when(n == 0, F.lit(0)).when(n % 2 == 1, odd).otherwise(even).cast("bigint").alias("cache_baseline"),
        F.when(idle, F.coalesce("_good", "cache_creation")).otherwise(F.col("cache_creation")).alias("rebuild_cost"),
    )


FAN, LEVELS = 1024, 3  # reaches over 2^30 calls of a session


def calls_to_regrow(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Distance from each target row to the next call at least as large.

    ``sizes`` (session_id, seq, size), ``targets`` (session_id, seq, target).
    Maxima over blocks of FAN, FAN² ... calls are searched upwards and the block
    found is opened downwards, so a target meets at most FAN rows per level.
    """
    depth = LEVELS
    levels = [sizes.select("session_id", F.col("seq").alias("idx"), F.col("size").alias("m"))]
    for _ in range(1, depth):
        levels.append(
            levels[-1].groupBy("session_id", F.floor(F.col("idx") / FAN).alias("idx")).agg(F.max("m").alias("m"))
        )
    levels = [lv.withColumn("up", F.floor(F.col("idx") / FAN)) for lv in levels]
    found = None
    for k in range(depth):
        q = targets.select(
            "session_id", "seq", "target", F.floor(F.col("seq") / FAN ** k).alias("qi")
        ).withColumn("up", F.floor(F.col("qi") / FAN))
        hit = (
            q.join(levels[k], ["session_id", "up"])
            .where((F.col("idx") > F.col("qi")) & (F.col("m") >= F.col("target")))
            .groupBy("session_id", "seq", "target").agg(F.min("idx").alias("idx"))
        )
        for down in range(k - 1, -1, -1):
            hit = (
                hit.select("session_id", "seq", "target", F.col("idx").alias("up"))
                .join(levels[down], ["session_id", "up"]).where(F.col("m") >= F.col("target"))
                .groupBy("session_id", "seq", "target").agg(F.min("idx").alias("idx"))
            )
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("session_id", "seq").agg((F.min("idx") - F.col("seq")).alias("calls_to_regrow"))


def efficacy(requests: DataFrame, composition: DataFrame | None = None) -> DataFrame:
    """Every compaction with what it reclaimed, what it cost and a verdict."""
    points = timeline(requests, composition).select("session_id", "seq", "approx_tokens")
    comp = find_compactions(requests).select(
        "session_id", "seq", "ts", "p_seq", "p_items", "transcript_items", "p_ctx", "ctx",
        "cache_creation", "cache_read", "p_cache_read",
    )
    pre = points.select("session_id", F.col("seq").alias("p_seq"), F.col("approx_tokens").alias("pre_tokens"))
    c = comp.join(points, ["session_id", "seq"]).join(pre, ["session_id", "p_seq"], "left")
    c = c.withColumn("pre_tokens", F.coalesce("pre_tokens", "p_ctx"))
    regrow = calls_to_regrow(
        points.withColumnRenamed("approx_tokens", "size"),
        c.select("session_id", "seq", F.col("pre_tokens").alias("target")),
    )
    costs = cache_costs(requests, comp)
    c = c.join(costs, ["session_id", "seq"], "left").join(regrow, ["session_id", "seq"], "left")
    reclaimed = F.greatest(F.lit(0), F.col("pre_tokens") - F.col("approx_tokens"))
    attributable = F.greatest(F.lit(0), F.col("rebuild_cost") - F.col("cache_baseline"))
    pct = F.when(
        F.col("pre_tokens") > 0, F.floor(F.col("reclaimed") / F.col("pre_tokens") * 1000 + 0.5) / 10
    ).otherwise(F.lit(0.0))
    c = c.withColumn("reclaimed", reclaimed).withColumn("attributable", attributable)
    verdict = (
        F.when(F.col("reclaimed") * (1 + RECLAIM_TOLERANCE) < F.col("attributable"), "negative")
        .when(F.col("reclaimed") < TRIVIAL_RECLAIM_TOKENS, "negative")
        .when(F.col("reclaimed") < F.col("attributable"), "marginal")
        .when(F.col("calls_to_regrow") <= SHORT_LIVED_CALLS, "marginal")
        .otherwise("positive")
    )
    return c.select(
        "session_id", "seq", "ts",
        F.col("p_items").alias("from_items"), F.col("transcript_items").alias("to_items"),
        (F.col("p_ctx") - F.col("ctx")).alias("dropped_tokens"),
        "pre_tokens", F.col("approx_tokens").alias("post_tokens"),
        "reclaimed", pct.alias("reclaimed_pct"), F.col("cache_creation").alias("cache_rebuild"),
        F.col("p_cache_read").alias("cache_read_before"), F.col("cache_read").alias("cache_read_after"),
        "cache_baseline", "rebuild_cost", "calls_to_regrow", verdict.alias("verdict"),
    )


# -- concurrency -------------------------------------------------------------

def max_in_flight(requests: DataFrame) -> DataFrame:
    """Most calls open at one instant per session; ends count before starts."""
    r = requests.where("duration_ms > 0")
    start = r.select("session_id", (F.col("ts") * 1000).alias("t"), F.lit(1).alias("d"))
    end = r.select("session_id", span_end_ms().alias("t"), F.lit(-1).alias("d"))
    line = running(
        start.unionByName(end), ["session_id"], F.floor(F.col("t") / 3_600_000), ["t", "d"], sums={"open": F.col("d")}
    )
    return line.groupBy("session_id").agg(F.max("open").alias("max_in_flight"))


def assign_lanes(requests: DataFrame) -> DataFrame:
    """Greedy first-fit lane of each call, by start time then seq.

    All lanes are free when nothing is in flight, so each stretch of activity is
    packed apart.  Rows stream through the packer in order; it holds lane ends only.
    """
    r = requests.select("session_id", "seq", (F.col("ts") * 1000).alias("t0"), span_end_ms().alias("t1"))
    hour = F.floor(F.col("t0") / 3_600_000)
    r = running(r, ["session_id"], hour, ["t0", "seq"], prev_max={"busy_to": F.col("t1")})
    fresh = F.when(F.col("busy_to").isNull() | (F.col("t0") >= F.col("busy_to")), 1).otherwise(0)
    r = running(r, ["session_id"], hour, ["t0", "seq"], sums={"stretch": fresh})
    r = r.select("session_id", "stretch", "seq", "t0", "t1").repartition("session_id", "stretch")
    r = r.sortWithinPartitions("session_id", "stretch", "t0", "seq")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ends = None, []
        for b in batches:
            lanes = []
            for s, g, a, z in zip(b.session_id, b.stretch, b.t0, b.t1):
                if (s, g) != key:
                    key, ends = (s, g), []
                lane = next((i for i, e in enumerate(ends) if e <= a), len(ends))
                if lane == len(ends):
                    ends.append(z)
                else:
                    ends[lane] = z
                lanes.append(lane)
            yield pd.DataFrame({"session_id": b.session_id, "seq": b.seq, "lane": lanes})

    return r.mapInPandas(pack, "session_id string, seq bigint, lane int")


# -- hooks and compactions ---------------------------------------------------

def compaction_triggers(compactions: DataFrame, hooks: DataFrame) -> DataFrame:
    """Each compaction with the nearest PreCompact hook, every hook used once.

    ``compactions`` (session_id, seq, ts), ``hooks`` (session_id, hook_id, ts, trigger).
    Compactions claim in seq order.  Events more than the window apart cannot
    compete, so each cluster of close events is settled on its own.
    """
    gap = HOOK_WINDOW_SEC + HOOK_SLACK_SEC
    kind = F.when(F.col("trigger").isin("manual", "auto"), F.col("trigger")).otherwise(F.lit("unknown"))
    nothing = F.lit(None)
    u = compactions.select(
        "session_id", "ts", F.lit(0).alias("is_hook"), F.col("seq").cast("bigint").alias("id"),
        nothing.cast("string").alias("kind"),
    ).unionByName(
        hooks.select("session_id", "ts", F.lit(1).alias("is_hook"), F.col("hook_id").cast("bigint").alias("id"), kind.alias("kind"))
    )
    order = ["ts", "is_hook", "id"]
    chunk = time_chunk(F.col("ts"))
    u = running(u, ["session_id"], chunk, order, lag={"p_ts": F.col("ts")})
    cut = F.when(F.col("p_ts").isNull() | (F.col("ts") - F.col("p_ts") > gap), 1).otherwise(0)
    u = running(u, ["session_id"], chunk, order, sums={"cluster": cut})

    def claim(g: pd.DataFrame) -> pd.DataFrame:
        comps = g[g.is_hook == 0].sort_values("id")
        free = g[g.is_hook == 1].sort_values(["ts", "id"])
        out = []
        for c in comps.itertuples():
            d = c.ts - free.ts
            near = free[(d >= -HOOK_SLACK_SEC) & (d <= HOOK_WINDOW_SEC)]
            if near.empty:
                continue
            best = (c.ts - near.ts).abs().idxmin()
            h = free.loc[best]
            out.append((c.session_id, c.id, h.id, h.ts, h.kind))
            free = free.drop(best)
        return pd.DataFrame(out, columns=["session_id", "seq", "hook_id", "hook_ts", "kind"])

    # Only clusters holding both sides can yield a claim.
    both = u.groupBy("session_id", "cluster").agg(F.min("is_hook").alias("lo"), F.max("is_hook").alias("hi")).where("lo < hi")
    u = u.join(both.select("session_id", "cluster"), ["session_id", "cluster"], "left_semi")
    return u.select("session_id", "cluster", "ts", "is_hook", "id", "kind").groupBy("session_id", "cluster").applyInPandas(
        claim, "session_id string, seq bigint, hook_id bigint, hook_ts double, kind string"
    )


# -- per-session extremes and rules ------------------------------------------

def session_extremes(requests: DataFrame) -> DataFrame:
    """Slowest call, peak context and largest jump of each session (first wins ties)."""
    d = with_previous(requests, by="seq")
    first = -F.col("seq")
    dur = F.coalesce("duration_ms", F.lit(0))
    jump = F.col("ctx") - F.col("p_ctx")
    return d.groupBy("session_id").agg(
        F.max_by("seq", F.struct(dur, first)).alias("slowest_seq"),
        F.max(dur).alias("slowest_ms"),
        F.max_by("seq", F.struct("ctx", first)).alias("peak_seq"),
        F.max("ctx").alias("peak_context"),
        F.max_by("seq", F.when(F.col("p_ctx").isNotNull(), F.struct(jump, first))).alias("jump_seq"),
        F.max(jump).alias("jump_tokens"),
    )


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """Per session: count and element floor(n/2) of the sorted values."""
    counts = df.groupBy("session_id", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    n = counts.groupBy("session_id").agg(F.sum("_c").alias("n"))
    upto = running(counts, ["session_id"], F.floor(F.col("_v") / 4096), ["_v"], sums={"_upto": F.col("_c")})
    return (
        upto.join(n, "session_id").where(F.col("_upto") > F.floor(F.col("n") / 2))
        .groupBy("session_id").agg(F.first("n").alias("n"), F.min("_v").alias("median"))
    )


def session_insights(requests: DataFrame, busiest: DataFrame | None = None, orphans: DataFrame | None = None) -> DataFrame:
    """Rule rows (session_id, rule, seq, value).

    ``busiest`` (session_id, seq, events) and ``orphans`` (session_id, total,
    orphan, last_seq) add the two rules on events and hooks.
    """
    # Three rules read the extremes: one row a session, written once.
    ext = written(session_extremes(requests), "extremes")
    comp = find_compactions(requests)
    ctx = context_tokens()
    rule = lambda x: F.lit(x).alias("rule")
    val = lambda c: c.cast("double").alias("value")
    comps = comp.groupBy("session_id").agg(
        rule("compaction"), F.min("seq").alias("seq"), val(F.sum(F.col("p_items") - F.col("transcript_items")))
    )
    errs = requests.where("errored").groupBy("session_id").agg(
        rule("error"), F.min("seq").alias("seq"), val(F.count(F.lit(1)))
    )
    rebuilds = requests.where((ctx > 20000) & (F.col("cache_creation") / F.nullif(ctx, F.lit(0)) > 0.5)).groupBy("session_id").agg(
        rule("cache"), F.min("seq").alias("seq"), val(F.sum("cache_creation"))
    )
    med = upper_median(requests.where("duration_ms > 0"), "duration_ms")
    slow = ext.join(med, "session_id").where("n > 4 and median > 0 and slowest_ms > 3 * median").select(
        "session_id", rule("slow"), F.col("slowest_seq").alias("seq"), val(F.col("slowest_ms"))
    )
    growth = ext.where("jump_tokens > 20000").select(
        "session_id", rule("growth"), F.col("jump_seq").alias("seq"), val(F.col("jump_tokens"))
    )
    peak = ext.select("session_id", rule("peak"), F.col("peak_seq").alias("seq"), val(F.col("peak_context")))
    out = comps
    for f in (errs, rebuilds, slow, growth, peak):
        out = out.unionByName(f)
    if busiest is not None:
        out = out.unionByName(
            busiest.where("events >= 5").select("session_id", rule("busy"), "seq", val(F.col("events")))
        )
    if orphans is not None:
        out = out.unionByName(
            orphans.where("orphan > 0").select("session_id", rule("hooks"), F.col("last_seq").alias("seq"), val(F.col("orphan")))
        )
    return out
