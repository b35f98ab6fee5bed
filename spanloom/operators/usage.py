"""Time-bucketed spend and token reports over usage events."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import like_any
from .pricing import with_cost

TOKENS = ["prompt_tokens", "completion_tokens", "cache_read", "cache_creation", "reasoning_tokens"]


def parse_when(text: str, *, zone: str = "UTC", end_of_day: bool = False, today: date | None = None) -> int:
    """Epoch seconds of ``YYYY-MM-DD``, ``today``, ``yesterday``, ``<N>d`` or a number."""
    tz = ZoneInfo(zone)
    s = text.strip().lower()
    now = today or datetime.now(tz).date()
    if re.fullmatch(r"\d+(\.\d+)?", s):
        return int(float(s))
    if s == "today":
        day = now
    elif s == "yesterday":
        day = now - timedelta(days=1)
    elif re.fullmatch(r"\d+d", s):
        day = now - timedelta(days=int(s[:-1]))
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        day = date.fromisoformat(s)
    else:
        raise ValueError(f"unrecognized date {text!r}: use YYYY-MM-DD, today, yesterday or <N>d")
    start = datetime(day.year, day.month, day.day, tzinfo=tz)
    seconds = int(start.timestamp())
    return seconds + 86_399 if end_of_day else seconds


def local_date(ts: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))


def bucket(ts: Column, granularity: str, zone: str = "UTC") -> Column:
    """Label ``2026-06-11``, ``2026-W24``, ``2026-06`` or ``total``; unknown time apart."""
    if granularity == "total":
        return F.lit("total")
    day = local_date(ts, zone)
    if granularity == "daily":
        label = F.date_format(day, "yyyy-MM-dd")
    elif granularity == "monthly":
        label = F.date_format(day, "yyyy-MM")
    elif granularity == "weekly":
        label = F.concat(
            F.extract(F.lit("YEAROFWEEK"), day).cast("string"),
            F.lit("-W"),
            F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"),
        )
    else:
        raise ValueError(granularity)
    return F.when(ts > 0, label).otherwise(F.lit("unknown"))


def filter_events(
    events: DataFrame,
    *,
    since: float | None = None,
    until: float | None = None,
    agent: str | None = None,
    model: str | None = None,
    project: str | None = None,
) -> DataFrame:
    """Bounds on the event's own time, exact agent, substring of model and project."""
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if until is not None:
        events = events.where(F.col("ts") <= until)
    if agent:
        events = events.where(F.lower("agent") == agent.lower())
    if model:
        events = events.where(like_any(F.col("model"), model))
    if project:
        events = events.where(like_any(F.col("project"), project))
    return events


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOKENS] + [
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_usd"),
        F.max(F.col("cost").isNull()).alias("has_unpriced"),
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("session_id").alias("sessions"),
    ]


def usage_report(
    events: DataFrame, prices: DataFrame, granularity: str, *, breakdown: bool = False, zone: str = "UTC"
) -> DataFrame:
    """One row per bucket, or per bucket and model with ``breakdown``.

    Re-priced at read time; an event without a price falls back to its index-time
    cost.  Without a breakdown the group is the sorted list of agents.
    """
    priced = with_cost(events, prices, stored="cost_usd" if "cost_usd" in events.columns else None)
    priced = priced.withColumn("bucket", bucket(F.col("ts"), granularity, zone))
    if breakdown:
        model = F.when(F.col("model") == "", F.lit(None)).otherwise(F.col("model"))
        return (
            priced.withColumn("group", F.coalesce(model, F.lit("(unknown)")))
            .groupBy("bucket", "group")
            .agg(*_sums())
        )
    agents = F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("group")
    return priced.groupBy("bucket").agg(agents, *_sums())


def usage_totals(events: DataFrame, prices: DataFrame) -> DataFrame:
    priced = with_cost(events, prices, stored="cost_usd" if "cost_usd" in events.columns else None)
    return priced.agg(*_sums())


def unpriced_models(events: DataFrame, prices: DataFrame) -> DataFrame:
    priced = with_cost(events, prices, stored="cost_usd" if "cost_usd" in events.columns else None)
    name = F.when(F.coalesce(F.col("model"), F.lit("")) == "", F.lit("(unknown)")).otherwise(F.col("model"))
    return priced.where(F.col("cost").isNull()).select(name.alias("model")).distinct()


def spend_line(events: DataFrame, prices: DataFrame, as_of: float, zone: str = "UTC") -> DataFrame:
    """Spend of the day and of the month of ``as_of`` (epoch seconds)."""
    now = local_date(F.lit(float(as_of)), zone)
    priced = with_cost(events, prices, stored="cost_usd" if "cost_usd" in events.columns else None)
    day = local_date(F.col("ts"), zone)
    month = priced.where(F.trunc(day, "month") == F.trunc(now, "month"))
    zero = F.lit(0.0)
    return month.agg(
        F.coalesce(F.sum(F.when(day == now, F.col("cost"))), zero).alias("today_usd"),
        F.coalesce(F.sum("cost"), zero).alias("month_usd"),
        F.coalesce(F.max(F.col("cost").isNull()), F.lit(False)).alias("has_unpriced"),
    )
