"""Trajectory documents for interchange."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.secrets import redact
from .identity import contains_join

# Fixed value: version of the document layout.
SCHEMA_VERSION = "ATIF-v1.7"


def iso_time(ts: Column) -> Column:
    """Seconds or milliseconds to ISO 8601 in UTC; NULL when unknown."""
    sec = F.when(ts < 1e12, ts).otherwise(ts / 1000)
    stamp = F.date_format(F.timestamp_millis(F.floor(sec * 1000 + 0.5).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(ts > 0, stamp)


def _nonzero(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c))


def _empty_as_null(s: Column, *fields: str) -> Column:
    present = s[fields[0]].isNotNull()
    for f in fields[1:]:
        present = present | s[f].isNotNull()
    return F.when(present, s)


def export_steps(steps: DataFrame, heads: DataFrame, mode: str = "standard") -> DataFrame:
    """One JSON text per step, secrets redacted unless ``mode`` is ``off``."""
    clean = (lambda c: redact(c, mode)) if mode != "off" else (lambda c: c)
    s = steps.join(heads, ["source_path", "session_id"])
    agent = F.col("role") == "agent"
    args = lambda a: F.when(F.coalesce(F.trim(a), F.lit("")) == "", F.lit("{}")).when(
        F.trim(a).startswith("{"), a).otherwise(F.to_json(F.struct(a.alias("value"))))
    calls = F.when(agent & (F.size("tool_calls") > 0), F.transform("tool_calls", lambda c: F.struct(
        F.coalesce(c["id"], F.lit("")).alias("tool_call_id"), F.coalesce(c["name"], F.lit("")).alias("function_name"),
        F.try_parse_json(args(clean(c["args"]))).alias("arguments"))))
    results = F.when(F.size("results") > 0, F.struct(F.transform("results", lambda r: F.struct(
        F.coalesce(clean(r["text"]), F.lit("")).alias("content"),
        F.nullif(r["call_id"], F.lit("")).alias("source_call_id"))).alias("results")))
    extra = F.struct(
        _nonzero("cache_creation").alias("cache_creation_input_tokens"), _nonzero("cache_read").alias("cache_read_input_tokens"),
        F.col("reasoning_tokens").alias("reasoning_tokens"),
    )
    metrics = F.when(agent & F.col("has_usage"), F.struct(
        "prompt_tokens", "completion_tokens", (F.col("cache_creation") + F.col("cache_read")).alias("cached_tokens"),
        _empty_as_null(extra, "cache_creation_input_tokens", "cache_read_input_tokens", "reasoning_tokens").alias("extra")))
    doc = F.struct(
        F.col("step_index").alias("step_id"), F.col("role").alias("source"), clean(F.col("message")).alias("message"),
        iso_time(F.col("ts")).alias("timestamp"),
        F.when(agent & (F.col("model") != "unknown"), F.col("model")).alias("model_name"),
        F.when(agent & (F.col("reasoning") != ""), clean(F.col("reasoning"))).alias("reasoning_content"),
        calls.alias("tool_calls"), metrics.alias("metrics"), results.alias("observation"),
    )
    return s.select("source_path", "session_id", "step_index", F.to_json(doc).alias("step"))


def last_tools(calls: DataFrame) -> DataFrame:
    """The last non-empty tool list of each session, as JSON objects."""
    at = F.struct("block_start", "row_id")
    objects = F.filter("tools", lambda t: F.trim(t).startswith("{"))
    t = calls.withColumn("defs", objects).where("size(defs) > 0")
    return t.groupBy("source_path", "session_id").agg(F.max_by("defs", at).alias("defs")).select(
        "source_path", "session_id", F.concat(F.lit("["), F.array_join("defs", ","), F.lit("]")).alias("tool_definitions")
    )


def export_documents(
    steps: DataFrame, heads: DataFrame, calls: DataFrame | None = None, *, mode: str = "standard",
    version: str = "unknown", per_part: int | None = None,
) -> DataFrame:
    """One document per trajectory: agent, steps, final metrics.

    Where ``per_part`` is given every trajectory is written as numbered parts of so
    many steps; every step is in exactly one part.
    """
    key = ["source_path", "session_id"]
    one = export_steps(steps, heads, mode).withColumn(
        "part", F.lit(0).cast("bigint") if per_part is None else F.floor((F.col("step_index") - 1) / F.lit(per_part)))
    parts = one.groupBy(*key, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_index", "step"))), lambda x: x["step"]), ",").alias("steps")
    )
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    totals = steps.groupBy(*key).agg(
        z("prompt_tokens"), z("completion_tokens"), z("cache_creation"), z("cache_read"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"), F.count(F.lit(1)).alias("n"),
    )
    extra = F.struct(
        _nonzero("cache_creation").alias("total_cache_creation_input_tokens"),
        _nonzero("cache_read").alias("total_cache_read_input_tokens"), F.col("reasoning_tokens").alias("total_reasoning_tokens"),
    )
    final = F.to_json(F.struct(
        F.col("prompt_tokens").alias("total_prompt_tokens"), F.col("completion_tokens").alias("total_completion_tokens"),
        (F.col("cache_creation") + F.col("cache_read")).alias("total_cached_tokens"), F.col("n").alias("total_steps"),
        _empty_as_null(extra, *["total_cache_creation_input_tokens", "total_cache_read_input_tokens", "total_reasoning_tokens"]).alias("extra"),
    ))
    d = parts.join(totals, key).join(heads, key)
    if calls is not None:
        d = d.join(last_tools(calls), key, "left")
    else:
        d = d.withColumn("tool_definitions", F.lit(None).cast("string"))
    agent = F.to_json(F.struct(
        F.col("agent").alias("name"), F.lit(version).alias("version"),
        F.when(F.col("model") != "unknown", F.col("model")).alias("model_name"),
        F.try_parse_json("tool_definitions").alias("tool_definitions"),
    ))
    ids = F.to_json(F.struct(F.col("session_id").alias("session_id"), F.col("session_id").alias("trajectory_id")))
    doc = F.concat(
        F.lit('{"schema_version":"' + SCHEMA_VERSION + '","agent":'), agent, F.lit(',"steps":['), "steps",
        F.lit('],"final_metrics":'), final, F.lit(","), F.expr("substring(_ids, 2)"),
    )
    return d.withColumn("_ids", ids).select(*key, "part", doc.alias("document"))


def nest_children(tasks: DataFrame, children: DataFrame) -> DataFrame:
    """Parent's Task calls with the child trajectory each started, used once.

    ``tasks`` (source_path, parent_id, task_no, call_id, prompt), ``children``
    (source_path, child_no, child_id, first_user), both numbered from 0.  In order, a
    task takes the first unused child whose text holds the prompt or is held by it,
    else the unused child at its own number.  Only logs with exactly one parent are
    nested.  The claims of a log depend on each other, so they are settled together
    on numbers and hashes alone; texts are matched before, by shared grams.
    """
    key = ["source_path"]
    one = tasks.groupBy("source_path").agg(F.min("parent_id").alias("lo"), F.max("parent_id").alias("hi")).where("lo = hi")
    t = tasks.join(one.select("source_path"), "source_path", "left_semi").withColumn("h", F.xxhash64("prompt"))
    prompts = t.where("prompt <> ''").select("source_path", "prompt", "h").distinct()
    c = children.where("first_user <> ''").select("source_path", "child_no", "first_user")
    held = contains_join(c, prompts, key, "first_user", "prompt", ["child_no"], ["h"])
    holds = contains_join(prompts, c, key, "prompt", "first_user", ["h"], ["child_no"])
    cand = held.select("source_path", "h", "child_no").unionByName(holds.select("source_path", "h", "child_no")).distinct()
    n = children.groupBy("source_path").agg((F.max("child_no") + 1).alias("n"))
    rows = (
        cand.select("source_path", "h", F.col("child_no").cast("bigint").alias("no"), F.lit(0).alias("is_task"))
        .unionByName(t.select("source_path", "h", F.col("task_no").cast("bigint").alias("no"), F.lit(1).alias("is_task")))
        .join(n, "source_path")
    )

    def claim(g: pd.DataFrame) -> pd.DataFrame:
        matches = {h: iter(sorted(x.no)) for h, x in g[g.is_task == 0].groupby("h")}
        used, out, size = set(), [], int(g.n.iloc[0])
        for task in g[g.is_task == 1].sort_values("no").itertuples():
            found = next((x for x in matches.get(task.h, ()) if x not in used), None)
            if found is None and task.no < size and task.no not in used:
                found = task.no
            if found is not None:
                used.add(found)
                out.append((task.source_path, task.no, found))
        return pd.DataFrame(out, columns=["source_path", "task_no", "child_no"])

    claimed = rows.groupBy("source_path").applyInPandas(claim, "source_path string, task_no bigint, child_no bigint")
    named = claimed.join(children.select("source_path", "child_no", "child_id"), ["source_path", "child_no"])
    return named.join(tasks.select("source_path", "parent_id", "task_no", "call_id"), ["source_path", "task_no"])
