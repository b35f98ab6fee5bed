"""Hook events: the JSON lines source and the safe previews of raw payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import HOOK

# Fields kept from a hook's input, and of its tool input.
STDIN_KEYS = [
    "session_id", "transcript_path", "cwd", "permission_mode", "hook_event_name", "tool_name", "stop_hook_active",
    "trigger", "tool_use_id", "prompt_id", "agent_id", "agent_type", "source",
]
TOOL_INPUT_KEYS = ["file_path", "path", "command", "pattern", "url", "description"]
FIELD_CAP, PROMPT_CAP, REASON_CAP = 200, 120, 160  # of preview fields; whole texts stand beside them


def parse_hooks(lines: DataFrame) -> DataFrame:
    """Valid events of version 1 with session and event names; time in seconds."""
    opts = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    j = lines.withColumn("j", F.from_json("value", " ".join(HOOK.split()), opts))
    j = j.where("j._bad is null and j.v = 1 and j.session_id <> '' and j.event <> ''")
    ts = F.unix_micros(F.try_to_timestamp(F.col("j.ts"))) / F.lit(1e6)
    stdin = F.coalesce("j.stdin_preview", F.lit("{}"))
    trigger = F.coalesce(F.get_json_object("j.payload", "$.trigger"), F.get_json_object(stdin, "$.trigger"))
    observe = F.get_json_object("j.stdout_preview", "$.observeOnly") == "true"
    return j.select(
        "source_path", "block_start", "row_id",
        F.xxhash64("source_path", "block_start", "row_id").alias("hook_id"),
        F.col("j.session_id").alias("hook_session"), F.coalesce(ts, F.lit(0.0)).alias("ts"), F.col("j.event").alias("event"),
        F.coalesce("j.hook_name", F.lit("")).alias("hook_name"), F.col("j.duration_ms").alias("duration_ms"),
        F.when(F.col("j.decision").isin("block", "allow"), F.col("j.decision")).alias("decision"),
        F.coalesce("j.stdin_digest", F.lit("")).alias("stdin_digest"), stdin.alias("stdin_preview"),
        F.col("j.stdout_preview").alias("stdout_preview"), F.col("j.outcome").alias("outcome"),
        F.col("j.exit_code").alias("exit_code"), F.col("j.payload").alias("payload"),
        F.coalesce(F.get_json_object(stdin, "$.cwd"), F.lit("")).alias("cwd"), trigger.alias("trigger"),
        F.coalesce(observe, F.lit(False)).alias("observe_only"),
    )


def _clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def stdin_preview(raw: Column) -> Column:
    """Allowed fields of a hook's input as JSON; free text only by size and opening."""
    fields = F.from_json(raw, "map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: k.isin(STDIN_KEYS))
    tool = F.map_filter(F.from_json(F.get_json_object(raw, "$.tool_input"), "map<string,string>"), lambda k, v: k.isin(TOOL_INPUT_KEYS))
    tool = F.transform_values(tool, lambda k, v: _clip(v, FIELD_CAP))
    prompt, said = F.get_json_object(raw, "$.prompt"), F.get_json_object(raw, "$.last_assistant_message")
    extra = F.to_json(F.struct(
        F.when(F.size(tool) > 0, tool).alias("tool_input"), F.length(prompt).alias("prompt_chars"),
        _clip(prompt, PROMPT_CAP).alias("prompt_preview"), F.length(said).alias("last_assistant_chars"),
    ))
    base = F.to_json(kept)
    joined = F.when(extra == "{}", base).when(base == "{}", extra).otherwise(
        F.concat(F.left(base, F.length(base) - 1), F.lit(","), F.substring(extra, 2, 1 << 30))
    )
    return F.when(F.trim(raw).startswith("{"), joined).otherwise(F.lit('{"kind":"other"}'))


def stdout_preview(stdout: Column, wrapped: Column) -> Column:
    """What a hook returned, as JSON; an empty one tells whether it could return."""
    t = F.trim(stdout)
    get = lambda p: F.get_json_object(t, p)
    parsed = F.try_parse_json(t).isNotNull() & t.startswith("{")
    reason, ctx = get("$.reason"), get("$.hookSpecificOutput.additionalContext")
    body = F.to_json(F.struct(
        F.length(t).alias("chars"), t.alias("text"), F.when(parsed, F.lit(True)).alias("parsed"),
        F.when(parsed, get("$.decision")).alias("decision"), F.when(parsed, F.length(reason)).alias("reason_chars"),
        F.when(parsed, _clip(reason, REASON_CAP)).alias("reason_preview"), F.when(parsed, reason).alias("reason"),
        F.when(parsed, F.length(ctx)).alias("additional_context_chars"),
        F.when(parsed, _clip(ctx, REASON_CAP)).alias("additional_context_preview"),
        F.when(parsed, ctx).alias("additional_context"),
        F.when(parsed, get("$.continue").cast("boolean")).alias("continue"),
        F.when(parsed, F.try_parse_json(t)).alias("returned"), F.when(~parsed, _clip(t, REASON_CAP)).alias("preview"),
    ))
    empty = F.concat(F.lit('{"chars":0,"empty":true,"observeOnly":'), (~wrapped).cast("string"), F.lit("}"))
    return F.when(t == "", empty).otherwise(body)


def decision(stdout: Column, exit_code: Column) -> Column:
    said = F.get_json_object(F.trim(stdout), "$.decision")
    return F.when(said.isin("block", "allow"), said).when(exit_code == 2, "block")


def outcome(decided: Column, exit_code: Column) -> Column:
    blocked = F.coalesce(decided == "block", F.lit(False)) | (exit_code == 2)
    return F.when(blocked, "blocked").when(exit_code != 0, "error").otherwise("ok")
