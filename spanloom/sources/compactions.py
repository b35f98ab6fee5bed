"""Compactions recorded in session transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RECORD = (
    "subtype string, sessionId string, cwd string, timestamp string, compactMetadata struct<trigger string, preTokens double, "
    "postTokens double, cumulativeDroppedTokens double, durationMs double, preservedMessages struct<uuids array<string>>, userContext string>"
)


def parse_compactions(lines: DataFrame) -> DataFrame:
    """Boundary records with both sizes; other lines are passed over unparsed."""
    r = lines.where(F.contains("value", F.lit("compact_boundary"))).select("source_path", F.from_json("value", _RECORD).alias("j"))
    m = "j.compactMetadata"
    r = r.where(f"j.subtype = 'compact_boundary' and {m}.preTokens is not null and {m}.postTokens is not null")
    ts = F.unix_micros(F.try_to_timestamp(F.col("j.timestamp"))) / F.lit(1e6)
    n = lambda c: F.col(f"{m}.{c}").cast("bigint")
    return r.select(
        "source_path", F.coalesce("j.sessionId", F.lit("")).alias("client_session_id"), F.coalesce(ts, F.lit(0.0)).alias("ts"),
        F.coalesce(f"{m}.trigger", F.lit("unknown")).alias("trigger"), n("preTokens").alias("pre_tokens"),
        n("postTokens").alias("post_tokens"), (n("preTokens") - n("postTokens")).alias("dropped_tokens"),
        n("cumulativeDroppedTokens").alias("cumulative_dropped"), n("durationMs").alias("duration_ms"),
        F.when(F.col(f"{m}.preservedMessages.uuids").isNotNull(), F.size(f"{m}.preservedMessages.uuids")).alias("preserved"),
        F.col("j.cwd").alias("cwd"), F.col(f"{m}.userContext").alias("user_context"),
    )


def distinct_compactions(records: DataFrame) -> DataFrame:
    """One record per client session, time and size; of several the last file's."""
    key = ["client_session_id", "ts", "pre_tokens"]
    row = F.struct(*records.columns)
    return records.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(row, "source_path").alias("r")).select("r.*")


def recorded_for_sessions(records: DataFrame, sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of each session's client id, marked where only sub-agents called."""
    kind = requests.groupBy("session_id").agg(F.min("is_subagent").alias("subagent_only"))
    s = sessions.where("client_session_id is not null").select("session_id", "client_session_id")
    return s.join(distinct_compactions(records), "client_session_id").join(kind, "session_id", "left")


def by_trigger(recorded: DataFrame) -> DataFrame:
    return recorded.groupBy("session_id", "trigger").agg(
        F.count(F.lit(1)).alias("compactions"), F.sum("dropped_tokens").alias("dropped_tokens")
    )
