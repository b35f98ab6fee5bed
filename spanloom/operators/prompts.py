"""Registry of system prompts over the requests table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up


def prompt_uses(requests: DataFrame, agent: str | None = None) -> DataFrame:
    """Per prompt hash: first and last known use, calls and distinct sessions."""
    r = requests.where("prompt_hash <> ''")
    if agent:
        r = r.where(F.lower("agent") == agent.lower())
    return registry(session_uses(r))


def session_uses(requests: DataFrame) -> DataFrame:
    """Per prompt hash and session: first and last known use and calls."""
    known = F.when(F.col("ts") > 0, F.col("ts"))
    return requests.groupBy("prompt_hash", "session_id").agg(
        F.min(known).alias("first_seen"), F.max(known).alias("last_seen"), F.count(F.lit(1)).alias("requests"),
    )


def registry(uses: DataFrame) -> DataFrame:
    """Prompts of ``session_uses`` rows; a session is counted once."""
    return uses.groupBy("prompt_hash").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("requests").alias("requests"), F.countDistinct("session_id").alias("sessions"),
    )


def list_prompts(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest use first, with the size of the text."""
    out = registry.withColumn("chars", F.length("content")).withColumn("approx_tokens", half_up(F.col("chars") / 4))
    out = out.drop("content").orderBy(F.desc_nulls_last("last_seen"), "prompt_hash")
    return out.limit(max(1, limit)) if limit is not None else out


def merge_registry(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two sets of ``session_uses`` rows as one: earliest first use, latest last use, calls added.

    Sessions stay rows, so that one in both sets is still one for ``registry``.
    """
    return known.unionByName(fresh).groupBy("prompt_hash", "session_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("requests").alias("requests"),
    )


def find_prompt(uses: DataFrame, prefix: str) -> DataFrame:
    """The prompt with this hash or hash prefix; of several the last used."""
    hit = uses.where(F.col("prompt_hash").startswith(prefix))
    return hit.orderBy(F.desc_nulls_last("last_seen"), "prompt_hash").limit(1)


def prompt_sessions(requests: DataFrame, prefix: str) -> DataFrame:
    """Sessions using that prompt with their last use."""
    chosen = find_prompt(prompt_uses(requests), prefix).select("prompt_hash")
    return requests.join(chosen, "prompt_hash").groupBy("prompt_hash", "session_id").agg(
        F.max("ts").alias("last_ts")
    )


def comparable_versions(agents: DataFrame, prompt_hash: str) -> DataFrame:
    """Other prompts of the same agent as the given one."""
    own = agents.where(F.col("prompt_hash") == prompt_hash).select("agent").distinct()
    return agents.join(own, "agent", "left_semi").where(F.col("prompt_hash") != prompt_hash)
