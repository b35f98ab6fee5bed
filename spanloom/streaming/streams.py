"""Streaming forms: ingest, live steps, running spend, hook matching, alerts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.secrets import DETECTORS, Detector, find, fingerprint
from ..operators.normalize import normalize_pairs
from ..operators.pricing import cost
from ..sources.pairs import parse_pairs


def read_pair_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Pairs of new log files; a collector rolls files, Spark takes each once.

    Within a split of a file ``row_id`` ascends with the lines, as in a batch.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.jsonl").text(path)
    lines = lines.select(
        "value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block_start"))
    return parse_pairs(lines.mapInArrow(
        _numbered, "value string, source_path string, block_start bigint, row_id bigint"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the lines of each split; a task reads a split from its start, in order."""
    seen: dict[tuple[str, int], int] = {}
    for b in batches:
        ids = []
        for split in zip(b.column("source_path").to_pylist(), b.column("block_start").to_pylist()):
            ids.append(seen.get(split, 0))
            seen[split] = ids[-1] + 1
        yield b.append_column("row_id", pa.array(ids, pa.int64()))


def stream_calls(pairs: DataFrame) -> DataFrame:
    """Stateless: one row per call with its counters and event time."""
    c = normalize_pairs(pairs)
    return c.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("bigint"))).withColumn(
        "model", F.coalesce("resp_model", "req_model")
    )


def without_resent(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A call delivered again within the delay counts once.

    A call is known by its session, time and content, so that calls of one instant stay apart.
    """
    content = F.xxhash64(F.to_json(F.struct("req_items", "resp_items", "usage")))
    marked = calls.withColumn("_content", content).withWatermark("event_time", delay)
    return marked.dropDuplicatesWithinWatermark(["session_id", "event_time", "_content"]).drop("_content")


def running_spend(calls: DataFrame, rates: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Spend and tokens per time window and model; ``rates`` is a static table
    (model, rates) of resolved prices."""
    c = calls.select("event_time", "model", "usage.*").where("prompt_tokens is not null").withWatermark("event_time", delay)
    c = c.join(rates, "model", "left").withColumn("cost", cost())
    win = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return c.groupBy(win, "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost_usd"),
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "model", "calls", "prompt_tokens", "completion_tokens", "cost_usd")


def latest_rows(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink: files sent again replace the rows of their source."""
    from ..sources.sinks import overwrite_sources

    overwrite_sources(batch, path)


class LiveSteps(StatefulProcessor):
    """New user messages, results and agent steps of a session as calls arrive.

    State per session: how many user messages and results were shown, the number
    of steps, the latest agent step, and the step of each call id.  It is kept for
    good unless ``idle_ms`` is given; a session that goes on after that starts anew.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.idle_ms}
        self.cursor = handle.getValueState("cursor", "users bigint, results bigint, steps bigint, agent_step bigint", **ttl)
        self.issued = handle.getMapState("issued", "call_id string", "step bigint", **ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.cursor.get() if self.cursor.exists() else (0, 0, 0, 0)
        users, results, steps, agent = (int(x) for x in seen)
        out = []
        calls = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for c in calls.itertuples():
            texts = list(c.users)
            for t in texts[users:]:
                if t and t.strip():
                    steps += 1
                    out.append((steps, "user", t, None))
            users = max(users, len(texts))
            got = list(c.results)
            for r in got[results:]:
                call_id = r["call_id"] or ""
                known = call_id and self.issued.containsKey((call_id,))
                at = int(self.issued.getValue((call_id,))[0]) if known else agent
                if at:
                    out.append((at, "result", r["text"], call_id))
            results = max(results, len(got))
            if c.produced:
                steps += 1
                agent = steps
                out.append((steps, "agent", c.message, None))
                for call_id in c.call_ids:
                    if call_id:
                        self.issued.updateValue((call_id,), (steps,))
        self.cursor.update((users, results, steps, agent))
        frame = pd.DataFrame(out, columns=["step_index", "kind", "text", "call_id"])
        frame.insert(0, "session_id", key[0])
        yield frame

    def close(self) -> None:
        pass


LIVE_SCHEMA = "session_id string, step_index bigint, kind string, text string, call_id string"


def live_steps(calls: DataFrame) -> DataFrame:
    """Events (step, kind, text) of every session; needs the RocksDB state store."""
    c = calls.selectExpr(
        "session_id", "ts", "size(resp_items) > 0 or usage is not null as produced",
        "transform(filter(req_items, x -> x.kind = 'message' and x.role = 'user'), x -> x.text) as users",
        "transform(filter(req_items, x -> x.kind = 'tool_result'), x -> struct(x.call_id as call_id, x.text as text)) as results",
        "array_join(transform(filter(resp_items, x -> x.kind = 'message'), x -> x.text), '') as message",
        "transform(filter(resp_items, x -> x.kind = 'tool_call'), x -> x.call_id) as call_ids",
    )
    return c.groupBy("session_id").transformWithStateInPandas(LiveSteps(), LIVE_SCHEMA, "Append", "ProcessingTime")


def match_hooks(calls: DataFrame, hooks: DataFrame, before: str = "5 seconds", after: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """Calls with the hooks of their client session fired shortly before.

    ``calls`` and ``hooks`` have client_session_id and event_time; the two streams
    are joined on an interval of time, so state is dropped behind the watermark.
    """
    c = calls.withWatermark("event_time", delay).alias("c")
    h = hooks.withWatermark("event_time", delay).alias("h")
    near = F.expr(
        f"c.client_session_id = h.client_session_id and h.event_time >= c.event_time - interval {after} "
        f"and h.event_time <= c.event_time + interval {before}"
    )
    return c.join(h, near, "inner")


def secret_alerts(texts: DataFrame, window: str = "10 minutes", delay: str = "10 minutes", mode: str = "standard", detectors: list[Detector] = DETECTORS) -> DataFrame:
    """Findings per secret and time window; ``texts`` has event_time and text."""
    f = texts.withWatermark("event_time", delay).select("event_time", F.explode(find(F.col("text"), mode, detectors)).alias("f"))
    return f.groupBy(
        F.window("event_time", window), F.col("f.kind").alias("detector"), fingerprint(F.col("f.token")).alias("fingerprint")
    ).agg(F.count(F.lit(1)).alias("hits")).select(F.col("window.start").alias("start"), "detector", "fingerprint", "hits")
