"""Hooks of live sessions: by clock within ten minutes, and one hook for each compaction."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.context import HOOK_SLACK_SEC, HOOK_WINDOW_SEC
from ..operators.hooks import SLACK_SEC, norm_cwd


def hooks_near_sessions(calls: DataFrame, hooks: DataFrame, *, slack: int = SLACK_SEC, delay: str = "10 minutes") -> DataFrame:
    """Hooks that fired within ``slack`` seconds of a call of a session that has no client id.

    ``calls`` has session_id, client_session_id, project and event_time; ``hooks`` hook_id,
    cwd and event_time.  A hook that names another project is left out.  Each session and
    hook meet once, at the first call in reach.  Rows meet in blocks of ``slack`` seconds,
    so a project with most of the calls is dealt out by time, and both watermarks bound the
    interval, so state is dropped behind it.  A pair is known by session and hook for as
    long as calls that can repeat it may come.
    """
    block = F.floor(F.unix_timestamp("event_time") / slack)
    c = calls.where("client_session_id is null").select(
        "session_id", norm_cwd(F.col("project")).alias("project"), F.col("event_time").alias("call_time"), block.alias("block"),
    ).withWatermark("call_time", delay)
    h = hooks.select(
        "hook_id", norm_cwd(F.col("cwd")).alias("cwd"), F.col("event_time").alias("hook_time"),
        F.explode(F.array(block - 1, block, block + 1)).alias("hook_block"),
    ).withWatermark("hook_time", delay)
    near = F.expr(
        f"block = hook_block and hook_time between call_time - interval {slack} seconds and call_time + interval {slack} seconds "
        "and (project = '' or cwd = '' or project = cwd)")
    met = c.join(h, near).select("session_id", "hook_id", "hook_time")
    return met.dropDuplicatesWithinWatermark(["session_id", "hook_id"])


class Claims(StatefulProcessor):
    """Nearest hook for each compaction of a conversation, every hook used once, in time order.

    A compaction is settled when the watermark has passed the last moment at which a hook of
    it may fire.  State holds compactions that wait and hooks that one of them, or one still
    to come, can claim: two minutes of a conversation at most behind the watermark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts double, seq bigint")
        self.free = handle.getListState("free", "ts double, hook_id bigint, kind string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for b in rows:
            for r in b[b.is_hook == 1].itertuples():
                self.free.appendValue((float(r.ts), int(r.id), r.kind))
            for r in b[b.is_hook == 0].itertuples():
                self.waiting.appendValue((float(r.ts), int(r.id)))
                self.handle.registerTimer(int((r.ts + HOOK_SLACK_SEC) * 1000) + 1)
            # a hook that nobody claims has to go as well
            for r in b[b.is_hook == 1].itertuples():
                self.handle.registerTimer(int((r.ts + HOOK_WINDOW_SEC) * 1000) + 1)
        yield pd.DataFrame(columns=_CLAIM)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() / 1000
        free = sorted(tuple(x) for x in self.free.get()) if self.free.exists() else []
        out, later = [], []
        for ts, seq in sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []:
            if ts + HOOK_SLACK_SEC >= now:
                later.append((ts, seq))
                continue
            near = [(abs(ts - h[0]), k) for k, h in enumerate(free) if -HOOK_SLACK_SEC <= ts - h[0] <= HOOK_WINDOW_SEC]
            if near:
                at, hook_id, kind = free.pop(min(near)[1])
                out.append((key[0], seq, hook_id, at, kind))
        oldest = min([ts for ts, _ in later] + [now])
        for state, rows in ((self.waiting, later), (self.free, [h for h in free if h[0] >= oldest - HOOK_WINDOW_SEC])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        yield pd.DataFrame(out, columns=_CLAIM)

    def close(self) -> None:
        pass


_CLAIM = ["session_id", "seq", "hook_id", "hook_ts", "kind"]


def claim_hooks(compactions: DataFrame, hooks: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """The stream form of ``context.compaction_triggers``: session_id, seq, hook_id, hook_ts, kind.

    ``compactions`` (session_id, seq, ts), ``hooks`` (session_id, hook_id, ts, trigger), two
    streams.  Claims come once the watermark has settled them and are never taken back.
    Needs the RocksDB state store.
    """
    kind = F.when(F.col("trigger").isin("manual", "auto"), F.col("trigger")).otherwise(F.lit("unknown"))
    rows = compactions.select(
        "session_id", "ts", F.lit(0).alias("is_hook"), F.col("seq").cast("bigint").alias("id"), F.lit("").alias("kind"),
    ).unionByName(hooks.select("session_id", "ts", F.lit(1).alias("is_hook"), F.col("hook_id").cast("bigint").alias("id"), kind.alias("kind")))
    timed = rows.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("bigint"))).withWatermark("event_time", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(
        Claims(), "session_id string, seq bigint, hook_id bigint, hook_ts double, kind string", "Append", "EventTime")
