"""What a request is made of: segments, buckets, and change from call to call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import items as I
from ..functions.scan import running
from ..functions.text import preview, utf16_len

# The nine buckets, in display order.
BUCKETS = ["system", "tools", "skills", "hook_inject", "user", "assistant", "thinking", "tool_result", "other"]
KEY = ["source_path", "session_id", "seq"]

TOOL_NAME = "coalesce(get_json_object({t}, '$.name'), get_json_object({t}, '$.function.name'), '')"


def system_bucket(t: str) -> str:
    """Bucket of system text: injected by a hook, a skill document, or plain."""
    low = f"lower({t})"
    return (
        f"case when contains({low}, 'additionalcontext') or contains({low}, '[context-health]') "
        f"or contains({low}, 'hookspecificoutput') or ({low} rlike '\\\\bposture\\\\b') then 'hook_inject' "
        f"when {t} rlike '(?i)skill\\\\.md|claude\\\\.md|</?skills?>|\\\\bavailable skills\\\\b' then 'skills' else 'system' end"
    )


def _seg(bucket: str, text: str, kind: str) -> str:
    return f"named_struct('bucket', {bucket}, 'text', cast({text} as string), 'kind', cast({kind} as string))"


NO_SEGS = "cast(array() as array<struct<bucket string, text string, kind string>>)"
_SEG_BLOCK = "type string, text string, thinking string, name string, input string, content string"


def _block_text(b: str, raw: str) -> str:
    """A single block is not a list, so its text is its JSON."""
    return f"case when {b}.thinking is not null and {b}.type in ('thinking', 'reasoning') then {b}.thinking else {raw} end"


def _message_segments(messages: str) -> str:
    head = I.read("msg", "role string, author string, content string, parts string, parts_text string")
    lists = I.read("msg", "content array<string>, parts array<string>")
    opened = f"transform({messages}, msg -> struct({head} as h, {lists} as l))"
    role = "coalesce(m.h.role, m.h.author, 'user')"
    blocks = "coalesce(m.l.content, if(m.h.content is null, m.l.parts, null))"
    bucket = (
        "case when b.b.type in ('thinking', 'reasoning') then 'thinking' "
        "when b.b.type in ('tool_result', 'function_response') then 'tool_result' "
        "when b.b.type in ('tool_use', 'function_call') then 'assistant' "
        f"when {role} in ('assistant', 'model') then 'assistant' when {role} = 'tool' then 'tool_result' else 'user' end"
    )
    kind = f"case when b.b.type is not null then b.b.type when {role} = 'tool' then 'tool' else 'text' end"
    per_block = f"transform(transform({blocks}, blk -> struct(blk as raw, {I.read('blk', _SEG_BLOCK)} as b)), b -> {_seg(bucket, _block_text('b.b', 'b.raw'), kind)})"
    text = "coalesce(m.h.content, m.h.parts, '')"
    single = (
        f"case when {role} in ('assistant', 'model') then 'assistant' when {role} in ('tool', 'function') then 'tool_result' "
        f"when {role} = 'system' then {system_bucket(text)} else 'user' end"
    )
    return f"flatten(transform({opened}, m -> if({blocks} is not null, {per_block}, array({_seg(single, text, role)}))))"


def segments(calls: DataFrame) -> DataFrame:
    """Every non-empty piece of each request body, in order.

    ``calls`` has source_path, session_id, seq and the body text.  ``segment_id``
    is the content address of bucket and text.
    """
    body = I.read("body", (
        "system string, instructions string, tools array<string>, tools_list array<string>, "
        "messages array<string>, input array<string>, contents array<string>"
    ))
    c = calls.selectExpr(*KEY, f"{body} as b", f"{I.read('body', 'system array<string>')}.system as blocks")
    block_text = "coalesce(get_json_object(x, '$.text'), if(trim(x) rlike '^\\\\{', '', x))"
    system = (
        f"case when blocks is not null then transform(transform(blocks, x -> {block_text}), t -> {_seg(system_bucket('t'), 't', repr('system_block'))}) "
        f"when b.system is not null then array({_seg(system_bucket('b.system'), 'b.system', repr('system'))}) "
        f"when b.instructions is not null then array({_seg(repr('system'), 'b.instructions', repr('instructions'))}) else {NO_SEGS} end"
    )
    name = f"coalesce(nullif({TOOL_NAME.format(t='t')}, ''), '(unnamed)')"
    tools = f"transform(coalesce(b.tools, b.tools_list, {I.NO_TEXTS}), t -> {_seg(repr('tools'), 't', f'concat({chr(39)}tool:{chr(39)}, {name})')})"
    messages = f"coalesce(b.messages, b.input, b.contents, {I.NO_TEXTS})"
    s = c.selectExpr(*KEY, f"posexplode(concat({system}, {tools}, {_message_segments(messages)})) as (pos, s)")
    s = s.where("s.text is not null and s.text <> ''").select(*KEY, "pos", "s.*")
    chars = utf16_len(F.col("text"))
    return s.select(
        *KEY, "pos", "bucket", "kind",
        F.substring(F.sha2(F.concat("bucket", F.lit("\0"), "text"), 256), 1, 16).alias("segment_id"),
        chars.alias("chars"), F.ceil(chars / 4).alias("approx_tokens"), preview(F.col("text")).alias("preview"), "text",
    )


def bucket_sizes(segs: DataFrame) -> DataFrame:
    return segs.groupBy(*KEY, "bucket").agg(
        F.sum("chars").alias("chars"), F.sum("approx_tokens").alias("approx_tokens"), F.count(F.lit(1)).alias("segments")
    )


def composition(segs: DataFrame) -> DataFrame:
    """Total size per call with one map bucket -> tokens."""
    b = bucket_sizes(segs)
    return b.groupBy(*KEY).agg(
        F.sum("chars").alias("total_chars"), F.ceil(F.sum("chars") / 4).alias("total_tokens"),
        F.map_from_entries(F.collect_list(F.struct("bucket", "approx_tokens"))).alias("buckets"),
    )


def diff_calls(segs: DataFrame) -> DataFrame:
    """Segments of each call marked new or carried, and those of the call before it
    that it dropped; a first call has none to compare with.  Calls are neighbours by
    seq, so both sides are equi-joins."""
    ids = segs.select(*KEY, "segment_id").distinct()
    before = ids.withColumn("seq", F.col("seq") + 1).withColumn("_seen", F.lit(True))
    cur = segs.where("seq > 0").join(before, [*KEY, "segment_id"], "left").withColumn(
        "change", F.when(F.col("_seen"), "carried").otherwise("new")
    ).drop("_seen")
    has_next = ids.select(*KEY).distinct().withColumn("seq", F.col("seq") - 1)
    later = ids.withColumn("seq", F.col("seq") - 1)
    gone = segs.join(has_next, KEY, "left_semi").join(later, [*KEY, "segment_id"], "left_anti")
    gone = gone.withColumn("seq", F.col("seq") + 1).withColumn("change", F.lit("dropped"))
    return cur.unionByName(gone)


def change_counts(diff: DataFrame) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("change") == k, 1)).alias(k)
    return diff.groupBy(*KEY).agg(n("new"), n("carried"), n("dropped"))


def bucket_changes(sizes: DataFrame) -> DataFrame:
    """Tokens per bucket before and after each call, one-sided buckets included."""
    cols = [*KEY, "bucket"]
    post = sizes.select(*cols, F.col("approx_tokens").alias("post"), "segments")
    calls = sizes.select(*KEY).distinct()
    pre = sizes.select(*cols, F.col("approx_tokens").alias("pre")).withColumn("seq", F.col("seq") + 1)
    pre = pre.join(calls, KEY, "left_semi")
    z = F.lit(0)
    out = post.join(pre, cols, "full_outer").select(
        *cols, F.coalesce("pre", z).alias("pre"), F.coalesce("post", z).alias("post"), F.coalesce("segments", z).alias("segments")
    )
    return out.withColumn("net", F.col("post") - F.col("pre"))


def presence(segs: DataFrame) -> DataFrame:
    """Intervals of calls [lo, hi] in which a segment stands without a break.

    Columns: source_path, session_id, segment_id, lo, hi, n_lo, n_hi (times it stands in the
    first and the last call of the interval).  A transcript that is resent with every call
    is one row a segment here, whatever the number of calls.
    """
    at = segs.groupBy(*KEY, "segment_id").agg(F.count(F.lit(1)).alias("n"))
    keys = ["source_path", "session_id", "segment_id"]
    chunk = F.floor(F.col("seq") / 4096)
    at = running(at, keys, chunk, ["seq"], lag={"p_seq": F.col("seq")})
    opens = F.when(F.col("p_seq").isNull() | (F.col("p_seq") < F.col("seq") - 1), 1).otherwise(0)
    at = running(at, keys, chunk, ["seq"], sums={"island": opens})
    return at.groupBy(*keys, "island").agg(
        F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        F.min_by("n", "seq").alias("n_lo"), F.max_by("n", "seq").alias("n_hi")).drop("island")


def counts_of_calls(segs: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """Per call: segments, new, carried and dropped against the call before it.

    From the ends of intervals: what opens at a call is new, what closed at the call before
    was dropped, the rest is carried.  Calls without a call before them have no counts.
    """
    intervals = presence(segs) if intervals is None else intervals
    session = ["source_path", "session_id"]
    calls = segs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("segments"))
    before = calls.select(*session, (F.col("seq") + 1).alias("seq"), F.lit(True).alias("_follows"))
    opened = intervals.groupBy(*session, F.col("lo").alias("seq")).agg(F.sum("n_lo").alias("new"))
    closed = intervals.groupBy(*session, (F.col("hi") + 1).alias("seq")).agg(F.sum("n_hi").alias("dropped"))
    z = F.lit(0).cast("bigint")
    per = calls.join(before, KEY, "left").join(opened, KEY, "left").join(closed, KEY, "left")
    follows = F.col("_follows").isNotNull()
    new = F.coalesce("new", z)
    return per.select(
        *KEY, "segments", F.when(follows, new).alias("new"), F.when(follows, F.col("segments") - new).alias("carried"),
        F.when(follows, F.coalesce("dropped", z)).alias("dropped"))


def call_windows(counts: DataFrame, radius: int = 0) -> DataFrame:
    """Each call with itself and its neighbours up to ``radius`` calls away: (..., center, seq, counts)."""
    centers = counts.select("source_path", "session_id", F.col("seq").alias("center"), F.explode(
        F.sequence(F.greatest(F.col("seq") - radius, F.lit(0)), F.col("seq") + radius)).alias("seq"))
    return centers.join(counts, KEY)


def call_window(segs: DataFrame, session_id: str, seq: int, radius: int = 0) -> DataFrame:
    """The window of one call.  Only its segments and those of the call before it are read.

    Empty when the session has no such call.
    """
    near = segs.where((F.col("session_id") == session_id) & F.col("seq").between(max(0, seq - radius - 1), seq + radius))
    counts = counts_of_calls(near).where(F.col("seq") >= max(0, seq - radius))
    return call_windows(counts, radius).where(F.col("center") == seq)


# -- declared tools ----------------------------------------------------------

def declared_tools(calls: DataFrame) -> DataFrame:
    """Toolset of each call: content hash, sizes in wire order, totals.

    The hash is over the definitions sorted by name, without their cache marks.
    """
    name = f"coalesce(nullif({TOOL_NAME.format(t='t')}, ''), '(unnamed)')"
    clean = f"to_json(map_filter({I.read('t', 'map<string,string>')}, (k, v) -> k <> 'cache_control'))"
    c = calls.where("size(tools) > 0").selectExpr(
        *KEY, "ts", "provider",
        f"sha2(to_json(array_sort(transform(tools, t -> struct({name} as name, {clean} as def)))), 256) as toolset_hash",
        f"transform(tools, t -> struct({name} as name, cast(octet_length(encode(t, 'UTF-16BE')) / 2 as bigint) as chars, cast(ceil(octet_length(encode(t, 'UTF-16BE')) / 8) as bigint) as approx_tokens)) as per_tool",
    )
    return c.withColumn(
        "total_tokens", F.aggregate("per_tool", F.lit(0).cast("bigint"), lambda a, t: a + t["approx_tokens"])
    )


def toolset_registry(declared: DataFrame) -> DataFrame:
    known = F.when(F.col("ts") > 0, F.col("ts"))
    return declared.groupBy("toolset_hash").agg(
        F.min_by("per_tool", F.struct(*KEY)).alias("per_tool"), F.min_by("provider", F.struct(*KEY)).alias("agent"),
        F.min(known).alias("first_seen"), F.max(known).alias("last_seen"),
    ).withColumn("tool_count", F.size("per_tool"))
