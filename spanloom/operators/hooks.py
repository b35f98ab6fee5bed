"""Attribution of hook events to sessions, calls and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import edge_chunk, stab_counts, stab_join, with_edges
from ..functions.scan import halo, running, time_chunk
from ..functions.text import collapse
from ..session import written

SLACK_SEC = 600
OPEN_END = 4e9  # an open end, beyond any time recorded


def norm_cwd(c: Column) -> Column:
    """Working directory without trailing separators; '' when absent."""
    bare = F.regexp_replace(c, r"[\\/]+$", "")
    return (
        F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(""))
        .when(bare == "", F.lit("/")).otherwise(bare)
    )


def signal_hooks(hooks: DataFrame) -> DataFrame:
    """Hooks that could return something (taps that only observe are hidden)."""
    return hooks.where(~F.coalesce("observe_only", F.lit(False)))


def prune_observe_only(hooks: DataFrame, dry_run: bool = False) -> DataFrame:
    """The hooks left after pruning; with ``dry_run`` the number that would go."""
    if dry_run:
        return hooks.agg(F.count(F.when(F.col("observe_only"), 1)).alias("matched"))
    return signal_hooks(hooks)


def hook_owner(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """The one session per client id that lists its hooks: most main-thread calls,
    then earliest start, then id."""
    main = requests.where("not is_subagent").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_main"))
    s = sessions.where("client_session_id is not null").join(main, "session_id", "left")
    return s.groupBy("client_session_id").agg(F.min_by("session_id", _owner_rank()).alias("session_id"))


def _owner_rank() -> Column:
    return F.struct(-F.coalesce("n_main", F.lit(0)), F.col("started_at"), F.col("session_id"))


def _fence(df: DataFrame) -> DataFrame:
    project, cwd = norm_cwd(F.col("project")), norm_cwd(F.col("cwd"))
    return df.where((project == "") | (cwd == "") | (cwd == project))


def _window(sessions: DataFrame, *cols: str) -> DataFrame:
    """Session window widened by the slack; unknown start is 0, unknown end open."""
    lo = F.when(F.col("started_at") > 0, F.col("started_at") - SLACK_SEC).otherwise(F.lit(0.0))
    hi = F.when(F.col("ended_at") > 0, F.col("ended_at") + SLACK_SEC).otherwise(F.lit(OPEN_END))
    return sessions.select("session_id", *cols, F.greatest(lo, F.lit(0.0)).alias("w_lo"), hi.alias("w_hi"))


def hook_places(sessions: DataFrame, requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """(session_id, project, hook_session, w_lo, w_hi): which hooks a session shows.

    Those of its own id, else of its client id when it is the owner; ``hook_session``
    names them.  Sessions without client id show the hooks inside their window, and
    have NULL there.  A session has one row at most.
    """
    keyed = hooks.select(F.col("hook_session").alias("session_id"), F.lit(True).alias("_own")).distinct()
    main = requests.where("not is_subagent").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_main"))
    s = sessions.join(keyed, "session_id", "left").join(main, "session_id", "left")
    s = written(s.select("session_id", "project", "started_at", "ended_at", "client_session_id", "_own", "n_main"), "sessions")
    always = [F.lit(float("-inf")).alias("w_lo"), F.lit(float("inf")).alias("w_hi")]
    direct = s.where("_own").select("session_id", "project", F.col("session_id").alias("hook_session"), *always)
    first = F.min_by(F.struct("session_id", "project", "_own"), _owner_rank()).alias("o")
    owner = s.where("client_session_id is not null").groupBy("client_session_id").agg(first)
    owned = owner.where("o._own is null").select("o.session_id", "o.project", F.col("client_session_id").alias("hook_session"), *always)
    timed = _window(s.where("_own is null and client_session_id is null"), "project")
    timed = timed.withColumn("hook_session", F.lit(None).cast("string"))
    return direct.unionByName(owned).unionByName(timed)


def _wanted(places: DataFrame) -> DataFrame:
    """A row per key ``_p`` of hooks that can be meant: a session meets hooks of its
    project and hooks without one; a session without project meets every hook."""
    project = norm_cwd(F.col("project"))
    in_project = F.array(F.concat(F.lit("="), project), F.lit("="))
    return places.withColumn("_p", F.explode(F.when(project == "", F.array(F.lit("*"))).otherwise(in_project))).drop("project")


def _keyed_points(hooks: DataFrame) -> DataFrame:
    """Each hook under the keys of ``_wanted``."""
    own = F.concat(F.lit("="), norm_cwd(F.col("cwd")))
    return hooks.withColumn("_p", F.explode(F.array(own, F.lit("*"))))


def _by_time(places: DataFrame) -> DataFrame:
    return _wanted(places.where("hook_session is null").drop("hook_session"))


def _of_one_session(timed: DataFrame, hooks: DataFrame) -> DataFrame:
    """Sessions (matched by time) whose hooks are all of one hook session.

    In time order a window holds one hook session if the run of equal ones that its last
    hook belongs to began no later than its first; nothing is paired for that.
    """
    p = _keyed_points(hooks.where("hook_session is not null and ts is not null").select("hook_id", "hook_session", "ts", "cwd")).drop("cwd")
    p = running(p, ["_p"], time_chunk(F.col("ts")), ["ts", "hook_id"], number="_rank", lag={"_before": F.col("hook_session")})
    began = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("hook_session")), F.col("_rank"))
    p = p.select("_p", "ts", F.col("hook_id").alias("_id"), "hook_session", began.alias("_began"))
    line = with_edges(p, timed, ["_p"], ["session_id"], "ts", "w_lo", "w_hi", F.lit(True))
    line = running(
        line, ["_p"], edge_chunk(), ["_t", "_k", "_id"], sums={"_upto": F.when(F.col("_k") == 1, 1).otherwise(0)},
        last={"_run": F.col("_began"), "_last": F.col("hook_session")},
    ).where("_side is not null")
    at = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    one = line.groupBy("session_id", "_p").agg(
        at(-1, "_upto").alias("below"), at(1, "_upto").alias("upto"), at(1, "_run").alias("run"), at(1, "_last").alias("last")
    ).where("upto > below")
    return one.groupBy("session_id").agg(
        (F.max(F.col("run") > F.col("below")) | (F.min("last") != F.max("last"))).alias("_several")
    ).where("not _several").select("session_id", F.lit(True).alias("_one"))


def hooks_by_time(sessions: DataFrame, hooks: DataFrame) -> DataFrame:
    """Hooks inside the window of sessions that carry no client id.

    A hook naming another project is dropped; one that names its project joins on
    it.  Where a session is matched by several hook sessions the payload is withheld;
    that is known before hooks and sessions are paired, so that pairs are not shuffled.
    """
    return _hooks_in_windows(_wanted(_window(sessions.where("client_session_id is null"), "project")), hooks)


def _hooks_in_windows(timed: DataFrame, hooks: DataFrame) -> DataFrame:
    s = timed.join(_of_one_session(timed, hooks), "session_id", "left")
    hit = stab_join(_keyed_points(hooks), s, ["_p"], "ts", "w_lo", "w_hi").drop("_p", "w_lo", "w_hi")
    return hit.withColumn("payload", F.when(F.col("_one"), F.col("payload"))).drop("_one")


def hooks_by_id(places: DataFrame, hooks: DataFrame) -> DataFrame:
    """Hooks of the hook session that a place names."""
    named = places.where("hook_session is not null").select("session_id", "project", "hook_session")
    return _fence(hooks.join(named, "hook_session")).drop("project")


def session_hooks(sessions: DataFrame, requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """All hooks shown under each session: by identity, else by time."""
    places = hook_places(sessions, requests, hooks)
    return hooks_by_id(places, hooks).unionByName(_hooks_in_windows(_by_time(places), hooks))


def shown_counts(places: DataFrame, hooks: DataFrame) -> DataFrame:
    """(session_id, shown): the number of hooks each session shows, without pairing those matched by time."""
    exact = hooks_by_id(places, hooks.drop("payload")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    points = _keyed_points(hooks.select("ts", "cwd"))
    timed = stab_counts(points, _by_time(places), ["_p"], ["session_id"], "ts", "w_lo", "w_hi", F.lit(True))
    return exact.unionByName(timed).groupBy("session_id").agg(F.sum("n").alias("shown")).where("shown > 0")


def conversation_hooks(sessions: DataFrame, hooks: DataFrame) -> DataFrame:
    """Hooks of the conversation inside each session's own window (no owner)."""
    s = _window(sessions.where("client_session_id is not null"), "project", "client_session_id")
    s = s.withColumnRenamed("client_session_id", "hook_session")
    return _fence(stab_join(hooks, s, ["hook_session"], "ts", "w_lo", "w_hi")).drop("project", "w_lo", "w_hi")


def hooks_meta(sessions: DataFrame, requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """Per session: hooks shown, hooks of its conversation, owner, and the reason for none."""
    per = hooks.groupBy(F.col("hook_session").alias("client_session_id")).agg(F.count(F.lit(1)).alias("conversation_hooks"))
    owner = hook_owner(sessions, requests).withColumnRenamed("session_id", "owner_id")
    shown = shown_counts(hook_places(sessions, requests, hooks), hooks)
    total = hooks.agg(F.count(F.lit(1)).alias("indexed_total")).withColumn("_one", F.lit(1))
    s = (
        sessions.select("session_id", "client_session_id").join(per, "client_session_id", "left")
        .join(owner, "client_session_id", "left").join(shown, "session_id", "left")
        .withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    )
    n = F.coalesce("conversation_hooks", F.lit(0))
    s = s.withColumn("conversation_hooks", n).withColumn("shown", F.coalesce("shown", F.lit(0)))
    s = s.withColumn("owner_id", F.when(F.col("conversation_hooks") > 0, F.col("owner_id")))
    reason = (
        F.when(F.col("shown") > 0, "shown")
        .when(F.col("indexed_total") == 0, "none indexed")
        .when(F.col("owner_id") != F.col("session_id"), "listed on owner")
        .when(F.col("client_session_id").isNull(), "no client id")
        .when(F.col("conversation_hooks") > 0, "other project")
        .otherwise("none for this conversation")
    )
    return s.select("session_id", "client_session_id", "owner_id", "conversation_hooks", "shown", reason.alias("reason"))


# -- turns -------------------------------------------------------------------

def turn_bounds(requests: DataFrame) -> DataFrame:
    """Each call with its turn [ts, next call's ts); the last ends with its own call."""
    r = halo(requests.select("session_id", "seq", "ts", "duration_ms"), F.col("seq"), 0, 1)
    w = Window.partitionBy("session_id", "_chunk").orderBy("seq")
    own_end = F.col("ts") + F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0))) / 1000
    r = r.withColumn("t_hi", F.coalesce(F.lead("ts").over(w), own_end)).where("_home")
    return r.select("session_id", "seq", F.col("ts").alias("t_lo"), "t_hi")


def turn_hooks(requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """(session_id, seq, hook_id) of hooks fired within each turn.

    ``hooks`` carries the session_id it is shown under.
    """
    t = turn_bounds(requests).where("t_hi > t_lo")
    h = hooks.select("session_id", "hook_id", "ts")
    return stab_join(h, t, ["session_id"], "ts", "t_lo", "t_hi", closed=False, tiles=True).select("session_id", "seq", "hook_id")


def _turn_keys(places: DataFrame, requests: DataFrame) -> DataFrame:
    """Turns cut to the window of their session, under the keys of the hooks it shows."""
    t = turn_bounds(requests).where("t_hi > t_lo").join(_wanted(places), "session_id")
    return t.select(
        F.coalesce(F.concat(F.lit("="), F.col("hook_session")), F.lit("*")).alias("_h"), "_p", "session_id", "seq",
        F.greatest("t_lo", "w_lo").alias("lo"), F.least("t_hi", "w_hi").alias("hi"), (F.col("w_hi") < F.col("t_hi")).alias("closed"),
    ).where("lo < hi or (closed and lo = hi)")


def _hook_keys(hooks: DataFrame) -> DataFrame:
    """Hooks under the keys of ``_turn_keys``: of their hook session, and of all."""
    named = F.array_compact(F.array(F.concat(F.lit("="), F.col("hook_session")), F.lit("*")))
    h = _keyed_points(hooks.select("hook_id", "hook_session", "ts", "cwd").where("ts is not null")).drop("cwd")
    return h.withColumn("_h", F.explode(named)).drop("hook_session")


def shown_turn_hooks(places: DataFrame, requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """``turn_hooks`` of the hooks shown under each session, met with its turns at once."""
    j = stab_join(_hook_keys(hooks), _turn_keys(places, requests), ["_h", "_p"], "ts", "lo", "hi", tiles=True)
    return j.where("closed or ts < hi").select("session_id", "seq", "hook_id")


def shown_turn_counts(places: DataFrame, requests: DataFrame, hooks: DataFrame) -> DataFrame:
    """(session_id, seq, n): hooks within each turn, of those shown under its session."""
    return stab_counts(
        _hook_keys(hooks), _turn_keys(places, requests), ["_h", "_p"], ["session_id", "seq"], "ts", "lo", "hi", F.col("closed")
    ).where("n > 0")


def turn_event_counts(requests: DataFrame, hook_counts: DataFrame, compactions: DataFrame) -> DataFrame:
    """(session_id, seq, events): tool calls, hooks and compactions of each turn that has any."""
    tools = requests.select("session_id", "seq", F.size("tool_names").cast("bigint").alias("n")).where("n > 0")
    cp = compactions.select("session_id", "seq", F.lit(1).cast("bigint").alias("n"))
    n = tools.unionByName(hook_counts.select("session_id", "seq", "n")).unionByName(cp)
    return n.groupBy("session_id", "seq").agg(F.sum("n").alias("events"))


def turn_events(requests: DataFrame, hooks: DataFrame, compactions: DataFrame) -> DataFrame:
    """One row per event of a turn: tool calls, hooks and compactions."""
    tools = requests.select("session_id", "seq", F.explode("tool_names")).select(
        "session_id", "seq", F.lit("tool").alias("kind")
    )
    hk = turn_hooks(requests, hooks).select("session_id", "seq", F.lit("hook").alias("kind"))
    cp = compactions.select("session_id", "seq", F.lit("compaction").alias("kind"))
    return tools.unionByName(hk).unionByName(cp)


def filter_turns(
    requests: DataFrame, events: DataFrame, kinds: list[str] | None = None,
    window: tuple[float, float] | None = None,
) -> DataFrame:
    """Turns with an event of the kinds, whose call overlaps the time window (ms)."""
    lo = F.col("ts") * 1000
    hi = lo + F.greatest(F.lit(0), F.coalesce("duration_ms", F.lit(0)))
    r = requests
    if window:
        r = r.where((hi >= window[0]) & (lo <= window[1]))
    if kinds:
        r = r.join(events.where(F.col("kind").isin(kinds)).select("session_id", "seq"), ["session_id", "seq"], "left_semi")
    return r


def busiest_turn(events: DataFrame) -> DataFrame:
    """The turn with most events; ``events`` has a row for each, or ``turn_event_counts``."""
    n = events
    if "events" not in n.columns:
        n = n.groupBy("session_id", "seq").agg(F.count(F.lit(1)).alias("events"))
    return n.groupBy("session_id").agg(
        F.max_by("seq", F.struct("events", -F.col("seq"))).alias("seq"), F.max("events").alias("events")
    )


def orphan_hooks(requests: DataFrame, shown: DataFrame, hook_counts: DataFrame) -> DataFrame:
    """Hooks of a session outside every turn, from ``shown_counts`` and ``shown_turn_counts``."""
    placed = hook_counts.groupBy("session_id").agg(F.sum("n").alias("placed"))
    last = requests.groupBy("session_id").agg(F.max("seq").alias("last_seq"))
    return (
        shown.withColumnRenamed("shown", "total").join(last, "session_id").join(placed, "session_id", "left")
        .withColumn("orphan", F.col("total") - F.coalesce("placed", F.lit(0)))
        .select("session_id", "total", "orphan", "last_seq")
    )


# -- what a turn was about -----------------------------------------------------

# Tool arguments in order of preference, and text sizes.
TOOL_ARG_KEYS = [
    "file_path", "path", "pattern", "command", "url", "query", "prompt", "description", "notebook_path", "skill", "name",
]
ARG_CHARS, ARG_SUMMARY_CHARS, STEP_CHARS = 60, 34, 200
EMPTY_STEP = "<block>no"


def one_line(c: Column, n: int) -> Column:
    """One line without reminders, clipped to n characters."""
    t = collapse(F.regexp_replace(c, r"(?s)<system-reminder>.*?</system-reminder>", " "))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.left(t, F.lit(n - 1)), F.lit("…")))


def tool_argument(input_json: Column) -> Column:
    """The argument that tells a tool call from its neighbours."""
    parsed = F.try_parse_json(input_json)
    fields = F.from_json(input_json, "map<string,string>")
    named = F.coalesce(*[F.nullif(fields[k], F.lit("")) for k in TOOL_ARG_KEYS], F.lit(""))
    return F.when(F.coalesce(input_json, F.lit("")) == "", "").when(parsed.isNull(), one_line(input_json, ARG_CHARS)).otherwise(
        one_line(named, ARG_CHARS)
    )


def step_text(message: Column) -> Column:
    """Readable text of a step: its one-key envelope opened, command tags dropped."""
    raw = F.coalesce(message, F.lit(""))
    keys = F.json_object_keys(raw)
    one = raw.startswith("{") & (F.size(keys) == 1) & F.schema_of_variant(F.try_parse_json(raw)).rlike(": STRING>$")
    key, value = F.get(keys, F.lit(0)), F.get(F.map_values(F.from_json(raw, "map<string,string>")), F.lit(0))
    label = F.when(one & (key != "user"), F.concat(key, F.lit(" "))).otherwise(F.lit(""))
    t = F.when(one, value).otherwise(raw)
    for pattern, to in (
        (r"<command-name>\s*", ""), (r"</command-name>", ""), (r"(?s)<command-message>.*?</command-message>", ""),
        (r"<command-args>\s*", " "), (r"</command-args>", ""), (r"</?local-command-stdout>", ""), (r"</?transcript>", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.when((raw == "") | raw.startswith(EMPTY_STEP), F.lit("")).otherwise(F.concat(label, one_line(t, STEP_CHARS)))


def turn_prompts(steps: DataFrame) -> DataFrame:
    """Each step with the nearest user message at or before it."""
    chunk = F.floor(F.col("step_index") / F.lit(1 << 20))
    asked = F.when(F.col("role") == "user", F.col("message"))
    return running(steps, ["session_id"], chunk, ["step_index"], last={"prompt": asked})


def turn_summaries(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """One line per call: the tools it used, else what it said, else what it was asked."""
    s = turn_prompts(steps).select(
        "session_id", F.col("step_index").alias("agent_step_index"), "tool_names", "tool_inputs", "message", "prompt"
    )
    r = requests.select("session_id", "seq", "agent_step_index").join(s, ["session_id", "agent_step_index"], "left")

    def tool_line(name: Column, i: Column) -> Column:
        arg = tool_argument(F.get("tool_inputs", i))
        return F.when(arg != "", F.concat(name, F.lit(" "), one_line(arg, ARG_SUMMARY_CHARS))).otherwise(name)

    tools = F.array_join(F.transform("tool_names", tool_line), "  ·  ")
    said, asked = step_text(F.col("message")), step_text(F.col("prompt"))
    summary = (
        F.when(F.size("tool_names") > 0, tools).when(said != "", said)
        .when(asked != "", F.concat(F.lit("› "), asked)).otherwise(F.lit(""))
    )
    return r.select("session_id", "seq", summary.alias("summary"))
