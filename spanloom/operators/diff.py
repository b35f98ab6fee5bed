"""Differences between runs, toolsets and versions of a text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scan import running


def _common_lengths(x: list, y: list) -> np.ndarray:
    """Longest common subsequence of ``x`` with every opening of ``y``, by bit vectors.

    One bit for each line of ``y`` (Hyyrö's recurrence): a bit that is zero adds one.
    """
    places: dict = {}
    for k, line in enumerate(y):
        places[line] = places.get(line, 0) | 1 << k
    full = (1 << len(y)) - 1
    v = full
    for line in x:
        u = v & places.get(line, 0)
        v = ((v + u) | (v - u)) & full
    raw = np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(raw, bitorder="little")[:len(y)].astype(np.int64))])


def _matched(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence (Hirschberg: halves of ``x`` against the
    best cut of ``y``), in memory linear in the lines."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            out += [(a, k) for k in range(c, d) if y[k] == x[a]][:1]
            continue
        mid = (a + b) // 2
        ahead = _common_lengths(x[a:mid], y[c:d])
        behind = _common_lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]
        cut = c + int((ahead + behind).argmax())
        todo += [(a, mid, c, cut), (mid, b, cut, d)]
    return sorted(out)


def _line_ops(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Shortest line edit; between kept lines removals come before additions."""
    ops, i, j = [], 0, 0
    for p, q in [*_matched(a, b), (len(a), len(b))]:
        ops += [("del", s) for s in a[i:p]] + [("add", s) for s in b[j:q]]
        if p < len(a):
            ops.append(("context", a[p]))
        i, j = p + 1, q + 1
    return ops


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


@F.udf(T.ArrayType(T.StructType().add("op", "string").add("line", "string")), useArrow=False)
def line_diff(a: str, b: str) -> list[tuple[str, str]]:
    """Line operations from a to b, in order.

    Texts come in batches of a hundred pairs; an Arrow batch has thousands, and each of
    their lines is an object of its own here.
    """
    return _line_ops(_lines(a), _lines(b))


def with_line_diff(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``ops`` and the numbers of added and removed lines."""
    d = df.withColumn("ops", line_diff(F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))))
    n = lambda op: F.size(F.filter("ops", lambda o: o["op"] == op))
    return d.withColumn("added", n("add")).withColumn("removed", n("del"))


def line_counts(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Added and removed lines by count alone (moved lines do not show).

    Needs no Python; lines are matched as a multiset.
    """
    side = lambda c, s: df.select(*keys, F.explode(F.split(c, "\n")).alias("line"), F.lit(s).alias("d"))
    n = side(a, -1).unionByName(side(b, 1)).groupBy(*keys, "line").agg(F.sum("d").alias("d"))
    return n.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("added"),
        F.coalesce(-F.sum(F.when(F.col("d") < 0, F.col("d"))), F.lit(0)).alias("removed"),
    )


def consecutive_versions(df: DataFrame, keys: list[str], order: str, text: str, id_col: str) -> DataFrame:
    """Each version of a text beside the one before it."""
    chunk = F.floor(F.col(order) / F.lit(4096))
    return running(df, keys, chunk, [order], lag={"p_text": F.col(text), "p_id": F.col(id_col)}).where("p_id is not null")


def diff_tools(a: DataFrame, b: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Tools of two runs: added, removed, changed or unchanged.

    Both have ``tool`` and ``definition`` (JSON); definitions are compared with
    their keys in sorted order.
    """
    canon = lambda c: F.to_json(F.try_parse_json(c))
    x = a.select(*keys, "tool", canon("definition").alias("da"), F.lit(True).alias("ina"))
    y = b.select(*keys, "tool", canon("definition").alias("db"), F.lit(True).alias("inb"))
    j = x.join(y, [*keys, "tool"], "full_outer")
    change = (
        F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed")
        .when(F.col("da").eqNullSafe(F.col("db")), "unchanged").otherwise("changed")
    )
    return j.select(*keys, "tool", change.alias("change"))


def diff_metrics(shape: DataFrame, a: str, b: str, key: str = "run") -> DataFrame:
    """(metric, a, b, delta) of two rows of a wide frame of whole-number metrics."""
    metrics = [c for c in shape.columns if c != key]
    long = shape.where(F.col(key).isin(a, b)).unpivot([key], metrics, "metric", "value")
    pick = lambda r: F.coalesce(F.max(F.when(F.col(key) == r, F.col("value"))), F.lit(0))
    return long.groupBy("metric").agg(pick(a).alias("a"), pick(b).alias("b")).withColumn("delta", F.col("b") - F.col("a"))


def diff_counts(counts: DataFrame, a: str, b: str, name: str = "tool", key: str = "run") -> DataFrame:
    """(name, a, b, delta) of two histograms; a name on one side counts 0 on the other."""
    pick = lambda r: F.coalesce(F.sum(F.when(F.col(key) == r, F.col("calls"))), F.lit(0))
    both = counts.where(F.col(key).isin(a, b)).groupBy(name).agg(pick(a).alias("a"), pick(b).alias("b"))
    return both.withColumn("delta", F.col("b") - F.col("a"))


def run_shape(steps: DataFrame, key: str = "source_path") -> DataFrame:
    """Counts and token totals of each run."""
    role = lambda r: F.count(F.when(F.col("role") == r, 1))
    tok = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return steps.groupBy(F.col(key).alias("run")).agg(
        F.countDistinct("session_id").alias("trajectories"), F.count(F.lit(1)).alias("steps"),
        role("user").alias("user_steps"), role("agent").alias("agent_steps"),
        F.coalesce(F.sum(F.size("tool_names")), F.lit(0)).alias("tool_calls"),
        tok("prompt_tokens"), tok("completion_tokens"), tok("cache_creation"), tok("cache_read"), tok("reasoning_tokens"),
    )


def run_models(calls: DataFrame, key: str = "source_path", order: list[str] = ("block_start", "row_id")) -> DataFrame:
    """Models of each run in the order first seen, and whether it changed model."""
    seen = calls.where("req_model <> ''").groupBy(F.col(key).alias("run"), "req_model").agg(
        F.min(F.struct(*order)).alias("at"), F.min("provider").alias("provider")
    )
    # One entry per model name of a run.
    models = F.transform(F.array_sort(F.collect_list(F.struct("at", "req_model"))), lambda x: x["req_model"])
    agents = F.collect_set("provider")
    return seen.groupBy("run").agg(
        models.alias("models"),
        F.when(F.size(agents) == 1, F.element_at(agents, 1)).otherwise(F.lit("mixed")).alias("agent"),
    ).withColumn("model_swap", F.size("models") > 1)


def run_profile(calls: DataFrame, steps: DataFrame, key: str = "source_path") -> DataFrame:
    """Models, agent, first system prompt, largest toolset and shape of each run."""
    at = F.struct("block_start", "row_id")
    first = calls.groupBy(F.col(key).alias("run")).agg(
        F.min_by("prompt_text", F.when(F.col("prompt_text").isNotNull(), at)).alias("system_prompt"),
        F.max_by("tools", F.struct(F.size("tools"), -F.col("block_start"), -F.col("row_id"))).alias("tools"),
    )
    return run_models(calls, key).join(first, "run", "left").join(run_shape(steps, key), "run", "left")


def tool_definitions(profile: DataFrame) -> DataFrame:
    """(run, tool, definition) of the largest toolset, cache marks dropped."""
    t = profile.select("run", F.explode("tools").alias("t"))
    name = F.coalesce(F.get_json_object("t", "$.name"), F.get_json_object("t", "$.function.name"), F.lit(""))
    clean = F.to_json(F.map_filter(F.from_json("t", "map<string,string>"), lambda k, v: k != "cache_control"))
    return t.select("run", name.alias("tool"), clean.alias("definition")).where("tool <> ''")


def diff_runs(profile: DataFrame, a: str, b: str) -> dict[str, DataFrame]:
    """The full diff of two runs: models, prompt lines, tools and metrics."""
    two = profile.where(F.col("run").isin(a, b))
    pick = lambda r, c: F.max_by(c, F.when(F.col("run") == r, 1))
    prompts = two.agg(pick(a, "system_prompt").alias("a"), pick(b, "system_prompt").alias("b"))
    defs = tool_definitions(two)
    models = two.agg(pick(a, "models").alias("a"), pick(b, "models").alias("b"))
    side = lambda r: defs.where(F.col("run") == r).select("tool", "definition")
    shape = two.drop("models", "agent", "model_swap", "system_prompt", "tools")
    return {
        "models": models.withColumn("changed", ~F.col("a").eqNullSafe(F.col("b"))),
        "prompt": with_line_diff(prompts, "a", "b"),
        "tools": diff_tools(side(a), side(b)),
        "shape": diff_metrics(shape, a, b),
    }
