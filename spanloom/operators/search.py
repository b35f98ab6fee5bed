"""Ranked search over the text of steps, through a table of postings.

The postings table has one row per (term, session, step, column) with positions;
written partitioned or sorted by term, a query reads its own terms only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stem_words, term_of
from ..functions.text import collapse

COLUMNS = ["message", "reasoning", "tool_name", "tool_input", "observation"]
FIELDS = {
    "message": ["message"], "reasoning": ["reasoning"], "tool-input": ["tool_name", "tool_input"],
    "tool-output": ["observation"], "all": COLUMNS,
}
# Parameters of the ranking, floor of a term's weight, snippet sizes.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
BEFORE, AFTER, LIMIT = 60, 120, 20
DOC = ["session_id", "step_index"]


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def postings(steps: DataFrame, *, stem: bool = True, columns: list[str] = COLUMNS) -> DataFrame:
    """Term positions of every step and column."""
    cols = F.array(*[
        F.struct(F.lit(c).alias("col"), tokenize(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for c in columns
    ])
    t = steps.select(*DOC, F.explode(cols).alias("c")).select(*DOC, "c.*").where("size(tokens) > 0")
    # Positions are grouped inside the row: one text is one bounded group.
    spread = t.select(*DOC, "col", F.posexplode("tokens").alias("pos", "term"))
    if stem:
        spread = spread.withColumn("term", stem_words("term"))
    return spread.groupBy("term", *DOC, "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy(*DOC).agg(F.sum(F.size("positions")).alias("dl"))


def query_phrases(query: str, *, stem: bool = True) -> list[list[str]]:
    """Words of a query; one with inner punctuation is a phrase of its parts."""
    words = re.findall(r"(?:[^\W_]|[_./@-])+", query)
    phrases = [re.findall(r"[^\W_]+", w) for w in words]
    return [[term_of(p) if stem else p.lower() for p in ph] for ph in phrases if ph]


def match(posts: DataFrame, query: str, *, field: str = "all", stem: bool = True) -> DataFrame:
    """Steps holding every phrase of the query, with the hits of each phrase."""
    phrases = query_phrases(query, stem=stem)
    if not phrases:  # a query without words is found nowhere
        return posts.where(F.lit(False)).select(*DOC, F.lit(0).alias("phrase"), F.lit(0).cast("bigint").alias("tf"))
    slots: dict[str, list[tuple[int, int]]] = {}
    for i, ph in enumerate(phrases):
        for k, t in enumerate(ph):
            slots.setdefault(t, []).append((i, k))
    p = posts.where(F.col("term").isin(list(slots)) & F.col("col").isin(FIELDS[field]))
    entry = lambda ik: F.struct(F.lit(ik[0]).alias("phrase"), F.lit(ik[1]).alias("k"))
    slot = F.lit(None).cast("array<struct<phrase:int,k:int>>")
    for t, places in slots.items():
        slot = F.when(F.col("term") == t, F.array(*map(entry, places))).otherwise(slot)
    p = p.select(*DOC, "col", F.explode(slot).alias("s"), "positions").select(
        *DOC, "col", "s.*", F.explode("positions").alias("pos")
    )
    # The parts of a phrase meet where their positions less their offsets agree.
    met = p.groupBy(*DOC, "col", "phrase", (F.col("pos") - F.col("k")).alias("base")).agg(F.count(F.lit(1)).alias("n"))
    need = F.element_at(F.array(*[F.lit(len(ph)) for ph in phrases]), F.col("phrase") + 1)
    tf = met.where(F.col("n") == need).groupBy(*DOC, "phrase").agg(F.count(F.lit(1)).alias("tf"))
    whole = tf.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(phrases))
    return tf.join(whole.select(*DOC), DOC, "left_semi")


def score(posts: DataFrame, query: str, *, field: str = "all", stem: bool = True) -> DataFrame:
    """BM25 of the matching steps; lower is better."""
    hits = match(posts, query, field=field, stem=stem)
    if not query_phrases(query, stem=stem):
        return hits.select(*DOC, F.lit(0.0).alias("score"))
    lengths = doc_lengths(posts)
    n_phrases = len(query_phrases(query, stem=stem))
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).withColumn("_one", F.lit(1))
    df = _phrase_frequency(posts, query, field, stem)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf)
    h = hits.join(lengths, DOC).join(F.broadcast(df), "phrase").withColumn("_one", F.lit(1))
    h = h.join(F.broadcast(stats), "_one")
    tf = F.col("tf")
    weight = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    h = h.withColumn("w", weight)
    # Added in phrase order, so the sum does not depend on the arrival of rows.
    parts = [F.sum(F.when(F.col("phrase") == i, F.col("w"))) for i in range(n_phrases)]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return h.groupBy(*DOC).agg((-total).alias("score"))


def _phrase_frequency(posts: DataFrame, query: str, field: str, stem: bool) -> DataFrame:
    """Steps holding each phrase, matched alone: at most one row per phrase."""
    phrases = query_phrases(query, stem=stem)
    out = None
    for i, ph in enumerate(phrases):
        one = match(posts, " ".join(ph) if len(ph) == 1 else ".".join(ph), field=field, stem=False)
        row = one.agg(F.count(F.lit(1)).alias("df")).select(F.lit(i).alias("phrase"), "df")
        out = row if out is None else out.unionByName(row)
    return out


def snippet_field(field: str = "all") -> Column:
    """Struct(text, field): the first non-blank column in order of priority."""
    order = {
        "all": [("message", "message"), ("observation", "tool-output"), ("tool_input", "tool-input"),
                ("reasoning", "reasoning"), ("tool_name", "tool-input")],
        "message": [("message", "message")], "reasoning": [("reasoning", "reasoning")],
        "tool-input": [("tool_input", "tool-input"), ("tool_name", "tool-input")],
        "tool-output": [("observation", "tool-output")],
    }[field]
    named = lambda c, f: F.struct(F.coalesce(F.col(c), F.lit("")).alias("text"), F.lit(f).alias("field"))
    out = F.struct(F.lit("").alias("text"), F.lit("message" if field == "all" else field).alias("field"))
    for c, f in reversed(order):
        out = F.when(F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S"), named(c, f)).otherwise(out)
    return out


def snippet(text: Column, query: str) -> Column:
    """Window around the first query word in the text, every query word in brackets."""
    tokens = list(dict.fromkeys(re.findall(r"(?:[^\W_]|_)+", query.lower())))
    flat = collapse(text)
    low = F.lower(flat)
    at = [F.when(F.instr(low, t) > 0, F.instr(low, t) - 1) for t in tokens]
    first = F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.lit(0)) if at else F.lit(0)
    start = F.greatest(F.lit(0), first - BEFORE)
    stop = F.least(F.length(flat), first + AFTER)
    cut = F.substring(flat, start + 1, stop - start)
    out = F.concat(
        F.when(start > 0, "…").otherwise(""), cut, F.when(stop < F.length(flat), "…").otherwise("")
    )
    for t in tokens:
        out = F.regexp_replace(out, "(?iu)(" + re.escape(t) + ")", "[$1]")
    return F.when(flat == "", "").otherwise(out)


def search(
    steps: DataFrame, sessions: DataFrame, posts: DataFrame, query: str, *, field: str = "all", stem: bool = True,
    tool: str | None = None, errored: bool = False, limit: int = LIMIT, **filters,
) -> DataFrame:
    """Best steps of the sessions that pass the filters, with a snippet each."""
    from .sessions import filter_sessions

    s = filter_sessions(sessions, **filters).select("session_id", "agent", "model", "project", "started_at", "cost_usd")
    hits = steps
    if tool:
        hits = hits.where(F.array_contains(F.split("tool_name", " "), tool))
    if errored:
        hits = hits.where("errored")
    scored = score(posts, query, field=field, stem=stem)
    top = scored.join(hits, DOC).join(s, "session_id").orderBy("score", *DOC).limit(limit)
    return top.withColumn("_p", snippet_field(field)).withColumn("snippet", snippet(F.col("_p.text"), query)).withColumn(
        "snippet_field", F.col("_p.field")
    ).drop("_p")


def best_per_session(scored: DataFrame) -> DataFrame:
    """Best step and number of hits of each session."""
    return scored.groupBy("session_id").agg(
        F.min_by("step_index", F.struct("score", "step_index")).alias("step_index"),
        F.min("score").alias("score"), F.count(F.lit(1)).alias("hits"),
    )
