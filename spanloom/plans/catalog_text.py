"""Search, secrets, identity, tool tax, prompts, diff, flow and imported sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.secrets import DETECTORS, Detector, count_redactions, entropy, redact
from ..functions.titles import activity_title
from ..operators import audit as A, diff as D, flow as W, forest as R, identity as N, prompts as P, search as Q, tooltax as X
from ..session import written
from . import driver_views as V
from .catalog_usage import money
from .oracle_base import sql
from .registry import query

# -- search over the turns of conversations -------------------------------------


def _steps(spark, sf):
    return V.table(spark, sf, "conversations").selectExpr(
        "cast(conv_id as string) as session_id", "turn + 1 as step_index", "role", "text as message", "'' as reasoning",
        "'' as tool_name", "'' as tool_input", "'' as observation", "false as errored",
    )


def _postings(spark, sf):
    return Q.postings(_steps(spark, sf), stem=False, columns=["message"])


_TOK = """tok AS (SELECT conv_id, turn, t.term, t.pos FROM conversations, (SELECT unnest(l) AS term, generate_subscripts(l, 1) AS pos
    FROM (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l)) t),
  dl AS (SELECT conv_id, turn, count(*) AS dl FROM tok GROUP BY 1, 2), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl)"""



def _weight(tf: str, d: str) -> str:
    idf = f"ln((n - {d} + 0.5) / ({d} + 0.5))"
    return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END * ({tf} * 2.2) / ({tf} + 1.2 * (0.25 + 0.75 * dl / a)))"


_HITS = f"""{_TOK}, x AS (SELECT conv_id, turn, count(*) AS tf FROM tok WHERE term = 'ered' OR term = 'die' GROUP BY 1, 2),
  a1 AS (SELECT conv_id, turn, count(*) AS tf FROM tok WHERE term = 'die' GROUP BY 1, 2),
  a2 AS (SELECT conv_id, turn, count(*) AS tf FROM tok WHERE term = 'zu' GROUP BY 1, 2),
  hit AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS step_index,
    -({_weight('a1.tf', '(SELECT count(*) FROM a1)')} + {_weight('a2.tf', '(SELECT count(*) FROM a2)')}) AS score
    FROM a1 JOIN a2 USING (conv_id, turn) JOIN dl USING (conv_id, turn), st)"""


@query("search_scores", f"WITH {_HITS} SELECT session_id, step_index, round(score, 8) AS score FROM hit")
def search_scores(spark, sf):
    s = Q.score(_postings(spark, sf), "die zu", stem=False)
    return s.select("session_id", "step_index", F.round("score", 8).alias("score"))


@query("search_best_per_session", f"WITH {_HITS} SELECT session_id, first(step_index ORDER BY score, step_index) AS step_index, round(min(score), 8) AS score, count(*) AS hits FROM hit GROUP BY 1")
def search_best(spark, sf):
    b = Q.best_per_session(Q.score(_postings(spark, sf), "die zu", stem=False))
    return b.select("session_id", "step_index", F.round("score", 8).alias("score"), "hits")


@query("search_phrase_hits", f"""WITH {_TOK} SELECT CAST(a.conv_id AS VARCHAR) AS session_id, a.turn + 1 AS step_index, count(*) AS tf
    FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1, 2""")
def search_phrase(spark, sf):
    return Q.match(_postings(spark, sf), "of-the", stem=False).select("session_id", "step_index", "tf")


# Terms that share a stem with a word of the query.
_STEMS = [
    *[(t, "and") for t in "and ands ande andes anded anding andings andness andful".split()],
    *[(t, "the") for t in "the thes theing theings".split()],
]


@query("search_stemmed_scores", f"""WITH {_TOK}, v(term, stem) AS (VALUES {', '.join(map(str, _STEMS))}),
  a1 AS (SELECT conv_id, turn, count(*) AS tf FROM tok JOIN v USING (term) WHERE stem = 'and' GROUP BY 1, 2),
  a2 AS (SELECT conv_id, turn, count(*) AS tf FROM tok JOIN v USING (term) WHERE stem = 'the' GROUP BY 1, 2)
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS step_index,
    round(-({_weight('a1.tf', '(SELECT count(*) FROM a1)')} + {_weight('a2.tf', '(SELECT count(*) FROM a2)')}), 8) AS score
  FROM a1 JOIN a2 USING (conv_id, turn) JOIN dl USING (conv_id, turn), st""")
def search_stemmed(spark, sf):
    s = Q.score(written(Q.postings(_steps(spark, sf), columns=["message"]), "postings"), "anding the")
    return s.select("session_id", "step_index", F.round("score", 8).alias("score"))


@query("search_stemmed_top")
def search_top(spark, sf):
    steps = _steps(spark, sf)
    s = steps.groupBy("session_id").agg(
        F.lit("claude").alias("agent"), F.lit("m").alias("model"), F.lit("").alias("project"),
        F.min("step_index").cast("double").alias("started_at"), F.lit(0.0).alias("cost_usd"),
    )
    top = Q.search(steps, s, written(Q.postings(steps), "postings"), "anding the")
    return top.select("session_id", "step_index", F.round("score", 8).alias("score"), "snippet", "snippet_field")


@query("search_index_sizes", f"WITH {_TOK} SELECT term, count(*) AS occurrences, count(DISTINCT (conv_id, turn)) AS steps FROM tok GROUP BY term")
def index_sizes(spark, sf):
    return _postings(spark, sf).groupBy("term").agg(
        F.sum(F.size("positions")).alias("occurrences"), F.count(F.lit(1)).alias("steps")
    )


# -- secrets in documents ---------------------------------------------------------

# The documents' own kind of secret, beside the built-in detectors.
_ASSIGNED = [*DETECTORS, Detector("assigned_token", r'token = "([0-9a-fA-F]{40})"', 1, keep='token = "{}"', hints=('token = "',))]
_FOUND = """f AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, 'token = "([0-9a-fA-F]{40})"', 1)) AS token FROM documents)"""


def _texts(spark, sf):
    return V.table(spark, sf, "documents").selectExpr(
        "doc_id", "concat(source, '.jsonl') as source_path", "lang as location", "if(doc_id % 3 = 0, 'response', 'egress') as direction",
        "cast(doc_id as double) as ts", "text",
    )


@query("secret_findings", f"""WITH {_FOUND} SELECT doc_id, 'assigned_token' AS detector, left(sha256(token), 12) AS fingerprint,
    length(token) AS token_length, right(token, 4) AS last4 FROM f""")
def secret_findings(spark, sf):
    f = A.scan(_texts(spark, sf), "standard", _ASSIGNED)
    return f.select("doc_id", "detector", "fingerprint", "token_length", "last4")


@query("secret_groups", f"""WITH {_FOUND} SELECT left(sha256(token), 12) AS fingerprint, 'assigned_token' AS detector, 40 AS token_length, right(any_value(token), 4) AS last4,
    count(*) FILTER (doc_id % 3 <> 0) AS egress, count(*) FILTER (doc_id % 3 = 0) AS response, count(DISTINCT lang) AS locations,
    count(DISTINCT source) AS files, coalesce(min(doc_id) FILTER (doc_id > 0), 0)::DOUBLE AS first_ts, coalesce(max(doc_id) FILTER (doc_id > 0), 0)::DOUBLE AS last_ts
    FROM f GROUP BY token""")
def secret_groups(spark, sf):
    return A.group_findings(A.scan(_texts(spark, sf), "standard", _ASSIGNED))


@query("secret_totals", f"""WITH {_FOUND} SELECT count(*) FILTER (doc_id % 3 <> 0) AS egress, count(*) FILTER (doc_id % 3 = 0) AS response,
    count(DISTINCT left(sha256(token), 12)) AS secrets FROM f""")
def secret_totals(spark, sf):
    return A.audit_totals(A.scan(_texts(spark, sf), "standard", _ASSIGNED))


@query("redacted_documents", """SELECT doc_id, sha256(regexp_replace(text, 'token = "([0-9a-fA-F]{40})"', 'token = "[REDACTED:assigned_token]"', 'g')) AS text_hash,
    len(regexp_extract_all(text, 'token = "([0-9a-fA-F]{40})"')) AS masked FROM documents""")
def redacted(spark, sf):
    d = _texts(spark, sf).withColumn("text", redact(F.col("text"), "standard", _ASSIGNED))
    return d.select("doc_id", F.sha2("text", 256).alias("text_hash"), count_redactions(F.col("text")).alias("masked"))


@query("part_name_entropy", """SELECT p_partkey, round(-list_sum(list_transform(list_sort(list_distinct(string_split(p_name, ''))), lambda c:
    (length(p_name) - length(replace(p_name, c, ''))) / length(p_name) * log2((length(p_name) - length(replace(p_name, c, ''))) / length(p_name)))), 8) AS bits FROM part""")
def name_entropy(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.round(entropy(F.col("p_name")), 8).alias("bits"))


# -- texts holding other texts ------------------------------------------------------

@query("documents_holding_passages", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passages(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    b = V.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    met = N.contains_join(d, b.where("passage <> ''"), [], "text", "passage", ["doc_id"], ["item_id"]).select("doc_id", "item_id")
    # an empty passage stands in every text
    return met.union(d.where("text is not null").select("doc_id").crossJoin(b.where("passage = ''").select("item_id")))


@query("subagent_marker", """SELECT event_id, event_id % 2 = 0 AS is_subagent FROM events""")
def marker(spark, sf):
    text = F.concat(
        F.lit("intro\nx-anthropic-billing-header: cc_version="), F.col("event_id").cast("string"),
        F.lit("; cc_is_subagent="), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("; cch=ab;\nrest"),
    )
    return V.table(spark, sf, "events").select("event_id", N.is_subagent(text).alias("is_subagent"))


# -- tool tax -----------------------------------------------------------------------

def _toolsets(spark, sf):
    """Declared tools: the called ones in every set, and some never called."""
    hashes = V.requests(spark, sf).where("toolset_hash is not null").select("toolset_hash").distinct()
    base = hashes.select("toolset_hash", F.explode(F.array(*[F.lit(t) for t in ("Bash", "Read", "Task", "mcp__git__status", "mcp__claude_ai_Mail__authenticate")])).alias("tool"))
    base = base.withColumn("approx_tokens", F.length("tool") * 10)
    extra = V.table(spark, sf, "part").groupBy(
        F.concat(F.lit("t"), (F.col("p_partkey") % 6).cast("string")).alias("toolset_hash"),
        F.concat(F.lit("mcp__plugin_q"), (F.col("p_size") % 4).cast("string"), F.lit("_x__t"), (F.col("p_size") % 5).cast("string")).alias("tool"),
    ).agg((F.max("p_size") * 10 + 50).cast("int").alias("approx_tokens"))
    return base.unionByName(extra).withColumn("approx_tokens", F.col("approx_tokens").cast("bigint"))


_TAX = """, decl AS (SELECT DISTINCT toolset_hash, t.tool, length(t.tool) * 10 AS approx_tokens FROM reqs,
      (VALUES ('Bash'), ('Read'), ('Task'), ('mcp__git__status'), ('mcp__claude_ai_Mail__authenticate')) t(tool) WHERE toolset_hash IS NOT NULL
    UNION ALL SELECT 't' || (p_partkey % 6), 'mcp__plugin_q' || (p_size % 4) || '_x__t' || (p_size % 5), max(p_size) * 10 + 50 FROM part GROUP BY 1, 2),
  u AS (SELECT session_id, toolset_hash, count(*) AS request_count FROM reqs WHERE toolset_hash IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT session_id, toolset_hash, tool, count(*) AS calls FROM (SELECT session_id, toolset_hash, unnest(tool_names) AS tool FROM reqs WHERE toolset_hash IS NOT NULL) GROUP BY ALL),
  r AS (SELECT u.session_id, u.toolset_hash, request_count, d.tool, d.approx_tokens, coalesce(c.calls, 0) AS calls, coalesce(c.calls, 0) = 0 AS dead,
      d.approx_tokens * request_count AS cum, p.pcr FROM u JOIN sess s USING (session_id) JOIN decl d USING (toolset_hash)
      LEFT JOIN c ON c.session_id = u.session_id AND c.toolset_hash = u.toolset_hash AND c.tool = d.tool LEFT JOIN resolved p ON p.model = s.model),
  tax AS (SELECT session_id, toolset_hash, max(request_count) AS request_count, count(*) AS declared, count(*) FILTER (NOT dead) AS called, count(*) FILTER (dead) AS dead,
      CAST(coalesce(sum(approx_tokens) FILTER (dead), 0) AS BIGINT) AS dead_per_request, CAST(coalesce(sum(cum) FILTER (dead), 0) AS BIGINT) AS dead_cumulative,
      CAST(sum(cum) AS BIGINT) AS cumulative, coalesce(sum(cum) FILTER (dead), 0) * max(pcr) / 1e6 AS dead_cost_usd FROM r GROUP BY 1, 2)"""
_TAXC = ("reqs", "sess", "resolved")


def _tax_rows(spark, sf):
    sets = _toolsets(spark, sf)
    usage, calls = X.toolset_usage(V.requests(spark, sf), V.sessions(spark, sf), sets)
    return X.tool_rows(usage, calls, sets, V.prices(spark))


@query("toolset_tax", sql(_TAX + " SELECT * EXCLUDE dead_cost_usd, round(dead_cost_usd, 9) AS dead_cost_usd FROM tax", *_TAXC))
def toolset_tax(spark, sf):
    return money(X.toolset_tax(_tax_rows(spark, sf)), "dead_cost_usd")


@query("tool_tax_by_session", sql(_TAX + """ SELECT session_id, CAST(sum(request_count) AS BIGINT) AS request_count, arg_max(declared, (request_count, toolset_hash)) AS declared,
    arg_max(called, (request_count, toolset_hash)) AS called, arg_max(dead, (request_count, toolset_hash)) AS dead, arg_max(dead_per_request, (request_count, toolset_hash)) AS dead_per_request,
    CAST(sum(dead_cumulative) AS BIGINT) AS dead_cumulative, CAST(sum(cumulative) AS BIGINT) AS cumulative, round(sum(dead_cost_usd), 9) AS dead_cost_usd FROM tax GROUP BY 1""", *_TAXC))
def tax_session(spark, sf):
    return money(X.tax_by_session(_tax_rows(spark, sf)), "dead_cost_usd")


@query("tool_tax_by_tool", sql(_TAX + """, l AS (SELECT tool, session_id, arg_min(calls, (request_count, toolset_hash)) AS kept, max(calls) AS most, max(approx_tokens) AS approx_tokens,
      sum(cum) AS cum, coalesce(sum(cum) FILTER (dead), 0) AS dc, sum(CASE WHEN dead THEN cum * pcr / 1e6 END) AS cost, bool_or(dead AND pcr IS NULL) AS unpriced FROM r GROUP BY 1, 2)
    SELECT tool, CAST(max(approx_tokens) AS BIGINT) AS approx_tokens, count(*) AS sessions_declared, count(*) FILTER (most > 0) AS sessions_called, CAST(sum(kept) AS BIGINT) AS calls,
      CAST(sum(cum) AS BIGINT) AS cumulative, CAST(sum(dc) AS BIGINT) AS dead_cumulative, round(sum(cost), 9) AS dead_cost_usd, bool_or(unpriced) AS has_unpriced FROM l GROUP BY 1""", *_TAXC))
def tax_tool(spark, sf):
    return money(X.tax_by_tool(_tax_rows(spark, sf)), "dead_cost_usd")


@query("tool_tax_totals", sql(_TAX + """ SELECT (SELECT count(DISTINCT session_id) FROM r) AS sessions, (SELECT count(DISTINCT tool) FROM r) AS tools, CAST(sum(cumulative) AS BIGINT) AS cumulative,
    CAST(sum(dead_cumulative) AS BIGINT) AS dead_cumulative, round(sum(dead_cost_usd), 8) AS dead_cost_usd, bool_or(dead_cost_usd IS NULL AND dead_cumulative > 0) AS has_unpriced,
    round(sum(dead_cumulative) / sum(cumulative), 9) AS dead_share FROM tax""", *_TAXC))
def tax_totals(spark, sf):
    return money(X.tax_totals(_tax_rows(spark, sf)), "dead_share").withColumn("dead_cost_usd", F.round("dead_cost_usd", 8))


@query("tool_tax_by_provider", sql(_TAX + """, v AS (SELECT *, CASE WHEN tool NOT LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'builtin' WHEN tool LIKE 'mcp\\_\\_plugin%' ESCAPE '\\' THEN 'plugin'
        WHEN tool LIKE 'mcp\\_\\_claude%' ESCAPE '\\' THEN 'connector' ELSE 'mcp' END AS kind,
      CASE WHEN tool NOT LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'built-in' WHEN tool LIKE 'mcp\\_\\_plugin%' ESCAPE '\\' THEN string_split(substr(tool, 13), '_')[1]
        WHEN tool LIKE 'mcp\\_\\_claude%' ESCAPE '\\' THEN 'Mail' ELSE 'git' END AS provider FROM r)
    SELECT session_id, toolset_hash, provider, min(kind) AS kind, count(*) AS tools, CAST(sum(approx_tokens) AS BIGINT) AS approx_tokens, CAST(sum(cum) AS BIGINT) AS cumulative,
      CAST(sum(calls) AS BIGINT) AS calls, CAST(coalesce(sum(approx_tokens) FILTER (dead), 0) AS BIGINT) AS dead_tokens, min(kind) = 'connector' AS deferred,
      round(sum(approx_tokens) / greatest(sum(sum(approx_tokens)) OVER (PARTITION BY session_id, toolset_hash), 1), 12) AS share FROM v GROUP BY 1, 2, 3""", *_TAXC))
def tax_provider(spark, sf):
    return X.tax_by_provider(_tax_rows(spark, sf)).withColumn("share", F.round("share", 12))


@query("dead_tools", sql(_TAX + " SELECT session_id, toolset_hash, tool, CAST(approx_tokens AS BIGINT) AS approx_tokens, CAST(cum AS BIGINT) AS cumulative FROM r WHERE dead", *_TAXC))
def dead_tools(spark, sf):
    return X.dead_tools(_tax_rows(spark, sf))


@query("activity_titles", sql("""SELECT session_id, coalesce((SELECT string_agg(tool || ' ×' || calls, ' · ' ORDER BY calls DESC, tool) FROM
    (SELECT * FROM toolcalls t WHERE t.session_id = s.session_id ORDER BY calls DESC, tool LIMIT 3)), '') AS title FROM sess s""", "sess", "toolcalls"))
def activity(spark, sf):
    return V.sessions(spark, sf).select("session_id", F.coalesce(activity_title(F.col("tool_histogram")), F.lit("")).alias("title"))


# -- prompts ------------------------------------------------------------------------

@query("prompt_registry", sql("""SELECT prompt_hash, min(ts) FILTER (ts > 0) AS first_seen, max(ts) FILTER (ts > 0) AS last_seen, count(*) AS requests,
    count(DISTINCT session_id) AS sessions FROM reqs WHERE prompt_hash <> '' GROUP BY 1""", "reqs"))
def prompt_registry(spark, sf):
    return P.prompt_uses(V.requests(spark, sf))


@query("prompt_registry_merged", sql("""SELECT prompt_hash, min(ts) FILTER (ts > 0) AS first_seen, max(ts) FILTER (ts > 0) AS last_seen, count(*) AS requests,
    count(DISTINCT session_id) AS sessions FROM reqs WHERE prompt_hash <> '' GROUP BY 1""", "reqs"))
def prompt_registry_merged(spark, sf):
    """Two parts of the requests, merged: sessions stand in both."""
    r = V.requests(spark, sf).where("prompt_hash <> ''")
    early, late = (P.session_uses(r.where(c)) for c in ("ts < 1704700000", "not ts < 1704700000"))
    return P.registry(P.merge_registry(early, late))


@query("prompt_by_prefix_sessions", sql("""SELECT prompt_hash, session_id, max(ts) AS last_ts FROM reqs WHERE prompt_hash = (SELECT prompt_hash FROM reqs
    WHERE starts_with(prompt_hash, 'p1') GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 1) GROUP BY 1, 2""", "reqs"))
def prompt_sessions(spark, sf):
    return P.prompt_sessions(V.requests(spark, sf), "p1")


@query("document_line_changes", """WITH v AS (SELECT doc_id, source, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
    n AS (SELECT doc_id, line, sum(d) AS d FROM (SELECT doc_id, unnest(string_split(p, chr(10))) AS line, -1 AS d FROM v WHERE p IS NOT NULL
      UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), 1 FROM v WHERE p IS NOT NULL) GROUP BY 1, 2)
    SELECT doc_id, CAST(coalesce(sum(d) FILTER (d > 0), 0) AS BIGINT) AS added, CAST(coalesce(-sum(d) FILTER (d < 0), 0) AS BIGINT) AS removed FROM n GROUP BY 1""")
def line_changes(spark, sf):
    v = D.consecutive_versions(V.table(spark, sf, "documents").select("doc_id", "source", "text"), ["source"], "doc_id", "text", "doc_id")
    return D.line_counts(v, ["doc_id"], "p_text", "text")


@query("document_line_diff", """WITH v AS (SELECT doc_id, text AS b, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS a FROM documents),
    p AS (SELECT doc_id, CASE WHEN a = '' THEN []::VARCHAR[] ELSE string_split(a, chr(10)) END AS x,
      CASE WHEN coalesce(b, '') = '' THEN []::VARCHAR[] ELSE string_split(b, chr(10)) END AS y FROM v WHERE a IS NOT NULL),
    c AS (SELECT doc_id, len(x) AS nx, len(y) AS ny, list_reduce(x, lambda r, l: list_reduce(range(1, len(y) + 1),
      lambda acc, j: list_append(acc, if(y[j] = l, r[j] + 1, greatest(r[j + 1], acc[j]))), [0::BIGINT]),
      list_transform(range(0, len(y) + 1), lambda k: 0::BIGINT)) AS r FROM p)
    SELECT doc_id, CAST(ny - r[-1] AS INTEGER) AS added, CAST(nx - r[-1] AS INTEGER) AS removed FROM c""")
def line_diff(spark, sf):
    v = D.consecutive_versions(V.table(spark, sf, "documents").select("doc_id", "source", "text"), ["source"], "doc_id", "text", "doc_id")
    return D.with_line_diff(v, "p_text", "text").select("doc_id", "added", "removed")


@query("tool_call_deltas", sql("""SELECT tool, CAST(coalesce(sum(calls) FILTER (session_id = 's1'), 0) AS BIGINT) AS a,
    CAST(coalesce(sum(calls) FILTER (session_id = 's2'), 0) AS BIGINT) AS b,
    CAST(coalesce(sum(calls) FILTER (session_id = 's2'), 0) - coalesce(sum(calls) FILTER (session_id = 's1'), 0) AS BIGINT) AS delta
    FROM toolcalls WHERE session_id IN ('s1', 's2') GROUP BY tool""", "toolcalls"))
def call_deltas(spark, sf):
    from ..operators.sessions import tool_counts

    counts = tool_counts(V.usage_events(spark, sf)).withColumnRenamed("session_id", "run")
    return D.diff_counts(counts, "s1", "s2")


@query("toolset_definition_diff", """WITH a AS (SELECT p_name AS tool, list_sort(list(DISTINCT p_brand)) AS d FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name),
    b AS (SELECT p_name AS tool, list_sort(list(DISTINCT p_brand)) AS d FROM part WHERE p_partkey % 2 = 1 GROUP BY p_name)
    SELECT tool, CASE WHEN a.tool IS NULL THEN 'added' WHEN b.tool IS NULL THEN 'removed' WHEN a.d = b.d THEN 'unchanged' ELSE 'changed' END AS change
    FROM a FULL OUTER JOIN b USING (tool)""")
def definition_diff(spark, sf):
    p = V.table(spark, sf, "part")
    side = lambda k: p.where(F.col("p_partkey") % 2 == k).groupBy(F.col("p_name").alias("tool")).agg(
        F.to_json(F.struct(F.array_sort(F.collect_set("p_brand")).alias("d"))).alias("definition"))
    return D.diff_tools(side(0), side(1))


# -- flow -----------------------------------------------------------------------------

_FLOW = """, st AS (SELECT session_id, line_no, ts, tool_names, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS step_index, seq FROM reqseq WHERE NOT errored),
  own AS (SELECT s.session_id, h.hook_id, h.ts FROM hooks h JOIN sess s ON h.hook_session = s.client_session_id AND h.ts BETWEEN s.started_at - 600 AND s.ended_at + 600
    WHERE s.project = '' OR h.cwd = s.project),
  hp AS (SELECT o.*, coalesce((SELECT min(step_index) FROM st WHERE st.session_id = o.session_id AND st.ts > 0 AND st.ts >= o.ts), 1000000000000) AS place FROM own o),
  nodes AS (SELECT session_id, step_index, 3 AS stage, 0::DOUBLE AS part, 0 AS sub, 'api-' || seq AS node_id, 'api_call' AS kind FROM st
    UNION ALL SELECT session_id, step_index, 4, i - 1, 0, 'tool-' || step_index || '-' || (i - 1), CASE WHEN t = 'Task' THEN 'branch' ELSE 'tool_call' END
      FROM (SELECT session_id, step_index, unnest(tool_names) AS t, generate_subscripts(tool_names, 1) AS i FROM st)
    UNION ALL SELECT session_id, place, 0, ts, hook_id, 'hook-' || hook_id, 'hook' FROM hp)
  SELECT session_id, lag(node_id) OVER w AS from_id, node_id AS to_id, CASE kind WHEN 'hook' THEN 'hook' WHEN 'branch' THEN 'branch' WHEN 'tool_call' THEN 'tool' ELSE 'sequence' END AS kind
  FROM nodes WINDOW w AS (PARTITION BY session_id ORDER BY step_index, stage, part, sub) QUALIFY from_id IS NOT NULL"""


@query("flow_edges", sql(_FLOW, "reqseq", "sess", "hooks"))
def flow_edges(spark, sf):
    from ..functions.scan import running
    from ..operators.hooks import conversation_hooks

    r = V.with_seq(V.requests(spark, sf))
    ok = running(r.where("not errored"), ["session_id"], F.floor(F.col("line_no") / F.lit(1 << 20)), ["line_no"], number="_n")
    ok = written(ok.withColumn("agent_step_index", F.col("_n") + 1), "requests")
    steps = ok.selectExpr(
        "session_id", "agent_step_index as step_index", "'agent' as role", "'' as message", "'' as reasoning", "tool_names",
        "cast(array() as array<string>) as tool_inputs", "'' as observation", "false as errored",
    )
    h = conversation_hooks(V.session_spans(spark, sf), V.hooks(spark, sf))
    # The graph reads its nodes twice: as a table, and not as seven branches each time.
    nodes = written(W.flow_nodes(steps, ok, written(h, "hooks")), "nodes")
    return W.flow_edges(W.flow_graph(nodes))


# -- imported sessions: a message tree per conversation ----------------------------------

def _forest(spark, sf):
    """Turn n hangs on turn n-1; every third turn has an abandoned sibling."""
    t = V.turns(spark, sf).withColumn("first", F.expr("turn % 8 = 0"))
    msg = (
        "to_json(named_struct('role', {role}, 'content', text, 'metadata', named_struct('generation_model', "
        "if(conv_id % 3 = 0, 'm-one', 'm-two'), 'metrics', named_struct('input_tokens', turn + 1, 'output_tokens', 2))))"
    )
    main = t.selectExpr(
        "cast(key as string) as session_id", "turn as node_id", "if(first, null, turn - 1) as parent_node_id",
        f"{msg.format(role='role')} as chat_message", "1700000000000 + turn * 1000 as created_at",
    )
    side = t.where("turn % 3 = 2").selectExpr(
        "cast(key as string) as session_id", "turn + 100000000 as node_id", "if(first, null, turn - 1) as parent_node_id",
        f"{msg.format(role=repr('assistant'))} as chat_message", "1600000000000 as created_at",
    )
    sessions = t.groupBy("key").agg(F.max("turn").alias("last")).selectExpr(
        "cast(key as string) as session_id", "if(key % 2 = 0, last, null) as main_chain_id", "'fallback' as model"
    )
    nodes = R.readable_nodes(main.unionByName(side))
    return nodes, sessions, R.active_chain(nodes, R.leaf_of(nodes, sessions))


@query("imported_chain", sql(
    "SELECT CAST(key AS VARCHAR) AS session_id, turn AS node_id, turn - min(turn) OVER (PARTITION BY key) AS position FROM conv", "conv"))
def imported_chain(spark, sf):
    return _forest(spark, sf)[2]


@query("imported_steps", sql(
    """SELECT CAST(key AS VARCHAR) AS session_id, step_index, CASE role WHEN 'assistant' THEN 'agent' ELSE 'user' END AS role, text AS message,
      CASE role WHEN 'assistant' THEN turn + 1 END AS prompt_tokens FROM said""", "said"))
def imported_steps(spark, sf):
    nodes, _, chain = _forest(spark, sf)
    return R.chain_steps(nodes, chain).select("session_id", "step_index", "role", "message", "prompt_tokens")


@query("imported_dominant_model", sql(
    """SELECT CAST(key AS VARCHAR) AS session_id, CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'fallback' WHEN any_value(conv_id) % 3 = 0 THEN 'm-one' ELSE 'm-two' END AS model
    FROM conv GROUP BY key""", "conv"))
def imported_model(spark, sf):
    nodes, sessions, chain = _forest(spark, sf)
    return R.dominant_model(nodes, chain, sessions)
