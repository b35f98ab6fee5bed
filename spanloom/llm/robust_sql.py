"""The outlier rules of ``robust_rules`` in SQL for DuckDB, written out step by step."""

from __future__ import annotations

_STATISTICS = r"""
with split as (
  select row_number() over () as r, doc_id, coalesce('+' || lang, '-') as lang, coalesce('+' || source, '-') as source,
         coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as lines
  from documents
), grams as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from split, unnest(range(1, len(w) - 1)) as t(i)
), twice as (select r, i from (select r, i, count(*) over (partition by r, gram) as n from grams) where n > 1),
covered as (select r, count(distinct i + j) as n from twice, unnest(range(3)) as t(j) group by r),
counted as (
  select s.r, doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from split s left join covered c on c.r = s.r
), stats as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    round(1000 * ln((word_chars + 500) / (n_words + 100) / 5))::bigint as v0,
    round(1000 * ln(1 + n_symbols / (n_words + 100)))::bigint as v1,
    round(1000 * (n_dup_lines / (n_lines + 10)))::bigint as v2,
    round(1000 * (n_repeat_words / (n_words + 100)))::bigint as v3
  from counted
), sizes as (
  select lang, source, count(*) as n, sum(count(*)) over (partition by lang) as n_lang
  from stats where not base_failed group by lang, source
), chosen as (
  select lang, source, case when n >= 200 then 's' || lang || chr(10) || source when n_lang >= 200 then 'l' || lang else 'a' end as scope
  from sizes
), cells as (
  select scope, v0, v1, v2, v3, count(*)::bigint as n from (
    select unnest(['s' || lang || chr(10) || source, 'l' || lang, 'a']) as scope, v0, v1, v2, v3 from stats where not base_failed)
  where scope in (select scope from chosen) group by all
), tall as (
  select scope, k, n, [v0, v1, v2, v3][k + 1] as v from cells, unnest(range(4)) as t(k)
), mid as (
  select scope, k, min(v) as mid from (
    select scope, k, v, sum(sum(n)) over (partition by scope, k order by v) as upto, sum(sum(n)) over (partition by scope, k) as whole
    from tall group by scope, k, v) where 2 * upto >= whole group by scope, k
), off as (
  select scope, k, min(v) as off from (
    select scope, k, v, sum(sum(n)) over (partition by scope, k order by v) as upto, sum(sum(n)) over (partition by scope, k) as whole
    from (select t.scope, t.k, abs(t.v - m.mid) as v, n from tall t join mid m on m.scope = t.scope and m.k = t.k)
    group by scope, k, v) where 2 * upto >= whole group by scope, k
)"""

_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
_SPREADS = (20, 50, 50, 50)


def _distances(rows: str, fit: str, columns: str) -> str:
    return f"""select {columns}, (v0 - m0) / l00 as y0, (v1 - m1 - l10 * y0) / l11 as y1,
    (v2 - m2 - l20 * y0 - l21 * y1) / l22 as y2, (v3 - m3 - l30 * y0 - l31 * y1 - l32 * y2) / l33 as y3,
    y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3 as d2 from {rows} join {fit} f on {{on}}"""


def _factor(name: str, sums: str, grow: float) -> str:
    means = ", ".join(f"s{k}::double / n::double as m{k}" for k in range(4))
    spread = ", ".join(
        f"(p{i}{j}::double / n::double - m{i} * m{j}) * {grow}::double" + (f" + {_SPREADS[i] ** 2}" if i == j else "") + f" as c{i}{j}"
        for i, j in _PAIRS)
    lower = []
    for i, j in _PAIRS:
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        lower.append(f"sqrt({rest}) as l{i}{j}" if i == j else f"({rest}) / l{j}{j} as l{i}{j}")
    return f"{name} as (select scope, {means}, {spread}, {', '.join(lower)} from {sums})"


_TOTALS = ", ".join(
    ["sum(n) as n"] + [f"sum(n * v{k}) as s{k}" for k in range(4)] + [f"sum(n * v{i} * v{j}) as p{i}{j}" for i, j in _PAIRS])
_AGAIN = ", ".join(
    ["sum(n) as n"] + [f"sum(s{k}) as s{k}" for k in range(4)] + [f"sum(p{i}{j}) as p{i}{j}" for i, j in _PAIRS])


def outlier_sql(steps: int = 3) -> str:
    parts = [_STATISTICS]
    start = ", ".join(f"max(m.mid) filter (m.k = {k})::double as m{k}, max(o.off) filter (o.k = {k}) as o{k}" for k in range(4))
    lower = ", ".join(
        f"sqrt(1.4826::double * o{i} * (1.4826::double * o{i}) + {_SPREADS[i] ** 2}) as l{i}{i}" if i == j else f"0.0::double as l{i}{j}"
        for i, j in _PAIRS)
    parts.append(f"fit0 as (select *, {lower} from (select m.scope, {start} from mid m join off o on o.scope = m.scope and o.k = m.k group by m.scope))")
    for s in range(steps):
        placed = _distances("cells c", f"fit{s}", "c.*").format(on="f.scope = c.scope")
        parts.append(f"""core{s} as (
  select scope, {_AGAIN} from (
    select *, coalesce(sum(n) over (partition by scope order by bin rows between unbounded preceding and 1 preceding), 0) as before,
           sum(n) over (partition by scope) as whole
    from (select scope, floor(ln(d2 + 1e-6) * 16) as bin, {_TOTALS} from ({placed}) group by all))
  where before::double < 0.75 * whole::double group by scope)""")
        parts.append(_factor(f"fit{s + 1}", f"core{s}", 1.4866))
    placed = _distances("cells c", f"fit{steps}", "c.*").format(on="f.scope = c.scope")
    parts.append(f"near as (select scope, {_TOTALS} from ({placed}) where d2 <= 11.143287 group by scope)")
    parts.append(_factor("fit", "near", 1.0645))
    judged = _distances("(select s.*, c.scope from stats s join chosen c using (lang, source) where not base_failed) c", "fit", "c.r").format(on="f.scope = c.scope")
    return ",\n".join(parts) + f"""
select s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
       coalesce(j.d2 <= 28.4733, false) as kept
from stats s left join ({judged}) j on j.r = s.r
"""
