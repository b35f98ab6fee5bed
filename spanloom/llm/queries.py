"""One registered query per operator, over the driver's whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    backoff, bit_planes, classifier_chain, compact_windows, fm_index, packing, phrase_tries, preferences, prefix_trie,
    rare_features, robust_rules, robust_sql, simhash, zstd_language,
)
from .common import checkpoint_dir, ready, table, written

QUERIES = {}
ORACLES = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ready(spark), sf_dir)

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_preferences(spark, sf_dir):
    """Masks as text ("12-" not trained, "40+" trained) so that they compare as values."""
    made = preferences.format_preferences(
        preferences.continued_pairs(table(spark, sf_dir, "conversations")), ["conv_id"])

    def runs(mask):
        return F.array_join(
            F.transform(mask, lambda m: F.concat(m["chars"].cast("string"), F.when(m["trained"], "+").otherwise("-"))), " ")

    return made.withColumns({c: runs(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


ORACLES["op1_preferences"] = """
with whole as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role nulls first, text nulls first) as c
  from conversations where conv_id is not null group by conv_id
), pairs as (
  select a.conv_id, a.c, list_concat(a.c[1:len(a.c) // 2], coalesce(b.c[len(a.c) // 2 + 1:], [])) as r
  from whole a left join whole b on b.conv_id = a.conv_id + 1
), cut as (
  select *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] is distinct from r[i])) - 1,
                     least(len(c), len(r))) as n from pairs
), parts as (select conv_id, n, c[1:n] as p, c[n + 1:] as c, r[n + 1:] as r from cut)
select conv_id, n::bigint as n_shared,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '') as prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '') as chosen_completion,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '') as rejected_completion,
  coalesce(array_to_string(list_transform(c, lambda t: (length(coalesce(t.role, '')) + 5) || '- ' || (length(coalesce(t.text, '')) + 8) || if(t.role = 'assistant', '+', '-')), ' '), '') as chosen_mask,
  coalesce(array_to_string(list_transform(r, lambda t: (length(coalesce(t.role, '')) + 5) || '- ' || (length(coalesce(t.text, '')) + 8) || if(t.role = 'assistant', '+', '-')), ' '), '') as rejected_mask
from parts
"""


@query
def op2_bit_planes(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/planes-{uuid.uuid4().hex}"
    bit_planes.write_planes(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return bit_planes.read_planes(spark, path)


@query
def op3_fm_index(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_index.report(
        fm_index.find_phrases(documents, table(spark, sf_dir, "benchmark"), columns=["doc_id"]))


ORACLES["op3_fm_index"] = r"""
with split as (
  select 'd' as kind, doc_id as id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), sized as (select distinct least(len(w), 10) as n from split where kind = 'b' and len(w) > 0),
phrases as (
  select distinct id as item_id, n, array_to_string(w[k:k + n - 1], ' ') as phrase
  from (select id, w, least(len(w), 10) as n from split where kind = 'b' and len(w) > 0) b,
       unnest(range(1, len(w) - n + 2)) as t(k)
), windows as (
  select id as doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as phrase
  from (select id, w, n from split, sized where kind = 'd' and len(w) >= n) d, unnest(range(1, len(w) - n + 2)) as t(k)
), met as (select w.doc_id, w.k, w.n, p.item_id from windows w join phrases p using (n, phrase)),
hits as (select doc_id, count(distinct j) as n_hit from met, unnest(range(k, k + n)) as t(j) group by doc_id),
items as (
  select doc_id, count(distinct item_id) as n_items,
         string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as listed
  from met group by doc_id
)
select d.id as doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit,
       coalesce(i.n_items, 0)::bigint as n_items, sha256(coalesce(i.listed, '')) as items_sha256,
       coalesce(h.n_hit, 0) > 0 as contaminated
from split d left join hits h on h.doc_id = d.id left join items i on i.doc_id = d.id where d.kind = 'd'
""".replace("\\\\", "\\")


@query
def op4_compact_windows(spark, sf_dir):
    return compact_windows.report(table(spark, sf_dir, "documents"))


@query
def op5_rare_features(spark, sf_dir):
    return rare_features.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op6_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query
def op7_zstd_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    made = zstd_language.train(documents.where(fold != 1))
    found = zstd_language.identify(documents, made)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_classifier_chain(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    categories = ["quality", "toxic"]
    chain = classifier_chain.train(documents, table(spark, sf_dir, "labels"), categories)
    return classifier_chain.score(documents, chain, categories).select(
        "doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query
def op9_backoff(spark, sf_dir):
    return backoff.score_documents(table(spark, sf_dir, "documents"))


ORACLES["op9_backoff"] = r"""
with split as (
  select doc_id, row_number() over () as r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), one as (select doc_id, r, i, w[i] as c, if(i > 1, w[i - 1], null) as b, if(i > 2, w[i - 2], null) as a
           from split, unnest(range(1, len(w) + 1)) as t(i)),
c1 as (select c, count(*) as n from one group by c),
c2 as (select b, c, count(*) as n from one where b is not null group by b, c),
c3 as (select a, b, c, count(*) as n from one where a is not null group by a, b, c),
total as (select count(*) as n from one),
scored as (
  select o.r, round(1000000 * case
      when c3.n >= 2 then ln(c3.n / ab.n::double)
      when c2.n >= 2 then ln(c2.n / b.n::double) + ln(0.4)
      else ln(c1.n / total.n::double) + 2 * ln(0.4) end)::bigint as s
  from one o cross join total join c1 on c1.c = o.c
  left join c1 b on b.c = o.b left join c2 on c2.b = o.b and c2.c = o.c
  left join c2 ab on ab.b = o.a and ab.c = o.b
  left join c3 on c3.a = o.a and c3.b = o.b and c3.c = o.c
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(sum(s.s), 0)::bigint as micro_score
from split d left join scored s on s.r = d.r group by d.r, d.doc_id, d.w
""".replace("\\\\", "\\")


@query
def op10_packing(spark, sf_dir):
    placed = packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)
    return placed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op11_phrase_tries(spark, sf_dir):
    return phrase_tries.mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op11_phrase_tries"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as a
  from split, unnest(range(1, 5)) as t(k), unnest(range(1, len(w) - k + 2)) as u(i) group by all
), found as (select lang, k, phrase, string_split(phrase, ' ') as w, a from grams where k > 1 and a >= 30),
cuts as (
  select f.lang, f.phrase, f.a, c, l.a as l, r.a as r, (2000000::hugeint * f.a // (l.a + r.a))::bigint as score
  from found f, unnest(range(1, f.k)) as t(c)
  join grams l on l.lang = f.lang and l.phrase = array_to_string(f.w[1:c], ' ')
  join grams r on r.lang = f.lang and r.phrase = array_to_string(f.w[c + 1:], ' ')
), weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (
  select lang, array_to_string(w[i:i + n - 1], ' ') as phrase, max(a) as longer
  from found, unnest(range(2, k)) as t(n), unnest(range(1, k - n + 2)) as u(i) group by all
), kept as (
  select w.* from weakest w left join inside i on i.lang = w.lang and i.phrase = w.phrase
  where i.longer is null or 100 * i.longer < 80 * w.a
), totals as (select lang, sum(a)::bigint as n from grams where k = 1 group by lang)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang)
where rank <= 2000
"""


@query
def op12_prefix_trie(spark, sf_dir):
    turns = written(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")), "numbered")
    conv = F.col("conv_id")
    ids, rows = prefix_trie.with_shared_heads(
        turns, base=conv - conv % 100, head=F.crc32(conv.cast("string")) % 6, most=5)
    return prefix_trie.prefix_trie(ids, rows)


ORACLES["op12_prefix_trie"] = """
with ordered as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, role, text) as own
  from conversations where conv_id is not null group by conv_id
), headed as (
  select conv_id, own, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint),
    lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)),
    4294967295::bigint)) % 6 as h
  from ordered
), rebuilt as (
  select c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) as seq
  from headed c left join ordered b on b.conv_id = c.conv_id - c.conv_id % 100
), prefixes as (
  select conv_id, len(seq) as n, d, seq[1:d] as node from rebuilt, unnest(range(len(seq) + 1)) as t(d)
), nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs, max(n) = d as leaf,
         (count(*) - 1) * coalesce(length(node[d].text), 0) as own_saving,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '') as ends
  from prefixes group by node, d
), above as (
  select node[1:a] as node, sum(own_saving) as saved, count(*) filter (leaf) as leaves, count(*) filter (a = d - 1) as children
  from nodes, unnest(range(d + 1)) as t(a) group by 1
)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, a.children as n_children,
       a.leaves as n_leaves, a.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join above a on a.node = n.node left join nodes p on n.d > 0 and p.node = n.node[1:n.d - 1]
"""


@query
def op13_robust_outliers(spark, sf_dir):
    return robust_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("d2")


ORACLES["op13_robust_outliers"] = robust_sql.outlier_sql()
