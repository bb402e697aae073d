"""Registered queries of the training-data operators and, where SQL expresses one, its DuckDB SQL."""

from __future__ import annotations

from fareflow.llm.chat import op8_chat_formatting
from fareflow.llm.collocations import op12_collocations
from fareflow.llm.embeddings import op1_embedding_dedup
from fareflow.llm.license import op7_license_scan
from fareflow.llm.lm_score import op11_lm_scoring
from fareflow.llm.minhash import op4_minhash_dedup
from fareflow.llm.mixing import op6_mixing
from fareflow.llm.packing import op9_best_fit_packing
from fareflow.llm.prefix_trie import op13_prefix_trie
from fareflow.llm.quality import op5_quality_rules
from fareflow.llm.sharding import op10_sharding
from fareflow.llm.substring import op2_substring_dedup
from fareflow.llm.toxicity import op3_toxicity

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings),
s as (select vec_id, e, list_max(list_transform(e, lambda x: abs(x))) m from v
  where vec_id is not null and len(e) > 0 and list_count(e) = len(e) and list_bool_and(list_transform(e, lambda x: isfinite(x)))),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) l from (select vec_id, list_transform(e, lambda x: x / m) e from s where m > 0)),
link as (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and a.l > 0 and b.l > 0 and list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.95),
reach(a, b) as (select vec_id, vec_id from v where vec_id is not null union select r.a, l.b from reach r join link l on r.b = l.a),
comp as (select a vec_id, min(b) component_id from reach group by a)
select v.vec_id, (select count(*) from link where a = v.vec_id)::bigint n_links, component_id,
  coalesce(v.vec_id = component_id, true) kept
from v left join comp using (vec_id)
"""

OP2 = f"""
with w as (select doc_id, {_WORDS} words from documents),
s as (select doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) i from w),
k as (select doc_id, i, array_to_string(words[i:i + 12], ' ') k from s),
m as (select k, min(doc_id) d from k group by k),
gone as (select distinct k.doc_id, k.i + j.j p from k join m on k.k = m.k and m.d < k.doc_id, range(13) j(j)),
e as (select doc_id, unnest(words) x, unnest(range(1, len(words) + 1)) p from w),
kept as (select e.doc_id, count(*) n, string_agg(x, ' ' order by e.p) t from e left join gone g on g.doc_id = e.doc_id and g.p = e.p
  where g.p is null group by e.doc_id)
select w.doc_id, len(words)::bigint n_words, (len(words) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""

OP4 = f"""
with recursive w as (select doc_id, {_WORDS} words from documents),
one as (select words, min(doc_id) rep from w where len(words) > 0 group by words),
s as (select distinct rep, array_to_string(words[i:i + 4], ' ') k from (
  select rep, words, unnest(range(1, greatest(len(words) - 3, 1))) i from one)),
n as (select rep, count(*) n from s group by rep),
pair as (select a.rep a, b.rep b, count(*) shared from s a join s b on a.k = b.k and a.rep < b.rep group by 1, 2),
near as (select a, b from pair join n x on x.rep = a join n y on y.rep = b where shared >= 0.8 * (x.n + y.n - shared)),
link as (select a, b from near union all select b, a from near),
reach(a, b) as (select rep, rep from one union select r.a, l.b from reach r join link l on r.b = l.a),
class as (select a rep, min(b) class_id from reach group by a)
select w.doc_id, len(w.words)::bigint n_words, coalesce(class_id, w.doc_id) class_id, coalesce(class_id, w.doc_id) = w.doc_id kept
from w left join one on one.words = w.words left join class using (rep)
"""

OP8 = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, len(t) + len(role) + 21
  + len(regexp_extract_all(t, '\\|<s>|</s>|\[INST\]|\[/INST\]')) n from t)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) turns_sha256,
  coalesce(sum(len(t)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) loss_sha256,
  sum(n)::bigint formatted_chars
from f group by conv_id
"""

OP12 = r"""
with d as (select coalesce(lang, 'und') lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) piece from d),
pw as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') w from p),
s as (select lang, w, unnest(range(1, len(w) + 1)) i from pw),
g as (select lang, w[i:i + m - 1] ph from s, (select unnest(range(1, 6)) m) ms where i + m - 1 <= len(w)),
f as (select lang, ph, count(*) f from g group by lang, ph),
n as (select lang, sum(len(w)) n from pw group by lang),
c as (select lang, ph, f a from f where len(ph) >= 2 and f >= 100),
k as (select lang, ph, a, unnest(range(1, len(ph))) k from c),
cuts as (select k.lang, k.ph, k.a, k.k, fl.f l, fr.f r from k
  join f fl on fl.lang = k.lang and fl.ph = k.ph[1:k.k] join f fr on fr.lang = k.lang and fr.ph = k.ph[k.k + 1:]),
scored as (select cuts.*, n.n, (1000::hugeint * a * n) // (l::hugeint * r) score from cuts join n using (lang)),
best as (select * from (select *, row_number() over (partition by lang, ph order by score, k) o from scored) where o = 1),
sub as (select lang, a outer_a, ph, unnest(range(2, len(ph))) ln from c where len(ph) >= 3),
subs as (select lang, outer_a, ph[st:st + ln - 1] ph from (select *, unnest(range(1, len(ph) - ln + 2)) st from sub)),
gone as (select distinct c.lang, c.ph from c join subs s on s.lang = c.lang and s.ph = c.ph and s.outer_a >= c.a),
kept as (select b.* from best b where not exists (select 1 from gone g where g.lang = b.lang and g.ph = b.ph)),
ranked as (select lang, array_to_string(ph, ' ') phrase, a, l, r, n, score,
  row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) rank from kept)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from ranked where rank <= 2000
"""

OP13 = """
with recursive
t as (select conv_id c, coalesce(role, '') role, coalesce(text, '') text,
  row_number() over (partition by conv_id order by turn asc nulls first, coalesce(role, ''), coalesce(text, '')) pos
  from conversations where conv_id is not null),
ids as (select distinct c, cast(c as varchar) s from t),
crc(c, s, j, v) as (
  select c, s, 0, 4294967295::bigint from ids
  union all
  select c, s, j + 1, xor(b >> 1, case when (b & 1) = 1 then 3988292384 else 0 end)
  from (select c, s, j, case when j % 8 = 0 then xor(v, ascii(substr(s, j // 8 + 1, 1))) else v end b
        from crc where j < 8 * length(s))),
h as (select c, xor(v, 4294967295) % 9 h from crc where j = 8 * length(s)),
rb as (select h.c, t.pos, t.role, t.text from h join t on t.c = h.c - h.c % 5 and t.pos <= h.h
  union all select t.c, t.pos, t.role, t.text from t join h using (c) where t.pos > h.h),
conv as (select h.c, list(struct_pack(role := x.role, text := x.text) order by x.pos) filter (where x.c is not null) lst
  from h left join rb x using (c) group by h.c),
mem as (select c, coalesce(len(lst), 0) n, unnest(range(0, coalesce(len(lst), 0) + 1)) d, lst from conv),
pre as (select c, n, d, case when d = 0 then null else lst[1:d] end p, case when d = 0 then 0 else strlen(lst[d].text) end b from mem),
nodes as (select p, min(d) depth, min(c) conv_id, count(*) n_convs, min(b) last_bytes,
  sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where d = n), '')) ends_sha256 from pre group by p),
kids as (select c.p, count(*) n_children from nodes c join nodes k on k.depth = c.depth + 1
  and (c.depth = 0 or k.p[1:c.depth] = c.p) group by c.p),
full_ as (select n.*, coalesce(k.n_children, 0) n_children from nodes n left join kids k on k.p is not distinct from n.p),
roll as (select a.p, sum(case when b.n_children = 0 then 1 else 0 end) n_leaves, sum((b.n_convs - 1) * b.last_bytes) saved_tokens
  from full_ a join full_ b on b.depth >= a.depth and (a.depth = 0 or b.p[1:a.depth] = a.p) group by a.p)
select f.conv_id, f.depth::bigint depth, q.conv_id parent_conv_id, f.n_convs::bigint n_convs, f.n_children::bigint n_children,
  r.n_leaves::bigint n_leaves, r.saved_tokens::bigint saved_tokens, f.ends_sha256
from full_ f join roll r on r.p is not distinct from f.p
left join full_ q on f.depth > 0 and q.depth = f.depth - 1 and (q.depth = 0 or q.p = f.p[1:f.depth - 1])
"""

QUERIES = {
    "op1_embedding_dedup": (op1_embedding_dedup, OP1),
    "op2_substring_dedup": (op2_substring_dedup, OP2),
    "op3_toxicity": (op3_toxicity, None),
    "op4_minhash_dedup": (op4_minhash_dedup, OP4),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_mixing": (op6_mixing, None),
    "op7_license_scan": (op7_license_scan, None),
    "op8_chat_formatting": (op8_chat_formatting, OP8),
    "op9_best_fit_packing": (op9_best_fit_packing, None),
    "op10_sharding": (op10_sharding, None),
    "op11_lm_scoring": (op11_lm_scoring, None),
    "op12_collocations": (op12_collocations, OP12),
    "op13_prefix_trie": (op13_prefix_trie, OP13),
}
