"""The SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from pullwise.llm.host_quality import RULES
from pullwise.llm.mixing import RAMPS

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _prior(rule: str) -> str:
    """alpha and beta of a rule, as in ``host_quality.prior``."""
    mean = f"least(greatest(sum(f_{rule}) / sum(n), 1e-6), 1 - 1e-6)"
    true = f"(sum(f_{rule} * f_{rule} / n) / sum(n) - {mean} * {mean}) - {mean} * (1 - {mean}) * count(*) / sum(n)"
    k = f"case when {true} <= 0 then 1e4 else least(greatest({mean} * (1 - {mean}) / ({true}) - 1, 2.0), 1e4) end"
    return f"{mean} * ({k}) as a_{rule}, (1 - {mean}) * ({k}) as b_{rule}"


HOST_QUALITY = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t, {WORDS} as w from documents),
g as (select r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
p as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by r, g) as c from g) where c > 1) group by 1),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as x, len(string_split(t, chr(10))) as n_lines from d),
s as (select d.r, doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(x) - len(list_distinct(x)))::bigint as n_dup_lines,
 n_lines, coalesce(p.n, 0)::bigint as n_repeat_words from d join l using (r) left join p using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
f as (select *, (n_words < 50)::int as f_short, (100 * n_repeat_words > 50 * n_words)::int as f_repeats, (10 * n_symbols > n_words)::int as f_symbols,
 (10 * n_dup_lines > 3 * n_lines)::int as f_dup_lines, (word_chars < 3 * n_words or word_chars > 12 * n_words or n_words = 0)::int as f_word_length from b),
h as (select source, count(*)::double as n, {', '.join(f'sum(f_{r})::double as f_{r}' for r in RULES)} from f group by 1),
o as (select {', '.join(_prior(r) for r in RULES)} from h),
v as (select source, greatest({', '.join(f'(f_{r} + a_{r}) / (n + a_{r} + b_{r})' for r in RULES)}) > 0.75 as host_rejected from h, o)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected, not base_failed and not host_rejected as kept
from b join v on b.source is not distinct from v.source"""

MIXING = rf"""
with d as (select doc_id, len({WORDS})::bigint as size, coalesce('+' || source, '-') as k, md5(coalesce(cast(doc_id as varchar), '')) as o from documents),
s as (select k, sum(size)::bigint as source_size, row_number() over (order by case when k = '-' then 1 else 0 end, k) - 1 as i from d group by 1),
c as (select *, i % 3 as kind, [5.0, 2.0, 1.0][i % 3 + 1]::double as weight, 2.0 * source_size::double as cap from s),
l as (select cap / weight as until, (1.5 * (select sum(source_size) from c)::double - coalesce(sum(cap) over o, 0.0))
 / ((select sum(weight) from c) - coalesce(sum(weight) over o, 0.0)) as level from c
 window o as (order by cap / weight, k rows between unbounded preceding and 1 preceding)),
t as (select k, kind, source_size, least(cap, weight * (select min_by(level, until) from l where level <= until)) as target from c),
a as (select d.doc_id, size, source_size, target, kind, round(target)::bigint as goal,
 coalesce(sum(size) over (partition by d.k order by o, d.doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as p from d join t using (k)),
w as (select *, case when 2 * p + size <= 2 * goal then size else 0 end as t0, case when 2 * (p + source_size) + size <= 2 * goal then size else 0 end as t1,
 {[float(a) for a, _ in RAMPS]}[kind + 1]::double as a, {[float(b) for _, b in RAMPS]}[kind + 1]::double as b,
 case when target > 0 then least((case when size > 0 and 2 * p + size <= 2 * goal then p else p + source_size end) / target, 1.0) else 0.0 end as u from a)
select doc_id, size, source_size, target, (t0 + t1)::bigint as taken, case when t0 + t1 = 0 then null when abs(b - a) < 1e-12 then u
 else (sqrt(greatest(a * a + (b * b - a * a) * u, 0.0)) - a) / (b - a) end as first_position from w"""

JACCARD = rf"""
with recursive d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct r, doc_id, array_to_string(w[i:i + 4], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select r, count(*) as n from g group by 1),
e as (select a.r as a, b.r as b, count(*) as n_both from g a join g b using (g) where a.r <> b.r group by 1, 2),
k as (select e.a, e.b from e join n x on x.r = e.a join n y on y.r = e.b where 100 * n_both >= 80 * (x.n + y.n - n_both)),
c as (select a, b from k union select c.a, k.b from c join k on k.a = c.b),
m as (select c.a as r, min(d.doc_id) as least from c join d on d.r = c.b group by 1)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(least(m.least, doc_id), doc_id) as component_id from d left join n using (r) left join m using (r)"""

LINE_DEDUP = rf"""
with d as (select doc_id, text, lang, source, n_chars, string_split(text, chr(10)) as x from documents),
l as (select doc_id, i, x[i] as line, len(list_filter(regexp_split_to_array(x[i], '[\x20\x09-\x0D]+'), lambda w: w <> '')) as n
 from (select *, unnest(range(1, len(x) + 1)) as i from d where text is not null)),
e as (select *, sum(n) over (partition by doc_id order by i)::bigint as e from l where n > 0),
a as (select doc_id, min(i) over w as f, max(i) over w as t, sum(n) over w as n, list(line) over w as c from (select *, e - n as b from e)
 window w as (partition by doc_id order by b range between current row and 49 following)
 union all select doc_id, min(i) over w, max(i) over w, sum(n) over w, list(line) over w from e
 window w as (partition by doc_id order by e range between 49 preceding and current row)),
m as (select c, min((doc_id, f)) as first from a where n >= 50 group by 1),
z as (select distinct doc_id, unnest(range(f, t + 1)) as i from a join m using (c) where a.n >= 50 and (doc_id, f) > first),
k as (select doc_id, list(line order by i) as x from (select doc_id, i, x[i] as line from (select *, unnest(range(1, len(x) + 1)) as i from d)) anti join z using (doc_id, i) group by 1)
select d.doc_id, case when z.doc_id is null then text else coalesce(array_to_string(k.x, chr(10)), '') end as text, lang, source,
 case when z.doc_id is null then n_chars else length(coalesce(array_to_string(k.x, chr(10)), '')) end::bigint as n_chars
from d left join (select distinct doc_id from z) z using (doc_id) left join k using (doc_id)"""

COLLOCATIONS = rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, k, w[i:i + k - 1] as g from (select *, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest([1, 2, 3]) as k from w))),
f as (select lang, k, g, count(*) as f from g group by all),
t as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
c as (select lang, g, f as a, k as words, unnest(range(1, k)) as k from f where k > 1 and f >= 10),
s as (select c.*, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
 from c join f x on x.lang = c.lang and x.g = c.g[:c.k] join f y on y.lang = c.lang and y.g = c.g[c.k + 1:]),
h as (select lang, g, max(f) as longer from (select lang, f, unnest([g[1:2], g[2:3]]) as g from f where k = 3 and f >= 10) group by 1, 2),
z as (select s.lang, s.g, s.a, min((s.score, s.k, s.l, s.r)) as x from s left join h on h.lang = s.lang and h.g = s.g
 where longer is null or 100 * longer < 50 * s.a group by 1, 2, 3),
o as (select lang, array_to_string(g, ' ') as phrase, a, x[3]::bigint as l, x[4]::bigint as r, x[1]::bigint as score from z),
q as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o)
select lang, rank, phrase, a, l, r, n, score from q join t using (lang) where rank <= 2000"""

HARD_NEGATIVES = r"""
with e as (select row_number() over () as r, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
 list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where vec_id is not null and label is not null and embedding is not null
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
 from e a join e b on a.r <> b.r where a.vec_id % 50 = 0),
p as (select * from (select *, row_number() over (partition by r order by score desc, vec_id) as i from s where same) where i <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
 row_number() over (partition by p.r, p.i order by s.score desc, s.vec_id) as rank from p join s on p.r = s.r and not s.same
 and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""

SQL = {"op2_line_dedup": LINE_DEDUP, "op5_source_mixing": MIXING, "op7_jaccard_join": JACCARD, "op9_host_quality": HOST_QUALITY,
       "op11_hard_negatives": HARD_NEGATIVES, "op12_collocations": COLLOCATIONS}
